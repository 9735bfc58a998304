"""Session helpers shared by the operators: staging tables, shipping code, sampling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[object, str]] = []
_shipped: set[str] = set()
#: What empties an operator's tables in a Python worker, by operator; the operator whose task ran last.
_tables: dict[str, Callable[[], object]] = {}
_last: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only in a local session without
    that setting, as in tests, a temporary folder is made and set; on a cluster
    each executor would have its own, so there the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    ``batch``: rows in an Arrow batch meanwhile, fewer where rows are long.

    This cuts the lineage: a lost executor costs only the tasks that were
    running, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}-{label}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        if batch:
            spark.conf.set(key, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, usual)
    if not _staged:
        atexit.register(_clean)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone by now
            return


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella_llm_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        out.write(os.path.join(top, "__init__.py"), "tessella/__init__.py")
        here = os.path.join(top, "llm")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                out.write(os.path.join(here, name), f"tessella/llm/{name}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def keeps(operator: str, forget: Callable[[], object]) -> None:
    """Says how to empty the tables that an operator's tasks leave to those after them in a Python worker."""
    _tables[operator] = forget


def give_back() -> None:
    """Memory that was freed goes back to the system; Arrow and the C library would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def lean(operator: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches. Freed memory goes back after each; before the first, so do the tables of other operators.

    Spark's Python workers serve the tasks of all stages. Without this each holds the most that any of them took.
    """
    if _last != [operator]:
        for other in _tables.keys() - {operator}:
            _tables[other]()
        _last[:] = [operator]
        gc.collect()
        give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_share(column: str, share: float, seed: int = 17) -> Column:
    """True for about ``share`` of the values of ``column``; equal values fall together."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, seed: int = 17) -> tuple[list, dict]:
    """Rows (doc_id, text, y) of about ``per_class`` labelled documents of each class, and all labels' counts.

    The bound is the documented parameter of the callers: the sample is drawn by
    a hash of doc_id, so it is the same on every run and its size doesn't grow
    with the corpus. Only ids that pass ``usable`` can be drawn. Contradicting
    or null labels are left out. The ids (about ``2 * per_class``, and at most
    ``4 * per_class``) are broadcast, the documents are scanned once. Of rows with
    the same doc_id the one with the least text is drawn.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_hi")).where("y = _hi")
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = F.lit(False)
    for y, n in counts.items():
        drawn = drawn | ((F.col("y") == y) & hash_share("doc_id", per_class / max(n, 1), seed))
    ids = known.where(drawn).select("doc_id", "y").limit(4 * per_class)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return rows, counts
