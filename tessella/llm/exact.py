"""Operator 4, exact deduplication by two-pass Bloom filtering.

Pass 1 puts the SHA-256 of each normalised text into a segmented counting Bloom
filter whose cells saturate at two. Pass 2 asks the filter for each row: a text
that occurs twice has all its cells at two, so only rows of possibly repeated
texts shuffle; the rest pass straight through. The shuffled rows are grouped by
the whole digest, so the filter's false positives cost work, never results.

The filter is cut into segments of 2**16 cells, each hash belongs to one
segment, and ``SEGMENTS`` segments (32 MB) at most are broadcast at a time. The
digests of a larger corpus are laid by segment, so that each slice of the
segments reads its own part of them, and all slices together read them once.

Whole rows are read once too, whatever the number of slices: what the groups
decide about (digest, doc_id) pairs goes into a second filter of at most SEGMENTS
segments, and only rows that hit it are joined with the decisions. With more
decisions than the filter was made for, more rows hit it; none is lost.

Defined cases: null text counts as empty; a null doc_id sorts after all others;
of repeated rows with equal doc_id and text one row stays; a text of any length
is hashed whole; an empty table gives an empty result; columns beside doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, ship, staged

CELLS = 1 << 16
PROBES = 4
#: Documents that a segment is made for: 16 cells a document, 0.2 % false positives.
SEGMENT_DOCS = 4096
#: Segments of 8 KB that are broadcast at a time: 32 MB.
SEGMENTS = 4096
#: A text that makes up more than this share of all rows is a hot group; so there are fewer than 1 / HOT of them.
HOT = 1e-3


def digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space replaced by one space."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _segment(segments: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(segments)).cast("int")


def _cells(*key: str) -> Column:
    """Sixty-four bits that name the PROBES cells of a key."""
    return F.xxhash64(*key, F.lit(1))


def _probe(k: int) -> Column:
    """True if the k-th cell of the row is set in its segment's bits."""
    cell = F.expr(f"cast(shiftrightunsigned(_cells, {16 * k}) & 65535 as int)")
    word = F.element_at("_bits", F.shiftright(cell, 6) + 1)
    return F.expr("1") == F.call_function("shiftright", word, cell.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows (_segment, _cells): for each segment the cells set once and more often."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        segment = batch.column(0).to_numpy(zero_copy_only=False)
        cells = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint16).reshape(-1, PROBES)
        order = np.argsort(segment, kind="stable")
        keys, begin = np.unique(segment[order], return_index=True)
        for key, rows in zip(keys.tolist(), np.split(order, begin[1:]), strict=True):
            counts = seen.setdefault(key, [np.zeros(0, np.uint16), np.zeros(0, np.uint16)])
            values, times = np.unique(cells[rows].ravel(), return_counts=True)
            both = np.intersect1d(values, np.union1d(*counts), assume_unique=True)
            counts[1] = np.union1d(counts[1], np.union1d(values[times > 1], both)).astype(np.uint16)
            counts[0] = np.union1d(counts[0], values).astype(np.uint16)
    if seen:
        yield pa.RecordBatch.from_pydict({
            "_segment": pa.array(list(seen), pa.int32()),
            "once": pa.array([x.tobytes() for x, _ in seen.values()], pa.binary()),
            "more": pa.array([x.tobytes() for _, x in seen.values()], pa.binary()),
        })


def _merge(least: int):
    """Adds up one segment's partial counts; a bit for each cell that is at ``least`` or more."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int32)
        for batch in batches:
            for name in ("once", "more"):
                for cells in batch.column(name):
                    count[np.frombuffer(cells.as_buffer(), np.uint16)] += 1
        bits = np.packbits(count >= least, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_pydict({"_segment": pa.array([key[0].as_py()], pa.int32()), "_bits": pa.array([bits], pa.list_(pa.int64()))})

    return run


def key_filter(rows: DataFrame, key: tuple[str, ...], segments: int, least: int) -> DataFrame:
    """Pass 1: a staged table (_segment, _bits) of the cells that ``least`` rows or more set."""
    ship(rows.sparkSession)
    counted = rows.select(_segment(segments, *key).alias("_segment"), _cells(*key).alias("_cells")).mapInArrow(_count, "_segment int, once binary, more binary")
    return staged(counted.groupBy("_segment").applyInArrow(_merge(least), "_segment int, _bits array<bigint>"), "bloom")


def _hits(rows: DataFrame, bits: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Pass 2 against broadcast segments: adds the boolean _maybe to rows that have _segment. No row moves."""
    found = rows.withColumn("_cells", _cells(*key)).join(F.broadcast(bits), "_segment", "left")
    yes = F.col("_bits").isNotNull()
    for k in range(PROBES):
        yes = yes & _probe(k)
    return found.withColumn("_maybe", F.coalesce(yes, F.lit(False))).drop("_segment", "_cells", "_bits")


def segments_for(rows: int) -> int:
    return max(1, -(-rows // SEGMENT_DOCS))


def marked_digests(docs: DataFrame) -> tuple[DataFrame, int]:
    """Staged rows (doc_id, _sha, _row, _maybe) and how many there are; _row numbers them."""
    n = docs.count()
    segments = segments_for(n)
    prints = docs.select("doc_id", digest().alias("_sha")).withColumns({"_row": F.monotonically_increasing_id(), "_segment": _segment(segments, "_sha")})
    if segments > SEGMENTS:
        prints = prints.repartitionByRange("_segment").sortWithinPartitions("_segment")
    prints = staged(prints, "digests")
    bits = key_filter(prints, ("_sha",), segments, 2)
    out = None
    for first in range(0, segments, SEGMENTS):
        inside = F.col("_segment").between(first, first + SEGMENTS - 1)
        part = _hits(prints.where(inside) if segments > SEGMENTS else prints, bits.where(inside), ("_sha",))
        out = part if out is None else out.union(part)
    return staged(out, "marked"), n


def _grouped(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows with the columns _first and _size of their digest's group. Hot groups are few, so they are broadcast."""
    hot = groups.where(F.col("_size") > max(1, int(n * HOT)))
    tried = rows.join(F.broadcast(hot.withColumnsRenamed({"_first": "_hot_first", "_size": "_hot_size"})), "_sha", "left")
    names = [F.col(c) for c in rows.columns]
    warm = tried.where("_hot_size is not null").select(*names, F.col("_hot_first").alias("_first"), F.col("_hot_size").alias("_size"))
    cold = tried.where("_hot_size is null").drop("_hot_first", "_hot_size").join(groups, "_sha").select(*names, "_first", "_size")
    return warm.union(cold)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marked, n = marked_digests(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = marked.where("_maybe").groupBy("_sha").agg(F.min(rank).alias("_first"), F.count("*").alias("_size"))
    groups = staged(groups, "groups")
    single = marked.where("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    )
    told = _grouped(marked.where("_maybe").drop("_maybe"), groups, n)
    told = told.select("doc_id", F.col("_first")["id"].alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_first")["row"] == F.col("_row")).alias("kept"), "_sha")
    return single.union(told).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def decisions(docs: DataFrame) -> DataFrame:
    """Staged (_sha, _id, _stay): the pairs of digest and doc_id whose rows go, and those of which one of many rows stays."""
    marked, n = marked_digests(docs)
    pairs = staged(marked.where("_maybe").groupBy("_sha", F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows")), "pairs")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    groups = staged(pairs.groupBy("_sha").agg(F.min(rank).alias("_first"), F.sum("_rows").alias("_size")), "groups")
    told = _grouped(pairs, groups, n).withColumn("_stay", F.col("_first")["id"].eqNullSafe(F.col("_id")))
    return staged(told.where("not _stay or _rows > 1").select("_sha", "_id", "_stay"), "decisions")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Rows that hit no decision pass without a shuffle; the others move with the
    key (digest, doc_id), which no single text can make hot.
    """
    told = decisions(docs)
    key, segments = ("_sha", "_id"), min(SEGMENTS, segments_for(told.count()))
    bits = key_filter(told, key, segments, 1)
    wide = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), digest().alias("_sha"))
    found = _hits(wide.withColumn("_segment", _segment(segments, *key)), bits, key)
    tried = found.where("_maybe")
    same = lambda some: (tried["_sha"] == some["_sha"]) & tried["_id"].eqNullSafe(some["_id"])
    out = found.where("not _maybe").select("_doc.*").union(tried.join(told, same(told), "left_anti").select("_doc.*"))
    many = told.where("_stay")
    if many.isEmpty():
        return out
    return out.union(tried.join(many, same(many), "left_semi").dropDuplicates(["_sha", "_id"]).select("_doc.*"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
