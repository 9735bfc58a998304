"""Operator 1, language identification: multinomial naive Bayes over hashed character n-grams.

The model learns every value of ``lang``, each from a bounded, hash-drawn sample
(about ``per_class`` documents). The sample's n-grams are counted where the texts
are, so the driver gets a vector of counts for each language and no text. The
log-probability matrix (2**16 buckets x languages, float32) is broadcast: 256 KB
for each language. Scoring is sparse: each n-gram of a batch picks a row of the
matrix, and the picked rows are summed by document in numpy. Every document's
whole text is scored, however long.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; of
languages with the same posterior the first by name is predicted; repeated rows
are predicted alike, and learned from as often as they occur; a null doc_id isn't
learned from and counts as not held out; without any learnable document all
documents are ``und``; an empty table gives an empty result; columns beside
doc_id and text (and lang, to learn) aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textops as tx
from tessella.llm.common import id_crc, lean, ship

BITS = 16
ORDERS = (1, 2, 3)
PER_CLASS = 2000
#: Texts of a batch that are Python strings at a time.
ROWS = 1000
UNKNOWN = "und"


def held_out() -> Column:
    return F.coalesce(id_crc() % 4 == 2, F.lit(False))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets, documents, and which n-grams count (single blanks and those of two documents don't)."""
    codes, doc = tx.letter_stream(texts)
    for n in ORDERS:
        buckets = tx.ngrams(codes, n, BITS)
        at = doc[min(1, n - 1) : len(doc) - max(0, n - 2)][: len(buckets)]
        counts = codes[: len(buckets)] != 0 if n == 1 else doc[n - 1 :] == at
        yield buckets, at, counts


def tally(texts: list[str]) -> np.ndarray:
    """How often each bucket's n-grams occur."""
    out = np.zeros(1 << BITS, np.int64)
    for a, b in tx.text_runs(texts):
        for buckets, _, ok in _grams(texts[a:b]):
            out += np.bincount(buckets[ok], minlength=1 << BITS)
    return out


def log_probabilities(tallies: dict[str, np.ndarray], smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [bucket, language]."""
    names = sorted(tallies)
    counts = np.stack([tallies[n] for n in names], axis=1) + smooth if names else np.zeros((1 << BITS, 0))
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows (text, lang): the counts of each language, those of buckets that occur."""
    seen: dict[str, np.ndarray] = {}
    for batch in lean("langid", batches):
        texts = defaultdict(list)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, own in texts.items():
            seen[lang] = seen.get(lang, 0) + tally(own)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": [lang], "at": [at.astype(np.uint16).tobytes()], "n": [n[at].tobytes()]})


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "at": [at.astype(np.uint16).tobytes()], "n": [total[at].tobytes()]})


def score(texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total, letters = np.zeros((len(texts), len(names))), np.zeros(len(texts), np.int64)
    for a, b in tx.text_runs(texts):
        for n, (buckets, at, ok) in zip(ORDERS, _grams(texts[a:b]), strict=True):
            starts = tx.group_starts(at, b - a)
            buckets = np.where(ok, buckets, 1 << BITS)
            if n == 1:
                letters[a:b] += tx.segment_sum(ok.astype(np.int64), starts)
            for k in range(len(names)):
                total[a:b, k] += tx.segment_sum(np.append(matrix[:, k], np.float32(0))[buckets], starts)
    best = total.argmax(axis=1)
    with np.errstate(under="ignore"):
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[i] if n else UNKNOWN for i, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, p, 0.0)


def train(docs: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray]:
    """The model, from about ``per_class`` documents of each language, none of them held out."""
    ship(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    drawn = usable.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.lit(float(per_class) * (1 << 30)) / F.col("_n"))
    kind = "lang string, at binary, n binary"
    rows = drawn.select("text", "lang").mapInArrow(_tallies, kind).groupBy("lang").applyInArrow(_added, kind)
    tallies = {}
    for r in rows.toLocalIterator():
        tallies[r["lang"]] = np.zeros(1 << BITS, np.int64)
        tallies[r["lang"]][np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.int64)
    return log_probabilities(tallies)


def _judged(column: pa.Array, names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text of a batch."""
    lang, p = [], [np.zeros(0)]
    for at in range(0, len(column), ROWS):
        some, posterior = score(["" if t is None else t for t in column.slice(at, ROWS).to_pylist()], names, matrix)
        lang += some
        p.append(posterior)
    return lang, np.concatenate(p)


def _scorer(model, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        for batch in lean("langid", batches):
            lang, p = _judged(batch.column("text"), names, matrix)
            if kind == "report":
                out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(p, pa.float64())}
                yield pa.RecordBatch.from_pydict(out)
            else:
                yield batch.filter(pa.array([x != UNKNOWN and s >= 0.5 for x, s in zip(lang, p.tolist(), strict=True)], pa.bool_()))

    return run


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, per_class))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model, "report"), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents in a known language: not ``und``, and with a posterior of one half or more."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, per_class))
    return docs.mapInArrow(_scorer(model, "filter"), docs.schema)
