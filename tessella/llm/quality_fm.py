"""Operator 9, quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words (hashed, weight = share of the words), a
dozen structure statistics of the text and its recorded length, each cut into
bins. The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairs
are scored in linear time, as half the sum over factors of
(sum v_i x_i)**2 - sum (v_i x_i)**2. Weights are trained in numpy by Adagrad.

It learns from about ``per_class`` labelled documents of each class, drawn by a
hash; ids whose crc32 modulo 4 is 2 are never learned from. labels, lang, source
and doc_id are no inputs. Every whole text is scored.

Defined cases: null text counts as empty and is scored from its statistics; a
text of any length is scored whole; a null n_chars has a bin of its own;
contradicting or null labels are left out; a doc_id that occurs several times is
learned from once, by its least row; repeated rows are scored alike; a score of
exactly THRESHOLD is predicted 1; without labels of both classes every score is
0; a null doc_id counts as not held out and isn't learned from; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textops as tx
from tessella.llm.common import hash_share, id_crc, ship

BITS = 16
FACTORS = 8
PER_CLASS = 3000
EPOCHS = 12
BATCH = 64
RATE = 0.08
BINS = 16
THRESHOLD = 0.7
STATS = ("words", "word_size", "symbols", "upper", "digits", "other", "high_bytes", "distinct", "same_as_before", "repeated_windows", "dup_lines", "line_size", "symbol_ends", "recorded")
WIDTH = (1 << BITS) + BINS * len(STATS)


def held_out() -> Column:
    return F.coalesce(id_crc() % 4 == 2, F.lit(False))


#: Classes of ASCII bytes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 other punctuation, 6 above ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_KIND[[ord(x) for x in "#*$%&|<>"]] = 4


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bin of the share a / b: finer near 0."""
    return np.clip(np.sqrt(a / np.maximum(b, 1)) * (BINS - 1), 0, BINS - 1).astype(np.int64)


def _log(a: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(a, 0) + 1), 0, BINS - 1).astype(np.int64)


def _repeats(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: how many keys are equal to another one of the same document, less one for each value."""
    both = np.unique((doc.astype(np.uint64) << np.uint64(54)) | (key >> np.uint64(10)))
    return np.bincount(doc, minlength=n) - np.bincount((both >> np.uint64(54)).astype(np.int64), minlength=n)


def features(column: pa.Array, recorded: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of documents: first, last, row starts, feature numbers and values."""
    for first, last, data, offsets in tx.chunks(column):
        n = last - first
        low = tx.LOWER[data]
        start, end, doc = tx.words(data, offsets)
        hashes = tx.span_hash(low, start, end)
        count = np.bincount(doc, minlength=n)
        size = np.diff(offsets)
        kinds = [tx.segment_sum((_KIND[data] == k).astype(np.int64), offsets) for k in range(7)]
        chars = np.maximum(1, size)
        same = np.zeros(len(doc), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        window, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(hashes) >= 8:
            window = tx.mix(sum(hashes[k : len(hashes) - 7 + k] * np.uint64(2 * k + 3) for k in range(8)))
            inside = doc[7:] == doc[:-7]
            window, at = window[inside], doc[:-7][inside]
        line_data = np.where(data == 10, np.uint8(32), np.where(tx.SPACE[data], np.uint8(160), data))
        ls, le, ld = tx.words(line_data, offsets)
        lines = tx.span_hash(line_data, ls, le)
        tail = np.bincount(doc, (_KIND[data[end - 1]] >= 4) & (_KIND[data[end - 1]] < 6) & (data[end - 1] != 46) & (data[end - 1] != 44), minlength=n) if len(doc) else np.zeros(n)
        inner = np.bincount(doc, end - start, minlength=n) if len(doc) else np.zeros(n)
        line_count = np.bincount(ld, minlength=n)
        bins = [
            _log(count), np.clip(inner / np.maximum(1, count), 0, BINS - 1).astype(np.int64),
            _share(kinds[4], chars), _share(kinds[1], chars), _share(kinds[3], chars), _share(kinds[5], chars), _share(kinds[6], chars),
            _share(count - _repeats(hashes, doc, n), count), _share(np.bincount(doc, same, minlength=n), count),
            _share(_repeats(window, at, n), count), _share(_repeats(lines, ld, n), line_count), _log(size / np.maximum(1, line_count)),
            _share(tail, count), np.where(recorded[first:last] < 0, BINS - 1, np.minimum(_log(recorded[first:last]), BINS - 2)),
        ]
        stats = np.stack(bins, axis=1) + (1 << BITS) + BINS * np.arange(len(STATS))
        key, times = np.unique((doc << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        row = key >> BITS
        rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(rows, kind="stable")
        numbers = np.concatenate([key & ((1 << BITS) - 1), stats.ravel()])[order]
        values = np.concatenate([times / count[row], np.ones(stats.size)])[order].astype(np.float32)
        yield first, last, np.searchsorted(rows[order], np.arange(n + 1)), numbers, values


def raw_score(model: tuple, starts: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for each row, and the factor sums."""
    w0, w, v = model
    vx = v[numbers] * values[:, None]
    sums = np.add.reduceat(vx, starts[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts[:-1])
    return w0 + np.add.reduceat(w[numbers] * values, starts[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def train(column: pa.Array, recorded: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> tuple:
    rng = np.random.Generator(np.random.PCG64(seed))
    w0, w = np.float32(0), np.zeros(WIDTH, np.float32)
    v = rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)
    if len(np.unique(labels)) < 2:
        return np.float32(-50), w, v * 0
    parts = list(features(column, recorded))
    starts = np.concatenate([np.zeros(1, np.int64)] + [np.diff(p[2]) for p in parts]).cumsum()
    numbers, values = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    y = labels.astype(np.float32)
    gw, gv, g0 = np.full(WIDTH, 1e-4, np.float32), np.full((WIDTH, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            docs = order[k : k + BATCH]
            lens = starts[docs + 1] - starts[docs]
            ends = lens.cumsum()
            at = np.arange(ends[-1]) + np.repeat(starts[docs] - ends + lens, lens)
            f, x, row = numbers[at], values[at], np.repeat(np.arange(len(docs)), lens)
            z, sums = raw_score((w0, w, v), np.concatenate([[0], ends]), f, x)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
            ids, inv = np.unique(f, return_inverse=True)
            gx = g[row] * x
            dw = np.bincount(inv, gx, len(ids)).astype(np.float32) + 1e-5 * w[ids]
            dv = np.stack([np.bincount(inv, gx * (sums[row, j] - v[f, j] * x), len(ids)) for j in range(FACTORS)], axis=1).astype(np.float32) + 1e-4 * v[ids]
            g0 += float(g.sum()) ** 2
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w0 -= np.float32(RATE * g.sum() / np.sqrt(g0))
            w[ids] -= RATE * dw / np.sqrt(gw[ids])
            v[ids] -= RATE * 0.5 * dv / np.sqrt(gv[ids])
    return w0, w, v


def score(model: tuple, column: pa.Array, recorded: np.ndarray) -> np.ndarray:
    out = np.zeros(len(column))
    for first, last, starts, numbers, values in features(column, recorded):
        out[first:last] = raw_score(model, starts, numbers, values)[0]
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _recorded(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(model.value, batch.column("text"), _recorded(batch.column("n_chars")))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= THRESHOLD).astype(np.int32)),
            })

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    recorded = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select("doc_id", "text", recorded.alias("n_chars"))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> pa.Table:
    """text, n_chars, y of about ``per_class`` documents of each class, none of them held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_hi")).where("y = _hi")
    )
    drawn = F.lit(False)
    for r in known.groupBy("y").agg(F.count("*").alias("n")).collect():
        drawn = drawn | ((F.col("y") == r["y"]) & hash_share("doc_id", per_class / r["n"]))
    ids = F.broadcast(known.where(drawn).select("doc_id", "y").limit(4 * per_class))
    rows = _inputs(docs).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "n_chars")).alias("_d"))
    return rows.select("doc_id", "y", "_d.*").toArrow().sort_by([("doc_id", "ascending")])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    rows = sample(docs, labels, per_class).combine_chunks()
    text = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    model = train(text, _recorded(rows["n_chars"].combine_chunks()) if rows.num_rows else np.zeros(0, np.int64), rows["y"].to_numpy())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = _inputs(docs).withColumn("held_out", held_out())
    return held.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"doc_id {id_type}, held_out boolean, score double, predicted int")
