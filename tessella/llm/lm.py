"""Operator 2, language-model scoring by masked pseudo-likelihood.

A window network predicts every word of a text from the two words before and the
two after it, never from itself; a document's score is the sum of these
conditional log-probabilities. The probability of a word is that of its class
times that of the word inside the class, so each prediction is properly
normalised at the cost of two small softmaxes.

The vocabulary comes from the word counts of the whole corpus: the most frequent
words, in classes by rank, ``vocabulary_size`` of them, which grows with the
number of distinct words; so does the width of a class. All other words share one
class of hash buckets. The probability of such a word is that of its bucket times
its share of the bucket's words in the whole corpus.

Training is data-parallel: documents fall by a hash into ROUNDS rounds; in each,
every partition continues from the common weights on its documents of the round,
and the weights are averaged, weighted by positions. Every position of the corpus
is a target exactly once. What is gathered, counts and weights, grows with the
corpus.

Defined cases: null text and text without words have 0 words, sum 0 and a null
mean; places before the first and after the last word are a padding word of
their own; a text of any length is scored whole, in runs of SCORED positions;
words of one count are ranked by hash; repeated rows score alike; an empty table
gives an empty result;
columns beside doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textops as tx
from tessella.llm.common import ship, staged

#: The least vocabulary and width of a class; words of the vocabulary for each cube root of the distinct words.
VOCABULARY, CLASS, GROWTH = 2048, 64, 32
#: Logarithms of counts are summed in whole numbers of 1 / FIXED, so the sum doesn't depend on the order.
FIXED = 1 << 32
SIDE, EMBED, HIDDEN = 2, 16, 24
#: Batches of a partition grow from FIRST positions to BATCH.
ROUNDS, FIRST, BATCH, RATE = 2, 256, 4096, 0.25
#: Bits of a hash that find a word of the vocabulary.
SLOT = 16
#: Positions that are scored at a time.
SCORED = 1 << 15
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 20
BLOCKS, SALTS = 8, 16
_U = np.uint64


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    keys, n = np.zeros(0, _U), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in tx.chunks(batch.column("text")):
            waiting.append(np.unique(tx.word_hashes(data, offsets)[0], return_counts=True))
            size += len(waiting[-1][0])
            if size > HELD:
                keys, n = _merged([(keys, n), *waiting])
                waiting, size = [], 0
                if len(keys) > HELD:
                    yield out(keys, n)
                    keys, n = np.zeros(0, _U), np.zeros(0, np.int64)
    keys, n = _merged([(keys, n), *waiting])
    yield out(keys, n)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def vocabulary_size(distinct: int) -> int:
    return max(VOCABULARY, CLASS * round(GROWTH * distinct ** (1 / 3) / CLASS))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: the words of the whole corpus by hash."""
    return staged(docs.select("text").mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("h IS NOT NULL"), "words")


def split_words(counts: DataFrame, size: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """Hashes of the most frequent words, most frequent first, and the counts of all others.

    The number of words at each count gives the count at which the vocabulary
    ends, so no task sorts all words; ties go by hash.
    """
    at = {r["n"]: r["words"] for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()}
    size = vocabulary_size(sum(at.values())) if size is None else size
    least, above = 0, 0
    for n in sorted(at, reverse=True):
        if above + at[n] > size:
            least = n
            break
        above += at[n]
    rows = [(r["n"], r["h"]) for r in counts.where(F.col("n") > least).collect()]
    ties = [r["h"] for r in counts.where(F.col("n") == least).orderBy("h").limit(size - above).collect()] if least else []
    rows.sort(key=lambda r: (-r[0], r[1]))
    rest = F.col("n") < least
    if least:
        rest = rest | ((F.col("n") == least) & (F.col("h") > ties[-1] if ties else F.lit(True)))
    return np.array([h for _, h in rows] + ties, np.int64).view(_U), counts.where(rest)


def vocabulary(docs: DataFrame, size: int | None = None) -> np.ndarray:
    """Hashes of the most frequent words of the whole corpus, most frequent first: at most ``size`` of them."""
    return split_words(word_counts(docs), size)[0]


class Network:
    """Weights and the two passes. Words are numbered: the vocabulary by rank, then the buckets, then the padding."""

    def __init__(self, words: np.ndarray) -> None:
        self.width = CLASS
        while self.width**2 < len(words):  # about as many classes as words in one
            self.width *= 2
        self.classes = -(-len(words) // self.width) + 1
        self.size = self.classes * self.width
        self.words = words
        self._slots: list[np.ndarray] = []
        shapes = [(self.size + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, self.classes), (self.classes,), (self.classes, HIDDEN, self.width), (self.classes, self.width)]
        self.shapes = shapes
        self.ends = np.cumsum([int(np.prod(shape)) for shape in shapes]).tolist()

    def fresh(self, seed: int = 2) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = [0.3, (2 * SIDE * EMBED) ** -0.5, 0, 0.1, 0, 0.1, 0]
        return np.concatenate([rng.normal(0, s, shape).ravel() if s else np.zeros(int(np.prod(shape))) for s, shape in zip(scale, self.shapes, strict=True)]).astype(np.float32)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[i:j].reshape(s) for i, j, s in zip([0, *self.ends], self.ends, self.shapes, strict=False)]

    def _tables(self) -> list[np.ndarray]:
        """Tables by the top SLOT bits of a hash: of each slot's words the first, of the others the second, and so on."""
        if not self._slots:
            left = np.arange(len(self.words))
            while len(left):
                slots, first = np.unique((self.words[left] >> _U(64 - SLOT)).astype(np.int64), return_index=True)
                table = np.full(1 << SLOT, -1, np.int32)
                table[slots] = left[first]
                self._slots.append(table)
                left = np.delete(left, first)
        return self._slots

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word."""
        out = self.size - self.width + (hashes % _U(self.width)).astype(np.int64)
        slot, at = (hashes >> _U(64 - SLOT)).astype(np.int64), None
        for table in self._tables():
            found = table[slot if at is None else slot[at]]
            some = np.flatnonzero(found >= 0)  # a slot without a word here has none in the next table either
            found, at = found[some], some if at is None else at[some]
            same = self.words[found] == hashes[at]
            out[at[same]] = found[same]
            at = at[~same]
        return out

    def contexts(self, words: np.ndarray, doc: np.ndarray, first: int, last: int) -> np.ndarray:
        """Numbers of the SIDE words on either side of the places from ``first`` to ``last``; the padding outside the document."""
        low, high = max(0, first - SIDE), min(len(words), last + SIDE)
        place = np.arange(low, high)
        place += SIDE * (doc[low:high] - doc[low])  # so many paddings between two documents
        padded = np.full(place[-1] - place[0] + 1 + 2 * SIDE, self.size, np.int64)
        place += SIDE - place[0]
        padded[place] = words[low:high]
        place = place[first - low : last - low, None]
        return padded[place + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])]

    def log_probability(self, flat: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        e, w1, b1, wc, bc, ww, bw = self.parts(flat)
        n = len(target)
        order, cls, starts = self._by_class(target)
        context, inner = context[order], target[order] - cls * self.width
        h, sorted_ = np.empty((n, HIDDEN), np.float32), np.empty(n, np.float32)
        for i in range(0, n, BATCH):
            j = min(i + BATCH, n)
            h[i:j] = _hidden(e, w1, b1, context[i:j])
            z = h[i:j] @ wc
            z += bc
            sorted_[i:j] = _log_softmax(z, cls[i:j])
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            z = h[i:j] @ ww[cls[i]]
            z += bw[cls[i]]
            sorted_[i:j] += _log_softmax(z, inner[i:j])
        out = np.empty(n)
        out[order] = sorted_
        return out

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the targets by class, their classes in it, and where each class begins."""
        cls = target // self.width
        order = np.argsort(cls.astype(np.uint16) if self.classes < 1 << 16 else cls, kind="stable")
        cls = cls[order]
        return order, cls, _starts(cls)

    def learn(self, flat: np.ndarray, sums: np.ndarray, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on a batch, in place."""
        own, past = self.parts(flat), self.parts(sums)
        e, w1, b1, wc, bc, ww, bw = own
        order, cls, starts = self._by_class(target)
        context, inner, n = context[order], target[order] - cls * self.width, len(target)
        used, each, one = cls[starts], np.arange(n), np.ones(n, np.float32)
        runs = list(zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), n], strict=True))
        x = e.take(context.ravel(), axis=0).reshape(n, -1)
        h = _hidden(e, w1, b1, context, x)
        p = h @ wc
        p += bc
        _softmax(p, n)[each, cls] -= np.float32(1 / n)
        q = np.empty((n, self.width), np.float32)
        for c, i, j in runs:
            np.matmul(h[i:j], ww[c], out=q[i:j])
            q[i:j] += bw[c]
        _softmax(q, n)[each, inner] -= np.float32(1 / n)
        dh, gww, gbw = p @ wc.T, np.empty((len(used), HIDDEN, self.width), np.float32), np.empty((len(used), self.width), np.float32)
        for k, (c, i, j) in enumerate(runs):
            np.matmul(h[i:j].T, q[i:j], out=gww[k])
            np.matmul(one[i:j], q[i:j], out=gbw[k])
            dh[i:j] += q[i:j] @ ww[c].T
        dz = dh * (1 - h * h)
        dx = (dz @ w1.T).reshape(-1, EMBED)
        near = context.ravel()
        by = np.argsort(near.astype(np.uint16) if self.size < 1 << 16 else near, kind="stable")
        near = near[by]
        ends = _starts(near)
        grads = [np.add.reduceat(dx.take(by, axis=0), ends, axis=0), x.T @ dz, one @ dz, h.T @ p, one @ p, gww, gbw]
        classes = used if len(used) < self.classes else slice(None)
        # Words and classes that the batch doesn't touch have no gradient, so Adagrad leaves them as they are.
        for to, total, rows, g in zip(own, past, [near[ends], *[slice(None)] * 4, classes, classes], grads, strict=True):
            total[rows] += g * g
            to[rows] -= RATE * g / np.sqrt(total[rows])


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered, non-empty array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _hidden(e: np.ndarray, w1: np.ndarray, b1: np.ndarray, context: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    h = (e.take(context.ravel(), axis=0).reshape(len(context), -1) if x is None else x) @ w1
    h += b1
    return np.tanh(h, out=h)


def _exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) in place and the rows' sums. Hidden units are within 1 of 0, so the clip only meets weights that have run away."""
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones((z.shape[1], 1), np.float32)


def _softmax(z: np.ndarray, n: int) -> np.ndarray:
    """The rows' softmax over ``n``, in place."""
    z, total = _exponents(z)
    total *= n
    z /= total
    return z


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one place; z is used up."""
    picked = np.clip(z[np.arange(len(z)), at], -80, 80)
    return picked - np.log(_exponents(z)[1][:, 0])


def _train(network, weights):
    """A partition's weights times its positions, and its positions, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, flat = network.value, weights.value.copy()
        sums, seen, step = np.full_like(flat, 1e-3), 0, 0
        for batch in batches:
            for _, _, data, offsets in tx.chunks(batch.column("text")):
                hashes, doc = tx.word_hashes(data, offsets)
                words, at = net.numbers(hashes), 0
                while at < len(words):
                    step += 1
                    last = min(len(words), at + min(BATCH, FIRST * step))
                    net.learn(flat, sums, net.contexts(words, doc, at, last), words[at:last])
                    at = last
                seen += len(words)
        if seen:
            total = np.array_split(flat.astype(np.float64) * seen, BLOCKS)
            salt = int(flat.view(np.uint32).sum(dtype=np.uint64) % _U(SALTS))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(BLOCKS), pa.int32()), "salt": pa.array([salt] * BLOCKS, pa.int32()),
                "n": pa.array([seen] * BLOCKS, pa.int64()), "total": pa.array([x.astype(np.float32).tobytes() for x in total], pa.binary()),
            })

    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("total"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            n, total = n + k, x if total is None else total + x
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def of_round(docs: DataFrame, turn: int) -> DataFrame:
    """The texts that a round learns from; each is in one round."""
    return docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn)


def fit(docs: DataFrame, words: np.ndarray | None = None) -> tuple[Network, np.ndarray]:
    """The network and its weights, learned from all documents."""
    spark = docs.sparkSession
    ship(spark)
    net = Network(vocabulary(docs) if words is None else words)
    network, flat = spark.sparkContext.broadcast(net), net.fresh()
    for turn in range(ROUNDS):
        own = of_round(docs, turn).mapInArrow(_train(network, spark.sparkContext.broadcast(flat)), "block int, salt int, n bigint, total binary")
        schema = "block int, n bigint, total binary"
        rows = own.groupBy("block", "salt").applyInArrow(_add, schema).groupBy("block").applyInArrow(_add, schema).orderBy("block").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["total"], np.float32) / r["n"] for r in rows]).astype(np.float32)
    return net, flat


def _score(network, weights, buckets=None):
    """Scores of documents. With ``buckets``, the logarithms of their words' counts, also each row's number and its
    rare words' hashes; a rare word then counts as one of its bucket's words, and the logarithm of its own count is still to add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, flat = network.value, weights.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, data, offsets in tx.chunks(batch.column("text")):
                hashes, doc = tx.word_hashes(data, offsets)
                words = net.numbers(hashes)
                logp = np.zeros(len(words))
                for at in range(0, len(words), SCORED):
                    to = min(at + SCORED, len(words))
                    logp[at:to] = net.log_probability(flat, net.contexts(words, doc, at, to), words[at:to])
                rare = np.flatnonzero(words >= net.size - net.width)
                if buckets is not None:
                    logp[rare] -= buckets.value[words[rare] - (net.size - net.width)]
                starts = tx.group_starts(doc, last - first)
                total, n = tx.segment_sum(logp, starts), np.diff(starts)
                out = {
                    "doc_id": batch.column("doc_id").slice(first, last - first), "n_words": pa.array(n.astype(np.int64)), "log_likelihood": pa.array(total),
                    "mean_log_likelihood": pa.array(total / np.maximum(1, n), mask=n == 0),
                }
                if buckets is not None:
                    out["row"] = pa.array(np.arange(row, row + last - first))
                    ends = np.searchsorted(rare, starts).astype(np.int32)
                    out["rare"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[rare].view(np.int64)))
                row += last - first
                yield pa.RecordBatch.from_pydict(out)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood, mean_log_likelihood."""
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    words, rest = split_words(word_counts(docs))
    net, flat = fit(docs, words)
    totals = np.ones(net.width)
    for r in rest.groupBy(F.col("h").bitwiseAND(F.lit(net.width - 1)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run = _score(sc.broadcast(net), sc.broadcast(flat), sc.broadcast(np.log(totals)))
    columns = f"doc_id {id_type}, n_words bigint, log_likelihood double, mean_log_likelihood double, row bigint, rare array<bigint>"
    scored = staged(docs.select("doc_id", "text").mapInArrow(run, columns), "scored")
    # A word that occurs once adds the logarithm of 1.
    own = rest.where("n > 1").select("h", F.round(F.log("n") * FIXED).cast("bigint").alias("own"))
    added = scored.select("row", F.explode("rare").alias("h")).join(own, "h").groupBy("row").agg(F.sum("own").alias("own"))
    total = F.col("log_likelihood") + F.coalesce("own", F.lit(0)) / FIXED
    return scored.drop("rare").join(added, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))
