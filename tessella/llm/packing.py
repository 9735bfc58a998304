"""Operator 5, best-fit packing with certified bounds.

Documents are tokenized, cut into pieces of at most ``LENGTH`` tokens (only
longer documents are cut; the first piece takes the odd rest) and packed into
sequences of ``LENGTH`` tokens. Each partition packs its pieces by best-fit
decreasing and computes a lower bound on its sequences from dual-feasible
functions. Where the two agree, the partition is certified and done. The others
exchange the pieces of their sequences that aren't full: these are dealt anew to
as few partitions as hold them, which pack them again. It ends when all are
certified, when an exchange no longer needs fewer partitions, or with the one
that held everything left. Pieces that fill a sequence alone never move. The
column ``certified`` says of a piece whether its sequence is full or its
partition met the bound; the last packing stands even where it didn't.

Only (row, length) move in the exchange: no text, no tokens. A partition gets
about SLICE pieces, whatever the input.

Tokenizing is by pre-tokens: numpy finds their borders in the code points, each
distinct one of a worker is given to the tokenizer once, and the ids are
gathered. Byte-level BPE never merges over such a border, so the ids are those
of the whole text. A text that holds one of the vocabulary's added tokens, such
as <|endoftext|>, is given to the tokenizer as a whole, which finds them.

Defined cases: null and empty texts are the end token alone, one piece of length
1; a text of any length is encoded whole; pieces of equal length are packed in
the order of their numbers; repeated rows are packed as documents of their own;
an empty table gives an empty result; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textops as tx
from tessella.llm.common import keeps, lean, ship, staged

LENGTH = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one partition packs at once.
SLICE = 40_000
#: Exchanges at most: sequence numbers have bits for so many. Each needs fewer partitions than the one before.
ROUNDS = 30
#: Pre-tokens whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1_500_000
#: The contractions that the vocabulary's pre-tokenizer splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_known: dict[str, tuple] = {}
keeps("packing", _known.clear)


def borders(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in the joined code points of texts that end at ``ends``.

    A pre-token is a contraction, a run of one class (letters, numbers, others)
    with the one space before it, or white space up to the last character before
    another class.
    """
    n = len(codes)
    kind = tx.classes()[codes]
    head = np.zeros(n + 1, bool)
    head[0] = True
    head[ends] = True
    head = head[:n]
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    first = run & ~space  # a run of another class begins
    begin = run.copy()
    after = np.flatnonzero(first & ~head)
    after = after[space[after - 1]]  # white space comes right before, in the same text
    joins = codes[after - 1] == 32
    begin[after[joins]] = False
    begin[after - 1] = True
    quote = np.flatnonzero(first & (codes == 39) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~head[quote + 1] & (kind[quote + 1] == 1)]
    if len(quote):
        limit = np.append(ends, n)[np.searchsorted(ends, quote, side="right")]
        open_ = np.ones(len(quote), bool)
        for short in CONTRACTIONS:
            fits = open_ & (quote + len(short) < limit)
            for k, letter in enumerate(short):
                at = np.minimum(quote + 1 + k, n - 1)
                fits &= codes[at] == ord(letter)
            hit = quote[fits]
            begin[hit + 1] = False
            rest = hit + 1 + len(short)
            rest = rest[rest < n]
            begin[rest] |= kind[rest] == 1
            open_ &= ~fits
    return np.flatnonzero(begin)


class Encoder:
    """Token ids of texts; pre-tokens are encoded once and remembered by a 64-bit hash."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Adds pre-tokens, given with their sorted hashes."""
        if len(self.hashes) + len(words) > REMEMBERED:
            self.forget()
        found = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        slots = len(self.starts) - 1 + np.arange(len(words))
        self.starts = np.concatenate([self.starts, self.starts[-1] + sizes.cumsum()])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        joined = "".join(texts)
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.added)] if any(x in joined for x in self.added) else []
        if not special:
            return self._encode(texts)
        plain = list(texts)
        for i in special:
            plain[i] = ""
        out = self._encode(plain)
        for i in special:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that hold none of the vocabulary's added tokens."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = lengths.cumsum()
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        codes = tx.code_points(joined)
        start = borders(codes, np.unique(ends[ends < len(codes)]))
        stop = np.append(start[1:], len(codes))
        up, down = tx.powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(tx.mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        hashes = tx.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[place] != distinct
        if new.any():
            if len(self.hashes) + int(new.sum()) > REMEMBERED:
                self.forget()
                new[:] = True
            which = at[new]
            self._learn([joined[a:b] for a, b in zip(start[which].tolist(), stop[which].tolist(), strict=True)], distinct[new])
        slot = self.slots[np.searchsorted(self.hashes, distinct)][inverse]
        size = self.starts[slot + 1] - self.starts[slot]
        total = size.cumsum()
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.starts[slot] - total + size, size)]
        until = np.append(0, total)[np.searchsorted(start, ends)]
        return np.split(ids, until[:-1])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _known:
        _known.clear()
        _known[path] = Encoder(path)
    return _known[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _cut(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in lean("packing", batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            rows: list[tuple[int, int, int, int, int]] = []
            for a, b in tx.text_runs(texts):
                for i, ids in enumerate(tokens.encode(texts[a:b]), a):
                    data = np.append(ids, np.uint32(END)).astype("<u4")
                    n = len(data)
                    first = n - (n - 1) // length * length
                    for piece, at in enumerate([0, *range(first, n, length)]):
                        stop = first if piece == 0 else at + length
                        rows.append((i, piece, at, stop - at, zlib.crc32(data[at:stop].tobytes())))
            i, piece, at, size, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(i)), "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(at), "length": pa.array(size), "ids_crc32": pa.array(crc),
            })

    return run


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Bins of one gap are interchangeable, so they wait in stacks by gap."""
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    gaps = 0  # bit g is set if a bin with gap g waits
    bins, n = np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                gaps &= ~(1 << gap)
            gap -= size
        else:
            b, gap = n, length - size
            n += 1
        bins[i] = b
        if gap:
            waiting[gap].append(b)
            gaps |= 1 << gap
    return bins


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """The best of a family of dual-feasible functions: sums of f(size) that no packing can go below.

    f_e counts an item over length - e as a whole bin, one under e as nothing and
    the others by size (e = 0: the volume); g_k counts floor((k + 1) x) / k for
    x = size / length, unless (k + 1) x is whole.
    """
    count = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    size = np.arange(length + 1)
    best = -(-int((count * size).sum()) // length)
    below, weight = np.cumsum(count), np.cumsum(count * size)
    for e in range(1, length // 2 + 1):
        whole = int(below[length] - below[length - e])
        middle = int(weight[length - e] - weight[e - 1])
        best = max(best, whole + -(-middle // length))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % length == 0, size * k, scaled // length * length)
        best = max(best, -(-int((count * value).sum()) // (k * length)))
    return best


def _pack(length: int, last: bool):
    """Packs one partition; sequences that are full, or of a certified partition, are final."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy().astype(np.int64)
        order = np.lexsort((table.column("row").to_numpy(), -sizes))
        table, sizes = table.take(pa.array(order)), sizes[order]
        bins = best_fit(sizes, length)
        n = int(bins.max()) + 1 if len(bins) else 0
        fill = np.bincount(bins, sizes, n).astype(np.int64)
        sure = np.ones(len(sizes), bool) if n == lower_bound(sizes, length) else fill[bins] == length
        by = np.argsort(bins, kind="stable")
        ends = sizes[by].cumsum()
        offset = np.zeros(len(sizes), np.int64)
        offset[by] = ends - sizes[by] - (fill.cumsum() - fill)[bins[by]]
        return pa.table({
            "row": table.column("row"), "length": table.column("length"),
            "slice": pa.array(np.full(len(sizes), key[0].as_py(), np.int64)), "bin": pa.array(bins), "offset": pa.array(offset), "done": pa.array(sure | last), "certified": pa.array(sure),
        })

    return run


def tokenize(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Staged pieces: row (a unique number), doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(_cut(path or vocabulary_path(), length), f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return staged(cut.withColumn("row", F.monotonically_increasing_id()), "pieces", batch=2000)


def assign(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequence and offset of each piece: (row, sequence_id, offset, certified), staged round by round."""
    full = pieces.where(F.col("length") == length).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("length") < length).select("row", "length")
    n = rest.count()
    found, slices, turn, last = [], max(1, -(-n // SLICE)), 0, False
    schema = "row bigint, length bigint, slice bigint, bin bigint, offset bigint, done boolean, certified boolean"
    while n:
        turn += 1
        last = last or slices == 1
        dealt = rest.withColumn("slice", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(slices)))
        packed = staged(dealt.groupBy("slice").applyInArrow(_pack(length, last), schema), f"packed-{turn}")
        # below 0, so that no number meets a row's; rounds, slices and bins each have bits of their own
        number = -(F.lit(turn).cast("bigint") * (1 << 58) + F.col("slice") * (1 << 20) + F.col("bin")) - 1
        found.append(packed.where("done").select("row", number.alias("sequence_id"), "offset", "certified"))
        rest = packed.where("not done").select("row", "length")
        n = rest.count()
        fewer = max(1, -(-n // SLICE))
        slices, last = fewer, fewer >= slices or turn == ROUNDS
    out = full
    for part in found:
        out = out.union(part)
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    pieces = tokenize(docs, path, length)
    return pieces.join(assign(pieces, length), "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
