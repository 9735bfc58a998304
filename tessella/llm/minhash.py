"""Operator 3, near-duplicates: fast similarity sketching, banding, exact verification.

A document's set holds its distinct 5-word shingles, hashed. Its sketch has BINS
coordinates. In round i < BINS each shingle is thrown into a random bin with the
value i + fraction; a bin keeps its least value. A document stops after the
round in which its last bin was filled; what is still empty after BINS rounds is
filled by rounds BINS + b that throw every shingle into bin b. So each
coordinate is filled after at most 2 * BINS rounds, and large sets need one or
two. The share of equal coordinates estimates the Jaccard similarity with the
concentration of BINS independent hashes.

Documents with equal sets are one class. Classes whose sketches agree in a band
(four coordinates of 32 bands: a pair at 0.75 is missed once in 200,000) are
candidates. First each class is compared with one centre, of those of its buckets
whose set's size allows a link that with which it shares most bands; a bucket's
centre is the member whose buckets are the fullest. Where a bucket still holds
several components, the components that meet in such buckets form a cluster. Sets
that link differ in size by a third at most, so a cluster is cut into windows of
sizes, each two steps of 4/3 wide and beginning a step after the one before: what
may link meets in a window. All pairs of a window's classes that aren't in its
largest component together are compared, block by block:
blocks of BLOCK texts meet two at a time in a task, which counts the shingles of
all their pairs by posting lists. So no pair is ever a row, no task holds more
than two blocks, and no link between candidates is lost. Every link is confirmed
on the two whole sets.

Defined cases: null text has no words, n_shingles 0 and no links; a document of
one to four words has one shingle, its whole sequence; a null doc_id links with
nothing and has component_id null and kept true; doc_id is read as a bigint, so
an id that isn't one is an error; a text of any length is one set, made at once;
repeated rows have one component, that of their doc_id; ties don't occur, since
the smallest doc_id is the component's; an empty table gives an empty result;
columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textops as tx
from tessella.llm.common import lean, ship, staged

WIDTH = 5
BINS = 128
BANDS = 32
MATCH, OF = 75, 100
#: Texts in a block, about; a task holds two of them.
BLOCK = 400
#: Links that one task may join into components; more are contracted by all tasks together.
LOCAL = 50_000
#: Pairs of a centre, at least, and share of all pairs beyond which it is joined in copies; copies at most.
HOT, HOT_SHARE, COPIES = 1000, 10_000, 64
#: Pairs of postings that are counted at a time.
POSTINGS = 1 << 21
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 54) - 1)


def shingle_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct keys of up to 1023 documents: the document above bit 54, the shingle's hash below."""
    hashes, doc = tx.word_hashes(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    first = count.cumsum() - count
    keys = []
    for width in range(1, WIDTH + 1):
        if width == WIDTH:
            at = np.arange(max(0, len(doc) - WIDTH + 1))
            at = at[doc[at] == doc[at + WIDTH - 1]]
        else:
            at = first[count == width]
        if len(at):
            h = np.full(len(at), width * 0x51_7C_C1_B7, np.uint64)
            for k in range(width):
                h = h * np.uint64(tx.BASE) + hashes[at + k]
            keys.append((doc[at].astype(np.uint64) << np.uint64(54)) | (tx.mix(h) >> np.uint64(10)))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def sketches(keys: np.ndarray, docs: int) -> np.ndarray:
    """Sketch [document, BINS] of 16-bit coordinates; rows of documents without shingles mean nothing."""
    out = np.full(docs * BINS, _FULL)
    doc, x = (keys >> np.uint64(54)).astype(np.int64), keys & _LOW
    for i in range(BINS):
        h = tx.mix(x + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        np.minimum.at(out, doc * BINS + (h >> np.uint64(57)).astype(np.int64), (np.uint64(i) << np.uint64(48)) | ((h >> np.uint64(9)) & np.uint64((1 << 48) - 1)))
        open_ = (out.reshape(docs, BINS) == _FULL).any(axis=1)[doc]
        doc, x = doc[open_], x[open_]
        if not len(doc):
            break
    if len(doc):
        empty = (out == _FULL).reshape(docs, BINS)
        for b in range(BINS):
            some = empty[doc, b]
            h = tx.mix(x[some] + np.uint64((BINS + b + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
            np.minimum.at(out, doc[some] * BINS + b, (np.uint64(BINS + b) << np.uint64(48)) | (h >> np.uint64(16)))
    return (tx.mix(out) >> np.uint64(48)).astype(np.uint16).reshape(docs, BINS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean("minhash", batches):
        for first, last, data, offsets in tx.chunks(batch.column("text")):
            n = last - first
            keys = shingle_keys(data, offsets)
            starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(54))
            x = keys & _LOW
            sums = [tx.segment_sum(tx.mix(x + np.uint64(seed)), starts).view(np.int64) for seed in (0x1F3D5B79, 0x2468ACE1357)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(first, n), "n_shingles": pa.array(np.diff(starts), pa.int64()),
                "k1": pa.array(sums[0]), "k2": pa.array(sums[1]),
                "sketch": pa.array([row.tobytes() for row in sketches(keys, n)], pa.binary()),
            })


def _sets(ids: np.ndarray, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids and their shingle hashes."""
    ids, at = np.unique(ids, return_index=True)
    column, out = column.take(pa.array(at)), []
    for first, last, data, offsets in tx.chunks(column):
        keys = shingle_keys(data, offsets)
        ends = np.searchsorted(keys, np.arange(1, last - first, dtype=np.uint64) << np.uint64(54))
        out.extend(np.split(keys & _LOW, ends))
    return ids, out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """MATCH percent or more of the union of two sets of distinct hashes are in both."""
    small, large = sorted((len(x), len(y)))
    if not small or OF * small < MATCH * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= MATCH * (small + large - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean("minhash", batches):
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        ids_a, sets_a = _sets(a, batch.column("text_a"))
        ids_b, sets_b = _sets(b, batch.column("text_b"))
        ok = [linked(sets_a[i], sets_b[j]) for i, j in zip(np.searchsorted(ids_a, a), np.searchsorted(ids_b, b), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections [x, y] of two lists of sets, by the posting lists of their hashes."""
    def postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        return keys[order], doc[order]

    keys, doc_x = postings(x)
    other, doc_y = postings(y)
    lo, hi = np.searchsorted(other, keys), np.searchsorted(other, keys, side="right")
    hit = hi > lo
    doc_x, lo, times = doc_x[hit], lo[hit], (hi - lo)[hit]
    out = np.zeros(len(x) * len(y), np.int64)
    ends = times.cumsum()
    at = 0
    while at < len(times):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, side="right")))
        n = times[at:stop]
        places = np.arange(n.sum()) + np.repeat(lo[at:stop] - n.cumsum() + n, n)
        out += np.bincount(np.repeat(doc_x[at:stop], n) * len(y) + doc_y[places], minlength=len(out))
        at = stop
    return out.reshape(len(x), len(y))


def find(up: dict[int, int], x: int) -> int:
    """The root of x, with the way there cut short."""
    root = x
    while up.get(root, root) != root:
        root = up[root]
    while up.get(x, x) != root:
        up[x], x = root, up.get(x, x)
    return root


def _blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the components of two blocks (or inside one), a forest of them."""
    table = table.combine_chunks()
    reps, at = np.unique(table.column("rep").to_numpy(), return_index=True)
    table = table.take(pa.array(at))
    block, comp = table.column("block").to_numpy(), table.column("comp").to_numpy()
    _, sets = _sets(reps, table.column("text"))
    a, b = (np.flatnonzero(block == k.as_py()) for k in key[1:])
    links, up = [], {}
    if len(a) and len(b):
        both = common_counts([sets[i] for i in a], [sets[i] for i in b])
        size = np.array([len(s) for s in sets])
        close = (OF * both >= MATCH * (size[a][:, None] + size[b][None, :] - both)) & (comp[a][:, None] != comp[b][None, :])
        for i, j in zip(*np.nonzero(close), strict=True):
            x, y = find(up, int(comp[a[i]])), find(up, int(comp[b[j]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((x, y))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of the nodes of at most LOCAL edges."""
    up: dict[int, int] = {}
    nodes: set[int] = set()
    for batch in batches:
        for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
            x, y = find(up, lo), find(up, hi)
            nodes.update((lo, hi))
            up[max(x, y)] = min(x, y)
    out = sorted(nodes)
    yield pa.RecordBatch.from_pydict({"node": pa.array(out, pa.int64()), "to": pa.array([find(up, x) for x in out], pa.int64())})


def may_link(x: Column, y: Column) -> Column:
    """True where two sets of these sizes are close enough to link."""
    return OF * F.least(x, y) >= MATCH * F.greatest(x, y)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that link, each compared on the whole sets of both.

    A centre b of more than HOT pairs, or a 1 / HOT_SHARE of all, is joined as several copies, each with a part of
    its pairs; there are fewer than HOT_SHARE such centres, so the table of them is broadcast.
    """
    limit = max(HOT, pairs.count() // HOT_SHARE)
    hot = staged(pairs.groupBy("b").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("b", F.least(F.lit(COPIES), F.ceil(F.col("_n") / limit)).cast("int").alias("_copies")), "centres")
    copies = F.coalesce("_copies", F.lit(1))
    left = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), copies).cast("int").alias("_copy"))
    right = texts.toDF("b", "text_b").join(F.broadcast(hot), "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"))
    both = left.join(texts.toDF("a", "text_a"), "a").join(right, ["b", "_copy"])
    return staged(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint"), "links", batch=1000)


def merge_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, comp) of a forest, grown by links (a, b): comp is the smallest node reachable.

    Each round every component hooks on to its smallest lower neighbour, chains
    are cut short by a pointer jump, and the links are contracted; once LOCAL or
    fewer are left, a task joins them. The driver sees none.
    """
    if labels is None:
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        labels, edges = nodes.withColumn("comp", F.col("node")), links
    else:
        fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
        labels = labels.union(fresh.withColumn("comp", F.col("node")))
        edges = links.join(labels.toDF("a", "_ca"), "a").join(labels.toDF("b", "_cb"), "b").select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    labels = staged(labels, "labels")
    while n := edges.count():
        if n <= LOCAL:
            up = staged(edges.coalesce(1).mapInArrow(_union, "node bigint, to bigint"), "roots")
        else:
            hooks = staged(edges.groupBy("hi").agg(F.min("lo").alias("to")).toDF("node", "to"), "hooks")
            up = staged(hooks.join(hooks.toDF("to", "over"), "to", "left").select("node", F.coalesce("over", "to").alias("to")), "roots")
        labels = staged(labels.join(up.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        if n <= LOCAL:
            break
        moved = edges.join(up.toDF("lo", "lo2"), "lo", "left").join(up.toDF("hi", "hi2"), "hi", "left")
        moved = moved.select(F.coalesce("lo2", "lo").alias("x"), F.coalesce("hi2", "hi").alias("y")).where("x <> y")
        edges = staged(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
    return labels


def _between(own: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of each cluster: rows (rep, comp, cluster, size) against each other, in blocks.

    From here on a cluster is one window of sizes of one of them. Its largest
    component is its main one; pairs inside it aren't compared. The other classes'
    blocks meet each other and the main ones'. Clusters smaller than a block share
    blocks.
    """
    # a step is wider than OF / MATCH by a hair, so that rounding can't part sizes that are exactly that far from each other
    step = F.floor(F.log(F.col("size") * 1.0) / F.lit(math.log(OF / MATCH) * (1 + 1e-9)))
    own = own.withColumn("_w", F.explode(F.array(step - 1, step))).withColumn("cluster", F.xxhash64("cluster", "_w")).drop("_w", "size")
    sizes = own.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("n_main"), (F.sum("c") - F.max("c")).alias("n_rest"))
    sizes = staged(sizes.where("n_rest > 0"), "sizes")
    small = F.col("n_main") + F.col("n_rest") <= BLOCK
    few = sizes.where(small).agg(F.coalesce(F.sum(F.col("n_main") + F.col("n_rest")), F.lit(0))).first()[0]
    rows = own.join(sizes, "cluster").withColumns({
        "_rest": F.ceil(F.col("n_rest") / BLOCK).cast("int"), "_mains": F.ceil(F.col("n_main") / BLOCK).cast("int"), "_h": F.xxhash64("rep"),
    })
    rows = rows.withColumn("block", F.when(small, 0).when(F.col("comp") == F.col("main"), F.col("_rest") + F.pmod("_h", "_mains")).otherwise(F.pmod("_h", "_rest")).cast("int"))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    # a main block meets every other block; another one also meets its like, the lower number first
    main = F.expr("transform(sequence(0, _rest - 1), i -> struct(i as x, block as y))")
    rest = F.expr("transform(sequence(0, _rest + _mains - 1), j -> struct(least(block, j) as x, greatest(block, j) as y))")
    meets = F.when(small, alone).when(F.col("comp") == F.col("main"), main).otherwise(rest)
    bundle = -1 - F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-int(few) // BLOCK))))
    rows = rows.select(F.when(small, bundle).otherwise(F.col("cluster")).alias("task"), "rep", "comp", "block", F.explode(meets).alias("_m"))
    rows = rows.select("task", F.col("_m.x").alias("x"), F.col("_m.y").alias("y"), "rep", "comp", "block")
    full = rows.join(texts.toDF("rep", "text"), "rep")
    return staged(full.groupBy("task", "x", "y").applyInArrow(_blocks, "a bigint, b bigint"), "between")


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = staged(docs.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sketch binary"), "sketches", batch=2000)
    live = signed.where("n_shingles > 0 and doc_id is not null")
    reps = staged(live.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")

    size = 2 * BINS // BANDS
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sketch, {size} * b + 1, {size})))")
    bands = reps.select("rep", F.col("n_shingles").alias("size"), F.explode(key).alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(bands.join(staged(buckets, "buckets"), "key"), "members")
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = staged(members.join(degree, "rep"), "ranked")
    centres = ranked.groupBy("key").agg(F.max_by(F.struct("rep", "size"), F.struct("degree", "rep")).alias("_c")).select("key", F.col("_c.rep").alias("centre"), F.col("_c.size").alias("_size"))
    near = ranked.join(staged(centres, "centres"), "key").where((F.col("rep") != F.col("centre")) & may_link(F.col("size"), F.col("_size"))).groupBy("rep", "centre").agg(F.count("*").alias("n"))
    pairs = near.groupBy("rep").agg(F.max_by("centre", F.struct("n", "centre")).alias("b")).withColumnRenamed("rep", "a")
    texts = staged(docs.join(members.select("rep").distinct(), docs["doc_id"] == F.col("rep"), "left_semi"), "texts")
    labels = merge_components(None, _confirmed(staged(pairs, "pairs"), texts))

    state = members.join(labels.toDF("rep", "comp"), "rep", "left").select("key", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    state = staged(state, "state")
    mixed = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    state = staged(state.join(staged(mixed.select("key", "lo"), "mixed"), "key"), "open")
    clusters = merge_components(None, state.where("comp <> lo").select(F.col("lo").alias("a"), F.col("comp").alias("b")))
    own = state.select("rep", "comp", "size").distinct().join(clusters.toDF("comp", "cluster"), "comp")
    own = staged(own, "clusters")
    labels = merge_components(labels, _between(own, texts))

    named = staged(reps.join(labels.toDF("rep", "comp"), "rep", "left").select("k1", "k2", F.col("n_shingles").alias("_n"), F.coalesce("comp", "rep").alias("component_id")), "named")
    same = (signed["k1"] == named["k1"]) & (signed["k2"] == named["k2"]) & (signed["n_shingles"] == named["_n"]) & signed["doc_id"].isNotNull()
    out = signed.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all columns as they are."""
    gone = components(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


#: The contract's rows in DuckDB: all pairs by their common shingles, then everything reachable.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.doc_id)
SELECT n.doc_id, n.n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
