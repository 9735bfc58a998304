"""Operator 8, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall by a hash into blocks. A source's target says how
many of its blocks (tickets) the mix takes: whole passes over the source, then a
permuted run of blocks whose last one is cut at a document; what is still
missing there is topped up by the one left document of the nearest size. A binary tree over
the output shards splits the vector of ticket quotas exactly: each node draws
its left half's counts without replacement (multivariate hypergeometric), so
every shard gets a fair and exact share of every source. A source's permuted
tickets are then dealt as disjoint runs, and each shard orders its documents by
a hash.

The driver draws the tree down to NODES subtrees, so it holds sources x NODES
counts whatever the number of shards. Below, a subtree's tickets are permuted by
a hash and cut into its shards' equal parts, which draws all its levels at once:
the counts of a random cut are multivariate hypergeometric too.

On the main path there are only DataFrame and SQL functions. Places in a
source's permutation come from groups of GROUP blocks, so no window has a row
for every block of a source. The table of sources is broadcast up to BROADCAST
rows, and beyond that joined with SALTS copies of each source, so a hot source is
dealt over SALTS tasks; the tables of blocks are broadcast up to BROADCAST rows,
and beyond that joined by block, of which each has a small share of the rows.

Defined cases: null or blank text has size 0; a null source is a source of its
own, the last; a source of size 0 has target 0 and is not taken; null doc_ids
are hashed as one id; a text of any length is one document, counted whole;
repeated rows are documents of their own, with one place in the order, so they
are taken together; equal sizes and order keys are tied and go by the key; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Output shards and blocks at least. Shards hold SHARD_WORDS words at most, about, so their number grows with the mix.
SHARDS, BLOCKS = 64, 4096
SHARD_WORDS = 100_000_000
BLOCKS_PER_SHARD = 16
#: Subtrees of the splitting tree that the driver draws; blocks, about, that are placed together.
NODES, GROUP = 256, 64
#: Rows up to which a table of sources or of blocks is broadcast; copies of a source beyond that.
BROADCAST, SALTS = 50_000, 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source: source, source_size, docs, target.

    The resharing until no target is above its limit ends where every target is
    min(limit * size, level * weight). Sorted by limit * size / weight, the
    capped sources come first, so the level is found with running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = by.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_w": weight, "_cap": limit * F.col("source_size").cast("double")})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ranked.withColumns({
        "_left": share * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    }).withColumn("_level", F.col("_left") / F.col("_rest"))
    open_ = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))
    level = level.withColumn("_at", F.min_by(open_, F.when(open_.isNotNull(), F.col("_cap") / F.col("_w"))).over(everything))
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("_w")))
    return level.select("source", "source_size", "docs", "_rank", target.alias("target"))


def _tree(quotas: np.ndarray, widths: list[int], rng: np.random.Generator) -> np.ndarray:
    """Counts [node, source]: the splitting tree over the quota vector, for nodes that stand for ``widths`` shards each."""
    if len(widths) == 1:
        return quotas[None, :]
    half = len(widths) // 2
    draw = int(quotas.sum()) * sum(widths[:half]) // sum(widths)
    took, pool = np.zeros_like(quotas), int(quotas.sum())
    for i, n in enumerate(quotas.tolist()):
        pool -= n
        took[i] = rng.hypergeometric(n, pool, draw) if n and draw else 0
        draw -= int(took[i])
    return np.concatenate([_tree(took, widths[:half], rng), _tree(quotas - took, widths[half:], rng)])


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("_blocks")).cast("int")


def _key(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(seed), F.lit("order"))


def _small(blocks: int) -> Callable[[DataFrame], DataFrame]:
    """The hint for tables with a row per block: broadcast, if there aren't too many."""
    return F.broadcast if blocks <= BROADCAST else lambda df: df


def _with_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """The rows (doc_id, source) with the columns of their source, which are given as ``_s`` and others."""
    same = rows["source"].eqNullSafe(F.col("_s"))
    if n <= BROADCAST:
        return rows.join(F.broadcast(sources), same)
    copies = sources.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")


def _running(runs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Adds to rows (_rank, _block, _words) the places from 0 in each source's permutation and the words before.

    The permutation is the order of a hash of the block. Its top bits name groups of about GROUP blocks of a large
    source; a place is that in the group behind the sizes of the groups before.
    """
    bits = max(1, (blocks // GROUP).bit_length())
    runs = runs.withColumn("_h", F.xxhash64("_block", F.lit(seed))).withColumn("_group", F.shiftright("_h", 64 - bits))
    inside = Window.partitionBy("_rank", "_group").orderBy("_h", "_block")
    groups = runs.groupBy("_rank", "_group").agg(F.count("*").alias("_n"), F.sum("_words").alias("_w"))
    before = Window.partitionBy("_rank").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_rank", "_group", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in (("_n", "_n0"), ("_w", "_w0"))])
    placed = runs.withColumns({"_place": F.row_number().over(inside) - 1, "_before": F.sum("_words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")})
    placed = placed.join(groups, ["_rank", "_group"])
    return placed.withColumns({"_place": (F.col("_place") + F.col("_n0")).cast("bigint"), "_before": F.col("_before") + F.col("_w0")}).drop("_h", "_group", "_n0", "_w0")


def deal(ticket: DataFrame, shards: int, seed: int, nodes: int = NODES) -> DataFrame:
    """Adds the shard to tickets (_rank, _n), where _n numbers a source's tickets from 0 in their permuted order."""
    spark, nodes = ticket.sparkSession, min(nodes, shards)
    quotas = ticket.groupBy("_rank").agg(F.count("*").alias("n")).orderBy("_rank").collect()
    widths = [shards * (k + 1) // nodes - shards * k // nodes for k in range(nodes)]
    counts = _tree(np.array([r["n"] for r in quotas], np.int64), widths, np.random.Generator(np.random.PCG64(seed)))
    ends = counts.cumsum(axis=0)
    rows = [
        (r["_rank"], k, widths[k], shards * k // nodes, int(ends[k, i] - counts[k, i]), int(ends[k, i]), -(-r["n"] // nodes))
        for i, r in enumerate(quotas) for k in range(nodes) if counts[k, i]
    ]
    # a source's runs are found by steps of their mean length, so that no ticket meets all runs of its source
    runs = spark.createDataFrame(rows, "_r int, _node int, _width int, _first int, _from bigint, _to bigint, _step bigint")
    steps = runs.select("_r", "_step").distinct()
    runs = runs.withColumn("_bucket", F.explode(F.expr("sequence(_from div _step, (_to - 1) div _step)"))).drop("_step")
    hit = (F.col("_rank") == F.col("_r")) & (F.floor(F.col("_n") / F.col("_step")) == F.col("_bucket")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to"))
    few = _small(len(rows))
    found = ticket.join(few(steps.withColumnRenamed("_r", "_rank")), "_rank").join(few(runs), hit)
    order = Window.partitionBy("_node").orderBy(F.xxhash64("_rank", "_n", F.lit(seed)), "_rank", "_n")
    total = spark.createDataFrame([(k, int(counts[k].sum())) for k in range(nodes)], "_node int, _tickets bigint")
    found = found.join(F.broadcast(total), "_node").withColumn("_at", F.row_number().over(order) - 1)
    return found.withColumn("shard", (F.col("_first") + F.floor(F.col("_at") * F.col("_width") / F.col("_tickets"))).cast("int"))


def plan(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The staged sizes (doc_id, source, size), the sources and the tickets.

    A ticket is (source, block, shard, cut, only): the mix takes the block's
    documents once, those with an order key up to ``cut`` if it isn't null, or
    those with the order key ``only`` if that isn't null.
    """
    spark = docs.sparkSession
    sizes = staged(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    sources = staged(targets(sizes), "targets")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = shards or max(SHARDS, int(-(-SHARE * total // SHARD_WORDS)))
    blocks = blocks or max(BLOCKS, BLOCKS_PER_SHARD * shards)
    share = F.ceil(F.lit(blocks) * F.col("source_size") / F.lit(max(1, total)))
    sources = staged(sources.withColumn("_blocks", F.greatest(F.lit(1), F.least(share, F.col("docs"))).cast("int")), "sources")
    small, n = _small(blocks + sources.count()), sources.count()
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(LIMIT))).otherwise(0).cast("int")
    mixed = sources.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    known = mixed.select(F.col("source").alias("_s"), "_rank", "_blocks", "_rest", "_whole")
    dealt = _with_source(sizes, known, n).select("_rank", "_rest", "_whole", _block(seed).alias("_block"), _key(seed).alias("_key"), "size")
    runs = dealt.groupBy("_rank", "_block", "_rest", "_whole").agg(F.sum("size").alias("_words"))
    runs = staged(_running(runs, blocks, seed), "blocks")
    edge = runs.where("_before < _rest and _before + _words > _rest")
    within = Window.partitionBy("_rank", "_block").orderBy("_key")
    last = dealt.drop("_rest", "_whole").join(small(edge.select("_rank", "_block", "_before", "_rest")), ["_rank", "_block"])
    last = last.withColumn("_sum", F.col("_before") + F.sum("size").over(within.rangeBetween(Window.unboundedPreceding, 0)))
    cuts = last.where("_sum <= _rest").groupBy("_rank", "_block").agg(F.max("_key").alias("_cut"))
    runs = runs.join(small(cuts), ["_rank", "_block"], "left")
    runs = runs.withColumn("_cut", F.when(F.expr("_before + _words > _rest"), F.coalesce("_cut", F.lit(-(2**63)))))
    open_ = runs.where("_before + _words > _rest")
    filled = edge.select("_rank", "_before").join(last.where("_sum <= _rest").groupBy("_rank").agg(F.max("_sum").alias("_sum")), "_rank", "left")
    filled = filled.select("_rank", F.coalesce("_sum", "_before").alias("_got"))
    left = dealt.drop("_whole").join(small(open_.select("_rank", "_block", "_cut")), ["_rank", "_block"]).where("size > 0 and _key > _cut")
    left = left.join(F.broadcast(filled) if n <= BROADCAST else filled, "_rank")
    miss = F.abs(F.col("_rest") - F.col("_got") - F.col("size"))
    top = left.where(miss < F.col("_rest") - F.col("_got")).groupBy("_rank").agg(F.min_by(F.struct("_block", "_key"), F.struct(miss, "_key")).alias("_top"))
    # A source's tickets are numbered pass by pass: all blocks in their permuted order, then those of the part, then the one document.
    counts = runs.groupBy("_rank").agg(F.count("*").alias("_all"), F.sum(F.when(F.expr("_before < _rest"), 1).otherwise(0)).alias("_part"), F.max("_whole").alias("_whole"))
    counts = staged(counts, "counts")
    by_source = F.broadcast(counts) if n <= BROADCAST else counts
    runs = runs.drop("_whole").join(by_source, "_rank")
    none = F.lit(None).cast("bigint")
    full = runs.withColumn("_pass", F.explode(F.expr("filter(sequence(0, _whole), x -> x < _whole)"))).withColumn("_cut", none)
    part = runs.where("_before < _rest").withColumn("_pass", F.col("_whole"))
    both = full.unionByName(part).select("_rank", "_block", "_cut", none.alias("_only"), "_pass", (F.col("_pass") * F.col("_all") + F.col("_place")).alias("_n"))
    top = top.join(counts, "_rank").select(
        "_rank", F.col("_top._block").alias("_block"), none.alias("_cut"), F.col("_top._key").alias("_only"), F.col("_whole").alias("_pass"), (F.col("_whole") * F.col("_all") + F.col("_part")).alias("_n")
    )
    ticket = staged(both.unionByName(top), "tickets")
    named = sources.select("_rank", "source", "_blocks")
    tickets = deal(ticket, shards, seed).join(F.broadcast(named) if n <= BROADCAST else named, "_rank")
    return sizes, sources, staged(tickets.select("source", "_rank", "_blocks", "_block", "shard", "_pass", "_cut", "_only"), "dealt")


def _keyed(rows: DataFrame, sources: DataFrame, seed: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with their source's numbers, block and order key, and the hint for tables of blocks."""
    n, blocks = sources.agg(F.count("*"), F.coalesce(F.sum("_blocks"), F.lit(0))).first()
    known = sources.select(F.col("source").alias("_s"), "_rank", "_blocks", "source_size", "target")
    return _with_source(rows, known, n).withColumns({"_block": _block(seed), "_key": _key(seed)}), _small(n + blocks)


def mix(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 8) -> DataFrame:
    """The mixed documents, as structs ``_doc``, with their shard and the key that orders them inside it.

    A document that is taken twice comes twice.
    """
    _, sources, tickets = plan(docs, shards, blocks, seed)
    wide, small = _keyed(docs.select(F.struct("*").alias("_doc"), "doc_id", "source"), sources, seed)
    drawn = wide.join(small(tickets.select("_rank", "_block", "shard", "_pass", "_cut", "_only")), ["_rank", "_block"]).where("(_cut is null or _key <= _cut) and (_only is null or _key = _only)")
    return drawn.select("_doc", "shard", F.xxhash64("doc_id", "_pass", F.lit(seed)).alias("shuffle_key"))


def mixed(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 8) -> DataFrame:
    """The mixed documents with their own columns, each shard together and in its shuffled order."""
    laid = mix(docs, shards, blocks, seed).repartition("shard").sortWithinPartitions("shard", "shuffle_key")
    return laid.select("_doc.*")


def taken(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes, sources, tickets = plan(docs, shards, blocks, seed)
    uses = tickets.groupBy("_rank", "_block").agg(F.sum(F.when(F.expr("_cut is null and _only is null"), 1).otherwise(0)).alias("_all"), F.max("_cut").alias("_upto"), F.max("_only").alias("_also"))
    keyed, small = _keyed(sizes, sources, seed)
    rows = keyed.join(small(uses), ["_rank", "_block"], "left")
    times = F.coalesce("_all", F.lit(0)) + F.when(F.expr("_key <= _upto or _key = _also"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"))
