"""Operator 7, quality rules combined by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts
of vote patterns estimates how often each rule is right on good and on bad
documents and the share of good ones, without any labels. A document is kept if
it doesn't fail the base rule and its posterior probability of being good is at
least one half; no rule has a veto of its own.

Only DataFrame functions run on the data. A pattern has one of three votes for
each of the seven rules, so the driver sees at most 3**7 rows, whatever the input.

Defined cases: null text has no words; a text without words fails the base rule;
a text of any length is measured whole; a posterior of exactly one half keeps a
document; repeated rows are judged alike, and each counts in the estimate; an
empty table gives an empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, staged

WINDOW = 8
ROUNDS = 30
#: Beta prior of a rule's accuracy: weight of PRIOR_N votes at PRIOR_ACC, so that silent or constant rules stay weak.
PRIOR_ACC, PRIOR_N = 0.8, 50.0


def _repeat_words() -> Column:
    """Words inside 8-word windows that occur twice or more, from the array _windows of window hashes.

    The windows of one hash stand side by side once sorted with their places.
    The places of repeated ones, in order, cover min(8, gap) words each.
    """
    return F.expr(f"""
        case when size(_windows) < 2 or size(array_distinct(_windows)) = size(_windows) then 0L else
        aggregate(
          array_sort(filter(transform(
            array(array_sort(transform(_windows, (h, i) -> struct(h as h, i as i)))),
            s -> transform(s, (x, k) -> case
              when (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h) then x.i end))[0], p -> p is not null)),
          struct(cast(0 as bigint) as n, cast(-{WINDOW} as int) as e),
          (a, p) -> struct(a.n + {WINDOW} - greatest(0, a.e + {WINDOW} - p) as n, p as e),
          a -> a.n) end""")


def _windows(hashed: DataFrame) -> DataFrame:
    """_windows: a hash of each run of WINDOW words, from _hashes, by hashing neighbours at distance 1, 2 and 4."""
    hashed = hashed.withColumn("_windows", F.col("_hashes"))
    for k in (1, 2, 4):
        pairs = f"zip_with(slice(_windows, 1, size(_windows) - {k}), slice(_windows, {k + 1}, size(_windows)), (a, b) -> xxhash64(a, b))"
        hashed = hashed.withColumn("_windows", F.expr(f"case when size(_windows) <= {k} then array() else {pairs} end"))
    return hashed


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract and what the rules look at."""
    blank = " \t\n\x0b\x0c\r"
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text = text.withColumn("_trim", F.btrim("_text", F.lit(blank)))
    text = text.select(
        "doc_id",
        F.when(F.col("_trim") == "", F.expr("array()")).otherwise(F.split("_trim", SPACES)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(blank))) > 0).alias("_lines"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("bigint").alias("_upper"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("bigint").alias("_letters"),
    )
    hashed = text.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    hashed = _windows(hashed.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint")))
    return hashed.select(
        "doc_id", F.size("_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("_n_lines"), F.size(F.array_distinct("_hashes")).cast("bigint").alias("_n_distinct"), "_upper", "_letters",
    )


def votes() -> dict[str, tuple[Column, Column]]:
    """Of each rule: when it votes good and when it votes bad; it abstains otherwise.

    Four rules only speak against a document: long texts, distinct lines and
    ordinary words say little for it.
    """
    c, n, never = F.col, F.col("n_words"), F.lit(False)
    return {
        "length": (never, n < 20),
        "symbols": (100 * c("n_symbols") <= c("word_chars"), 100 * c("n_symbols") > 8 * c("word_chars")),
        "lines": (never, 100 * c("n_dup_lines") > 30 * c("_n_lines")),
        "windows": (never, 100 * c("n_repeat_words") > 20 * n),
        "word_size": (never, (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n) | (n == 0)),
        "shouting": (10 * c("_upper") <= 2 * c("_letters"), 10 * c("_upper") > 5 * c("_letters")),
        "letters": (100 * c("_letters") >= 92 * c("word_chars"), 10 * c("_letters") < 7 * c("word_chars")),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """EM over (votes, documents) pairs: the posterior of good for each pattern.

    Votes are 1, -1 and 0. A rule has an accuracy on good and one on bad
    documents, given that it votes; both are held at 0.55 or more, since a rule
    is written to point to its class. It starts where a document without a bad
    vote is likely good, and each bad vote makes that much less likely.
    """
    total = sum(n for _, n in patterns)
    good = {v: 0.9 * 0.25 ** v.count(-1) for v, _ in patterns}
    for _ in range(rounds if total else 0):
        share = min(0.99, max(0.01, (sum(good[v] * n for v, n in patterns) + 1) / (total + 2)))
        right = []
        for k in range(rules):
            g = [(good[v] * n, v[k]) for v, n in patterns if v[k]]
            b = [((1 - good[v]) * n, v[k]) for v, n in patterns if v[k]]
            right.append(tuple(
                min(0.99, max(0.55, (sum(w for w, x in rows if x == sign) + PRIOR_ACC * PRIOR_N) / (sum(w for w, _ in rows) + PRIOR_N)))
                for rows, sign in ((g, 1), (b, -1))
            ))
        for v, _ in patterns:
            odds = math.log(share / (1 - share))
            for x, (pg, pb) in zip(v, right, strict=True):
                odds += x and (math.log(pg / (1 - pb)) if x > 0 else math.log((1 - pg) / pb))
            good[v] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return good


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, quality (posterior of good)."""
    spark = docs.sparkSession
    rules = votes()
    seen = measures(docs)
    vote = [F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0)).alias(f"v_{k}") for k, (good, bad) in rules.items()]
    failed = ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed")
    seen = staged(seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, *vote), "measures")
    names = [f"v_{k}" for k in rules]
    counts = [(tuple(r[k] for k in names), r["n"]) for r in seen.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    good = estimate(sorted(counts), len(names))
    known = spark.createDataFrame([(*v, p) for v, p in good.items()], ", ".join(f"{k} int" for k in names) + ", quality double")
    out = seen.join(F.broadcast(known), names, "left")
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality")
