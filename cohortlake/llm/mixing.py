"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import stored, table, unused

#: Tokens that one block of a source holds, about; a source has as many blocks as its tokens ask for.
BLOCK_TOKENS = 250_000
#: Passes over a source's documents that a mix may ask for, unless a caller says otherwise.
REPEATS = 1.5
SEED = 11


@dataclass(frozen=True)
class Mix:
    """The exponent found, and per source its tokens, weight and budget of tokens."""

    exponent: float
    tokens: dict[str | None, int]
    weights: dict[str | None, float]
    budgets: dict[str | None, int]


def tempered(tokens: dict, exponent: float) -> dict:
    """Normalised powers of the token shares."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: v / norm for s, v in raw.items()} if norm else raw


def _bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent for which ``holds``; it holds at ``high`` and is monotone."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def solve(tokens: dict, budget: int | None = None, entropy: float | None = None, repeats: float | None = REPEATS) -> Mix:
    """Find the exponent between 0 (equal weights) and 1 (shares as they are).

    With ``entropy`` (part of the largest possible, log of the number of sources) the weights get that
    entropy, or the nearest one that exponents from 0 to 1 give.  With ``repeats`` no source is seen more
    often than that; of both, the larger exponent holds.  With neither, weights are equal.

    ``budget`` is the number of tokens of the mix.  None asks for the smallest mix in which every document
    occurs: the source with the least weight for its tokens is seen exactly once, the others more often.
    """
    filled = {s: n for s, n in tokens.items() if n}
    if not filled:
        return Mix(1.0, dict(tokens), dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))

    def total(weights: dict) -> float:
        return budget if budget is not None else max(filled[s] / weights[s] for s in filled)

    def seen(x: float) -> float:
        w = tempered(filled, x)
        return max(w[s] * total(w) / filled[s] for s in filled)

    exponent = 0.0
    if entropy is not None and len(filled) > 1:
        bits = lambda w: -sum(v * math.log(v) for v in w.values() if v) / math.log(len(w))
        exponent = max(exponent, _bisect(lambda x: bits(tempered(filled, x)) <= entropy))
    if repeats is not None:
        limit = max(repeats, seen(1.0)) * (1 + 1e-12)  # a budget may need more passes than the limit, whatever the weights
        exponent = max(exponent, _bisect(lambda x: seen(x) <= limit))
    weights = tempered(filled, exponent)
    size = total(weights)
    budgets = {s: round(weights[s] * size) for s in filled}
    if budget is None:
        budgets = {s: max(b, filled[s]) for s, b in budgets.items()}
    blank = {s: 0 for s in tokens if s not in filled}
    return Mix(exponent, dict(tokens), weights | dict.fromkeys(blank, 0.0), budgets | blank)


def _draw(*parts: Column | int | str) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts])


def mixed(
    docs: DataFrame, tokens: Column, source: str = "source", ident: str = "doc_id",
    budget: int | None = None, entropy: float | None = None, repeats: float | None = REPEATS, seed: int = SEED,
) -> DataFrame:
    """The rows of the mix: (_id, _source, _tokens, pass, block, start, weight, budget), start in tokens of its source.

    Every source's documents are dealt to blocks by a hash; in each pass the blocks come in a new order,
    and the documents inside a block too.  A source takes whole passes and then the head of the next
    permutation: all rows that start before its budget ends.  So its tokens exceed the budget by less than
    one document.  Budgets are kept by running sums over blocks and inside blocks, and a block has a
    bounded number of tokens (or one document), so no source is sorted as a whole.

    Token counts below 1 or null count as 1, as every document takes up some room; a null source is a
    source of its own.  Rows that repeat are documents of their own.  An empty table gives an empty mix.
    The driver reads one row per source.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.col(ident).alias("_id"), F.col(source).cast("string").alias("_source"),
            F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1)).alias("_tokens"),
        ), "mix",
    )
    sums = {r["_source"]: r["t"] for r in rows.groupBy("_source").agg(F.sum("_tokens").alias("t")).collect()}
    mix = solve(sums, budget, entropy, repeats)
    plan = spark.createDataFrame(
        [(s, float(mix.weights[s]), int(mix.budgets[s]), int(sums[s]), max(1, -(-sums[s] // BLOCK_TOKENS))) for s in sums],
        "_s string, weight double, budget long, _total long, _blocks long",
    )
    blocked = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn(
        "block", F.pmod(_draw(seed, F.col("_id"), F.col("_tokens")), "_blocks").cast("int")
    )
    # blocks with their place in every pass that the budget reaches
    passes = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("budget") / F.col("_total")) - 1, F.lit(0)).cast("int")))
    blocks = blocked.groupBy("_source", "block").agg(
        F.sum("_tokens").alias("_size"), F.first("budget").alias("budget"), F.first("_total").alias("_total"), F.first("weight").alias("weight")
    )
    order = [_draw(seed, F.col("pass"), F.col("block")), F.col("block")]
    earlier = Window.partitionBy("_source", "pass").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocks.withColumn("pass", passes)
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)) + F.col("pass") * F.col("_total"))
        .where(F.col("_before") < F.col("budget"))
        .select(F.col("_source").alias("_b_source"), F.col("block").alias("_b_block"), "pass", "_before")
    )
    met = blocked.join(placed, F.col("_source").eqNullSafe(F.col("_b_source")) & (F.col("block") == F.col("_b_block")))
    inside = (
        Window.partitionBy("_source", "block", "pass")
        .orderBy(_draw(seed, F.col("pass"), F.col("_id")), "_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_before") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))
    return met.withColumn("start", start).where(F.col("start") < F.col("budget")).select(
        "_id", "_source", "_tokens", "pass", "block", "start", "weight", "budget"
    )


def text_tokens(text: str = "text") -> Column:
    """Words of a text, at least 1: what a document counts in the mix when no tokenizer is given."""
    return F.size(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\n\r\f\x0b]+"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest mix that holds every document and repeats none more than about one and a half times; one row per occurrence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixed(docs, text_tokens())
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").cast("long").alias("tokens"),
        "pass", "block", F.col("start").cast("long").alias("start"), "weight", "budget",
    )


def remixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, with their columns; a document that is seen twice is two rows."""
    names, key, times, copy = list(docs.columns), *(unused(docs, n) for n in ("_key", "_times", "_copy"))
    seen = mixed(docs, text_tokens()).groupBy("_id").agg(F.count("*").alias("_n"))
    own = docs.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("_rows"))
    # rows that repeat an id share its occurrences: as whole as before, and each at least once
    each = F.greatest(F.round(F.col("_n") / F.col("_rows")).cast("int"), F.lit(1))
    copies = own.join(seen, F.col(key).eqNullSafe(F.col("_id"))).select(key, each.alias(times))
    met = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(key)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)


QUERIES = {"op10_temperature_mix": op10_temperature_mix}
ORACLE: dict[str, str] = {}
