"""Sharding by a k-d tree over document metadata (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import buckets_for, numbered, released, stored, table

#: Bits of a sort key looked at in one pass: at most 2**BITS counters per open node.
BITS = 16
#: Bits of a sort key: coordinate above, checksum of the text below.
KEY_BITS, GRAIN_BITS = 48, 32
#: A cut may miss its weight by this part of a leaf to keep equal texts together.
SLACK = 0.01


def _literal_map(col: Column, values: dict[int, object], kind: str) -> Column:
    """Value by node number, null where a node has none: one literal array, as the tree has fewer than twice as many nodes as shards."""
    if not values:
        return F.lit(None).cast(kind)
    size = max(values) + 1
    return F.get(F.array(*[F.lit(values.get(n)).cast(kind) for n in range(size)]), col)


def _locate(rows: DataFrame, key: str, bits: int, goal: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Per node: (key k, weight below k, weight at k), k the key whose weight range holds the node's goal.

    A radix descent: every pass sums weights by the next ``BITS`` bits of the keys that still agree with
    the prefix found so far, so a pass is one map-side combined aggregate whatever the row count.
    """
    found = dict.fromkeys(goal, 0)
    below = dict.fromkeys(goal, 0)
    at: dict[int, int] = {}
    for shift in range(bits - BITS, -1, -BITS):
        open_rows = rows
        if shift < bits - BITS:
            prefix = _literal_map(F.col("node"), found, "long")
            open_rows = rows.where(F.shiftright(key, shift + BITS) == prefix)
        digit = F.shiftright(key, shift).bitwiseAND(F.lit((1 << BITS) - 1))
        sums = open_rows.where(F.col("node").isin(list(goal))).groupBy("node", digit.alias("d")).agg(F.sum("w").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("node").orderBy("d"))
        target = _literal_map(F.col("node"), {n: goal[n] - below[n] for n in goal}, "decimal(38,0)")
        total = F.sum("s").over(Window.partitionBy("node"))
        cut = (
            sums.select("node", "d", "s", upto.alias("c"), total.alias("t"))
            .where((F.col("c") > target) | (F.col("c") == F.col("t")))
            .groupBy("node")
            .agg(F.min("d").alias("d"), F.min_by("s", "d").alias("s"), F.min_by("c", "d").alias("c"))
            .collect()
        )
        for r in cut:  # one row for each open node
            found[r.node] = (found[r.node] << BITS) | int(r.d)
            below[r.node] += int(r.c - r.s)
            at[r.node] = int(r.s)
    return {n: (found[n], below[n], at[n]) for n in goal if n in at}


def kd_shards(
    docs: DataFrame, ident: str, weight: Column, dims: dict[str, Column], tie: Column, shards: int
) -> DataFrame:
    """Columns (_id, w, tie, shard): every row of ``docs`` in one of ``shards`` leaves of near equal weight.

    Each node that still stands for k > 1 shards is cut on the dimension in which its rows spread
    widest, relative to that dimension's overall range, at the weighted quantile floor(k/2)/k, found
    exactly by distributed aggregates.  With equal shares the leaves reach total weight / shards; for a
    target in bytes pass ``shards = ceil(total / target)``.  Rows with equal coordinate and equal ``tie``
    (equal texts) stay together unless that would put the cut off by more than ``SLACK`` of a leaf: then
    the group is cut by a hash of its id.  So neither a hot value nor a hot group of copies unbalances it.

    ``dims`` are expressions of non-negative numbers below 2**16 (null counts as 0), ``tie`` of ones below 2**32.  Nulls in ``ident``
    are allowed, repeated ids too; rows alike in id, coordinates and tie stay together.  An empty table
    gives an empty result.
    """
    narrow = stored(
        docs.select(
            F.col(ident).alias("_id"), weight.cast("long").alias("w"), tie.cast("long").alias("tie"),
            *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"d_{n}") for n, c in dims.items()],
        ),
        "kd",
    )
    names = [f"d_{n}" for n in dims]
    rows = narrow.withColumn("node", F.lit(0))
    leaves = {0: (0, shards)}  # node -> (first shard, shards)
    spread: dict[str, int] = {}
    last = narrow
    while any(k > 1 for _, k in leaves.values()):
        open_nodes = [n for n, (_, k) in leaves.items() if k > 1]
        stats = (
            rows.where(F.col("node").isin(open_nodes)).groupBy("node")
            .agg(F.sum("w").alias("w"), *[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names])
            .collect()
        )  # one row for each open node
        widest, goal, leaf = {}, {}, {}
        for r in stats:
            wide = {c: r[f"hi_{c}"] - r[f"lo_{c}"] for c in names}
            spread = spread or {c: max(v, 1) for c, v in wide.items()}
            widest[r.node] = max(names, key=lambda c: wide[c] / spread[c])
            k = leaves[r.node][1]
            goal[r.node], leaf[r.node] = r.w * (k // 2) // k, r.w / k
        if not stats:
            break
        along = _literal_map(F.col("node"), {n: names.index(c) for n, c in widest.items()}, "int")
        coordinate = F.get(F.array(*names), F.coalesce(along, F.lit(0)))
        # coordinate above, tie below: an order in which equal texts are neighbours
        keyed = stored(rows.withColumn("key", F.shiftleft(coordinate, 32).bitwiseOR(F.col("tie"))), "kd")
        released(last)
        last = keyed
        cuts, split = {}, {}
        for n, (key, low, own) in _locate(keyed, "key", KEY_BITS, goal).items():
            first = goal[n] - low <= low + own - goal[n]  # the border nearer to the goal
            off = min(goal[n] - low, low + own - goal[n])
            cuts[n] = key if first else key + 1
            if off > SLACK * leaf[n]:
                split[n] = (key, goal[n] - low)
        grain = F.shiftrightunsigned(F.xxhash64("_id"), 64 - GRAIN_BITS)
        inner: dict[int, int] = {}
        if split:
            held = keyed.where(F.col("key") == _literal_map(F.col("node"), {n: k for n, (k, _) in split.items()}, "long"))
            for n, (g, low, own) in _locate(held.withColumn("grain", grain), "grain", GRAIN_BITS, {n: t for n, (_, t) in split.items()}).items():
                inner[n] = g if split[n][1] - low <= low + own - split[n][1] else g + 1
                cuts[n] = split[n][0]
        right = F.col("key") >= _literal_map(F.col("node"), cuts, "long")
        inside = F.col("key") == _literal_map(F.col("node"), {n: split[n][0] for n in inner}, "long")
        right = F.when(inside, grain >= _literal_map(F.col("node"), inner, "long")).otherwise(right)
        nodes, grown = {}, {}
        for n, (at, k) in leaves.items():
            if k > 1 and n in cuts:
                nodes[2 * n + 1], nodes[2 * n + 2] = (at, k // 2), (at + k // 2, k - k // 2)
                grown[n] = 2 * n + 1
            else:
                nodes[n] = (at, k if n not in open_nodes else 1)
        step = keyed.withColumn(
            "node", F.coalesce(_literal_map(F.col("node"), grown, "int") + right.cast("int"), F.col("node"))
        ).drop("key")
        rows, leaves = step, nodes
    shard = _literal_map(F.col("node"), {n: at for n, (at, _) in leaves.items()}, "int")
    return rows.select("_id", "w", "tie", *names, shard.alias("shard"))


def op1_kd_shards(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in 24 shards of near equal bytes (law ``bytes``).

    Dimensions: bytes on a log scale, characters a word on a log scale, and a checksum as the direction
    along which rows spread evenly.  All three are functions of the text, so equal texts have equal
    coordinates.  A null text has no bytes and size 8; a null doc_id is a value like any other.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    crc = F.crc32(text.cast("binary"))
    words = F.length(F.regexp_replace(text, "[^ \n\t]", "")) + 1
    placed = kd_shards(
        docs, "doc_id", size,
        {"bytes": F.log2(size) * 2048, "letters": F.log2(F.length(text) / words + 1) * 2048, "crc": F.shiftright(crc, 16)},
        crc, shards,
    )
    placed = stored(placed.select(F.col("_id").alias("doc_id"), F.col("w").alias("size"), F.col("tie").alias("text_crc32"), "shard"), "placed")
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32"], buckets_for(placed.count(), 200_000), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op1_kd_shards": op1_kd_shards}
ORACLE: dict[str, str] = {}
