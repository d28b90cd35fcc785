"""N-gram Jaccard join by rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cohortlake.llm.common import components, lean, small_batches, stored, table, tidy, unused
from cohortlake.llm.textkit import LOWER, SPACE, chunks, mixed, runs_hashed, word_bounds

WORDS = 5
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles are counted in 2**COUNT_BITS cells (one byte a cell once they are ranks), sent around in parts.
COUNT_BITS, PART_BITS = 24, 16
#: Partial counts that one task adds up.
FAN_IN = 64
#: Nodes that may share a prefix shingle before they are thinned out round a pivot, and how often that is done.
CROWD, ROUNDS = 64, 3

#: Longs of a set's parity bitmap, by the size up to which it is used.
BITMAPS = ((2048, 16), (8192, 64), (None, 256))
#: Bits of the filter that tells tasks which sets are wanted (16 MB), and of its parts.
WANTED_BITS, WANTED_PART = 27, 16

_STEP = np.uint64(0xA0761D6478BD642F | 1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, edges, hashes): the distinct shingles of text i, sorted, are hashes[edges[i]:edges[i + 1]].

    A text with one to four words has one shingle, its whole sequence; one without words has none.
    """
    for low, high, data, offsets in chunks(column):
        lowered = LOWER[data]
        starts, ends, of = word_bounds((~SPACE[lowered]).astype(np.uint8), offsets)
        words = runs_hashed(lowered, starts, ends)
        count = np.bincount(of, minlength=high - low)
        first = np.concatenate([[0], np.cumsum(count)])
        m = max(len(words) - WORDS + 1, 0)
        value = np.zeros(m, dtype=np.uint64)
        for j in range(WORDS):
            value = value * _STEP + words[j : m + j]
        whole = (of[:m] == of[WORDS - 1 : WORDS - 1 + m]) if m else np.zeros(0, bool)
        text, hashed = of[:m][whole], mixed(value[whole])
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            tail = np.zeros(len(short), dtype=np.uint64)
            for j in range(WORDS - 1):
                has = count[short] > j
                tail[has] = tail[has] * _STEP + words[first[short[has]] + j]
            text = np.concatenate([text, short])
            hashed = np.concatenate([hashed, mixed(tail + count[short].astype(np.uint64))])
        order = np.lexsort((hashed, text))
        text, hashed = text[order], hashed[order]
        fresh = np.ones(len(text), dtype=bool)
        fresh[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
        text, hashed = text[fresh], hashed[fresh]
        yield low, high, np.searchsorted(text, np.arange(high - low + 1)), hashed


def _nodes(edges: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A fingerprint of every set (64 bits); equal sets are one node of the join."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashed ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(edges).astype(np.uint64)
    return mixed((total[edges[1:]] - total[edges[:-1]]) + size * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: every shingle flips one bit.  Where two bitmaps differ, so do the sets."""
    longs = next(w for most, w in BITMAPS if most is None or len(own) <= most)
    odd = np.bincount((own >> np.uint64(8)) % np.uint64(64 * longs), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row (doc_id, row, n, node, bits) per document, and per task the counts of its shingles.

    A count row is (part, body): the low bytes of 2**PART_BITS cells, then the cells of 255 and more with
    what they hold beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, node, bits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for low, high, edges, hashed in shingle_sets(batch["_text"]):
                n[low:high], node[low:high] = np.diff(edges), _nodes(edges, hashed)
                bits += [bitmap(hashed[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                np.add.at(cells, (hashed >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["_row"], pa.array(n), pa.array(node, mask=n == 0), pa.array(bits, pa.list_(pa.int64())), none, pa.nulls(batch.num_rows, pa.binary())],
                names=names,
            )
        parts, bodies = [], []
        for part, own in enumerate(cells.reshape(-1, 1 << PART_BITS)):
            if own.any():
                parts.append(part)
                bodies.append(_packed(own))
        m = len(parts)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.list_(pa.int64())), pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())],
            names=names,
        )

    names = ["doc_id", "row", "n", "node", "bits", "part", "body"]
    return docs.mapInArrow(lean(run), "doc_id long, row long, n long, node long, bits array<long>, part int, body binary")


def _packed(own: np.ndarray) -> bytes:
    low = np.minimum(own, 255).astype(np.uint8)
    over = np.flatnonzero(own >= 255).astype("<u4")
    body = low.tobytes() + over.tobytes() + (own[over] - 255).astype("<u4").tobytes()
    return zstandard.compress(body, 1)


def _unpacked(body: bytes) -> np.ndarray:
    raw = zstandard.decompress(body)
    own = np.frombuffer(raw, np.uint8, 1 << PART_BITS).astype(np.uint32)
    rest = np.frombuffer(raw, "<u4", offset=1 << PART_BITS)
    own[rest[: len(rest) // 2]] += rest[len(rest) // 2 :]
    return own


def rare_first(counts: DataFrame, tasks: int) -> np.ndarray:
    """The rank of every cell: 8 * log2(1 + shingles counted there), one byte each, so of fixed size.

    Partial counts are added in two levels, at most ``FAN_IN`` (or the root of their number) at a time.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PART_BITS, dtype=np.uint32)
        for body in pdf["body"]:
            own = _unpacked(body)
            total = np.where(total > ~own, np.uint32(0xFFFFFFFF), total + own)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].astype("int32"), "body": [_packed(total)]})

    salts = max(1, -(-tasks // FAN_IN))
    if salts > 1:
        counts = counts.groupBy("part", F.pmod(F.xxhash64("body"), F.lit(salts))).applyInPandas(add, "part int, body binary")
    ranks = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for r in counts.groupBy("part").applyInPandas(add, "part int, body binary").collect():  # a fixed number of cells
        own = np.minimum(np.round(8 * np.log2(1.0 + _unpacked(r["body"]))), 255)
        ranks[r["part"] << PART_BITS : (r["part"] + 1) << PART_BITS] = own
    return ranks


def prefix_length(n):
    """Shingles of a set of n of which one at least is shared with any set that links to it."""
    return n - -(-PERCENT * n // 100) + 1


def _prefixes(texts: DataFrame, ranks) -> DataFrame:
    """(token, node, n, pos): the rarest shingles of every distinct set of a task; pos counts from 0 in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = ranks.value
        for batch in batches:
            for _, _, edges, hashed in shingle_sets(batch["_text"]):
                node, size = _nodes(edges, hashed), np.diff(edges)
                once = np.zeros(len(node), dtype=bool)
                once[np.unique(node, return_index=True)[1]] = True
                once &= size > 0
                text = np.repeat(np.arange(len(size)), size)
                keep = once[text]
                text, own = text[keep], hashed[keep]
                rank = order_of[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.lexsort((own, rank, text))
                text, own = text[order], own[order]
                pos = np.arange(len(text)) - np.searchsorted(text, text)
                front = pos < prefix_length(size[text])
                text, own, pos = text[front], own[front], pos[front]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(node[text]), pa.array(size[text].astype(np.int32)), pa.array(pos.astype(np.int32))],
                    names=["token", "node", "n", "pos"],
                )

    return texts.mapInArrow(lean(run), "token long, node long, n int, pos int")


def _wanted(hashes: DataFrame) -> np.ndarray:
    """A bit for every value that the upper bits of a wanted hash (the only column) take: a filter of fixed size."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << WANTED_PART, dtype=bool)
        bits[pdf["cell"].to_numpy() & ((1 << WANTED_PART) - 1)] = True
        return pd.DataFrame({"part": [int(pdf["cell"].iloc[0]) >> WANTED_PART], "body": [np.packbits(bits).tobytes()]})

    cell = F.shiftrightunsigned(hashes.columns[0], 64 - WANTED_BITS).alias("cell")
    marked = hashes.select(cell).distinct().groupBy(F.shiftright("cell", WANTED_PART)).applyInPandas(mark, "part int, body binary")
    out = np.zeros(1 << (WANTED_BITS - 3), dtype=np.uint8).reshape(-1, 1 << (WANTED_PART - 3))
    for r in marked.collect():  # at most as many rows as the filter has parts
        out[r["part"]] = np.frombuffer(r["body"], np.uint8)
    return out.ravel()


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.view(np.uint64) >> np.uint64(64 - WANTED_BITS)
    return (marks[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _sets(texts: DataFrame, wanted, nodes) -> DataFrame:
    """(node, shingles): sorted shingle hashes of all nodes that pass the filter; the texts themselves stay where they are.

    ``texts`` holds _key, a hash of the id, and _text.  Only texts whose key passes ``wanted`` are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_marked(wanted.value, batch["_key"].to_numpy())))
            seen: set[int] = set()
            for _, _, edges, hashed in shingle_sets(some["_text"]):
                node, size = _nodes(edges, hashed), np.diff(edges)
                hit = _marked(nodes.value, node)
                good = [i for i in np.flatnonzero(hit & (size > 0)) if not (node[i] in seen or seen.add(node[i]))]
                sets = [hashed[edges[i] : edges[i + 1]].tobytes() for i in good]
                yield pa.RecordBatch.from_arrays([pa.array(node[good]), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles binary")


@F.pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shingles in common, or -1 where the suffix filter shows that two sets can't link."""
    out = np.empty(len(a), dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        out[i] = np.intersect1d(x, y, assume_unique=True).size
    return pd.Series(out)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the shingles that two sorted sets share: cut both at a middle value, bound each side."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    middle = x[len(x) // 2]
    i, j = len(x) // 2, int(np.searchsorted(y, middle))
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


@F.pandas_udf(LongType())
def _shared_if_close(a: pd.Series, b: pd.Series) -> pd.Series:
    """As :func:`_shared`, but -1 where the suffix filter shows that two sets can't link."""
    out = np.empty(len(a), dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        most = suffix_bound(x, y)
        close = 100 * most >= PERCENT * (len(x) + len(y) - most)
        out[i] = np.intersect1d(x, y, assume_unique=True).size if close else -1
    return pd.Series(out)


def _most(x: str, y: str, n: str, m: str):
    """Upper bound of the shingles that two sets share: every bit in which their bitmaps differ is a shingle of one only.

    Null where the bitmaps have different lengths.
    """
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return F.floor((F.col(n) + F.col(m) - differ) / 2).cast("long")


def _may_link(most, n: str, m: str):
    return F.coalesce(100 * most >= PERCENT * (F.col(n) + F.col(m) - most), F.lit(True))


def _close_in_size(n: str, m: str):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _placed(n: str, m: str, pos: str, other: str):
    """Length and positional filter: the first shingle that both prefixes share has none before it in common."""
    most = 1 + F.least(F.col(n) - 1 - F.col(pos), F.col(m) - 1 - F.col(other))
    return _close_in_size(n, m) & (100 * most >= PERCENT * (F.col(n) + F.col(m) - most))


class _Verifier:
    """Similarities of pairs of nodes: bitmaps first, then the sets of what is left.

    ``nodes`` holds (node, n, bits), ``sets_of(nodes)`` gives (node, shingles).  Sets are fetched once per node.
    """

    def __init__(self, nodes: DataFrame, sets_of):
        self.nodes, self.sets_of, self.sets = nodes, sets_of, []

    def __call__(self, pairs: DataFrame, exact: bool) -> DataFrame:
        """(a, b, jaccard, linked); the similarity of unlinked pairs may be an upper bound, or null without ``exact``."""
        side = lambda k, n, x: self.nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bits").alias(x))
        most = _most("_x", "_y", "_n", "_m")
        met = pairs.join(side("a", "_n", "_x"), "a").join(side("b", "_m", "_y"), "b").withColumn("_most", most)
        bound = F.col("_most") / (F.col("_n") + F.col("_m") - F.col("_most"))
        bounds = stored(met.select("a", "b", bound.alias("jaccard"), _may_link(F.col("_most"), "_n", "_m").alias("close")), "bounds")
        todo = bounds.where("close").select("a", "b")
        if todo.isEmpty():
            return bounds.select("a", "b", "jaccard", F.lit(False).alias("linked"))
        fresh = todo.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for known in self.sets:
            fresh = fresh.join(known, "node", "left_anti")
        fresh = stored(fresh, "wanted")
        if not fresh.isEmpty():
            self.sets.append(stored(self.sets_of(fresh), "sets"))
        far = bounds.where("not close").select("a", "b", "jaccard", F.lit(False).alias("linked"))
        if not self.sets:
            return far
        sets = reduce(DataFrame.unionByName, self.sets)
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
        both = (_shared if exact else _shared_if_close)("_x", "_y")
        done = todo.join(one, "a").join(two, "b").withColumn("_i", both)
        union = ((F.octet_length("_x") + F.octet_length("_y")) / 8 - F.col("_i")).cast("long")
        linked = (F.col("_i") >= 0) & (100 * F.col("_i") >= PERCENT * union)
        ratio = F.when(F.col("_i") >= 0, F.col("_i") / union)
        out = stored(done.select("a", "b", ratio.alias("jaccard"), linked.alias("linked")), "verified")
        tidy(pairs.sparkSession)
        return far.unionByName(out)


def linked_nodes(prefixes: DataFrame, nodes: DataFrame, sets_of, spark: SparkSession) -> DataFrame:
    """(node, label) for all nodes with links, label the same for nodes that links connect.

    ``prefixes`` holds (token, node, n, pos), ``nodes`` (node, n, bits); ``sets_of(nodes)`` gives (node, shingles).

    All nodes that share a prefix shingle are candidates.  Instead of emitting every pair of such a crowd,
    each crowd compares its nodes with one pivot.  What links to the pivot is connected through it; and as
    1 - Jaccard is a metric, a linked node x can only link to an unlinked node y if
    d(y, pivot) <= d(x, pivot) + 0.2.  Linked nodes that are too near the pivot for any y leave the
    crowd, and crowds whose nodes are all connected are done.  Crowds still above ``CROWD`` nodes go
    round again with another pivot, ``ROUNDS`` times.  Of the rest, pairs of nodes that are not connected yet pass the
    length, positional and bitmap filters; of every two components the most promising pair is verified first, and the others
    only if that did not connect them.  No link between components is lost.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    dealt = prefixes.repartition("token")
    # the aggregate asks for all columns, so that it and the join share the one exchange
    shared = dealt.groupBy("token").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.max("n").alias("_n"), F.max("pos").alias("_p"))
    met = stored(dealt.join(shared.where("_lo < _hi and _n >= 0 and _p >= 0").select("token"), "token").dropDuplicates(["token", "node"]), "crowds")
    tidy(spark)
    # two nodes that meet by themselves, as most that meet by chance do, are one pair and need no pivot
    place = F.struct("node", "n", "pos")
    sizes = stored(met.groupBy("token").agg(F.count("*").alias("_c"), F.min(place).alias("_lo"), F.max(place).alias("_hi")), "sizes")
    of_two = sizes.where((F.col("_c") == 2) & _placed("_lo.n", "_hi.n", "_lo.pos", "_hi.pos"))
    couples = of_two.select(F.col("_lo.node").alias("a"), F.col("_hi.node").alias("b")).distinct()
    crowd = stored(met.join(sizes.where("_c > 2").select("token"), "token").select("token", "node", "n", "pos"), "crowds")
    verify = _Verifier(nodes, sets_of)
    known: list[DataFrame] = []
    small: list[DataFrame] = []
    labels: DataFrame | None = None

    def all_known() -> DataFrame:
        return reduce(DataFrame.unionByName, known)

    def joined_up(found: DataFrame) -> DataFrame:
        """Labels after what was just found; a link is an edge once, a label ever after."""
        edges = found.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if labels is not None:
            edges = edges.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
        return stored(components(edges), "labels")

    def with_labels(rows: DataFrame) -> DataFrame:
        of = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        return rows.join(of, F.col("node") == F.col("_node"), "left").select(*rows.columns, F.coalesce("_label", "node").alias("label"))

    def unsettled(rows: DataFrame) -> DataFrame:
        """Rows of crowds that more than one label has, with the size of the crowd."""
        several = rows.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count("*").alias("_c")).where("_l < _h")
        return rows.join(several.select("token", "_c"), "token")

    for turn in range(ROUNDS):
        pivots = crowd.groupBy("token").agg(F.min_by(place, F.xxhash64("node", F.lit(turn))).alias("_p"))
        pivots = pivots.select("token", F.col("_p.node").alias("_pivot"), F.col("_p.n").alias("_pn"))
        rows = crowd.join(pivots, "token").where("node <> _pivot")
        rows = rows.withColumns({"a": F.least("node", "_pivot"), "b": F.greatest("node", "_pivot")})
        pairs = rows.where(_close_in_size("n", "_pn")).select("a", "b").distinct()
        if known:
            pairs = pairs.join(all_known().select("a", "b"), ["a", "b"], "left_anti")
        else:
            pairs = pairs.unionByName(couples).distinct()
        known.append(verify(pairs, True))
        near = rows.join(all_known(), ["a", "b"], "left").withColumn(
            "_d", 1 - F.coalesce("jaccard", F.least("n", "_pn") / F.greatest("n", "_pn"))
        )
        near = near.withColumn("linked", F.coalesce("linked", F.lit(False)))
        edge = near.groupBy("token").agg(F.min(F.when(~F.col("linked"), F.col("_d"))).alias("_edge")).where("_edge is not null")
        limit = F.col("_edge") - (1 - PERCENT / 100) - 1e-9
        left = near.join(edge, "token").where(~F.col("linked") | (F.col("_d") >= limit)).select("token", "node", "n", "pos")
        labels = joined_up(known[-1])
        left = stored(unsettled(with_labels(left)).drop("label"), "left")
        small.append(left.where(F.col("_c") <= CROWD).drop("_c"))
        crowd = stored(left.where(F.col("_c") > CROWD).drop("_c"), "crowds")
        tidy(spark)
        if crowd.isEmpty():
            break
    else:
        small.append(crowd)
    rest = unsettled(with_labels(reduce(DataFrame.unionByName, small).select("token", "node", "n", "pos"))).drop("_c")
    bits = nodes.select(F.col("node").alias("_k"), "bits")
    rest = stored(rest.join(bits, F.col("node") == F.col("_k")).drop("_k"), "rest")
    other = rest.select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "pos", "label", "bits")])
    most = _most("bits", "_bits", "n", "_n")
    meet = (
        (rest["token"] == other["token"]) & (F.col("node") < F.col("_node")) & (F.col("label") != F.col("_label"))
        & _placed("n", "_n", "pos", "_pos") & _may_link(most, "n", "_n")
    )
    bound = F.coalesce(most / (F.col("n") + F.col("_n") - most), F.lit(1.0)).alias("bound")
    pairs = rest.join(other, meet).select(F.col("node").alias("a"), F.col("_node").alias("b"), F.col("label").alias("_x"), F.col("_label").alias("_y"), bound)
    pairs = stored(pairs.distinct().join(all_known().select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    # the most promising pair of every two labels first: once two parts are connected, their other pairs need no look
    first = pairs.groupBy(F.least("_x", "_y"), F.greatest("_x", "_y")).agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("p")).select("p.*")
    known.append(verify(first, False))
    labels = joined_up(known[-1])
    ends = pairs.join(known[-1].select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    at = lambda k, x: labels.select(F.col("node").alias(k), F.col("label").alias(x))
    apart = F.coalesce("_x", "a") != F.coalesce("_y", "b")
    open_ = ends.join(at("a", "_x"), "a", "left").join(at("b", "_y"), "b", "left").where(apart).select("a", "b")
    known.append(verify(open_, False))
    return joined_up(known[-1])


def _labelled(docs: DataFrame, row) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, node) of every document of (doc_id, text), and (node, rep, label) of every set.

    ``row`` is a column of ``docs`` that goes along, rep the smallest id that holds the set, label the same for
    sets that links connect.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), row.cast("long").alias("_row"), F.col("text").alias("_text"))
    first = stored(_counted(texts), "counts")
    rows = first.where("part is null").select("doc_id", "row", "n", "node")
    ranks = spark.sparkContext.broadcast(rare_first(first.where("part is not null").select("part", "body"), texts.rdd.getNumPartitions()))
    alike = first.where("node is not null").groupBy("node")
    reps = stored(alike.agg(F.min("doc_id").alias("_rep"), F.max("n").alias("n"), F.first("bits").alias("bits")), "nodes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # a node's set is taken from the documents of the smallest id that has it
        keys = reps.join(nodes, "node", "left_semi").select(F.xxhash64("_rep").alias("_key"))
        given = [spark.sparkContext.broadcast(_wanted(h)) for h in (keys, nodes)]
        found = _sets(texts.select(F.xxhash64("_id").alias("_key"), "_text"), *given)
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    labels = linked_nodes(_prefixes(texts.select("_text"), ranks), reps.select("node", "n", "bits"), sets_of, spark)
    return rows, reps.select("node", "_rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of (doc_id, text).

    Sets are compared by 64-bit shingle hashes.  Equal sets are one node, so exact copies cost nothing but
    their row.  An empty set links with nothing, not even with another empty one.  A row with a null
    doc_id is linked like any other; its component_id is null if no row of the component has an id.  Rows that repeat an id are kept; if their texts differ, each is linked by its own text.
    """
    rows, grouped = _labelled(docs, F.lit(None))
    low = grouped.groupBy("label").agg(F.min("_rep").alias("component_id"))
    of = stored(grouped.join(low, "label").select(F.col("node").alias("_node"), "component_id"), "components")
    return rows.join(of, F.col("node") == F.col("_node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word Jaccard similarity of 0.8 or more."""
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _one_of_groups(docs: DataFrame, nameless: bool) -> DataFrame:
    """One row of each component of ``docs``: the first by (non-null id, id, hash of the row).

    It is decided per row, by id and a 64-bit hash of all columns, so rows that share an id but not their text don't
    share their fate.  Of identical rows one stays.  Rows without shingles are no copies of anything and stay.
    With ``nameless``, all rows with a null id stay too.
    """
    hashed = F.xxhash64(*[c for name in docs.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])
    rows, grouped = _labelled(docs, hashed)
    of = stored(grouped.select(F.col("node").alias("_node"), "label"), "components")
    alike = rows.where("node is not null").groupBy("doc_id", "row", "node").agg(F.count("*").alias("_copies"))
    alike = stored(alike.join(of, F.col("node") == F.col("_node")).select("doc_id", "row", "label", "_copies"), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    best = alike.groupBy(F.col("label").alias("_label")).agg(F.min(place).alias("_best"))
    first = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("row") == F.col("_best.row"))
    ranked = alike.join(best, F.col("label") == F.col("_label")).withColumn("_first", first)
    if nameless:
        ranked = ranked.where("doc_id is not null")
    ident, row = unused(docs, "_ident"), unused(docs, "_row")
    odd = stored(ranked.where("not _first or _copies > 1").select(F.col("doc_id").alias(ident), F.col("row").alias(row), "_first"), "odd")
    keyed = docs.withColumn(unused(docs, "_hash"), hashed)
    mine = F.col(keyed.columns[-1])
    same = lambda of: F.col("doc_id").cast("long").eqNullSafe(of[ident]) & (mine == of[row])
    # most rows are the only first one and pass an anti join; identical ones are few and are made one
    only = keyed.join(odd, same(odd), "left_anti")
    copied = odd.where("_first")
    again = keyed.join(copied, same(copied), "left_semi").dropDuplicates(["doc_id", keyed.columns[-1]])
    return only.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def first_of_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row, the one with the smallest id, with all its columns; rows with a null id stay as well.

    Documents without shingles stay.  See :func:`one_of_groups` for the form without copies that have no id.
    """
    return _one_of_groups(docs, True)


def one_of_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component exactly one row, with all its columns, so that no later stage meets a copy of it.

    It is the row with the smallest id, or one without an id if the component has none.  Documents without shingles stay.
    """
    return _one_of_groups(docs, False)


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE = {
    "op2_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT r.root, e.b FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(node) FROM r WHERE r.root = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
""",
}
