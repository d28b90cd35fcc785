"""Near-duplicate vectors by a robust-pruned flat graph that is searched range by range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import components, released, stored, table

#: Cosine from which two vectors link.
COSINE = 0.9
#: Vectors of a shard, about; vectors that the centres are fitted on, at most; centres, at most.
SHARD, FIT, CENTRES = 1500, 20_000, 4096
#: Clusters that a vector belongs to at first; the audit may ask for more, up to WIDEST before all pairs are compared.
OVERLAP, WIDEST = 2, 16
#: Out-degree and slack of the pruned graph, beam of the search, cosine up to which a search goes on round a hit.
DEGREE, ALPHA, BEAM, MARGIN, ENTRIES = 24, 1.2, 32, 0.08, 8
#: Audited are vectors with an id that these divide, the first alone at first; the recall below which the search is widened,
#: and the true links that an audit needs for its recall to count.
EVERY, RECALL, SEEN = (50, 10, 1), 0.97, 100
#: Vectors that are compared with all others in one pass (sent to all tasks), and rows and pairs that are held at a time.
BLOCK, ROWS, PAIRS = 4096, 2048, 200_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def distinct_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(node, vec, copies, tier): one row for each different direction-carrying vector, node the smallest id that holds it.

    ``tier`` is the first place in ``EVERY`` whose number divides one of the vector's ids.

    Vectors that are null, empty or zero, or hold a null or a non-finite component, are left out, as are rows
    with a null id.  The rows of a vector that fills a third of the table are combined in the map tasks.
    """
    v = F.col(vector)
    whole = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where(whole).where(F.exists(v, lambda x: x != 0))
    same = F.transform(v, lambda x: x.cast("double") + 0.0)
    tier = F.coalesce(*[F.when(F.col(ident) % every == 0, F.lit(i)) for i, every in enumerate(EVERY)])
    return sound.where(F.col(ident).isNotNull()).groupBy(same.alias("vec")).agg(
        F.min(ident).alias("node"), F.count("*").alias("copies"), F.min(tier).alias("tier")
    )


def centres(vectors: DataFrame, count: int, rounds: int = 6, sample: int = FIT) -> np.ndarray:
    """Spherical k-means on at most ``sample`` vectors (the first by a hash of their node)."""
    some = vectors.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(sample).select("vec").toArrow()
    x = _unit(_matrix(some["vec"].combine_chunks()))
    count = min(count, len(x))
    at = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ at.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 2000))])
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        held = np.linalg.norm(total, axis=1) > 0
        at[held] = _unit(total[held])
    return at


def _dealt(vectors: DataFrame, at, keep: int) -> DataFrame:
    """(cluster, node, vec, copies, clusters) for the ``keep`` nearest centres of every vector."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = at.value
        k = min(keep, len(middle))
        for batch in batches:
            if not batch.num_rows:
                continue
            close = np.argsort(-(_unit(_matrix(batch["vec"])) @ middle.T), axis=1, kind="stable")[:, :k].astype(np.int32)
            row = pa.array(np.repeat(np.arange(len(close)), k))
            own = pa.array(np.sort(close, axis=1).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(close.ravel()), *(batch[c].take(row) for c in ("node", "vec", "copies")), own.take(row)],
                names=["cluster", "node", "vec", "copies", "clusters"],
            )

    return vectors.select("node", "vec", "copies").mapInArrow(
        deal, "cluster int, node long, vec array<double>, copies long, clusters array<int>"
    )


def robust_pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Edges of unit vectors, one row each, filled up with -1.

    Candidates of a vector are its nearest ones.  Robust pruning takes the nearest, drops all that are
    ``alpha`` times closer to it than to the vector, and goes on, so that edges point in different directions;
    at most ``degree`` are kept.  Then every edge is added the other way round too: in a tight group
    pruning leaves most members without an edge that leads to them.
    """
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int32)
    if n < 2:
        return edges
    pool = min(n - 1, 3 * degree)
    for low in range(0, n, 512):
        part = np.arange(low, min(low + 512, n))
        sims = x[part] @ x.T
        sims[np.arange(len(part)), part] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        order = np.take_along_axis(sims, near, 1).argsort(axis=1)[:, ::-1]
        near = np.take_along_axis(near, order, 1)
        far = 1 - np.take_along_axis(sims, near, 1)  # ascending distance
        between = 1 - np.einsum("qid,qjd->qij", x[near], x[near])
        alive = np.ones(near.shape, dtype=bool)
        taken = np.zeros(len(part), dtype=int)
        rows = np.arange(len(part))
        for i in range(pool):
            use = alive[:, i] & (taken < degree)
            edges[part[use], taken[use]] = near[use, i]
            taken[use] += 1
            drop = alpha * between[rows, i] <= far
            drop[:, : i + 1] = False
            alive &= ~(drop & use[:, None])
    a, k = np.nonzero(edges >= 0)
    b = edges[a, k]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = np.divmod(pairs, n)
    places = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, int(places.max()) + 1), -1, dtype=np.int32)
    out[a, places] = b
    return out


def medoids(x: np.ndarray, count: int = ENTRIES) -> np.ndarray:
    """The vector nearest to the mean, of all rows and of ``count`` stretches of them."""
    parts = [np.arange(len(x)), *np.array_split(np.arange(len(x)), min(count, len(x)))]
    return np.unique([p[(x[p] @ x[p].mean(axis=0)).argmax()] for p in parts])


def range_search(
    x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, own: np.ndarray | None = None, cosine: float = COSINE
) -> np.ndarray:
    """Which vectors have at least ``cosine`` with each query (a boolean matrix), for many queries at once.

    A greedy search with a beam starts from the entry points (and from the query's own place, if it is part
    of the graph) and runs until its beam holds only expanded vectors.  Then the range opens: every vector
    met within ``cosine - MARGIN`` is expanded too, until no new one turns up.  What it returns is
    verified: cosines are computed in double precision from the vectors themselves.
    """
    q, n = len(queries), len(x)
    sims = np.full((q, n), -2.0)
    seen, done = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool)
    rows = np.arange(q)

    def look(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.unique(r[c >= 0] * n + c[c >= 0])
        r, c = np.divmod(flat, n)
        new = ~seen[r, c]
        r, c = r[new], c[new]
        seen[r, c] = True
        for low in range(0, len(r), 50_000):
            i, j = r[low : low + 50_000], c[low : low + 50_000]
            sims[i, j] = np.einsum("ij,ij->i", queries[i], x[j])
        return r, c

    beam = np.full((q, BEAM), -1)
    value = np.full((q, BEAM), -3.0)

    def merge(r: np.ndarray, c: np.ndarray) -> None:
        """Keep the best of each query's beam and its new vectors."""
        if not len(r):
            return
        wide = int(np.bincount(r).max())
        spot = np.arange(len(r)) - np.searchsorted(r, r)
        ids, sim = np.full((q, wide), -1), np.full((q, wide), -3.0)
        ids[r, spot], sim[r, spot] = c, sims[r, c]
        ids, sim = np.hstack([beam, ids]), np.hstack([value, sim])
        best = np.argsort(-sim, axis=1, kind="stable")[:, :BEAM]
        beam[:], value[:] = np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)

    merge(*look(np.repeat(rows, len(entry)), np.tile(entry, q)))
    if own is not None:
        merge(*look(rows, own))
    while True:
        fresh = np.where((beam >= 0) & ~done[rows[:, None], np.maximum(beam, 0)], value, -3.0)
        best = fresh.argmax(axis=1)
        r = np.flatnonzero(fresh[rows, best] > -3)
        if not len(r):
            break
        c = beam[r, best[r]]
        done[r, c] = True
        merge(*look(np.repeat(r, edges.shape[1]), edges[c].ravel()))
    while True:
        r, c = np.nonzero((sims >= cosine - MARGIN) & ~done)
        if not len(r):
            break
        done[r, c] = True
        for low in range(0, len(r), 20_000):
            look(np.repeat(r[low : low + 20_000], edges.shape[1]), edges[c[low : low + 20_000]].ravel())
    return sims >= cosine


def _inside(edges: pa.Array, node: np.ndarray) -> np.ndarray:
    """Adjacency lists of node ids as places among ``node`` (ascending); edges that lead elsewhere are -1."""
    sizes = edges.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    to = edges.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(node, to), len(node) - 1)
    at = np.where(node[at] == to, at, -1)
    out = np.full((len(node), max(1, sizes.max(initial=1))), -1)
    row = np.repeat(np.arange(len(node)), sizes)
    out[row, np.arange(len(to)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = at
    return out


def _build(rows: pa.Table) -> pa.Table:
    """Edges of one part of a cluster."""
    rows = rows.sort_by("node").combine_chunks()
    node = rows["node"].to_numpy()
    edges = robust_pruned(_unit(_matrix(rows["vec"].combine_chunks())))
    lists = [node[e[e >= 0]] for e in edges]
    return pa.table({"node": pa.array(node), "edges": pa.array(lists, pa.list_(pa.int64()))})


def _label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that the edges (a, b), given both ways, lead to."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _shared(mine: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many clusters the vectors at places a and b share."""
    out = np.zeros(len(a), dtype=np.int64)
    for low in range(0, len(a), PAIRS):
        own = slice(low, low + PAIRS)
        out[own] = (mine[a[own]][:, :, None] == mine[b[own]][:, None, :]).any(axis=2).sum(axis=1)
    return out


def _search(rows: pa.Table) -> pa.Table:
    """Links inside a part of a cluster, or between two parts of it.

    Vectors may share several clusters.  A link whose ends share this one only is counted here: a row
    (node, near, links) holds how many there are, and how many copies they lead to.  Any other is a row
    (node, other, copies, others), the smaller node first, as other clusters may find it too.  The rest of a row is
    null; ``star`` is the smallest node that the links of the task lead to.
    """
    rows = rows.sort_by("node").combine_chunks()
    node, copies, part = (rows[c].to_numpy() for c in ("node", "copies", "part"))
    i, j = (rows[c][0].as_py() for c in ("i", "j"))
    x = _unit(_matrix(rows["vec"].combine_chunks()))
    mine = np.array(rows["clusters"].to_pylist())
    edges = _inside(rows["edges"].combine_chunks(), node)
    hits = np.zeros((len(node), len(node)), dtype=bool)
    if i == j:
        hits = range_search(x, edges, medoids(x), x, np.arange(len(node)))
        hits |= hits.T
        np.fill_diagonal(hits, False)
    else:
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if len(one) and len(two):
            place = np.full(len(node) + 1, -1)
            place[two] = np.arange(len(two))
            found = range_search(x[two], place[edges[two]], medoids(x[two]), x[one])
            hits[np.ix_(one, two)] = found
            hits[np.ix_(two, one)] = found.T
    a, b = np.nonzero(hits)
    alone = _shared(mine, a, b) == 1
    near = np.bincount(a[alone], minlength=len(node)).astype(np.int64)
    links = np.bincount(a[alone], copies[b[alone]], minlength=len(node)).astype(np.int64)
    label = _label(len(node), a, b)
    some = np.flatnonzero((near > 0) | (label != np.arange(len(node))))
    twice = ~alone & (a < b)
    c, d = a[twice], b[twice]
    none = lambda n: pa.nulls(n, pa.int64())
    counts = [pa.array(v[some]) for v in (node, near, links, node[label])] + [none(len(some))] * 3
    pairs = [pa.array(node[c]), none(len(c)), none(len(c)), none(len(c)), *(pa.array(v) for v in (node[d], copies[c], copies[d]))]
    names = ["node", "near", "links", "star", "other", "copies", "others"]
    return pa.concat_tables([pa.table(counts, names=names), pa.table(pairs, names=names)])


FOUND = "node long, near long, links long, star long, other long, copies long, others long"


def _searched(vectors: DataFrame, total: int, overlap: int) -> DataFrame:
    """(node, near, links, star, other, copies, others): what :func:`_search` finds in all shards."""
    spark = vectors.sparkSession
    count = _clusters(total, overlap)
    at = spark.sparkContext.broadcast(centres(vectors, count))  # at most CENTRES vectors
    dealt = stored(_dealt(vectors, at, overlap), "dealt")
    sizes = dealt.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("_n"))
    parts = sizes.select("_c", F.ceil(F.col("_n") / (2 * SHARD)).cast("int").alias("_parts"))
    cut = dealt.join(parts, F.col("cluster") == F.col("_c")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    cut = cut.select("cluster", "node", "vec", "copies", "clusters", "part", "_parts")
    built = cut.select("cluster", "part", "node", "vec").groupBy("cluster", "part").applyInArrow(_build, "node long, edges array<long>")
    union = built.groupBy(F.col("node").alias("_node")).agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    # a part meets every part of its cluster once
    pairs = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    pairs = pairs.withColumns({"i": F.least("part", "_other"), "j": F.greatest("part", "_other")})
    met = pairs.join(union, F.col("node") == F.col("_node")).select("cluster", "i", "j", "part", "node", "vec", "copies", "clusters", "edges")
    found = stored(met.groupBy("cluster", "i", "j").applyInArrow(_search, FOUND), "found")
    released(dealt)
    return found


def _clusters(total: int, overlap: int) -> int:
    return min(CENTRES, max(1, -(-total * overlap // SHARD)))


def _linked(found: DataFrame) -> DataFrame:
    """(node, near, links): found links of every node, to how many vectors and to how many of their copies; each link once.

    Pairs that several clusters found are made one by their two ends, so a node of many links is not one task's.
    """
    pairs = found.where("other is not null").groupBy("node", "other").agg(F.first("copies").alias("copies"), F.first("others").alias("others"))
    ends = pairs.select(F.explode(F.array(
        F.struct("node", F.lit(1).cast("long").alias("near"), F.col("others").alias("links")),
        F.struct(F.col("other").alias("node"), F.lit(1).cast("long").alias("near"), F.col("copies").alias("links")),
    )).alias("e")).select("e.*")
    own = found.where("near is not null").select("node", "near", "links")
    return own.unionByName(ends).groupBy("node").agg(F.sum("near").alias("near"), F.sum("links").alias("links"))


def _stars(found: DataFrame) -> DataFrame:
    return found.where("star is not null").select(F.col("node").alias("u"), F.col("star").alias("v"))


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and unit vectors of all queries, at most about ``BLOCK`` at a time on the driver."""
    count = -(-queries.count() // BLOCK)
    cut = queries.select("node", "vec", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(max(count, 1))).alias("_block"))
    for block in range(count):
        rows = cut.where(F.col("_block") == block).select("node", "vec").toArrow().combine_chunks()
        if rows.num_rows:
            yield rows["node"].to_numpy(), _unit(_matrix(rows["vec"].combine_chunks()))


def compared(vectors: DataFrame, queries: DataFrame, stars: bool) -> Iterator[DataFrame]:
    """True links of ``queries`` against all ``vectors``, a frame per block: rows as :func:`_search` counts them.

    Without ``stars`` only the counts of queries are given.
    """
    spark = vectors.sparkSession
    for block in _blocks(queries):
        sent = spark.sparkContext.broadcast(block)

        def brute(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            near, links = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)

            def made(node, near, links, star):
                own = [pa.array(v, pa.int64()) for v in (node, near, links, star)]
                return pa.RecordBatch.from_arrays(own + [pa.nulls(len(node), pa.int64())] * 3, names=[f.split()[0] for f in FOUND.split(", ")])

            for whole in batches:
                for low in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(low, ROWS)
                    node, copies = batch["node"].to_numpy(), batch["copies"].to_numpy()
                    hit = (q @ _unit(_matrix(batch["vec"])).T) >= COSINE
                    a, b = np.nonzero(hit)
                    real = names[a] != node[b]
                    a, b = a[real], b[real]
                    near += np.bincount(a, minlength=len(q))
                    links += np.bincount(a, copies[b], minlength=len(q)).astype(np.int64)
                    if stars and len(a):
                        every, place = np.unique(np.concatenate([names[a], node[b]]), return_inverse=True)
                        c, d = place[: len(a)], place[len(a) :]
                        label = _label(len(every), np.concatenate([c, d]), np.concatenate([d, c]))
                        yield made(every, np.zeros(len(every)), np.zeros(len(every)), every[label])
            yield made(names, near, links, names)

        yield vectors.select("node", "vec", "copies").mapInArrow(brute, FOUND)


def audit_recall(vectors: DataFrame, counted: DataFrame) -> float:
    """Part of the true links of audited vectors, against all vectors, that were found; copies don't count.

    Audited are the vectors with an id that 50 divides.  If those have fewer than ``SEEN`` links, more are
    taken, up to all: only a table without links passes without one.
    """
    for tier in range(len(EVERY)):
        queries = vectors.where(F.col("tier") <= tier)
        true = sum(df.agg(F.sum("near")).first()[0] or 0 for df in compared(vectors, queries, False))
        if true >= SEEN:
            break
    if not true:
        return 1.0  # all vectors are compared, and none links
    found = counted.join(queries.select("node"), "node", "left_semi").agg(F.sum("near")).first()[0] or 0
    return found / true


def all_links(vectors: DataFrame) -> DataFrame:
    """What :func:`_search` would give if it missed nothing: all vectors against all, block by block."""
    blocks = [stored(df, "found") for df in compared(vectors, vectors, True)]
    return reduce(DataFrame.unionByName, blocks)


def near_duplicates(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; pairs of cosine 0.9 and more link.

    Equal vectors are one node of the graph.  A clustering fitted on a bounded sample cuts the nodes into
    overlapping shards, a robust-pruned graph is built on each, the adjacency lists of a node's shards are
    united, and each shard is searched along the united lists by all its vectors.  An audit compares links with
    brute force, whatever the size; below ``RECALL`` every vector joins twice as many clusters, and when these are
    all there are, or ``WIDEST``, all vectors are compared with all, block by block.  Shards above twice ``SHARD``
    are cut into parts that are searched pair by pair, so none grows with the data.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
    own component; vectors of different lengths never link.  Rows that repeat an id each count their own
    vector; a null id links with nothing and has a null component.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(ident).cast("long").alias("_id"), F.col(vector).alias("_v"))
    nodes = stored(distinct_vectors(base, "_id", "_v"), "vectors")
    lengths = sorted(r[0] for r in nodes.select(F.size("vec")).distinct().collect())  # as many as there are vector lengths
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    counted: DataFrame | None = None
    stars: DataFrame | None = None
    for n in lengths:
        own = nodes.where(F.size("vec") == n)
        total, overlap = own.count(), OVERLAP
        while True:
            found = _searched(own, total, overlap)
            links = stored(_linked(found), "links")
            if audit_recall(own, links) >= RECALL:
                break
            released(found, links)
            if overlap >= min(_clusters(total, overlap), WIDEST):
                found = all_links(own)
                links = _linked(found)
                break
            overlap *= 2
        star, links = _stars(found), links.select("node", "links")
        counted = links if counted is None else counted.unionByName(links)
        stars = star if stars is None else stars.unionByName(star)
    key = F.transform("_v", lambda x: x.cast("double") + 0.0)
    if counted is None:
        known = nodes.select("vec", "node", "copies", F.lit(0).cast("long").alias("_links"), F.col("node").alias("_label"))
    else:
        labels = components(stars).withColumnRenamed("node", "_n1")
        known = (
            nodes.join(labels, F.col("node") == F.col("_n1"), "left")
            .join(counted.select(F.col("node").alias("_n2"), "links"), F.col("node") == F.col("_n2"), "left")
            .select("vec", "node", "copies", F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("label", "node").alias("_label"))
        )
    met = base.join(known, (key == F.col("vec")) & F.col("_id").isNotNull(), "left")
    component = F.coalesce("_label", "_id")
    return met.select(
        F.col("_id").alias(ident), F.coalesce(F.col("_links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def op6_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op6_flat_graph": op6_flat_graph}
ORACLE: dict[str, str] = {}
