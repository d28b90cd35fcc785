"""De-duplication of repeated passages by a hash-compared suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import lean, released, small_batches, stored, table, tidy, unused
from cohortlake.llm.textkit import BASE, CODES, INVERSE, chunks, mixed, prefix_hashes

#: Bytes of a repeated string, and of the anchors by which its occurrences find each other.
LENGTH, GRAM = 200, 64
#: Starts that one anchor can serve: every string of LENGTH bytes holds this many grams.
SPAN = LENGTH - GRAM + 1
#: Occurrences that are sorted together, about, and the most that one anchor may have there.
SORTED, HOT = 20_000, 20_000


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring starts with one anchor: (text, first start, last start, anchor, anchor hash, stretch hash).

    A string's anchor is the leftmost gram in it with the smallest hash, so equal strings have equal
    anchors at equal distances.  The stretch is all bytes that the strings of a run cover.
    """
    none = np.zeros(0, dtype=np.int64)
    size = len(data)
    if size < LENGTH:
        return (none,) * 4 + (none.astype(np.uint64),) * 2
    h = prefix_hashes(data)
    inverse = INVERSE.upto(size + 1)
    grams = mixed((h[GRAM:] - h[:-GRAM]) * inverse[: size - GRAM + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~np.uint64((1 << 28) - 1)) | at  # leftmost of the smallest
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[: len(low)])
    if not len(starts):
        return (none,) * 4 + (none.astype(np.uint64),) * 2
    anchor = (low[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    anchor = anchor[head]
    stretch = (h[last + LENGTH] - h[first]) * inverse[first]
    shape = ((anchor - first) << 16 | (last - first)).astype(np.uint64)
    stretch = mixed(stretch ^ mixed(shape + np.uint64(BASE)))
    return np.searchsorted(offsets, first, "right") - 1, first, last, anchor, grams[anchor], stretch


RUNS = "g long, ctx long, k long, place long, m long, more binary"


def _runs(texts: DataFrame) -> DataFrame:
    """Runs of all texts of (k, text), one row for each (anchor hash, stretch hash) of a task's batch.

    ``place`` packs the first start, the number of starts and the anchor's distance.  ``m`` counts the
    batch's occurrences, copies of a text included; those after the first are in ``more`` as (k, place).
    So a stretch that very many texts share is one row per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["k"].to_numpy()
            _, one, copies = np.unique(keys, return_index=True, return_counts=True)
            own = batch.take(pa.array(np.sort(one)))
            times = copies[np.argsort(one, kind="stable")]
            names, out = own["k"].to_numpy(), []
            for low, _, data, offsets in chunks(own["text"]):
                text, first, last, anchor, g, ctx = _anchored(data, offsets)
                place = (first - offsets[text]) << 16 | (last - first) << 8 | (anchor - first)
                out.append((g.view(np.int64), ctx.view(np.int64), names[low + text], place, times[low + text]))
            if not out:
                continue
            g, ctx, k, place, m = map(np.concatenate, zip(*out, strict=True))
            order = np.lexsort((ctx, g))
            g, ctx, k, place, m = (x[order] for x in (g, ctx, k, place, m))
            head = np.ones(len(g), dtype=bool)
            head[1:] = (g[1:] != g[:-1]) | (ctx[1:] != ctx[:-1])
            at = np.flatnonzero(head)
            end = np.append(at[1:], len(g))
            total = np.add.reduceat(m, at) if len(at) else m
            pairs = np.column_stack([k, place]).astype("<i8")
            more = [pairs[a + 1 : b].tobytes() if b - a > 1 else None for a, b in zip(at, end, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[at]) for x in (g, ctx, k, place)), pa.array(total.astype(np.int64)), pa.array(more, pa.binary())],
                names=[c.split()[0] for c in RUNS.split(", ")],
            )

    return texts.mapInArrow(lean(run), RUNS)


def _spread(rows: DataFrame) -> DataFrame:
    """(k, lo, hi) of all occurrences that rows of runs stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = b"".join(x for x in batch["more"].to_pylist() if x)
            other = np.frombuffer(rest, "<i8").reshape(-1, 2)
            k = np.concatenate([batch["k"].to_numpy(), other[:, 0]])
            place = np.concatenate([batch["place"].to_numpy(), other[:, 1]])
            lo = place >> 16
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(lo), pa.array(lo + ((place >> 8) & 255) + LENGTH)], names=["k", "lo", "hi"]
            )

    return rows.mapInArrow(lean(run), "k long, lo long, hi long")


def _extension(h: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows x and y: binary search on equal prefix hashes."""
    low, high = np.zeros(len(x), dtype=np.int64), np.minimum(size[x], size[y])
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = h[x, mid] == h[y, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def sorted_suffixes(group: np.ndarray, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows by group and suffix, and the bytes that each shares with the row before.

    ``body`` holds one suffix per row, padded with zeros, ``size`` their lengths; ``group`` ascends.  A merge
    sort from the bottom up: all pairs of runs of one width are merged at once, every row finding its place
    in the other run by binary search.  Two suffixes are compared by their longest common extension, found
    by binary search on prefix polynomial hashes, and the byte behind it.  The result is then read byte by
    byte: the common lengths are exact, and if a hash collision has put rows into the wrong order they are
    sorted again by their bytes.  Rows of different groups share nothing (-1).
    """
    n, width = body.shape
    powers = np.full(width, np.uint64(BASE))
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    h = np.zeros((n, width + 1), dtype=np.uint64)
    np.cumsum(CODES[body] * powers, axis=1, out=h[:, 1:])
    order = np.arange(n)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    end = np.append(edge[1:], n)
    low_of, high_of = np.repeat(edge, end - edge), np.repeat(end, end - edge)
    largest = int((end - edge).max()) if n else 0

    def before(x: np.ndarray, y: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as ``tie`` says."""
        e = _extension(h, size, x, y)
        at = np.minimum(e, width - 1)
        bx = np.where(e < size[x], body[x, at].astype(np.int64), -1)
        by = np.where(e < size[y], body[y, at].astype(np.int64), -1)
        return np.where(bx == by, tie, bx < by)

    step = 1
    place = np.arange(n)
    while step < 2 * largest and step < n:
        block = place // step
        sib = (block ^ 1) * step
        lo, hi = np.maximum(sib, low_of), np.minimum(np.minimum(sib + step, high_of), n)
        rows = np.flatnonzero(lo < hi)
        if len(rows):
            left = block[rows] % 2 == 0
            a, b, x = lo[rows].copy(), hi[rows].copy(), order[rows]
            while True:  # first place in the other run whose suffix does not come before x
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                less = before(order[mid], x[open_], ~left[open_])
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            found = a - lo[rows]
            to = np.where(left, rows + found, rows - (hi[rows] - lo[rows]) + found)
            moved = order.copy()
            moved[to] = order[rows]
            order = moved
        step *= 2

    def check(order: np.ndarray) -> tuple[np.ndarray, bool]:
        common = np.full(n, -1, dtype=np.int64)
        x, y = order[:-1], order[1:]
        differ = body[x] != body[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared = np.minimum(first, np.minimum(size[x], size[y]))
        at = np.minimum(shared, width - 1)
        bx = np.where(shared < size[x], body[x, at].astype(np.int64), -1)
        by = np.where(shared < size[y], body[y, at].astype(np.int64), -1)
        same = group[x] == group[y]
        common[1:] = np.where(same, shared, -1)
        return common, bool((~same | (bx <= by)).all())

    common, good = check(order)
    if not good:
        keys = [*(body[:, j] for j in range(width - 1, -1, -1)), group]
        order = np.lexsort([size, *keys])
        common, _ = check(order)
    return order, common


def repeated_starts(
    group: np.ndarray, stretch: list[bytes], starts: np.ndarray, anchor: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per occurrence the first and last start (from its first) of strings that another of its group holds; -1 if none.

    ``starts`` counts the starts after the first, ``anchor`` is the anchor's distance from the first.  Two
    strings at distance d before their anchors are equal if LENGTH - d bytes from the anchors on and d bytes
    backwards are equal: same class in the forward and in the backward suffix order.
    """
    n = len(group)
    data = np.frombuffer(b"".join(stretch), dtype=np.uint8)
    size = np.array([len(s) for s in stretch], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    ahead = np.minimum(size - anchor, LENGTH)
    column = np.arange(LENGTH)
    body = data[np.minimum(at[:, None] + anchor[:, None] + column, len(data) - 1)] * (column < ahead[:, None])
    back = np.arange(SPAN)
    behind = data[np.maximum(at[:, None] + anchor[:, None] - 1 - back, 0)] * (back < anchor[:, None])
    forward, same_f = sorted_suffixes(group, body.astype(np.uint8), ahead)
    backward, same_b = sorted_suffixes(group, behind.astype(np.uint8), anchor)
    low, high = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    f, b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d in range(SPAN):  # distance of the start before the anchor
        live = np.flatnonzero((anchor - starts <= d) & (d <= anchor))
        if len(live) < 2:
            continue
        f[forward] = np.cumsum(same_f < LENGTH - d)
        b[backward] = np.cumsum(same_b < d)
        both = f[live] * (n + 1) + b[live]
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        equal = np.zeros(len(live), dtype=bool)
        equal[1:] = ranked[1:] == ranked[:-1]
        equal[:-1] |= equal[1:].copy()
        hit = live[order[equal]]
        start = anchor[hit] - d
        low[hit] = np.where(low[hit] < 0, start, np.minimum(low[hit], start))
        high[hit] = np.maximum(high[hit], start)
    return low, high


def _compared(rows: DataFrame) -> DataFrame:
    """(k, lo, hi) from rows (g, k, place, alone, stretch) that are sorted by g inside their partitions."""

    def solve(g, k, place, alone, stretch) -> pa.RecordBatch:
        first, starts, anchor = place >> 16, (place >> 8) & 255, place & 255
        low, high = repeated_starts(g, stretch, starts, anchor)
        hit = alone & (low >= 0)
        lo = first[hit] + low[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(k[hit]), pa.array(lo), pa.array(first[hit] + high[hit] + LENGTH)], names=["k", "lo", "hi"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((
                batch["g"].to_numpy(), batch["k"].to_numpy(), batch["place"].to_numpy(),
                batch["alone"].to_numpy(zero_copy_only=False), batch["stretch"].to_pylist(),
            ))
            while sum(len(x[0]) for x in held) >= SORTED:
                g, k, place, alone = (np.concatenate([x[i] for x in held]) for i in range(4))
                stretch = [s for x in held for s in x[4]]
                cut = int(np.searchsorted(g, g[SORTED - 1]))  # whole groups only
                cut = cut or int(np.searchsorted(g, g[0], "right"))
                if cut == len(g):
                    held = [(g, k, place, alone, stretch)]
                    break
                yield solve(g[:cut], k[:cut], place[:cut], alone[:cut], stretch[:cut])
                held = [(g[cut:], k[cut:], place[cut:], alone[cut:], stretch[cut:])]
        if held:
            g, k, place, alone = (np.concatenate([x[i] for x in held]) for i in range(4))
            yield solve(g, k, place, alone, [s for x in held for s in x[4]])

    return rows.mapInArrow(lean(run), "k long, lo long, hi long")


def _strings(rows: DataFrame) -> DataFrame:
    """(k, lo, hash) of every single string of very crowded anchors: they are counted instead of sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, place, alone, body in zip(*(batch[c].to_pylist() for c in ("k", "place", "alone", "stretch")), strict=True):
                n = ((place >> 8) & 255) + 1
                hashed = [int.from_bytes(hashlib.blake2b(body[i : i + LENGTH], digest_size=8).digest(), "little", signed=True) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n), pa.array(np.arange(n) + (place >> 16)), pa.array([alone] * n), pa.array(hashed, pa.int64())],
                    names=["k", "lo", "alone", "hash"],
                )

    return rows.mapInArrow(lean(run), "k long, lo long, alone boolean, hash long")


def _stretches(texts: DataFrame) -> DataFrame:
    """The bytes of wanted runs: (g, ctx, k, place, alone, hot, stretch) from texts with their list ``_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["_runs"]
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(int))
            place = flat.field("place").to_numpy()
            flat_text = batch["text"].cast(pa.large_binary())
            out = []
            body: bytes = b""
            seen = -1
            for r, p in zip(row.tolist(), place.tolist(), strict=True):
                if r != seen:
                    body, seen = flat_text[r].as_py() or b"", r
                first = p >> 16
                out.append(body[first : first + ((p >> 8) & 255) + LENGTH])
            yield pa.RecordBatch.from_arrays(
                [flat.field("g"), batch["k"].take(pa.array(row)), flat.field("place"), flat.field("alone"), flat.field("hot"), pa.array(out, pa.binary())],
                names=["g", "k", "place", "alone", "hot", "stretch"],
            )

    return texts.mapInArrow(lean(run), "g long, k long, place long, alone boolean, hot boolean, stretch binary")


def _cut(texts: DataFrame, keep_text: bool) -> DataFrame:
    """(k, n_removed, n_spans, kept_sha256[, kept]) from texts with their list ``_spans`` of (lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, spans in zip(batch["k"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), batch["_spans"].to_pylist(), strict=True):
                body, at, parts, removed, n = text or b"", 0, [], 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                    if lo > end:
                        parts.append(body[at:lo])
                        n += 1
                        removed += hi - lo
                        end = at = hi
                    elif hi > end:
                        removed += hi - end
                        end = at = hi
                kept = b"".join([*parts, body[at:]])
                rows.append((k, removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            names = ["k", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return texts.mapInArrow(lean(run), "k long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeats(docs: DataFrame, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is removed from the texts of (doc_id, text), by text key: (narrow rows per document, changes per text).

    A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place too, in this text or
    another; bytes are UTF-8, strings are judged on the input, overlaps count.  Exact: every such string
    has an anchor, and equal strings have equal anchors.

    1. Runs of starts with one anchor are found in the map tasks.  Runs whose whole stretch occurs twice are
       repeated; they are counted by hash, which spreads over the cluster.
    2. Other runs whose anchor occurs elsewhere too are the borders of repeats.  Their stretches are fetched,
       dealt by anchor and sorted as suffixes forwards and backwards from the anchor, many anchors at a time.
       An anchor with more than ``HOT`` different stretches is counted string by string instead.
    3. The spans of a text are united and cut out where the text lies.

    Texts with exact copies are removed whole if they have LENGTH bytes, and need no spans.  Null texts are
    empty.  Repeated rows are copies.  A null doc_id is a value.  Texts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), _key(body).alias("k"), body.alias("text")
    )
    narrow = docs.select(
        "doc_id", _key(body).alias("k"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha")
    )
    ids = stored(
        rows.groupBy("k").agg(F.min("_id").alias("_id"), F.count("*").alias("copies")), "texts"
    )
    whole = Window.partitionBy("g", "ctx")
    runs = _runs(rows.where(F.octet_length("text") >= LENGTH).select("k", "text"))
    counted = runs.withColumns({"n": F.sum("m").over(whole), "rn": F.row_number().over(whole.orderBy("k", "place"))})
    known = stored(counted.select("g", "ctx", "k", "place", "more", "n", "rn"), "runs")
    tidy(spark)
    covered = _spread(known.where("n > 1").select("k", "place", "more"))

    # one row for each different stretch of an anchor; those of anchors with several are compared
    stretch = known.where("rn = 1").select("g", "k", "place", (F.col("n") == 1).alias("alone"))
    several = stretch.groupBy("g").agg(F.count("*").alias("c"), F.max("alone").alias("any")).where("c > 1 and any")
    border = stretch.join(several.select("g", (F.col("c") > HOT).alias("hot")), "g")
    wanted = stored(border.groupBy("k").agg(F.collect_list(F.struct("g", "place", "alone", "hot")).alias("_runs")), "borders")
    want = wanted.join(ids.select("k", "_id"), "k")
    texts = rows.join(want, ["k", "_id"]).select("k", "text", "_runs")
    fetched = stored(_stretches(texts), "stretches")
    tidy(spark)
    dealt = fetched.where("not hot").select("g", "k", "place", "alone", "stretch").repartition("g").sortWithinPartitions("g")
    strings = _strings(fetched.where("hot").select("k", "place", "alone", "stretch"))
    often = strings.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    single = strings.where("alone").join(often, "hash").select("k", "lo", (F.col("lo") + LENGTH).alias("hi"))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    found = covered.unionByName(_compared(dealt)).unionByName(single)
    copied = ids.where("copies > 1").select("k")
    lists = found.join(copied, "k", "left_anti").groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    spans = stored(lists.join(ids.select("k", "_id"), "k"), "spans")
    released(known, wanted, fetched)
    tidy(spark)
    changed = _cut(rows.join(spans, ["k", "_id"]).select("k", "text", "_spans"), keep_text)
    gone = ids.where("copies > 1").select(
        "k", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"),
    )
    return narrow, changed.unionByName(gone)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when strings of 200 bytes that occur twice are removed."""
    narrow, changes = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    met = narrow.join(changes.drop("kept").withColumnRenamed("k", "_k"), F.col("k") == F.col("_k"), "left")
    hit = F.col("_k").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return met.select(
        "doc_id", "n_bytes",
        F.when(hit, F.coalesce("n_removed", "n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(hit, F.col("n_spans")).otherwise(F.lit(0)).alias("n_spans"),
        F.when(hit, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, repeated passages cut out of their texts; n_chars follows if there is one.

    A character of which only some bytes are left goes with them.  Null texts stay null.
    """
    _, changes = repeats(docs.select("doc_id", "text"), keep_text=True)
    key, kept = unused(docs, "_k"), unused(docs, "_kept")
    found = changes.select(F.col("k").alias(key), F.col("kept").alias(kept))
    body = F.coalesce(docs["text"], F.lit(""))
    met = docs.join(found, (_key(body) == F.col(key)) & (F.octet_length(body) >= LENGTH), "left")
    text = F.coalesce(F.col(kept), F.col("text"))
    out = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return met.select(*[c.alias(n) for n, c in out.items()])


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE: dict[str, str] = {}
