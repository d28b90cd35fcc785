"""Periodic runs of words, found as maximal pairs in the LCP-interval tree of each text."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import table

#: A run has at least ``LEAST`` words and ``TIMES`` periods.
LEAST, TIMES = 24, 3
#: Bytes of text in one batch of results.
BATCH = 1 << 23


def common_floor(least: int, times: int) -> int:
    """Words that two suffixes share at least if they make a run: the least of max(least - q, (times - 1) * q) over all q."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def repeats_itself(words: np.ndarray, length: int) -> bool:
    """Whether any ``length`` words in a row occur twice.

    Prefixes are doubled, but a place leaves as soon as its prefix occurs once, so little is left after few steps.
    """
    n = len(words)
    at, own, done = np.arange(n), words, 1
    while True:
        count = np.bincount(own, minlength=1)
        full = np.arange(n + 1) + n  # places that have left, and the end, are like no other
        full[at] = own
        at = at[count[own] > 1]
        if not len(at) or done == length:
            return bool(len(at))
        step = min(done, length - done)
        at = at[at + step <= n]
        if not len(at):
            return False
        own = np.unique(full[at] * (2 * n + 1) + full[at + step], return_inverse=True)[1]
        done += step


def repeated_suffixes(words: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lcp) of the suffixes that share ``floor`` words or more with another, in their order; lcp[k] is what k - 1 and k share.

    Prefix doubling: a suffix is ranked by its first 1, 2, 4, ... words, each rank being where its group begins in the
    order; a group is sorted by the ranks of what follows until it is one suffix.  The ranks of all steps give the
    shared words by halving.  Ranks are exact, so no hash can collide.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, length = [], 1
    while True:
        levels.append((length, np.append(rank, -1).astype(np.int32)))
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        after = levels[-1][1][np.minimum(open_ + length, n)]
        sort = np.lexsort((after, rank[open_]))
        at, group, after = open_[sort], rank[open_][sort], after[sort]
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = group[1:] != group[:-1]
        cut = begins.copy()
        cut[1:] |= after[1:] != after[:-1]
        number = np.arange(len(at))
        inside = np.maximum.accumulate(np.where(cut, number, 0)) - np.maximum.accumulate(np.where(begins, number, 0))
        rank = rank.copy()
        rank[at] = group + inside
        length *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for step, ranks in reversed(levels):
        same = (ranks[a] == ranks[b]) & (a < n) & (b < n)
        a, b = a + step * same, b + step * same
        shared[1:] += step * same
    near = shared >= floor
    near[:-1] |= near[1:]
    return order[near], shared[near]


def maximal_pairs(words: np.ndarray, positions: np.ndarray, lcp: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, shared): maximal pairs i < j of equal stretches of ``shared`` words, with shared >= max(least - q, (times - 1) * q) for q = j - i.

    The LCP-interval tree is walked bottom-up.  An interval of value l carries its positions in order, each in the class
    of the word on its left; when a child joins, the smaller list goes into the larger one, position by position.
    Pairs of different children can't be extended to the right, pairs of different classes not to the left.  Of the
    positions within reach = l / (times - 1) of a position, which all repeat the same l words, all are one period
    apart as reach <= l / 2, so that all but the first share their left word: an odd class can only be met at either end.
    """
    floor = common_floor(least, times)
    left = words.tolist()

    def joined(one: list[int], two: list[int], value: int) -> list[int]:
        nonlocal found
        if len(one) < len(two):
            one, two = two, one
        reach, nearest = value // (times - 1), max(least - value, 1)
        new = []
        for i in two:
            low, high = bisect_left(one, i - reach), bisect_right(one, i + reach)
            if low == high:
                continue
            for j in {one[low], one[high - 1]}:
                a, b = (i, j) if i < j else (j, i)
                if b - a >= nearest and (a == 0 or left[a - 1] != left[b - 1]):
                    new.append((a, b, value))
        found = new
        if two[0] > one[-1]:
            one.extend(two)
        elif len(two) * 8 < len(one):
            for i in two:
                insort(one, i)
        else:
            one.extend(two)
            one.sort()
        return one

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    values = [*lcp.tolist()[1:], 0]
    for position, value in zip(positions.tolist(), values, strict=True):
        own = [position]
        while stack and stack[-1][0] > value:
            depth, list_ = stack.pop()
            own = joined(list_, own, depth)
            yield from found
        if value < floor:  # and so the stack is empty
            continue
        if stack and stack[-1][0] == value:
            stack[-1] = (value, joined(stack[-1][1], own, value))
            yield from found
        else:
            stack.append((value, own))


def runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of numbered words, by start, then period.

    A run is a stretch of at least ``least`` words and ``times`` periods that no neighbour extends; its period is the
    smallest.  Every maximal pair whose distance fits is a run as it stands: words q apart are equal over its whole
    length and differ at both ends.  Pairs at multiples of the period of the same stretch give way to the smallest.
    """
    if times < 3:
        raise ValueError("fewer than three periods: positions within reach need not be one period apart")
    if len(words) < max(least, times):
        return []
    floor = common_floor(least, times)
    if not repeats_itself(words, floor):
        return []
    positions, lcp = repeated_suffixes(words, floor)
    best: dict[tuple[int, int], int] = {}
    for i, j, shared in maximal_pairs(words, positions, lcp, least, times):
        key = (i, j - i + shared)
        best[key] = min(best.get(key, j - i), j - i)
    return sorted((s, n, q) for (s, n), q in best.items())


def kept_words(words: Sequence[bytes], found: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """Words outside of runs, and the first period of each run unless another run covers it."""
    if not found:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def numbered_words(words: Sequence[bytes]) -> np.ndarray:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, ident: str, text: str, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; ``runs`` are all periodic runs (start, length, period), ordered;
    ``collapsed`` has the words that no run repeats, joined by one space.  ``edit`` may change the words of a document
    before.  A null text has no words; a null id is a value; repeated rows are documents of their own; an empty table gives no
    rows; other columns are not read.  A text is one task's work; its neighbours in a batch are not held up by copies of it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            keys, column = batch["_id"].to_pylist(), batch["_text"]
            rows, size = [], 0
            for i, key in enumerate(keys):
                words = (column[i].as_py() or b"").split()
                if edit is not None:
                    words = edit(key, words)
                found = runs(numbered_words(words))
                body = b" ".join(kept_words(words, found))
                rows.append((key, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], body))
                size += len(body)
                if size > BATCH or i == len(keys) - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), kind, pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                    rows, size = [], 0

    return docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(find, RUNS)


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: of one document in ten, by the checksum of its id, the words from some place on repeat the first of them.

    A document without an id is left alone.
    """
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the planted edit: their number, the one of most periods, digests of all and of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, "doc_id", "text", planted)
    # length / period as an exact order: cross products of longs
    most = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.withColumn("_top", most)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE: dict[str, str] = {}
