"""Spelling variants: words one edit apart, found in tries of letter-group counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import buckets_for, stored, table
from cohortlake.llm.textkit import LOWER, chunks, runs_hashed, word_bounds

#: Words have at least so many code points and occurrences; one in ``DROP`` occurrences loses a letter (the contract's edit).
LETTERS, SEEN, DROP = 7, 2, 31
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: Groups of letters, that is levels of a trie.
GROUPS = 12
#: Words that one trie should hold.
BRANCH = 50_000
#: Comparisons of counts for which a subtree is looked through at once, and of words that are verified at once.
SCAN, VERIFY = 1 << 15, 1 << 18
#: Bytes up to which words are compared in matrices.
WIDTH = 32

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = 1


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_CRC = _crc_table()


def _checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of every stretch of bytes, each going on from a seed."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    crc = ~seeds[order].astype(np.uint32)
    short = int(np.searchsorted(-size, -WIDTH * 2))  # longer ones by zlib
    for i in range(short):
        crc[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~crc[i])))
    for j in range(int(size[short]) if short < len(size) else 0):
        end = int(np.searchsorted(-size, -j))  # those of more than j bytes
        own = slice(short, end)
        crc[own] = _CRC[(crc[own] ^ data[at[own] + j]) & np.uint32(0xFF)] ^ (crc[own] >> np.uint32(8))
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = ~crc
    return out


def _same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> bool:
    """Whether every stretch has the bytes of the stretch ``of`` names, so that no hash collided."""
    if (sizes != sizes[of]).any():
        return False
    order = np.argsort(-sizes, kind="stable")
    at, other, size = starts[order], starts[of][order], sizes[order]
    for j in range(int(size[0]) if len(size) else 0):
        end = int(np.searchsorted(-size, -j))
        if (data[at[:end] + j] != data[other[:end] + j]).any():
            return False
    return True


def _edited(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def counted_words(docs: DataFrame, ident: str, text: str, letters: int = LETTERS, drop: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least ``letters`` code points, and how often each occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased.  With ``drop``, a run loses
    the code point h % length if ``drop`` divides h, the crc32 of ``<id>:<run>`` (a null id is written as nothing).
    Equal runs of a stretch of text are found by their hashes, compared byte by byte, and counted before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["_id"].to_pylist()
            for low, _, raw, offsets in chunks(batch["_text"]):
                data = LOWER[raw]
                kind = _LETTER[data]
                lead = np.flatnonzero(data == 0xC3)  # the first byte of U+00C0 to U+00FF, always followed by the second
                kind[lead] = 1
                kind[lead + 1] = 1
                starts, ends, of = word_bounds(kind, offsets)
                sizes = ends - starts
                found: Counter[bytes] = Counter()
                if drop is not None:
                    seeds = np.array([zlib.crc32(b":" if k is None else b"%d:" % k) for k in keys[low : low + len(offsets) - 1]], np.uint32)
                    h = _checksums(data, starts, sizes, seeds[of])
                    hit = h % np.uint32(drop) == 0
                    for a, b, x in zip(starts[hit].tolist(), ends[hit].tolist(), h[hit].tolist(), strict=True):
                        found[_edited(data[a:b].tobytes(), x)] += 1
                    starts, ends, sizes = starts[~hit], ends[~hit], sizes[~hit]
                long = sizes >= letters
                starts, ends, sizes = starts[long], ends[long], sizes[long]
                _, first, back, times = np.unique(runs_hashed(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                if _same(data, starts, sizes, first[back]):
                    words, counts = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], times.tolist()
                else:
                    own = Counter(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                    words, counts = list(own), list(own.values())
                words += found
                counts += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(count, "word string, n long")
    return rows.where(F.char_length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of every code point below U+0100: letters are dealt out, the most frequent first, each to the group with the fewest so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    seen = sorted(((r["count"], r["letter"]) for r in letters.collect() if r["letter"]), reverse=True)  # at most 90 letters
    load, group = [0] * groups, np.zeros(256, dtype=np.int64)
    for n, letter in seen:
        least = load.index(min(load))
        load[least] += n
        group[ord(letter)] = least
    return group


def vectors(words: Sequence[bytes], group: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Letters of each group in every word (Latin-1 bytes), one row per word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    codes = group[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(of * groups + codes, minlength=len(words) * groups).reshape(-1, groups)


def candidates(home: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``asked``, rows of ``home``) whose counts differ by a surplus and a deficit of at most one each.

    The rows of ``home``, sorted, are a trie: a node is the stretch of rows with the same first counts.  All that ask go down
    together, depth first; each child takes those on whose budget allows its count.  Where little is left
    to compare, a subtree is looked through at once.
    """
    groups = home.shape[1]
    order = np.lexsort(home.T[::-1])
    rows = home[order].astype(np.int16 if max(home.max(initial=0), asked.max(initial=0)) < 1 << 15 else np.int64)
    asked = asked.astype(rows.dtype)
    none = np.zeros(len(asked), dtype=bool)
    stack = [(0, len(rows), 0, np.arange(len(asked)), none, none)] if len(rows) and len(asked) else []
    while stack:
        low, high, depth, who, over, under = stack.pop()
        if depth == groups or (high - low) * len(who) * (groups - depth) <= SCAN:
            if depth < groups:
                gap = asked[who, None, depth:] - rows[None, low:high, depth:]
                more = np.maximum(gap, 0).sum(axis=2) + over[:, None]
                less = np.maximum(-gap, 0).sum(axis=2) + under[:, None]
                a, b = np.nonzero((more <= 1) & (less <= 1))
                if len(a):
                    yield who[a], order[low + b]
                continue
            step = max(1, VERIFY // (high - low))  # all words of a node have the same counts
            for first in range(0, len(who), step):
                part = who[first : first + step]
                yield np.repeat(part, high - low), np.tile(order[low:high], len(part))
            continue
        column = rows[low:high, depth]
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]])
        mine = asked[who, depth]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            gap = mine - column[a]
            up, down = gap == 1, gap == -1
            go = np.flatnonzero((gap == 0) | (up & ~over) | (down & ~under))
            if len(go):
                stack.append((low + a, low + b, depth + 1, who[go], over[go] | up[go], under[go] | down[go]))


def one_edit(x: bytes, y: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least) if x[-1 - i] != y[-1 - i]), least)
    return head + tail >= max(len(x), len(y)) - 1


class _Words:
    """Words ready to be compared by the thousand: letters from the left and from the right, in matrices."""

    def __init__(self, words: Sequence[bytes]):
        self.words, n = words, len(words)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        short = np.minimum(self.size, WIDTH)
        flat = np.frombuffer(b"".join(w[:WIDTH] for w in words), np.uint8)
        row = np.repeat(np.arange(n), short)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(short) - short, short)
        self.left, self.right = np.zeros((n, WIDTH), np.uint8), np.zeros((n, WIDTH), np.uint8)
        self.left[row, at] = flat
        self.right[row, np.repeat(short, short) - 1 - at] = flat

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are one edit apart, for arrays of their numbers."""
        head = np.where((x := self.left[a] != self.left[b]).any(axis=1), x.argmax(axis=1), WIDTH)
        tail = np.where((x := self.right[a] != self.right[b]).any(axis=1), x.argmax(axis=1), WIDTH)
        most, least = np.maximum(self.size[a], self.size[b]), np.minimum(self.size[a], self.size[b])
        out = (a != b) & (most - least <= 1) & (head + tail >= most - 1)
        for i in np.flatnonzero(most > WIDTH).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def _offsets(depth: int) -> np.ndarray:
    """All ways to spend a surplus and a deficit of at most one each on ``depth`` counts that lead to a later prefix."""
    out = {tuple(s * (i == a) - t * (i == b) for i in range(depth)) for a in range(depth) for b in range(depth) for s in (0, 1) for t in (0, 1)}
    return np.array(sorted(o for o in out if o > (0,) * depth), dtype=np.int64).reshape(-1, depth)


def _buckets(prefix: np.ndarray, buckets: int) -> np.ndarray:
    """The trie in which words of this prefix of counts are kept (last axis: counts)."""
    value = np.zeros(prefix.shape[:-1], dtype=np.uint64)
    for i in range(prefix.shape[-1]):
        value = (value ^ prefix[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return (value % np.uint64(buckets)).astype(np.int64)


def _search(group: np.ndarray, depth: int, batch: pa.Table) -> pa.Table:
    """(word, near, near_n) for all near pairs that one trie settles, both ways."""
    column = batch["word"].combine_chunks()
    words = [w.encode("latin-1") for w in column.to_pylist()]
    home = np.flatnonzero(batch["home"].to_numpy())
    counts = vectors(words, group)
    ready = _Words(words)
    one, two = [], []
    for a, b in candidates(counts[home], counts):
        b = home[b]
        for low in range(0, len(a), VERIFY):
            x, y = a[low : low + VERIFY], b[low : low + VERIFY]
            good = ready.near(x, y)
            x, y = x[good], y[good]
            gap = counts[y, :depth] - counts[x, :depth]
            moved = (gap != 0).any(axis=1)
            first = np.where(moved, gap[np.arange(len(gap)), (gap != 0).argmax(axis=1)], 0) if depth else np.zeros(len(x), np.int64)
            mine = (first > 0) | ((first == 0) & np.fromiter((words[i] < words[j] for i, j in zip(x, y, strict=True)), bool, len(x)))
            one.append(x[mine])
            two.append(y[mine])
    x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (one, two))
    n = batch["n"].combine_chunks()
    left, right = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
    return pa.table({"word": column.take(left), "near": column.take(right), "near_n": n.take(right)})


def near_words(words: DataFrame, branch: int = BRANCH) -> DataFrame:
    """(word, near, near_n): all pairs of distinct words (word, n) that one inserted, deleted or replaced letter tells apart, both ways.

    A word's counts of letters in ``GROUPS`` groups are its path in a trie.  One edit changes them by a surplus and a
    deficit of at most one each.  The first counts decide in which trie a word is kept; it asks there and in the tries
    of all later prefixes within that budget, so that every pair meets once.  As many
    first counts are used as it takes for no prefix to hold more than ``branch`` words; should even all counts not do,
    words of equal counts are spread over slices and every slice is asked.
    """
    spark = words.sparkSession
    group = letter_groups(words)
    schema = "word string, n long, counts array<int>"

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors([w.encode("latin-1") for w in batch["word"].to_pylist()], group).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, GROUPS, dtype=np.int32)), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], counts], names=["word", "n", "counts"])

    known = stored(words.select("word", "n").mapInArrow(paths, schema), "paths")
    total = known.count()
    buckets, depth, largest = buckets_for(total, branch), 0, total
    if buckets > 1:
        sizes = known.groupBy("counts").agg(F.count("*").alias("c"))
        cuts = [F.slice("counts", 1, d).alias("cut") for d in range(1, GROUPS + 1)]
        at = sizes.select("c", F.posexplode(F.array(*cuts)).alias("d", "cut")).groupBy("d", "cut").agg(F.sum("c").alias("c"))
        most = sorted(tuple(r) for r in at.groupBy("d").agg(F.max("c")).collect())  # one row per level
        depth, largest = next(((d + 1, c) for d, c in most if c <= branch), (GROUPS, most[-1][1]))
    slices = buckets_for(largest, branch) if depth == GROUPS else 1
    ways = _offsets(depth) if depth else np.zeros((0, 0), np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own = batch["counts"].flatten().to_numpy().astype(np.int64).reshape(n, -1)[:, :depth]
            at = _buckets(own, buckets)
            others = own[:, None, :] + ways[None]
            go = np.where((others >= 0).all(axis=2), _buckets(others, buckets), -1)
            go[go == at[:, None]] = -1
            go.sort(axis=1)
            go[:, 1:][go[:, 1:] == go[:, :-1]] = -1
            asks, column = np.nonzero(go >= 0)
            row = np.concatenate([np.arange(n), asks])
            bucket = np.concatenate([at, go[asks, column]])
            home = np.arange(len(row)) < n
            part = np.zeros(len(row), np.int64)
            if slices > 1:
                live = np.array([zlib.crc32(w.encode()) % slices for w in batch["word"].to_pylist()])
                row, bucket, home = (np.repeat(c, slices) for c in (row, bucket, home))
                part = np.tile(np.arange(slices), len(row) // slices)
                home = home & (live[row] == part)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(part), pa.array(home), batch["word"].take(take), batch["n"].take(take)],
                names=["bucket", "part", "home", "word", "n"],
            )

    rows = known.mapInArrow(dealt, "bucket long, part long, home boolean, word string, n long")

    def search(batch: pa.Table) -> pa.Table:
        return _search(group, depth, batch)

    return stored(rows.groupBy("bucket", "part").applyInArrow(search, "word string, near string, near_n long"), "near")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps word -> form end.  A form occurs ``TIMES`` as often, so chains are short; each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_then"))
        then = stored(now.join(further, "root", "left").select("word", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("_moved")), "roots")
        if then.where("_moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    The form of a word is its near word of largest n, the smallest in code-point order of several, if that n is at
    least ``times`` its own; root is the last of the forms that follow from it, or the word itself.
    """
    words = stored(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    met = words.join(best, "word", "left").withColumn("_n", -F.col("_best.less"))
    good = F.col("_n") >= times * F.col("n")
    found = stored(met.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("_best.near")).alias("form"), F.when(good, F.col("_n")).alias("form_n"),
    ), "forms")
    roots = rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, after the contract's edit, with their forms and roots.

    A null text has no words; the id of a row without one is empty in its checksum; repeated rows count each; an
    empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(counted_words(docs, "doc_id", "text", LETTERS, DROP).where(F.col("n") >= SEEN))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE: dict[str, str] = {}
