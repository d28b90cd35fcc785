"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import buckets_for, lean, numbered, small_batches, stored, table
from cohortlake.llm.encoding import encoder
from cohortlake.llm.textkit import chunks

#: End-of-document id that closes every document.
END_ID = 2
#: Bytes of text that are encoded at a time.
TEXT = 1 << 22


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, ident: str, text: str, tokenizer: str, room: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its ids and ``END_ID``; a null text is empty.  One longer than ``room`` is cut into
    pieces of ``room`` ids, and what is left over is the first, shorter piece.
    """
    schema = PIECES + (", ids array<long>" if with_ids else "")

    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, *([pa.list_(pa.int64())] if with_ids else [])]
        for batch in batches:
            for low, high, _, _ in chunks(batch["_text"], TEXT):
                texts = [t or "" for t in batch["_text"].slice(low, high - low).to_pylist()]
                rows = []
                for key, found in zip(batch["_id"].slice(low, high - low).to_pylist(), own.encode(texts), strict=True):
                    ids = found.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    edges = [0, *range(n % room or room, n + 1, room)] if n > room else [0, n]
                    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        raw = ids[4 * a : 4 * b]
                        row = (key, i, a, b - a, zlib.crc32(raw))
                        rows.append((*row, np.frombuffer(raw, "<u4").astype("int64")) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(cut), schema)


def best_two_fit(counts: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Bins of ``room`` for ``counts[length]`` items, as (number of equal bins, item lengths).

    Best-two-fit: a bin takes the longest item left that fits, again and again.  Then its smallest item
    s gives way to the two unpacked items of the greatest sum that fit into the gap and s together, if
    that sum is greater than s.  As long as no length runs out, the next bin gets the same lengths, so
    bins are made in runs; each run uses up at least one length but for a few items.
    """
    left = np.zeros(room + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    if left[0]:
        raise ValueError("items of length 0 cannot be packed")
    runs: list[tuple[int, list[int]]] = []
    while left.any():
        free, items, taken = room, [], {}
        lengths = np.flatnonzero(left)
        at = len(lengths)
        while at:
            at = min(at, int(np.searchsorted(lengths, free, "right")))
            if not at:
                break
            n = int(lengths[at - 1])
            take = min(free // n, int(left[n]) - taken.get(n, 0))
            if take:
                items += [n] * take
                taken[n] = taken.get(n, 0) + take
                free -= n * take
            at -= 1
        if free and len(items) > 1:
            small = items[-1]
            spare = left.copy()
            for n, c in taken.items():
                spare[n] -= c
            pair = _two(spare, free + small)
            if pair and sum(pair) > small:
                items[-1:] = pair
        need = {n: items.count(n) for n in set(items)}
        times = min(int(left[n]) // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * times
        runs.append((times, items))
    return runs


def _two(spare: np.ndarray, gap: int) -> list[int] | None:
    """The two items of the greatest sum up to ``gap``."""
    have = np.flatnonzero(spare)
    have = have[have < gap]
    if not len(have):
        return None
    at = np.searchsorted(have, gap - have, "right") - 1  # for each: the longest partner
    partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    own = (partner == have) & (spare[have] < 2)  # only one of that length: the next shorter one
    lower = np.maximum(at - 1, 0)
    partner = np.where(own, np.where(at > 0, have[lower], 0), partner)
    total = np.where(partner > 0, have + partner, 0)
    best = int(total.argmax())
    return [int(max(have[best], partner[best])), int(min(have[best], partner[best]))] if total[best] else None


def packed(pieces: DataFrame, room: int, length: str = "length", ident: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` plus sequence_id and offset.

    Items of equal length are interchangeable, so the bins are worked out on how many there are of each
    length: at most ``room`` counters, whatever the table.  Then every item is numbered among those of
    its length (spread over buckets, as one length may be most of the table) and looks up the run of bins
    and the place to which its number belongs.  The look-up table has one row per run and place.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    runs = best_two_fit(counts, room)
    first = 0
    given: dict[int, int] = {}
    places: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for times, items in runs:
        offset, at = 0, 0
        while at < len(items):
            n, each = items[at], 1
            while at + each < len(items) and items[at + each] == n:
                each += 1
            low = given.get(n, 0)
            given[n] = low + each * times
            # numbers low .. low + each*times - 1 of this length: bin first + k // each, place k % each
            places.setdefault(n, []).append((low, low + each * times, each, first, offset))
            offset += n * each
            at += each
        first += times
    # one row per length with the runs that use it
    runs_of = spark.createDataFrame(
        list(places.items()), "_len long, _runs array<struct<low:long,high:long,each:long,first:long,offset:long>>"
    )
    ranked = numbered(pieces, [length], list(ident), buckets_for(sum(counts.values())), "_number")
    met = ranked.join(F.broadcast(runs_of), F.col(length) == F.col("_len"))
    run = F.filter("_runs", lambda r: (r["low"] <= F.col("_number")) & (r["high"] > F.col("_number")))[0]
    found = met.withColumn("_run", run)
    k = F.col("_number") - F.col("_run.low")
    return found.select(
        *pieces.columns,
        (F.col("_run.first") + F.floor(k / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + F.pmod(k, F.col("_run.each")) * F.col(length)).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, room: int = 1024, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) cut, packed and placed; one row per piece.

    A null text is a document of ``END_ID`` alone.  Repeated rows are documents of their own, and a null
    doc_id is a value.  An empty table gives no rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    pieces = stored(tokenised(docs, "doc_id", "text", tokenizer, room, with_ids), "pieces")
    return packed(pieces, room)


def sequences(layout: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, from a layout that carries ids (room bounds a group)."""
    spans = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return layout.groupBy("sequence_id").agg(F.flatten(F.transform(spans, lambda s: s["ids"])).alias("ids"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_best_two_fit": op3_best_two_fit}
ORACLE: dict[str, str] = {}
