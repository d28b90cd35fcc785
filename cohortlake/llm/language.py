"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import table
from cohortlake.llm.textkit import chunks

#: Buckets of subwords, width of an embedding, lengths of a subword in bytes.
BUCKET_BITS, WIDTH, GRAMS = 16, 16, (2, 3, 4)
#: Labelled documents that the model is fitted on, at most; every fifth of them calibrates it.
SAMPLE = 4000
EPOCHS, STEPS, RATE, BATCH = 6, 1500, 0.5, 16
#: Wanted accuracy of the predictions that are not rejected.
ACCEPTED = 0.99

_KEEP = np.full(256, 32, dtype=np.uint8)  # all but letters becomes a space
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of every subword: n bytes inside a word, the space before or behind it included."""
    kept = _KEEP[data]
    gap = kept == 32
    last = np.zeros(len(data) + 1, dtype=np.int64)  # end of the text a byte belongs to
    ends = np.repeat(offsets[1:], np.diff(offsets))
    last[: len(ends)] = ends
    for n in GRAMS:
        m = len(kept) - n + 1
        if m <= 0:
            continue
        value = kept[:m].astype(np.uint64)
        for j in range(1, n):
            value |= kept[j : m + j].astype(np.uint64) << np.uint64(8 * j)
        good = np.arange(n, m + n) <= last[:m]
        for j in range(1, n - 1):
            good &= ~gap[j : m + j]
        good &= ~(gap[:m] & gap[n - 1 : m + n - 1])
        at = np.flatnonzero(good)
        hashed = (value[at] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        yield at, (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bags(docs: DataFrame, label: str) -> DataFrame:
    """(label, buckets, counts) per document: what training needs, of bounded size whatever the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for low, high, data, offsets in chunks(pc.utf8_lower(batch["_text"])):
                for i in range(high - low):
                    own = data[offsets[i] : offsets[i + 1]]
                    found = [b for _, b in _grams(own, np.array([0, len(own)]))]
                    u, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0, int))
                    ids.append(u.astype("int32"))
                    counts.append(c.astype("int32"))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch["_label"], pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                    names=["label", "buckets", "counts"],
                )

    return docs.select(F.col(label).alias("_label"), F.col("text").alias("_text")).mapInArrow(
        count, "label string, buckets array<int>, counts array<int>"
    )


@dataclass
class Model:
    """Scores of every bucket per language (embedding times softmax weights), bias, temperature, rejection level."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(bags: list, seed: int = 7) -> Model:
    """Train on the driver's bounded sample: SGD over embeddings and softmax, then temperature and rejection level."""
    bags = [r for r in bags if len(r["buckets"])]
    languages = sorted({r["label"] for r in bags})
    if not languages:  # nothing to learn from: every text is of unknown language
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 1.0)
    at = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, k), dtype=np.float32)
    bias = np.zeros(k, dtype=np.float32)
    feats = [(np.asarray(r["buckets"]), np.asarray(r["counts"], dtype=np.float32)) for r in bags]
    feats = [(b, (c / c.sum())[:, None]) for b, c in feats]
    goal = np.array([at[r["label"]] for r in bags])
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    train = np.flatnonzero(~held)
    a_pass = max(1, len(train) // BATCH)
    passes = max(EPOCHS, -(-STEPS // a_pass))  # a small sample is seen more often
    steps, step = passes * a_pass, 0
    for _ in range(passes):
        for some in np.array_split(draw.permutation(train), a_pass):
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([(embed[feats[i][0]] * feats[i][1]).sum(axis=0) for i in some])
            err = _softmax(mean @ out + bias)
            err[np.arange(len(some)), goal[some]] -= 1
            back = err @ out.T
            out -= rate * (mean.T @ err) / len(some)
            bias -= rate * err.mean(axis=0)
            for j, i in enumerate(some):  # the average hands the same gradient to each subword, by its share
                embed[feats[i][0]] -= rate * len(feats[i][0]) ** 0.5 * feats[i][1] * back[j]
    scores = embed @ out
    check = np.flatnonzero(held) if held.any() else train
    logits = np.stack([(scores[feats[i][0]] * feats[i][1]).sum(axis=0) for i in check]) + bias
    sure = lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), goal[check]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.02, 5, 60), key=sure))
    prob = _softmax(logits / temperature)
    top, right = prob.max(axis=1), prob.argmax(axis=1) == goal[check]
    order = np.argsort(-top)
    kept = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(kept >= ACCEPTED)
    level = float(top[order][enough[-1]]) if len(enough) else 1.0
    if level <= top.min():
        level = 1.0 / k
    return Model(languages, (scores / temperature).astype(np.float32), bias / temperature, temperature, level)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a text column) to (_id, lang_pred, score, rejected) of whole texts.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every text if the model knows no
    language.  An empty table gives no rows; null ids and repeated rows are predicted like others.  A text whose best score is
    below the calibrated level keeps its prediction and is marked as rejected.
    """
    names = np.array([*model.languages, "und"], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if not model.languages:
                rest = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                yield pa.RecordBatch.from_arrays([batch["_id"], *map(pa.array, rest)], names=["_id", "lang_pred", "score", "rejected"])
                continue
            n, k = batch.num_rows, len(model.languages)
            total, seen = np.zeros((n, k)), np.zeros(n)
            for low, high, data, offsets in chunks(pc.utf8_lower(batch["_text"])):
                if not len(data):
                    continue
                for at, bucket in _grams(data, offsets):
                    edges = np.searchsorted(at, offsets)
                    some = np.flatnonzero(np.diff(edges))
                    if len(some):
                        total[low + some] += np.add.reduceat(model.scores[bucket], edges[some], axis=0)
                        seen[low + some] += np.diff(edges)[some]
            prob = _softmax(total / np.maximum(seen, 1)[:, None] + model.bias)
            best = prob.argmax(axis=1)
            letters = pc.fill_null(pc.match_substring_regex(batch["_text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            score = np.where(letters, prob.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(names[np.where(letters, best, k)], pa.string()), pa.array(score),
                 pa.array(~letters | (score < model.reject_below))],
                names=["_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(
        predict, "_id long, lang_pred string, score double, rejected boolean"
    )


def fold(ident: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents with text and language of folds 0 and 2, the first by a hash of their id."""
    rows = docs.where((fold() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = rows.select("lang", "text", F.xxhash64("doc_id").alias("_h"), "doc_id").orderBy("_h", "doc_id").limit(sample)
    return fit(_bags(some, "lang").collect())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from documents whose crc32(doc_id) mod 3 is not 1.

    Without a text with a language to learn from, all are ``und`` with score 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identified(docs, trained(docs)).withColumnRenamed("_id", "doc_id")
    return found.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
