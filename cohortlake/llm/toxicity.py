"""Toxicity by a classifier chain of linear models over the tokens of whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import lean, released, small_batches, stored, table, tidy
from cohortlake.llm.textkit import chunks, runs_hashed, word_bounds

#: Labelled documents that the chain is fitted on, at most: the first by a hash of their id.
SAMPLE = 20_000
#: Tokens that a model of the chain may use, folds of the out-of-fold predictions, penalty, steps.
FEATURES, FOLDS, PENALTY, STEPS, RATE = 2048, 3, 1e-6, 300, 0.15
#: Standard errors by which the log odds of a chosen token differ from none.
EVIDENCE = 3.0
#: Bytes of text handled at a time: every word makes several tokens, so less than other operators take.
PART = 1 << 19
#: Bytes of the openings of words that count as tokens.
OPENINGS = (4, 5, 6)
#: A document is rejected from this probability of the last category on.
THRESHOLD = 0.5
#: Logit of a category of which nothing is known.
NEVER = -30.0

_KIND = np.full(256, 2, dtype=np.uint8)  # 1: letters, digits and bytes of other scripts; 2: signs; 0: white space
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def _lowered(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """:func:`chunks` of lower-cased texts; not more than ``PART`` of them, or one text, is copied at a time."""
    for first, end, _, _ in chunks(column, PART):
        for low, high, data, offsets in chunks(pc.utf8_lower(column.slice(first, end - first)), PART):
            yield first + low, first + high, data, offsets


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text number, hash) of all tokens, ordered by text.

    Tokens are runs of letters or of signs, lower-cased, and the openings of longer runs of letters, so
    that words of one stem share evidence.
    """
    for low, high, data, offsets in _lowered(column):
        starts, ends, of = word_bounds(_KIND[data], offsets)
        stop, text = [ends], [of]
        start = [starts]
        for n in OPENINGS:
            longer = ends - starts > n
            start.append(starts[longer])
            stop.append(starts[longer] + n)
            text.append(of[longer])
        begin, text = np.concatenate(start), np.concatenate(text)
        hashed = runs_hashed(data, begin, np.concatenate(stop)).view(np.int64)
        order = np.argsort(text, kind="stable")
        yield low, high, text[order], hashed[order]


def _bags(rows: DataFrame, labels: Sequence[str], chosen: np.ndarray) -> DataFrame:
    """Fold, labels and the places in ``chosen`` (sorted hashes) of those distinct tokens of every text that it holds, as int32."""
    given = rows.sparkSession.sparkContext.broadcast(chosen)  # a bounded number of tokens

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for batch in batches:
            out: list[bytes] = []
            for low, high, of, hashed in _tokens(batch["_text"]):
                edges = np.searchsorted(of, np.arange(high - low + 1))
                for a, b in zip(edges, edges[1:], strict=False):
                    own = np.unique(hashed[a:b])
                    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                    out.append(at[hit].astype("<i4").tobytes())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch["_fold"], *(batch[c] for c in labels), pa.array(out, pa.binary())], names=["fold", *labels, "tokens"]
                )

    return rows.mapInArrow(lean(bag), ", ".join(["fold int", *(f"{c} int" for c in labels), "tokens binary"]))


def _token_counts(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per token and fold: texts that hold it (n_<fold>), and those of them in each category (<label>_<fold>)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch["_fold"].to_numpy()
            marks = [np.ones(batch.num_rows, dtype=np.int64), *(batch[c].to_numpy().astype(np.int64) for c in labels)]
            for low, _, of, hashed in _tokens(batch["_text"]):
                order = np.lexsort((hashed, of))
                text, token = of[order], hashed[order]
                once = np.ones(len(text), dtype=bool)
                once[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
                text, token = text[once] + low, token[once]
                order = np.lexsort((fold[text], token))
                text, token = text[order], token[order]
                if not len(text):
                    continue
                head = np.ones(len(text), dtype=bool)
                head[1:] = (token[1:] != token[:-1]) | (fold[text[1:]] != fold[text[:-1]])
                at = np.flatnonzero(head)
                sums = [pa.array(np.add.reduceat(m[text], at)) for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(fold[text[at]]), *sums], names=["token", "fold", "n", *labels])

    long = rows.mapInArrow(lean(count), ", ".join(["token long", "fold int", "n long", *(f"{c} long" for c in labels)]))
    return long.groupBy("token").agg(*[
        F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(F.lit(0))).alias(f"{c}_{f}") for f in range(FOLDS) for c in ("n", *labels)
    ])


def _chosen(counts: DataFrame, totals: dict[int, dict[str, int]], label: str, without: int | None) -> np.ndarray:
    """The ``FEATURES`` tokens whose log odds ratio for a category stands out most in all folds but ``without``.

    Tokens that speak against a category are left out: harmless words around them don't outweigh harmful ones.  So are
    those that stand out less than ``EVIDENCE`` standard errors: among many rare words, some always meet in a few texts of a
    category by chance, and would take weight from those that cause it.
    """
    folds = [f for f in range(FOLDS) if f != without]
    n, ones = (float(sum(totals.get(f, {}).get(c, 0) for f in folds)) for c in ("n", label))
    inside = reduce(Column.__add__, [F.col(f"{label}_{f}") for f in folds])
    seen = reduce(Column.__add__, [F.col(f"n_{f}") for f in folds])
    outside = seen - inside
    odds = F.log((inside + 0.5) / (ones - inside + 0.5)) - F.log((outside + 0.5) / (n - ones - outside + 0.5))
    z = odds / F.sqrt(1 / (inside + 0.5) + 1 / (outside + 0.5))
    best = counts.where(seen >= 3).select("token", z.alias("z")).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "token").limit(FEATURES)
    return np.sort(np.array([r["token"] for r in best.collect()], dtype=np.int64))


@dataclass
class Link:
    """One category of the chain: chosen tokens (sorted hashes), their weights, weights of earlier logits, bias."""

    tokens: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, of: np.ndarray, hashed: np.ndarray, texts: int, before: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, hashed), max(len(self.tokens) - 1, 0))
        hit = self.tokens[at] == hashed if len(self.tokens) else np.zeros(len(hashed), bool)
        pairs = np.unique(of[hit].astype(np.int64) * (len(self.tokens) + 1) + at[hit])  # a token counts once a text
        text, token = np.divmod(pairs, len(self.tokens) + 1)
        return np.bincount(text, self.weights[token], minlength=texts) + before @ self.earlier + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_link(of: np.ndarray, hashed: np.ndarray, before: np.ndarray, goal: np.ndarray, chosen: np.ndarray) -> Link:
    """Logistic regression on the chosen tokens and the earlier logits, by Adam steps over all rows."""
    n, ones, width = len(goal), float(goal.sum()), len(chosen)
    place = np.minimum(np.searchsorted(chosen, hashed), max(width - 1, 0))
    used = chosen[place] == hashed if width else np.zeros(len(hashed), bool)
    rows, cols = of[used], place[used]
    beta = np.zeros(width + before.shape[1] + 1)
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    beta[-1] = np.log((ones + 0.5) / (n - ones + 0.5))
    for t in range(1, STEPS + 1):
        logit = np.bincount(rows, beta[cols], minlength=n) + before @ beta[width:-1] + beta[-1]
        err = (_sigmoid(logit) - goal) / n
        grad = np.concatenate([np.bincount(cols, err[rows], minlength=width), before.T @ err, [err.sum()]])
        grad[:-1] += PENALTY * beta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        beta -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Link(chosen, beta[:width], beta[width:-1], float(beta[-1]))


def fit_chain(bags: list, categories: Sequence[str], chosen: dict[tuple[str, int | None], np.ndarray]) -> list[Link]:
    """Fit the categories one after the other on a bounded sample.

    Each later model is trained on the earlier categories' *out-of-fold* logits: what models that have not
    seen a document say of it, as it will be when the chain is applied.  ``chosen`` has the tokens of each
    category for all folds (None) and without each fold, so the choice of tokens is out of fold too.
    Without labelled documents no text belongs to any category.
    """
    n = len(bags)
    if not n:
        none = np.zeros(0, np.int64)
        return [Link(none, np.zeros(0), np.zeros(i), NEVER) for i in range(len(categories))]
    of = np.repeat(np.arange(n), [len(r["tokens"]) for r in bags])
    hashed = np.concatenate([np.asarray(r["tokens"], dtype=np.int64) for r in bags])
    fold = np.array([r["fold"] for r in bags])
    before, chain = np.zeros((n, 0)), []
    for name in categories:
        goal = np.array([r[name] for r in bags], dtype=float)
        chain.append(_fit_link(of, hashed, before, goal, chosen[name, None]))
        unseen = np.zeros(n)
        for f in range(FOLDS):
            rest = np.flatnonzero(fold != f)
            number = np.full(n, -1)
            number[rest] = np.arange(len(rest))
            keep = number[of] >= 0
            if len(rest):
                link = _fit_link(number[of[keep]], hashed[keep], before[rest], goal[rest], chosen[name, f])
                unseen[fold == f] = link.logits(of, hashed, n, before)[fold == f]
        before = np.column_stack([before, np.clip(unseen, -8, 8)])
    return chain


def scored(docs: DataFrame, chain: Sequence[Link], categories: Sequence[str]) -> DataFrame:
    """(_id, one probability per category) of every whole text; a null text has no tokens."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probs = [np.zeros(batch.num_rows) for _ in chain]
            for low, high, of, hashed in _tokens(batch["_text"]):
                before = np.zeros((high - low, 0))
                for p, link in zip(probs, chain, strict=True):
                    logit = link.logits(of, hashed, high - low, before)
                    p[low:high] = _sigmoid(logit)
                    before = np.column_stack([before, np.clip(logit, -8, 8)])
            yield pa.RecordBatch.from_arrays([batch["_id"], *map(pa.array, probs)], names=["_id", *categories])

    return docs.mapInArrow(lean(apply), ", ".join(["_id long", *(f"{c} double" for c in categories)]))


def trained(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list[Link]:
    """Fit on at most ``sample`` labelled documents (the first by a hash of their id).

    A document labelled more than once has a category if any of its labels says so; labels with a null id
    or a null category, and documents without text, take no part.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    known = known.dropna().groupBy("_id").agg(*[F.max(n).alias(n) for n in categories])
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded, so it can be sent to every task
    rows = docs.where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    fold = F.pmod(F.xxhash64("_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("_fold")
    rows = stored(rows.select(*categories, F.col("text").alias("_text"), fold), "labelled")
    names = list(categories)
    counts = stored(_token_counts(rows, names), "tokens")
    sums = rows.groupBy("_fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()  # one row per fold
    totals = {r["_fold"]: r.asDict() for r in sums}
    chosen = {(c, f): _chosen(counts, totals, c, f) for c in names for f in (None, *range(FOLDS))}
    known = np.unique(np.concatenate(list(chosen.values())))
    bags = _bags(rows, names, known).collect()  # four bytes per chosen token of at most ``sample`` texts, as packed bytes
    released(rows, counts)
    # an order that does not depend on how the table is cut into tasks
    bags.sort(key=lambda r: (r["fold"], bytes(r["tokens"]), *(r[c] for c in names)))
    given = [{"fold": r["fold"], "tokens": known[np.frombuffer(r["tokens"], "<i4")], **{c: r[c] for c in names}} for r in bags]
    del bags
    chain = fit_chain(given, names, chosen)
    del given
    tidy(docs.sparkSession)
    return chain


def rejected(docs: DataFrame, chain: Sequence[Link], categories: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """(_id, a probability per category, rejected) with the decision on the last category."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")), chain, categories)
    return rows.withColumn("rejected", F.col(categories[-1]) >= threshold)


def label_categories() -> dict[str, Column]:
    """The two categories that the given labels hold, in chain order: poor quality, then toxic."""
    return {"p_low_quality": 1 - F.col("quality"), "p_toxic": F.col("toxic")}


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities; ``toxic`` is the decision.

    A null or empty text has no tokens and gets the chain's biases alone; a null id is a value; repeated rows are scored
    each.  No documents give no rows; without labelled documents all probabilities are next to 0 and nothing is toxic.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = label_categories()
    chain = trained(docs, table(spark, sf_dir, "labels"), kinds)
    found = rejected(docs, chain, list(kinds))
    return found.select(F.col("_id").alias("doc_id"), *kinds, F.col("rejected").alias("toxic"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the chain does not reject, with all their columns.

    The score is worked out in the task that reads a document, so no row is moved; a null doc_id is judged
    by its text like any other, a null text by the chain's biases.  Without labelled documents all stay.
    """
    kinds = label_categories()
    chain = trained(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), kinds)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, of, hashed in _tokens(batch.column(at)):
                before = np.zeros((high - low, 0))
                for link in chain:
                    logit = link.logits(of, hashed, high - low, before)
                    before = np.column_stack([before, np.clip(logit, -8, 8)])
                yield batch.slice(low, high - low).filter(pa.array(_sigmoid(logit) < THRESHOLD))

    return docs.mapInArrow(lean(keep), docs.schema)


QUERIES = {"op5_classifier_chain": op5_classifier_chain}
ORACLE: dict[str, str] = {}
