"""Order MinHash fingerprints of texts (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import buckets_for, table

#: Words of a k-mer, or code points where words are too few.
WORDS, POINTS = 3, 5
#: Code points for each k-mer of words: k-mers of code points are taken from NEAR on, those of words below FAR.
NEAR, FAR = 8, 12
#: K-mers of words: those of words are taken if there are more than FEW, those of code points if there are SHORT at most.
FEW, SHORT = 2, 6
#: Low bits that hold a k-mer's place in its text; above them 64 bins (6 bits) and 31 bits of hash.
PLACE = 27
#: Ranges of ids that are told apart by quantiles, and documents in a bucket inside a range.
RANGES, BUCKET = 32, 2000
#: Bits of a component's hash.
HASH = 40


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _placed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(-(1 << PLACE))).bitwiseOR(place.cast("long"))


def _occurrences(units: Column, width: int) -> Column:
    """The k-mers of ``width`` units as long values: hash of (k-mer, number of its occurrence) above, place below."""
    count = F.greatest(F.size(units) - (width - 1), F.lit(1))

    def hashed(i: Column) -> Column:
        """Nulls don't count in the hash."""
        return F.xxhash64(*[F.get(units, i + j) for j in range(width)])

    kmers = F.transform(F.sequence(F.lit(0), count - 1), hashed)

    def first_only(k: Column) -> Column:
        return F.transform(k, lambda h, i: _placed(F.xxhash64(F.shiftright(h, PLACE), F.lit(1)), i))

    def number(ranked: Column) -> Column:
        """Equal k-mers stand together here, in text order."""
        n = F.size(ranked)
        heads = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: (j == 0) | (F.shiftright(F.get(ranked, j), PLACE) != F.shiftright(F.get(ranked, j - 1), PLACE)),
        )
        mask = F.lit((1 << PLACE) - 1)

        def run(start: Column, end: Column) -> Column:
            def one(j: Column) -> Column:
                own = F.get(ranked, j)
                return _placed(F.xxhash64(F.shiftright(own, PLACE), j - start + 1), own.bitwiseAND(mask))

            return F.transform(F.sequence(start, end - 1), one)

        return _let(heads, lambda at: F.flatten(F.transform(at, lambda s, r: run(s, F.coalesce(F.get(at, r + 1), n)))))

    def numbered(k: Column) -> Column:
        ranked = F.sort_array(F.transform(k, _placed))
        return F.when(F.size(F.array_distinct(F.transform(k, lambda h: F.shiftright(h, PLACE)))) == F.size(k), first_only(k)).otherwise(
            _let(ranked, number)
        )

    return _let(kmers, numbered)


def _kinds(words: Column, clean: Column) -> tuple[Column, Column]:
    """Whether a text has k-mers of words, and of code points.

    Words say little about an edit where they are few for the code points.  The two kinds overlap, so that a text
    and its edited form, a quarter of it changed, have one in common.
    """
    kmers, n = F.greatest(F.size(words) - (WORDS - 1), F.lit(1)), F.length(clean)
    tiny = n <= 3
    return tiny | ((kmers > FEW) & (n < FAR * kmers)), ~tiny & ((kmers <= SHORT) | (n >= NEAR * kmers))


def order_minhash(text: Column) -> Column:
    """Signature of a text: at most 32 long values for each kind of k-mer, ascending, each a tuple's number and hash.

    K-mers are ``WORDS`` words, with tuple numbers below 32, or ``POINTS`` code points, with numbers from 32, in
    texts with few words for their length (unsegmented scripts, long tokens, few words); texts between have both.
    Every occurrence-numbered k-mer falls into one of 64 bins by its hash; the smallest of
    each bin is chosen.  Two bins make a tuple: their chosen k-mers are put back into text order and
    hashed as a sequence, so a tuple agrees only if both k-mers are kept in the same order.  Tuples without
    a k-mer are left out.  A text without words has no tuple; shorter ones than a k-mer have one.
    Words are runs of characters other than white space.  All work stays in one row, in time n log n.
    """
    white = " \t\n\x0b\f\r"
    clean = F.btrim(text, F.lit(white))
    smallest = lambda v: F.filter(
        v, lambda x, j: (j == 0) | (F.shiftright(x, 58) != F.shiftright(F.get(v, j - 1), 58))
    )
    mask, low = F.lit((1 << PLACE) - 1), F.lit((1 << HASH) - 1)

    def tuples(chosen: Column, base: int) -> Column:
        def one(x: Column, j: Column) -> Column:
            after, group = F.get(chosen, j + 1), F.shiftright(x, 59)
            pair = F.shiftright(after, 59) == group
            second = F.shiftright(F.get(chosen, j - 1), 59) == group
            ahead = x.bitwiseAND(mask) <= after.bitwiseAND(mask)
            a, b = F.shiftright(x, PLACE), F.shiftright(after, PLACE)
            hashed = F.when(pair & ahead, F.xxhash64(a, b)).when(pair, F.xxhash64(b, a)).otherwise(F.xxhash64(a))
            own = F.shiftleft(group + base, HASH).bitwiseOR(hashed.bitwiseAND(low))
            return F.when(~F.coalesce((j > 0) & second, F.lit(False)), own)

        return F.filter(F.transform(chosen, one), lambda c: c.isNotNull())

    def signed(units: Column, width: int, base: int) -> Column:
        return _let(F.sort_array(_occurrences(units, width)), lambda v: _let(smallest(v), lambda c: tuples(c, base)))

    none = F.array().cast("array<long>")

    def both(c: Column) -> Column:
        def made(words: Column) -> Column:
            by_words, by_points = _kinds(words, c)
            return F.concat(
                F.when(by_words, signed(words, WORDS, 16)).otherwise(none),
                F.when(by_points, _let(F.split(c, ""), lambda u: signed(u, POINTS, 48))).otherwise(none),
            )

        return F.when(F.length(c) == 0, none).otherwise(_let(F.split(c, "[\\x20\\x09-\\x0D]+"), made))

    return _let(clean, both)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda c: F.lower(F.hex(c))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two texts by their signatures alone, 0 to 1.

    Square root of the part of tuples that agree, as a tuple needs two k-mers: of words if both signatures have such, else
    of code points, so 0 if they have no kind in common.  1 for two empty signatures.
    """
    number = lambda s: F.transform(s, lambda c: F.shiftright(c, HASH))
    worded = lambda s: F.coalesce(F.shiftright(F.get(s, F.lit(0)), HASH) < 32, F.lit(False))

    def compared(p: Column) -> Column:
        part = lambda s: F.filter(s, lambda c: (F.shiftright(c, HASH) < 32) == p["w"])

        def shared(q: Column) -> Column:
            either = F.size(F.array_distinct(F.concat(number(q["a"]), number(q["b"]))))
            return F.when(either == 0, F.lit(0.0)).otherwise(F.sqrt(F.size(F.array_intersect(q["a"], q["b"])) / either))

        return _let(F.struct(part(p["a"]).alias("a"), part(p["b"]).alias("b")), shared)

    met = _let(F.struct(a.alias("a"), b.alias("b"), (worded(a) & worded(b)).alias("w")), compared)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(met)


def with_next(docs: DataFrame, ident: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """``ident``, ``columns`` and ``derived`` of every row, plus _next_<column> of the row with the next id; the first follows the last.

    Rows are dealt once, to buckets of ids: quantiles of the ids cut the table into ``RANGES``, and each range is cut
    evenly.  The next row is the following one in the bucket; only the last row of a bucket looks up the
    first of the next bucket, which is found without moving the others.  ``derived`` columns, functions
    of ``columns``, are worked out once per row.  Null ids come first, equal ids in the order of a hash of the row.
    """
    derived = derived or {}
    docs = docs.select(ident, *columns)
    rows = docs.count()
    probs = [i / RANGES for i in range(1, RANGES)]
    found = docs.agg(F.min(ident), F.max(ident), F.percentile_approx(ident, probs)).first()
    edges = sorted({found[0], *(found[2] or [])}) if found[0] is not None else [0]
    ends = [*edges[1:], (found[1] or 0) + 1]
    inside = buckets_for(-(-rows // RANGES), BUCKET)
    cut = F.array(*[F.lit(e).cast("long") for e in edges])
    to = F.array(*[F.lit(e).cast("long") for e in ends])
    value = F.col(ident).cast("long")
    part = F.size(F.filter(cut, lambda e: e <= value)) - 1
    part = F.when(value.isNull(), F.lit(-1)).otherwise(part)
    share = (value - F.get(cut, part)) * inside / F.greatest(F.get(to, part) - F.get(cut, part), F.lit(1))
    dealt = docs.withColumn("_part", part).withColumn(
        "_bucket", F.when(F.col("_part") < 0, F.lit(-1).cast("long")).otherwise(F.col("_part").cast("long") * inside + F.floor(share))
    )
    order = [F.col(ident).asc_nulls_first(), F.xxhash64(*columns)]
    within = Window.partitionBy("_bucket").orderBy(*order)
    names = [*columns, *derived]
    ahead = dealt.withColumns(derived).withColumns({
        **{f"_next_{c}": F.lead(c).over(within) for c in names}, "_more": F.lead(F.lit(1)).over(within),
    })
    buckets = dealt.select("_part", "_bucket").distinct()
    parts = sorted(buckets.groupBy("_part").agg(F.min("_bucket").alias("_first")).collect(), key=lambda r: r["_part"])
    wrap = {a["_part"]: b["_first"] for a, b in zip(parts, [*parts[1:], *parts[:1]], strict=True)}
    beyond = F.lit(None).cast("long")
    for p, b in wrap.items():
        beyond = F.when(F.col("_part") == p, F.lit(b).cast("long")).otherwise(beyond)
    follow = buckets.select(
        F.col("_bucket").alias("_from"), F.coalesce(F.lead("_bucket").over(Window.partitionBy("_part").orderBy("_bucket")), beyond).alias("_to")
    )
    first = dealt.withColumn("_rank", F.row_number().over(within)).where("_rank = 1").withColumns(derived)
    heads = follow.join(first.withColumnRenamed("_bucket", "_head"), F.col("_to") == F.col("_head"))
    heads = heads.select("_from", *[F.col(c).alias(f"_h_{c}") for c in names])
    met = ahead.join(heads, F.col("_bucket") == F.col("_from"), "left")
    return met.select(
        ident, *names, *[F.when(F.col("_more").isNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"_next_{c}") for c in names]
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text).

    The edited text has its last quarter (rounded down, in characters) replaced by as many of the next
    document's first characters.  Null texts are empty; of a single document the next is itself.  The likenesses
    are those of the two signatures by :func:`likeness`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    met = with_next(rows, "doc_id", ["text"], {"sign": order_minhash(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next_text"), F.lit(1), cut))
    changed = met.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "sign", F.col("_next_sign").alias("_after")
    ).withColumn("_sign", order_minhash(F.col("_edited")))
    return changed.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sign")).alias("fingerprint"), as_text(F.col("_sign")).alias("edited_fingerprint"),
        likeness(F.col("sign"), F.col("_sign")).alias("near_edited"), likeness(F.col("sign"), F.col("_after")).alias("near_next"),
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents, of their edited texts, and likenesses."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_order_minhash": op9_order_minhash}
ORACLE: dict[str, str] = {}
