"""Operators on documents against brute force, with awkward and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from texts import words
from pyspark.sql import functions as F

from cohortlake.llm import common, encoding, fingerprints, jaccard, mixing, packing, sharding, suffixes, textkit, token_files, toxicity

PATH = "byte_bpe_50k.json"


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def pairs(rows):
    return [(r[0], (r[1] or "").encode()) for r in rows]


# --- op1 --------------------------------------------------------------------------------------


def test_shards_hold_every_row_once(spark, folder, documents):
    sf = folder(documents=documents())
    rows = sharding.op1_kd_shards(spark, sf).collect()
    docs = documents().collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in rows],
         [(d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs])
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_are_even_although_copies_hold_a_third(spark):
    rows = [(i, words(0, 50) if i % 3 == 0 else words(i, 20 + i % 70)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = F.octet_length("text") + 8
    crc = F.crc32(F.col("text").cast("binary"))
    out = sharding.kd_shards(docs, "doc_id", size, {"bytes": F.log2(size) * 2048, "crc": F.shiftright(crc, 16)}, crc, 10)
    load = [r["w"] for r in out.groupBy("shard").agg(F.sum("w").alias("w")).collect()]
    assert len(load) == 10 and max(load) < 1.03 * sum(load) / 10 and min(load) > 0.97 * sum(load) / 10
    spread = out.groupBy("tie").agg(F.countDistinct("shard").alias("s"), F.count("*").alias("n")).where("n < 100").agg(F.max("s")).first()[0]
    assert spread == 1  # other equal texts stay together


def test_empty_documents(spark, folder, documents):
    sf = folder(documents=documents([]))
    for query in (sharding.op1_kd_shards, jaccard.op2_ngram_jaccard, packing.op3_best_two_fit, suffixes.op8_suffix_dedup,
                  fingerprints.op9_order_minhash, mixing.op10_temperature_mix, token_files.op12_token_files):
        assert query(spark, sf).count() == 0


# --- op2 --------------------------------------------------------------------------------------


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(r[0], len(s), low.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)]


def test_jaccard_awkward(spark, folder, documents):
    rows = [(r.doc_id, r.text) for r in documents().collect()]
    got = jaccard.op2_ngram_jaccard(spark, folder(documents=documents())).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute_components(rows))


def test_jaccard_crowds_and_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 4)
    base = words(1, 100).split()
    rows = []
    for i in range(60):  # a chain: neighbours are near, ends are not
        text = [f"w{i}x{j}" if j < i else w for j, w in enumerate(base)]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base[:20] + words(200 + i, 10).split())) for i in range(30)]  # one passage, unlike otherwise
    rows += [(200 + i, " ".join([*base[:50], f"u{i}", *base[51:]])) for i in range(40)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, brute_components(rows))


def test_suffix_bound_is_an_upper_bound():
    draw = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(draw.integers(0, 300, draw.integers(1, 120))).astype(np.uint64) for _ in range(2))
        assert jaccard.suffix_bound(x, y) >= len(np.intersect1d(x, y))


def test_one_document_of_each_group_stays(spark, documents):
    docs = documents()
    kept = jaccard.first_of_groups(spark, docs, "").collect()
    want = [r for r in docs.collect()]
    groups = dict((i, c) for i, _, c in brute_components([(r.doc_id, r.text) for r in want]) if i is not None)
    same(kept, [r for r in want if r.doc_id is None or groups[r.doc_id] == r.doc_id])
    assert kept[0].__fields__ == docs.columns


@pytest.mark.parametrize("stage", ["one_of_groups", "first_of_groups"])
def test_exactly_one_row_of_each_group_stays(spark, stage):
    """Repeated rows, repeated ids with different texts or columns, and copies without an id."""
    a, b, c, d, e = (words(40 + i, 80) for i in range(5))
    rows = [(1, a, "x", None), (1, a, "x", None), (1, a, None, "x"), (7, a + " end", "x", "x"), (2, b, "x", "x"), (3, b + " end", "x", "x"),
            (3, c, "x", "x"), (4, d, "x", "x"), (4, d, "x", "x"), (5, "", "x", "x"), (5, "", "x", "x")]
    if stage == "one_of_groups":
        rows += [(None, a, "x", "x"), (None, e, "x", "x"), (None, e, "x", "x"), (None, e + " end", "x", "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row string")
    kept = getattr(jaccard, stage)(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    want = collections.Counter({(1, a): 1, (2, b): 1, (3, c): 1, (4, d): 1, (5, ""): 2})
    if stage == "one_of_groups":
        ends = [k for k in got if k[0] is None and k[1] in (e, e + " end")]
        assert len(ends) == 1
        want += collections.Counter({ends[0]: 1, (None, None): 1})
    assert got == want


def test_no_text_is_lost_between_stages(spark):
    import corpus_pipeline

    a, b = words(50, 80), words(51, 80)
    docs = spark.createDataFrame([(1, a), (1, a), (None, a), (None, b), (None, b)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "").cache()
    same(docs.collect(), [(1, a), (None, b)])


# --- op3 --------------------------------------------------------------------------------------


def test_packing_awkward(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = packing.op3_best_two_fit(spark, folder(documents=documents())).collect()
    want = collections.Counter()
    for d in documents().collect():
        ids = own.encode(d.text or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 1024 or 1024
        edges = [0, len(ids)] if len(ids) <= 1024 else [0, *range(cut, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(d.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_sequences(rows, 1024)


def check_sequences(rows, room):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def brute_best_two_fit(lengths, room):
    """One bin at a time on the items themselves."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        free, own = room, []
        for n in list(left):
            if n <= free:
                own.append(n)
                left.remove(n)
                free -= n
        if free and len(own) > 1:
            best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= free + own[-1]), default=None)
            if best and best[0] > own[-1]:
                left.append(own.pop())
                for n in best[1:]:
                    left.remove(n)
                    own.append(n)
                left.sort(reverse=True)
        bins.append(sorted(own))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_best_two_fit_runs_equal_single_bins(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 41, 300).tolist() + [7] * 50
    runs = packing.best_two_fit(dict(collections.Counter(lengths)), 40)
    bins = [sorted(items) for times, items in runs for _ in range(times)]
    assert collections.Counter(x for b in bins for x in b) == collections.Counter(lengths)
    assert all(sum(b) <= 40 for b in bins)
    want = brute_best_two_fit(lengths, 40)
    assert len(bins) == len(want) and collections.Counter(sum(b) for b in bins) == collections.Counter(sum(b) for b in want)


def test_sequences_are_whole(spark, documents):
    import public_tokenizers

    layout = packing.packed_documents(documents().select("doc_id", "text"), public_tokenizers.path(PATH), 64, with_ids=True)
    layout = layout.cache()
    check_sequences(layout.collect(), 64)
    total = sum(len(r.ids) for r in packing.sequences(layout).collect())
    assert total == sum(r.length for r in layout.collect())


def test_encoder_gives_the_ids_of_tokenizers(monkeypatch):
    """Every character of known class in contexts, random texts, and a small memory that is given up again and again."""
    import public_tokenizers

    own = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x3000, 0x4E00, 0x1F600, 0x37E]]
    draw = random.Random(1)
    texts = [a + c + b for c in chars for a, b in ((" ", "a"), ("a", " 1"), ("'", " "), (" ", "\n"), ("1", "'s"))]
    texts += ["".join(draw.choice(chars + [" "] * 40 + list("'stvemldre \n\t") * 3) for _ in range(draw.randint(0, 60))) for _ in range(5_000)]
    texts += ["", "Hello's  <|endoftext|> wörld\n\n 123 \x85　x'll", words(3, 50)]
    want = own.whole(texts)
    monkeypatch.setattr(encoding, "KNOWN", 2_000)
    monkeypatch.setattr(encoding, "BLOCK", 30)
    got = [ids for a in range(0, len(texts), 500) for ids in own.encode(texts[a : a + 500])]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("text", [" " * 1_500_000 + "a", "a" * 2_000_000, "#" * 2_000_000, "\n \t" * 700_000, words(9, 400_000)])
def test_long_texts_are_encoded_whole(text):
    import public_tokenizers

    own = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.array_equal(own.encode([text])[0], own.whole([text])[0])


def test_pieces_are_those_of_the_vocabulary():
    """Where pieces start, in many texts at once, against the pre-tokenizer itself."""
    import public_tokenizers

    own = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json")).own
    draw = random.Random(2)
    chars = list("aZ\u00e91\u00b2.'#\u2014\u20ac \n\t\xa0\x85") + [" "] * 4 + list("'stvemldre")
    texts = ["", "", "it's", "'s't", " 's", "\xa0's", "''s", "a  b", "a \n b", " \xa0", "'ll've"]
    texts += ["".join(draw.choice(chars) for _ in range(draw.randint(0, 30))) for _ in range(3_000)]
    data = np.frombuffer(encoding.GAP + b"".join(t.encode() + encoding.GAP for t in texts), np.uint8)
    starts = set(encoding.piece_starts(data).tolist())
    want, at = {0}, 1
    for t in texts:
        want |= {at + len(t[:low].encode()) for _, (low, _) in own.pre_tokenizer.pre_tokenize_str(t)}
        at += len(t.encode())
        want.add(at)
        at += 1
    assert starts == want


# --- op12 -------------------------------------------------------------------------------------


def token_rows(docs):
    """(doc_id, ids) in ascending id order, nulls first, from tokenizers itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0))
    return [(d.doc_id, own.encode(d.text or "", add_special_tokens=False).ids + [2]) for d in rows]


@pytest.mark.parametrize("small", [False, True])
def test_token_files_awkward(spark, folder, documents, tmp_path, monkeypatch, small):
    """Rows against tokenizers; ids that repeat may stand in any order among themselves."""
    import public_tokenizers

    want = token_rows(documents().collect())
    if small:
        monkeypatch.setattr(token_files, "TEXT", 50)
        monkeypatch.setattr(token_files, "STRETCH", 300)
        files = token_files.write_tokens(documents(), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "f"), 64, 4_000)
        assert files.count() > 5
        rows = token_files.read_documents(token_files.index_of(files)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    else:
        rows = token_files.op12_token_files(spark, folder(documents=documents()))
    got = sorted(rows.collect(), key=lambda r: r.start)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), crc(x)) for i, x in want)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_files_are_plain_zstandard(spark, tmp_path, monkeypatch):
    """Any zstandard reader restores the ids; a reader of selected documents touches only their frames and sees damage."""
    import public_tokenizers
    import zstandard

    docs = spark.createDataFrame([(i, words(i, 40 if i % 9 else 900)) for i in range(200)], "doc_id long, text string")
    files = token_files.write_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/out", 256).collect()
    want = token_rows(docs.collect())
    raw = open(files[0].file.removeprefix("file://"), "rb").read()
    out = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert out == b"".join(np.array(x, "<u4").tobytes() for _, x in want)
    index = token_files.index_of(spark.createDataFrame(files))
    some = token_files.read_documents(index.where("doc_id % 50 = 0")).collect()
    assert {r.doc_id: r.ids for r in some} == {i: np.array(x, "<u4").tobytes() for i, x in want if i % 50 == 0}

    reader = token_files.Reader(files[0].file)
    places, seen = reader.places, []
    inner = reader._content
    monkeypatch.setattr(reader, "_content", lambda k: seen.append(k) or inner(k))
    row = index.where("doc_id = 100").first()
    reader.ids(row["at"], row["n_tokens"])
    assert 1 <= len(seen) <= 2 and len(places) > 100
    at = int(places[seen[0]]) + 12
    damaged = tmp_path / "damaged.zst"
    damaged.write_bytes(raw[:at] + bytes([raw[at] ^ 0x55]) + raw[at + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(str(damaged)).ids(row["at"], row["n_tokens"])
    (tmp_path / "cut.zst").write_bytes(raw[:-5])
    with pytest.raises(ValueError, match="seek table"):
        token_files.Reader(str(tmp_path / "cut.zst"))


# --- op8 --------------------------------------------------------------------------------------


def brute_repeats(rows, length=200):
    count = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        body = np.frombuffer(b, np.uint8)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(body[~gone[:-1]].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_awkward(spark, folder, documents):
    rows = pairs([(r.doc_id, r.text) for r in documents().collect()])
    same(suffixes.op8_suffix_dedup(spark, folder(documents=documents())).collect(), brute_repeats(rows))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup_borders(spark, folder, documents, monkeypatch, hot):
    """Passages of just under and over the length, in many surroundings; crowded anchors by the other way too."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    passage = words(9, 120)
    rows = []
    for i in range(40):
        cut = passage[i : i + 190 + i]
        rows.append((i, words(100 + i, 15) + cut + words(300 + i, 15)))
    rows += [(50 + i, ("ab" * 150) + words(i, 3)) for i in range(3)] + [(60, "z" * 450), (61, "y" * 205)]
    full = [(i, t, None, None, None, None, None, None, None, None) for i, t in rows]
    same(suffixes.op8_suffix_dedup(spark, folder(documents=documents(full))).collect(), brute_repeats(pairs(rows)))


def test_sorted_suffixes_against_sorted():
    draw = np.random.default_rng(3)
    n, width = 300, 20
    body = draw.integers(97, 99, (n, width)).astype(np.uint8)
    size = draw.integers(0, width + 1, n)
    body *= np.arange(width) < size[:, None]
    group = np.sort(draw.integers(0, 12, n))
    order, common = suffixes.sorted_suffixes(group, body, size)
    key = [(int(group[i]), body[i, : size[i]].tobytes()) for i in range(n)]
    assert [key[i] for i in order] == sorted(key)
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        x, y = key[a][1], key[b][1]
        want = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert c == (want if key[a][0] == key[b][0] else -1)


def test_sorted_suffixes_survive_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffixes, "CODES", np.ones(256, dtype=np.uint64))  # all bytes hash alike
    body = np.array([[98, 97], [97, 98], [97, 97]], dtype=np.uint8)
    order, common = suffixes.sorted_suffixes(np.zeros(3, int), body, np.full(3, 2))
    assert order.tolist() == [2, 1, 0] and common.tolist() == [-1, 1, 0]


def test_texts_without_repeats_keep_their_columns(spark, documents):
    docs = documents()
    out = suffixes.without_repeats(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.where("doc_id in (8, 9, 10, 11, 4, 18)").collect()}
    rows = brute_repeats(pairs([(r.doc_id, r.text) for r in docs.collect()]))
    assert {h for i, _, _, _, h in rows if i in (8, 9, 10, 11, 4, 18)} == kept


# --- op9 --------------------------------------------------------------------------------------


def test_order_minhash_awkward(spark, folder, documents):
    rows = fingerprints.op9_order_minhash(spark, folder(documents=documents())).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in documents().collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    seen = {}
    for (i, text) in docs:
        seen.setdefault(i, []).append(text)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in seen and len(set(seen[r.doc_id])) == 1:
            by_text.setdefault(seen[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({next(iter(f)) for t, f in by_text.items() if t.strip()}) > 10
    plain = [d for d in docs if d[0] is not None and d[0] not in (13,)]
    edited = {r.doc_id: r for r in rows}
    for (i, text), (j, after) in zip(plain, plain[1:], strict=False):
        if j == i + 1 and 13 not in (i, j):
            cut = len(text) // 4
            want = text[: len(text) - cut] + after[:cut]
            assert edited[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and edited[i].n_chars == len(text)


def python_order_minhash(spark, text):
    """The definition, with Spark's hash function as a table."""
    w = re.split("[\x20\x09-\x0d]+", text.strip(" \t\n\x0b\f\r"))
    kmers = [w[i : i + 3] for i in range(max(len(w) - 2, 1))]
    frame = spark.createDataFrame([(i, *(k + [None] * 3)[:3]) for i, k in enumerate(kmers)], "i int, a string, b string, c string")
    hashed = [r[0] for r in frame.orderBy("i").select(F.xxhash64("a", "b", "c")).collect()]
    count, numbered = collections.Counter(), []
    for h in hashed:
        count[h >> 27] += 1
        numbered.append((h >> 27, count[h >> 27]))
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(numbered)], "i int, a long, b int")
    values = [(r[0] >> 27 << 27) | i for i, r in enumerate(frame.orderBy("i").select(F.xxhash64("a", "b")).collect())]
    least = {}
    for v in sorted(values, reverse=True):
        least[v >> 58] = v
    out = []
    for t in sorted({b >> 1 for b in least}):
        own = sorted((v for b, v in least.items() if b >> 1 == t), key=lambda v: v & ((1 << 27) - 1))
        frame = spark.createDataFrame([tuple(v >> 27 for v in own)], ", ".join(f"c{i} long" for i in range(len(own))))
        out.append(((t + 16) << 40) | (frame.select(F.xxhash64("*")).first()[0] & ((1 << 40) - 1)))
    return out


def test_order_minhash_follows_its_definition(spark):
    texts = [words(1, 400), "to be or not to be or not to be or not to be", "one", words(2, 5)]
    only_words = lambda s: [v for v in s if v >> 40 < 32]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(fingerprints.order_minhash(F.col("t"))).collect()]
    assert [only_words(g) for g in got[:2]] == [python_order_minhash(spark, t) for t in texts[:2]]
    assert [len(only_words(g)) == len(g) for g in got] == [True, True, True, False]


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    """Both likenesses follow from the returned strings, also where words are few or a text and its edited form differ in kind."""
    draw = np.random.default_rng(9)
    long_words = lambda n, k: " ".join("".join(draw.choice(list("abcdefgh"), k)) for _ in range(n))
    texts = [words(i, 3 + 7 * i) for i in range(12)] + [long_words(n, k) for n in (4, 9, 60) for k in (5, 7, 9, 12, 30)] + ["", " ", "a", "\u4e00" * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(fingerprints.fingerprints(frame).collect(), key=lambda r: r.doc_id)

    def near(x, y):
        a, b = ({int(t, 16) for t in s.split("-") if t} for s in (x, y))
        if not a and not b:
            return 1.0
        words_too = any(v >> 40 < 32 for v in a) and any(v >> 40 < 32 for v in b)
        a, b = ({v for v in s if (v >> 40 < 32) == words_too} for s in (a, b))
        either = len({v >> 40 for v in a | b})
        return (len(a & b) / either) ** 0.5 if either else 0.0

    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert r.near_edited == pytest.approx(near(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(near(r.fingerprint, after.fingerprint))
    assert all(r.near_edited > 0.25 for r in rows if r.n_chars > 30)


def test_few_words_are_told_apart_by_code_points(spark):
    """Short texts, unsegmented scripts and long tokens stay near their edited form; so does a text whose edit changes the k-mers."""
    draw = np.random.default_rng(4)
    han = lambda n: "".join(chr(c) for c in draw.integers(0x4E00, 0x9FA5, n))
    emoji = "".join(chr(c) for c in draw.integers(0x1F300, 0x1F5FF, 400))
    six = "abcd efgh ijklm nopqr stuvw xyzab"  # its edit has fewer words
    texts = ["alpha beta gamma", "some words here today", han(4000), emoji, "Zm9v" * 10 + words(1, 60).replace(" ", ""), six, han(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    assert all(rows[i].near_edited > 0.3 for i in range(len(texts)))
    assert (int(rows[5].fingerprint.split("-")[0], 16) >> 40) < 32 <= (int(rows[5].fingerprint.split("-")[-1], 16) >> 40)
    assert 0 <= rows[2].near_next < 0.3


def test_code_points_follow_their_definition(spark):
    """K-mers of five code points, each counted by its occurrence, in tuples with numbers from 32."""
    text = "ab\U0001F600" * 40 + "xyz"
    frame = spark.createDataFrame([(i, *text[i : i + 5]) for i in range(len(text) - 4)], "i int, a string, b string, c string, d string, e string")
    hashed = [r[0] >> 27 for r in frame.orderBy("i").select(F.xxhash64(*"abcde")).collect()]
    count, numbered = collections.Counter(), []
    for i, h in enumerate(hashed):
        count[h] += 1
        numbered.append((i, h, count[h]))
    frame = spark.createDataFrame(numbered, "i int, a long, b int").orderBy("i")
    values = [(r[0] >> 27 << 27) | i for i, r in enumerate(frame.select(F.xxhash64("a", "b")).collect())]
    got = spark.createDataFrame([(text,)], "t string").select(fingerprints.order_minhash(F.col("t"))).first()[0]
    assert [g >> 40 for g in got] == sorted({(v >> 59) + 48 for v in values})


def test_order_counts(spark):
    """The same k-mers in another order are less alike than a text with one changed word."""
    a = words(1, 400).split()
    frame = spark.createDataFrame([(" ".join(a), " ".join(a[200:] + a[:200]), " ".join([*a[:399], "zz"]))], "a string, b string, c string")
    s = frame.select(*[fingerprints.order_minhash(F.col(c)).alias(c) for c in "abc"])
    swapped, close = s.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("c"))).first()
    assert close > 0.9 > swapped


def test_next_rows(spark):
    rows = [(i * i % 5000, str(i)) for i in range(1, 900)] + [(None, "none")]
    rows = list({r[0]: r for r in rows}.values())
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    same([(r.doc_id, r.text, r._next_text) for r in got], [(*a, b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)])


# --- op10 -------------------------------------------------------------------------------------


def test_solve():
    tokens = {"a": 9000, "b": 900, "c": 100}
    equal = mixing.solve(tokens, budget=1000, repeats=None)
    assert equal.exponent == 0 and all(abs(w - 1 / 3) < 1e-9 for w in equal.weights.values())
    limited = mixing.solve(tokens, budget=5000, repeats=2)
    assert abs(limited.weights["c"] * 5000 / 100 - 2) < 1e-6
    bent = mixing.solve(tokens, budget=5000, repeats=None, entropy=0.7)
    assert abs(-sum(w * np.log(w) for w in bent.weights.values()) / np.log(3) - 0.7) < 1e-9
    least = mixing.solve(tokens, repeats=1.5)
    assert min(least.budgets[s] / tokens[s] for s in tokens) == 1 and max(least.budgets[s] / tokens[s] for s in tokens) <= 1.52
    assert mixing.solve({}, budget=5).budgets == {}


def test_mix_awkward(spark, folder, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = mixing.op10_temperature_mix(spark, folder(documents=documents())).collect()
    docs = documents().collect()
    tokens = lambda t: max(1, len(re.split("[ \t\n\r\f\x0b]+", t or "")))
    sums = collections.Counter()
    for d in docs:
        sums[d.source] += tokens(d.text)
    mix = mixing.solve(dict(sums))
    once = collections.Counter((r.doc_id, r.source, r.tokens) for r in rows if r["pass"] == 0)
    assert once == collections.Counter((d.doc_id, d.source, tokens(d.text)) for d in docs)  # the first pass is whole
    for source, total in sums.items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: r.start)
        at = 0
        for r in own:  # gapless
            assert r.start == at and r.budget == mix.budgets[source] and abs(r.weight - mix.weights[source]) < 1e-12
            at += r.tokens
        assert at >= mix.budgets[source] > own[-1].start
        for n in range(own[-1]["pass"] + 1):  # inside a pass a block stands together
            blocks = [r.block for r in own if r["pass"] == n]
            assert len([b for i, b in enumerate(blocks) if i == 0 or blocks[i - 1] != b]) == len(set(blocks))
        assert {r["pass"] for r in own} <= set(range(int(np.ceil(mix.budgets[source] / total))))


def test_mix_under_a_budget(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", 1 + i % 9) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    out = mixing.mixed(docs, F.col("n"), budget=3000, entropy=1.0, repeats=None)
    for r in out.groupBy("_source").agg(F.sum("_tokens").alias("t"), F.max("budget").alias("b")).collect():
        assert r.b <= r.t < r.b + 9


def test_remixed_keeps_every_document(spark, documents):
    docs = documents()
    out = mixing.remixed(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() >= docs.count()


# --- op5 --------------------------------------------------------------------------------------


@pytest.fixture
def labelled(spark, folder):
    bad = ["vilest", "wretch", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = words(i, 60).split()
        if toxic:
            text.insert(i % 50, bad[i % 3])
        if i % 4 == 0:
            text = [w + "$$$" for w in text]
        rows.append((i, " ".join(text)))
        if i % 2 == 0 or i < 200:
            labels.append((i, int(i % 4 != 0), int(toxic)))
    rows += [(None, "you wretch"), (700, None), (701, ""), (702, words(1, 20000) + " Scoundrel!"), (703, "kind words"), (703, "kind words")]
    labels += [(None, 1, 1), (3, None, 0), (0, 0, 1)]
    return folder(
        documents=spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic string"),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_chain(spark, labelled):
    rows = toxicity.op5_classifier_chain(spark, labelled).collect()
    assert len(rows) == 606
    for r in rows:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.toxic == (r.doc_id % 5 == 0), r
            assert (r.p_low_quality > 0.5) == (r.doc_id % 4 == 0), r
    assert {r.doc_id for r in rows if r.toxic and (r.doc_id is None or r.doc_id >= 600)} == {None, 702}
    kept = toxicity.without_toxic(spark, spark.read.parquet(labelled + "/documents.parquet"), labelled)
    assert kept.count() == sum(not r.toxic for r in rows) and kept.columns == ["doc_id", "text", "toxic"]


def test_chain_without_labels_or_documents(spark, folder):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = folder(documents=docs, labels=none)
    rows = toxicity.op5_classifier_chain(spark, sf).collect()
    assert [(r.doc_id, r.toxic) for r in rows] == [(1, False), (2, False)] and max(r.p_toxic for r in rows) < 1e-6
    assert toxicity.without_toxic(spark, docs, sf).count() == 2
    labels = spark.createDataFrame([(1, 1, 1)], none.schema)
    assert toxicity.op5_classifier_chain(spark, folder(documents=docs.limit(0), labels=labels)).count() == 0


def test_later_models_see_out_of_fold_logits():
    bags = [{"one": i % 2, "two": i % 2, "fold": i % 3, "tokens": [10 + i % 2]} for i in range(300)]
    own = np.array([10, 11])
    chosen = {(c, f): own for c in ("one", "two") for f in (None, 0, 1, 2)}
    chain = toxicity.fit_chain(bags, ["one", "two"], chosen)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    # a token that only the held-out fold knows says nothing out of fold
    blind = chosen | {("one", f): np.zeros(0, dtype=np.int64) for f in (0, 1, 2)}
    assert abs(toxicity.fit_chain(bags, ["one", "two"], blind)[1].earlier[0]) < chain[1].earlier[0] / 2


# --- memory of workers ------------------------------------------------------------------------


@pytest.mark.parametrize("work", ["suffixes", "shingles"])
def test_worker_memory_for_a_batch_of_texts(work):
    """What numpy holds at once while it goes through 8 MB of texts."""
    import tracemalloc

    column = pa.array([words(i, 400) for i in range(40)] * 100)
    tracemalloc.start()
    try:
        if work == "suffixes":
            for _, _, data, offsets in textkit.chunks(column):
                suffixes._anchored(data, offsets)
        else:
            for _ in jaccard.shingle_sets(column):
                pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6


def test_text_stages_hand_small_batches_to_workers(spark, documents):
    """Without a limit of the session's own, no batch of texts is larger than ``BATCH``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name) if name in spark.conf.getAll else None

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    try:
        spark.conf.unset(name)
        suffixes.repeats(documents().select("doc_id", "text"))
        texts = spark.range(0, 5_000, 1, 1).select(F.repeat(F.lit("x"), 5_000).alias("text"))
        most = texts.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
        assert most < common.BATCH + 100_000
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
