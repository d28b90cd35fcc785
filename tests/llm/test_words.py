"""Spelling variants and periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import words

from cohortlake.llm import periodic, spelling

# --- op11 -------------------------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs):
    c = collections.Counter()
    for d in docs:
        for w in RUN.findall(d.text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def brute_near(n):
    alphabet = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        s = {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in alphabet}
        s |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in alphabet}
        out[w] = sorted((s - {w}) & n.keys())
    return out


def brute_variants(n):
    near, form = brute_near(n), {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()}


def misspelt(seed, rows):
    """Documents of few stems, with edits, accents, capitals, digits and long words."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeéÀß") for _ in range(draw.randint(6, 12))) for _ in range(40)] + ["a" * 70, "ab" * 40, "aaaaaaa", "aaaaaab"]
    for i in range(rows):
        out = []
        for _ in range(draw.randint(0, 60)):
            w = stems[min(int(draw.expovariate(0.15)), len(stems) - 1)]
            if draw.random() < 0.2:
                p = draw.randrange(len(w))
                w = draw.choice([w[:p] + w[p + 1 :], w[:p] + draw.choice("abcé") + w[p:], w[:p] + draw.choice("abcé") + w[p + 1 :]])
            out.append(w.upper() if draw.random() < 0.1 else w)
        yield (i if i % 50 else None, draw.choice([" ", "1", "\n", "×", "ā"]).join(out))


def test_variants_awkward(spark, folder, documents):
    rows = spelling.op11_spelling_variants(spark, folder(documents=documents())).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute_variants(brute_counts(documents().collect()))


@pytest.mark.parametrize(("branch", "scan"), [(50_000, None), (60, 40), (7, 1 << 15)])
def test_variants_against_brute_force(spark, folder, monkeypatch, branch, scan):
    """One trie, many tries of some first counts, and tries that even all counts can't make small enough."""
    if scan:
        monkeypatch.setattr(spelling, "SCAN", scan)
    docs = spark.createDataFrame(list(misspelt(3, 400)), "doc_id long, text string").repartition(5)
    n = brute_counts(docs.collect())
    assert len(n) > 150
    words_ = spelling.counted_words(docs, "doc_id", "text", drop=31).where("n >= 2")
    assert {(r.word, r.n) for r in words_.collect()} == set(n.items())
    got = collections.Counter((r.word, r.near, r.near_n) for r in spelling.near_words(words_, branch).collect())
    near = brute_near(n)
    assert got == collections.Counter((w, x, n[x]) for w, xs in near.items() for x in xs)
    if branch == 50_000:
        rows = spelling.op11_spelling_variants(spark, folder(documents=docs)).collect()
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute_variants(n)


def test_long_chains_have_one_root(spark):
    """Each word is the form of the next; ties go to the smallest in code-point order."""
    chain = [("a" * (8 + i), 10 ** (6 - i)) for i in range(6)]
    rows = spark.createDataFrame([*chain, ("zzzzzzz", 1), ("zzzzzzx", 10), ("zzzzzzé", 10)], "word string, n long")
    out = {r.word: r for r in spelling.variants(rows).collect()}
    assert all(out[w].root == "a" * 8 for w, _ in chain) and out["a" * 8].form is None and out["a" * 10].form == "a" * 9
    assert out["zzzzzzz"].form == "zzzzzzx" and out["zzzzzzz"].n_near == 2


def test_colliding_hashes_do_not_merge_words(spark, documents, monkeypatch):
    """Should two words have one hash, they are counted by their bytes."""
    import pyarrow as pa

    monkeypatch.setattr(spelling, "runs_hashed", lambda data, a, b: (b - a).astype(np.uint64))
    docs = documents([(1, "abcdefgh hgfedcba abcdefgh", "", "", 1, "", "", "", "", "")])
    seen = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(f) or self.selectExpr("'' word", "1L n"))
    spelling.counted_words(docs, "doc_id", "text")
    batch = pa.RecordBatch.from_pydict({"_id": [1], "_text": ["abcdefgh hgfedcba abcdefgh"]})
    assert sorted((r["word"], r["n"]) for b in seen[0](iter([batch])) for r in b.to_pylist()) == [("abcdefgh", 2), ("hgfedcba", 1)]


# --- op13 -------------------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                best.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in best.items())


def sequences(seed, cases):
    draw = random.Random(seed)
    for _ in range(cases):
        w = []
        for _ in range(draw.randint(1, 6)):
            if draw.random() < 0.5:
                u = [draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 12))]
                w += u * draw.randint(1, 12) + u[: draw.randint(0, len(u))]
            else:
                w += [draw.randint(0, draw.choice([0, 1, 3, 50])) for _ in range(draw.randint(0, 40))]
        yield w


def thue_morse(k):
    w = [0]
    for _ in range(k):
        w = w + [1 - a for a in w]
    return w


@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 3), (10, 4), (40, 3)])
def test_runs_against_brute_force(least, times):
    special = [[], [0] * (least - 1), [0] * least, [0] * 300, [0, 1] * 50, thue_morse(9), list(range(100))]
    for w in [*special, *sequences(least, 400)]:
        assert periodic.runs(periodic.numbered_words([b"%d" % x for x in w]), least, times) == brute_runs(w, least, times)


@pytest.mark.parametrize("w", [[0] * 100_000, [0, 1, 2] * 50_000, thue_morse(16), [x for i in range(5_000) for x in [*range(18), 100 + i]]])
def test_runs_of_long_texts(w):
    got = periodic.runs(periodic.numbered_words(w))
    if len(set(w)) <= 3 and w[0] != w[-1] or len(set(w)) == 1:
        assert got in ([(0, len(w), 1)], [(0, len(w), 3)], [])
    else:
        assert got == []


def test_periodic_runs_awkward(spark, folder, documents):
    extra = [(100 + i, " ".join(f"w{x}" for x in w), None, None, 0, "", "", "", "", "") for i, w in enumerate(sequences(7, 150))]
    from texts import awkward

    docs = documents(awkward() + extra + [(2_000, words(1, 60) + " x\x0b" + words(1, 60), *[None] * 8)])
    want = collections.Counter()
    for d in docs.collect():
        w = [x for x in re.split("[\x20\x09-\x0d]+", d.text or "") if x]
        h = 1 if d.doc_id is None else zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(
            d.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        )] += 1
    rows = periodic.op13_periodic_runs(spark, folder(documents=docs)).collect()
    assert collections.Counter(map(tuple, rows)) == want and sum(r.n_runs for r in rows) > 100


def test_collapsed_keeps_the_first_period(spark, documents):
    unit = [f"u{i}" for i in range(9)]
    docs = spark.createDataFrame([(1, " ".join(["a", "b", *unit * 5, "c"]))], "doc_id long, text string")
    row = periodic.periodic_runs(docs, "doc_id", "text").first()
    assert bytes(row["collapsed"]).decode() == " ".join(["a", "b", *unit, "c"]) and [tuple(r) for r in row["runs"]] == [(2, 45, 9)]


def test_empty_words(spark, folder, documents):
    sf = folder(documents=documents([]))
    assert spelling.op11_spelling_variants(spark, sf).count() == 0 and periodic.op13_periodic_runs(spark, sf).where(F.lit(True)).count() == 0
