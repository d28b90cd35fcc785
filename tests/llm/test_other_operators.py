"""Archives, vectors, languages, helpers and the pipeline."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from texts import words
from pyspark.sql import functions as F

from cohortlake.llm import common, graphs, language, registry, warc
from cohortlake.llm.common import components, numbered
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql_twin(spark, name):
    ok, message = compare(spark, duck(SF), SF, registry.QUERIES[name], registry.ORACLE[name])
    assert ok, message


def test_all_operators_and_the_pipeline():
    assert {n.split("_")[0] for n in registry.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_languages_of_nothing(spark, folder):
    docs = spark.createDataFrame([(1, "some words", None), (None, None, "en")], "doc_id long, text string, lang string")
    rows = language.op7_language(spark, folder(documents=docs)).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in rows] == [(1, "und", 0.0), (None, "und", 0.0)]
    assert language.op7_language(spark, folder(documents=docs.limit(0))).count() == 0


# --- helpers ----------------------------------------------------------------------------------


def test_numbered_is_gapless(spark):
    rows = [("a" if i % 3 else None, i) for i in range(500)] + [("b", None), ("b", None)]
    out = numbered(spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"], 7, "n").collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.k].append(r.n)
    assert sum(map(len, by.values())) == 502 and all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("task", [500_000, 5])
def test_components(spark, monkeypatch, task):
    monkeypatch.setattr(common, "TASK_EDGES", task)
    edges = [(i, i + 1) for i in range(100)] + [(200, 150), (150, 190), (190, 200), (5, 5), (None, 3)] + [(300, 300 + i) for i in range(50)]
    out = dict(components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect())
    want = {i: 0 for i in range(101)} | {150: 150, 190: 150, 200: 150} | {300 + i: 300 for i in range(50)}
    assert out == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op4 --------------------------------------------------------------------------------------


def test_archives(spark, folder, tmp_path):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [
        (3, "http://a", big), (1, "http://b\r\nInjected: 1", big), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""),
        (7, "u", "a\r\n\r\nWARC/1.0\r\n\r\nb" * 20), (None, "u", big), (8, "u", "é" * 99), (9, "u", "é" * 99), (1, "again", big),
        (10, "u", "long " * 200_000), (None, None, None),
    ]
    sf = folder(pages=spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, file string"))
    got = warc.op4_warc(spark, sf).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_selected_records(spark, tmp_path):
    rows = [(i, f"http://{i}", words(i, 50)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages, "page_id", "url", F.col("html"), f"file://{tmp_path}/w")
    some = warc.read_records(index.where("page_id % 7 = 0")).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in some} == {r for r in rows if r[0] % 7 == 0}


def test_empty_pages(spark, folder):
    assert warc.op4_warc(spark, folder(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# --- op6 --------------------------------------------------------------------------------------


def vectors(n=900, dims=16, seed=5):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    for i in range(0, n, 3):  # near copies of earlier vectors
        x[i] = x[i // 7] + 0.15 * draw.normal(size=dims)
    x[50:90] = x[50]
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def brute_links(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(list)
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    for a, hit in enumerate((x @ x.T) >= 0.9):
        links[ok[a][0]] = [ok[b][0] for b in np.flatnonzero(hit) if b != a]
    return links


@pytest.mark.parametrize("shard", [1500, 60])
def test_graph_against_brute_force(spark, folder, monkeypatch, shard):
    monkeypatch.setattr(graphs, "SHARD", shard)
    rows = vectors() + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] + [1.0] * 15),
                        (2005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    sf = folder(embeddings=spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, label int, node string"))
    got = {r.vec_id: r for r in graphs.op6_flat_graph(spark, sf).collect()}
    links = brute_links(rows)
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and all(got[i].n_links <= len(links[i]) for i, _ in rows)
    assert sum(r.n_links for r in got.values()) >= 0.95 * total
    for i in range(2000, 2006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[None].component_id is None and not got[None].kept
    if shard == 1500:
        for i, near in links.items():
            assert got[i].n_links == len(near) and all(got[i].component_id == got[j].component_id for j in near)


def sparse(n=1200, dims=16):
    """Unlike vectors but for ten pairs, and one vector with a third of all rows and a single link."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(n, dims))
    for i in range(10):
        x[601 + 7 * i] = x[3 + 11 * i] + 0.01 * draw.normal(size=dims)
    x[n - 400 :] = x[50] + 0.01 * draw.normal(size=dims)
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("shard", [1500, 200])
def test_lost_links_are_noticed(spark, monkeypatch, shard):
    """A search that finds the link to the frequent vector only is no pass, whatever the size."""
    monkeypatch.setattr(graphs, "SHARD", shard)
    search = graphs._searched
    monkeypatch.setattr(graphs, "_searched", lambda *a: search(*a).where("node = 50 or star = 50"))
    rows = sparse()
    got = {r.vec_id: r for r in graphs.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = brute_links(rows)
    assert sum(map(bool, links.values())) >= 420
    for i, _ in rows:
        assert got[i].n_links == len(links[i]) and got[i].component_id == min([i, *links[i]])


def test_links_of_several_clusters_count_once(spark):
    rows = [(1, None, None, 1, 2, 3, 5), (1, None, None, 1, 2, 3, 5), (1, 1, 7, 1, None, None, None), (4, 2, 2, 1, None, None, None)]
    got = graphs._linked(spark.createDataFrame(rows, graphs.FOUND)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 12), (2, 1, 3), (4, 2, 2)]


def test_audit_takes_more_queries_until_it_sees_links(spark):
    vectors = graphs.distinct_vectors(spark.createDataFrame(sparse(), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert graphs.audit_recall(vectors, spark.createDataFrame([], "node long, near long, links long")) == 0
    one = spark.createDataFrame([(50, 1, 400), (800, 1, 1)], "node long, near long, links long")
    assert 0 < graphs.audit_recall(vectors, one) < 0.2


def test_no_vectors(spark, folder):
    sf = folder(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert graphs.op6_flat_graph(spark, sf).count() == 0


def test_pruned_edges_lead_everywhere():
    x = np.array([v for _, v in vectors(400)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = graphs.robust_pruned(x)
    found = graphs.range_search(x, edges, graphs.medoids(x), x)  # without the queries' own places
    true = (x @ x.T) >= 0.9
    assert (found & ~true).sum() == 0 and found.sum() >= 0.9 * true.sum()


# --- op7 --------------------------------------------------------------------------------------


def test_language(spark, folder):
    texts = {"xx": "aeiou", "yy": "bcdfg", "zz": "éèàùö"}
    rows = []
    for i in range(900):
        lang = sorted(texts)[i % 3]
        draw = np.random.default_rng(i)
        text = " ".join("".join(draw.choice(list(texts[lang]), 5)) for _ in range(30))
        rows.append((i, text.upper() if i % 5 == 0 else text, lang if i % 11 else None, "s"))
    rows += [(1000, None, "xx", None), (1001, "", "xx", None), (1002, "123 ###", "yy", None), (None, rows[0][1], "xx", None), (1003, rows[1][1] * 200, None, None)]
    sf = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    got = {r.doc_id: r for r in language.op7_language(spark, sf).collect()}
    import zlib

    for i in range(900):
        assert got[i].lang_pred == sorted(texts)[i % 3] and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "yy"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = language.op7_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from test_text_operators import brute_components, check_sequences

    sf = SF
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        kept[name] = docs.collect()
        if name != "best_two_fit":
            assert docs.columns == before.columns
    rows = [(r.doc_id, r.text) for r in kept["toxicity"]]
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert sorted(r.doc_id for r in kept["ngram_jaccard"]) == sorted(want)
    text = {r.doc_id: r.text for r in kept["suffix_dedup"]}
    seen = collections.Counter(hash(b[i : i + 200]) for r in kept["ngram_jaccard"] for b in [(r.text or "").encode()] for i in range(len(b) - 199))
    for r in kept["ngram_jaccard"]:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                gone[i : i + 200] = True
        # a cut inside a character drops its rest
        assert (text[r.doc_id] or "") == np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore")
    assert {r.doc_id for r in kept["temperature_mix"]} == set(text)
    check_sequences(kept["best_two_fit"], 1024)
    assert corpus_pipeline.run(spark, sf).count() == len(kept["best_two_fit"])


def test_workers_give_memory_back_after_every_batch(monkeypatch):
    """Freed memory goes back to the system before the next batch is taken, at the end, and when a task fails."""
    from cohortlake.llm import common

    calls = []
    monkeypatch.setattr(common, "trimmed", lambda: calls.append(1))
    given = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]

    def doubled(batches):
        for batch in batches:
            yield batch
            yield batch

    assert [b["a"][0].as_py() for b in common.lean(doubled)(iter(given))] == [0, 0, 1, 1, 2, 2]
    assert len(calls) == 4

    def failing(batches):
        raise ValueError(next(batches))
        yield

    with pytest.raises(ValueError):
        list(common.lean(failing)(iter(given)))
    assert len(calls) == 5
