"""Cases worked out by hand."""

from __future__ import annotations

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import bm25, chunking, cleaning, corpus, hybrid, metrics, vectors
from tidewell.sources import files


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "wanted"), [("exam-\nple", "example"), ("exam-\r\nple", "exam-\nple"), ("é-\nx", "éx"), ("ﬁn  a\t b", "fin a b"), ("a\n\n\n\nb\r", "a\n\nb"), (None, "")])
def test_normalize(spark, given, wanted):
    assert one(spark, given, "string", T.normalize) == wanted


def test_sanitize_keeps_line_ends(spark):
    assert one(spark, "a\x00\x0b\r\n\tb\x1f", "string", T.sanitize) == "a\r\n\tb"


def test_citation(spark):
    rows = spark.createDataFrame([("pdf", "f", 3, 5, None), ("pdf", "f", 3, 3, None), ("html", "f", None, None, "s"), ("txt", " ", None, None, None)], "k string, f string, a int, b int, s string")
    got = [r[0] for r in rows.select(T.citation(F.col("k"), F.col("f"), F.lit(None).cast("string"), F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert got == ["f p. 3–5", "f p. 3", "f > s", "source"]


def test_citation_parts(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert tuple(one(spark, f"{u}:v2:7", "string", T.citation_parts)) == (u, 2, 7)
    assert tuple(one(spark, f"{u}:7", "string", T.citation_parts)) == (u, None, 7)
    assert one(spark, "x:v1:0", "string", T.citation_parts) is None


@pytest.mark.parametrize(("response", "wanted"), [('["a"," ","b"]', ["a", "b"]), ("{}", ["q"]), ("[bad", ["q"]), (None, ["q"]), ("[]", ["q"])])
def test_rewrites(spark, response, wanted):
    assert one(spark, response, "string", lambda c: T.rewrites(c, F.lit("q"))) == wanted


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c c"), (2, "a"), (3, None)], "corpus_row long, text string")
    asked = spark.createDataFrame([(0, "c"), (1, "c c"), (2, "a"), (3, "zz")], "query_id long, text string")
    got = {(r.query_id, r.corpus_row): r.score for r in bm25.search(docs, asked, 4).collect()}
    raw = {"a": math.log(1.5) - math.log(3.5), "b": math.log(3.5) - math.log(1.5), "c": math.log(3.5) - math.log(1.5)}
    mean, avgdl = sum(raw.values()) / 3, 6 / 4
    c = raw["c"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert got[0, 1] == pytest.approx(c, abs=1e-6) and got[1, 1] == pytest.approx(2 * c, abs=1e-6)
    assert got[2, 2] == pytest.approx(0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avgdl)), abs=1e-6)
    assert [got[3, i] for i in range(4)] == [0, 0, 0, 0]


def test_bm25_keeps_negative_scores(spark):
    same = spark.createDataFrame([(i, "a") for i in range(3)], "corpus_row long, text string")
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, text string")
    got = [(r.query_id, r.corpus_row, r.score) for r in bm25.search(same, asked, 2).orderBy("query_id", "rank").collect()]
    raw = math.log(0.5) - math.log(3.5)
    assert got == [(0, 0, pytest.approx(0.25 * raw, abs=1e-6)), (0, 1, pytest.approx(0.25 * raw, abs=1e-6)), (1, 0, 0.0), (1, 1, 0.0)]
    more = same.union(spark.createDataFrame([(9, "zz"), (8, "zz yy")], same.schema))
    got = [(r.corpus_row, r.score) for r in bm25.search(more, asked.limit(1), 5).orderBy("rank").collect()]
    assert [row for row, _ in got] == ([8, 9, 0, 1, 2] if got[0][1] == 0 else [0, 1, 2, 8, 9])


def test_bm25_of_odd_tables(spark):
    schema = "corpus_row long, text string"
    asked = spark.createDataFrame([(0, "a"), (1, None)], "query_id long, text string")
    assert bm25.search(spark.createDataFrame([], schema), asked, 2).count() == 0
    assert bm25.search(spark.createDataFrame([(1, "a")], schema), asked.limit(0), 2).count() == 0
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "A_b É c-d " * 300_000)], schema)
    assert sorted((r.query_id, r.corpus_row, r.score) for r in bm25.search(rows, asked, 5).collect()) == [(q, c, 0.0) for q in (0, 1) for c in (1, 2, 3)]
    assert [(r.term, r.df, r.tf) for r in bm25.frequencies(rows).orderBy("term").collect()] == [(None, 3, 0), ("a_b", 1, 300_000), ("c", 1, 300_000), ("d", 1, 300_000)]
    assert {(r.corpus_row, r.term, r.tf) for r in bm25.postings(rows).collect()} == {(3, t, 300_000) for t in ("a_b", "c", "d")}


def test_vector_metrics(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None)], "corpus_row long, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, embedding array<float>")
    best = lambda metric: [(r.corpus_row, r.score) for r in vectors.search(rows, asked, 2, metric).orderBy("rank").collect()]
    assert best("cosine") == [(1, 1.0), (0, 0.0)] and best("dot") == [(1, 2.0), (0, 0.0)] and best("l2") == [(1, -1.0), (2, -1.0)]
    with pytest.raises(ValueError):
        vectors.search(rows, asked, 2, "other")
    assert vectors.search(rows, asked.limit(0), 2).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_an_index_is_kept_and_extended(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 8)) * 4
    x = [[float(v) for v in middle[i % 12] + rng.normal(size=8) * 0.3] for i in range(600)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "corpus_row long, embedding array<float>")
    asked = rows.where("corpus_row % 40 = 0").withColumnRenamed("corpus_row", "query_id")
    vectors.CellIndex.build(rows.where("corpus_row < 500"), str(tmp_path / "i"), metric)
    again = vectors.CellIndex(spark, str(tmp_path / "i"))
    assert again.params["cells"] == 23 and again.params["probes"] < 23
    again.add(rows.where("corpus_row >= 500"))
    exact = vectors.search(rows, asked, 5, metric)
    assert metrics.recall(exact, vectors.CellIndex(spark, str(tmp_path / "i")).search(asked, 5), 5).toPandas()["recall"].mean() >= 0.9
    assert sorted(again.search(asked, 5, probes=23).collect()) == sorted(exact.collect())
    assert {r.corpus_row % 5 for r in again.search(asked, 5, allowed=rows.where("corpus_row % 5 = 1").select("corpus_row")).collect()} == {1}
    with pytest.raises(ValueError):
        again.add(spark.createDataFrame([(900, [1.0])], rows.schema))


def test_an_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "corpus_row long, embedding array<float>")
    asked = rows.withColumnRenamed("corpus_row", "query_id")
    index = vectors.CellIndex.build(rows.limit(0), str(tmp_path / "i"))
    assert index.search(asked, 3).count() == 0
    index.add(rows)
    assert [(r.query_id, r.corpus_row) for r in vectors.CellIndex(spark, str(tmp_path / "i")).search(asked, 3).collect()] == [(1, 1)]


def test_rows_of_a_store_are_checked(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "corpus_row long, embedding array<float>")
    assert vectors.checked(good, 2).count() == 2
    for bad in ([(1, [1.0])], [(None, [1.0, 2.0])], [(1, None)], [(1, [1.0, 2.0]), (1, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            vectors.checked(spark.createDataFrame(bad, good.schema), 2)


def test_minmax_of_equal_scores(spark):
    rows = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 1, 2.0), (1, 2, 4.0)], "query_id int, corpus_row int, score double")
    assert [r.scaled for r in hybrid.minmax(rows).orderBy("query_id", "corpus_row").collect()] == [1.0, 1.0, 0.0, 1.0]


def test_merge_keeps_the_first_of_equal_variants(spark):
    rows = spark.createDataFrame([(0, 5, 2, 0.5), (0, 5, 1, 0.5), (0, 6, 1, 0.1), (0, 6, 2, 0.9)], "query_id int, corpus_row int, variant int, score double")
    assert {(r.corpus_row, r.variant) for r in hybrid.merge_variants(rows).collect()} == {(5, 1), (6, 2)}


def test_mmr_leaves_out_the_too_similar():
    units = np.array([[1, 0], [0.93, math.sqrt(1 - 0.93**2)], [0.91, -math.sqrt(1 - 0.91**2)]])
    assert hybrid.mmr_order(np.array([1.0, 0.9, 0.8]), units, 3) == [0, 2]
    assert hybrid.mmr_order(np.zeros(0), np.zeros((0, 2)), 3) == []


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (10, 1), (11, 2), (17, 2), (18, 3)])
def test_chunk_boundaries(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, " ".join(words), "string", lambda c: chunking.windows(chunking.words(c), 10, 3))
    assert len(got) == chunks
    assert [w for i, c in enumerate(got) for w in c.split()[3 * (i > 0) :]] == words


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.windows(F.col("x"), 10, 10)


def test_sentences_are_packed(spark):
    text = "Aaaa bb. Cccc dd! Eeee? " + "x" * 30
    assert one(spark, text, "string", lambda c: chunking.packed_sentences(c, 20)) == ["Aaaa bb. Cccc dd!", "Eeee?", "x" * 30]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([("f", i, ("head\n" if i < 3 else "") + ("twice\n" if i < 2 else "") + f"own {i}") for i in range(10)] + [("g", i, "x\nx" if i == 0 else f"y{i}") for i in range(4)], "file string, page int, text string")
    assert {(r.file, r.line) for r in cleaning.repeated_lines(pages).collect()} == {("f", "head"), ("g", "x")}
    kept = {(r.file, r.page): r.text for r in cleaning.clean_pages(pages).collect()}
    assert kept["f", 0] == "twice\nown 0" and kept["g", 0] == ""


def test_sections():
    assert cleaning.split_sections("INTRO-PART 1\ntext a\n\nmore\n\nNEXT SECTION") == [("Intro-Part 1", "text a"), ("Intro-Part 1", "more")]


def test_percentile_has_no_interpolation(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, v double")
    got = metrics.latencies(rows, "g", "v").first()
    assert (got.n, got.p50, got.p95) == (10, 4.0, 8.0)


def test_limits(spark):
    rows = spark.sql("SELECT 1L AS key, timestamp_seconds(t) AS ts, t AS id FROM VALUES (0L), (50L), (90L), (110L) AS x(t)")
    fold = {r.id: r.allowed for r in metrics.limit_first_hit(rows, 2, 100).collect()}
    assert fold == {0: True, 50: True, 90: False, 110: True}


def test_overfetch_may_give_fewer(spark):
    ranked = spark.createDataFrame([(0, i, 1.0 / (i + 1), i + 1) for i in range(8)], "query_id int, corpus_row int, score double, rank int")
    deleted = spark.createDataFrame([(i,) for i in range(5)], "corpus_row int")
    assert [r.corpus_row for r in corpus.overfetch(ranked, deleted, 2).collect()] == [5]


def test_appended_rows_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = corpus.append_rows(10, rows, ["k"]).orderBy("k").collect()
    assert [r.corpus_row for r in got] == list(range(10, 1010))


def test_compaction_keeps_the_newest(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("a", 2, 2)], "document string, version int, corpus_row long")
    got = corpus.compact(rows, corpus.tombstones(rows)).orderBy("corpus_row").collect()
    assert [(r.document, r.version, r.corpus_row) for r in got] == [("b", 1, 0), ("a", 2, 1)]


def test_html_outline():
    page = "<h1>One</h1><p>a<p>b <b>c</b><ul><li>x<li>y<p>z</p></ul><script>no</script><h2>Two</h2><p>d &amp; e"
    assert files.html_outline(page) == [("One", "a"), ("One", "b c"), ("One", "x"), ("One", "y z"), ("One", "z"), ("Two", "d & e")]
    assert files.html_outline("plain") == [("root", "plain")] and files.html_outline(None) == []


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff text")
    (tmp_path / "b.html").write_text("<p>para</p>")
    (tmp_path / "c.bin").write_bytes(b"no")
    (tmp_path / "e.pdf").write_bytes(b"one|two")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(word.getvalue())
    got = {(r.kind, r.page, r.section, r.text) for r in files.load_files(spark, str(tmp_path), pdf=lambda b: b.decode().split("|")).collect()}
    assert got == {("txt", None, None, "ok  text"), ("html", None, "root", "para"), ("docx", None, None, "one\ntwo"), ("pdf", 1, None, "one"), ("pdf", 2, None, "two")}


def test_vectors_from_a_file(spark, tmp_path):
    (tmp_path / "v").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert [tuple(r.embedding) for r in files.read_vectors(spark, str(tmp_path / "v"), 3).orderBy("corpus_row").collect()] == [(0, 1, 2), (3, 4, 5)]


def test_latest_leaf(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        for name in ("docstore.jsonl", "embeddings.bin"):
            (tmp_path / folder / name).write_text("x")
    assert files.latest_leaf(spark, str(tmp_path)).endswith("b/c")


def test_tables_last_no_longer_than_their_step(spark):
    import os

    from tidewell import storage

    rows = spark.range(5)
    with storage.scope() as keep:
        gone = storage.materialize(rows, "gone")
        kept = keep(storage.materialize(gone.where("id > 2"), "kept"))
    assert sorted(r.id for r in kept.collect()) == [3, 4] and not os.path.exists(gone._written_at) and os.path.exists(kept._written_at)
    storage.discard(kept, rows)
    assert not os.path.exists(kept._written_at)


def test_rows_of_hot_keys_meet_their_table(spark, monkeypatch):
    from tidewell import storage

    monkeypatch.setattr(storage, "OFTEN", 10)
    rows = storage.materialize(spark.range(100).selectExpr("if(id < 60, 0, id) as k", "id"), "rows")
    table = storage.materialize(spark.range(90).selectExpr("id as k", "id * 2 as v"), "table")
    for hot in (storage.often(rows, "k"), None):
        assert sorted(map(tuple, storage.join_often(rows, table, "k", hot, 16).select("id", "v").collect())) == [(i, 0 if i < 60 else 2 * i) for i in range(90)]
    assert [r.k for r in storage.often(rows, "k").collect()] == [0]
    assert storage.often(rows.where("k > 0").limit(5), "k") is None
