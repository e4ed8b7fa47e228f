"""The durable corpus, ingestion, models and retrieval, on cases worked out by hand."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import models
from tidewell.operators import chunking, hybrid, ingest, metrics, retrieval, vectors
from tidewell.plans import sweep
from tidewell.sources import files
from tidewell.sources.store import CHUNKS, Corpus

U = "00000000-0000-4000-8000-00000000000"


def chunk_rows(spark, rows):
    """rows: (document, version, index, text)."""
    df = spark.createDataFrame(rows, "document string, version int, chunk_index int, text string")
    df = df.withColumn("chunk_id", F.concat_ws(":", "document", F.concat(F.lit("v"), "version"), "chunk_index")).withColumn("checksum", F.concat(F.lit("c"), "version"))
    return df.withColumn("embedding", F.array(*(F.lit(float(i)) + F.length("text") * (1 + i) + F.col("chunk_index") for i in range(3))).cast("array<float>"))


def test_a_corpus_is_kept_updated_and_compacted(spark, tmp_path):
    path = str(tmp_path / "corpus")
    with pytest.raises(FileNotFoundError):
        Corpus(spark, path)
    store = Corpus(spark, path, dim=3)
    assert store.count() == 0 and store.chunks().count() == store.deleted().count() == store.manifest().count() == 0
    first = chunk_rows(spark, [("a", 1, 0, "x"), ("a", 1, 1, "xx"), ("b", 1, 0, "xyz"), ("c", 1, 0, "w" * 9)])
    assert {tuple(r) for r in store.update(first).collect()} == {("a", True), ("b", True), ("c", True)}
    again = Corpus(spark, path)
    assert again.meta()["dim"] == 3 and again.count() == 4
    assert [(r.corpus_row, r.chunk_id) for r in again.ids().orderBy("corpus_row").collect()] == [(0, "a:v1:0"), (1, "a:v1:1"), (2, "b:v1:0"), (3, "c:v1:0")]
    second = chunk_rows(spark, [("a", 2, 0, "new"), ("b", 1, 0, "xyz"), ("d", 1, 0, "q"), ("d", 1, 1, "r")])
    assert {tuple(r) for r in again.update(second).collect()} == {("a", True), ("b", False), ("d", True)}
    assert {r.chunk_id for r in again.deleted().collect()} == {"a:v1:0", "a:v1:1"} and again.count() == 7
    listed = {r.document: (r.version, r.corpus_start, r.corpus_count, r.active_chunk_ids) for r in Corpus(spark, path).manifest().collect()}
    assert listed == {"a": (2, 4, 1, ["a:v2:0"]), "b": (1, 2, 1, ["b:v1:0"]), "c": (1, 3, 1, ["c:v1:0"]), "d": (1, 5, 2, ["d:v1:0", "d:v1:1"])}
    asked = again.active().select(F.col("corpus_row").alias("query_id"), "embedding")
    assert again.index().rows().count() == 7
    again.compact()
    final = Corpus(spark, path)
    assert final.count() == 5 and final.deleted().count() == 0 and final.index().rows().count() == 5
    assert [(r.corpus_row, r.chunk_id) for r in final.ids().orderBy("corpus_row").collect()] == [(0, "b:v1:0"), (1, "c:v1:0"), (2, "a:v2:0"), (3, "d:v1:0"), (4, "d:v1:1")]
    assert {r.document: r.corpus_start for r in final.manifest().collect()} == {"b": 0, "c": 1, "a": 2, "d": 3}
    assert final.index().search(asked, 1, probes=99).count() == 5
    with pytest.raises(ValueError):
        final.append(chunk_rows(spark, [("z", 1, 0, "x")]).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")))
    assert {f.name for f in final.chunks().schema} == {c.split()[0] for c in CHUNKS.split(", ")}


def test_kinds_of_sources_are_chunked_as_they_should(spark):
    pages = [("p", "pdf", i + 1, i, None, f"Running head\nTITLE OF PART\nThis is sentence number {i} of quite some length. Short one. Another sentence that is long enough {i}.\nTLFeBOOK") for i in range(4)]
    rows = [*pages, ("h", "html", None, 0, "One", "alpha beta"), ("h", "html", None, 1, " ", "gamma"), ("t", "txt", None, 0, None, "w " * 25), ("e", "txt", None, 0, None, " \n"), ("x", None, None, 0, None, "ex-\nample")]
    parts = spark.createDataFrame(rows, ingest.PARTS)
    got = {}
    for r in ingest.chunks(parts, ingest.chunker(size=10, overlap=2)).orderBy("document", "chunk_index").collect():
        got.setdefault(r.document, []).append((r.chunk_index, r.page_start, r.section, r.text))
    assert got["h"] == [(0, None, "One", "alpha beta"), (1, None, None, "gamma")] and got["x"] == [(0, None, None, "example")] and "e" not in got
    assert [i for i, *_ in got["t"]] == [0, 1, 2] and all(len(t.split()) <= 10 for *_, t in got["t"])
    first = got["p"][0]
    assert first == (0, 1, "Page Summary", "Page 1 summary: TITLE OF PART\nThis is sentence number 0 of quite some length. Another sentence that is long enough 0.") or first[2] == "Page Summary"
    assert [p for _, p, *_ in got["p"]] == sorted(p for _, p, *_ in got["p"]) and not any("Running head" in t or "TLFeBOOK" in t for *_, t in got["p"])
    with pytest.raises(ValueError):
        ingest.chunker("paragraphs")


def test_sentences_are_chunked_as_by_themselves(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd ee! " * 30), (2, None), (3, "x " * 100)], "doc_id long, text string")
    one = [(r.doc_id, r.chunk_index, r.text) for r in chunking.chunk_sentences(docs, 10, 2).orderBy("doc_id", "chunk_index").collect()]
    cut = ingest.chunker("sentences", 10, 2)
    two = [(r.doc_id, r.i, r.t) for r in docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("i", "t")).orderBy("doc_id", "i").collect()]
    assert one == two and {d for d, *_ in one} == {1, 3}


def test_a_tokenizer_of_the_caller_cuts_chunks(spark):
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    got = spark.createDataFrame([("abcdefgh",), (None,), ("ab",)], "t string").select(ingest.chunker(size=4, overlap=1, tokenizer=Letters)(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [["abcd", "defg", "gh"], [], ["ab"]]


def test_arriving_documents_are_inserted_bumped_or_skipped(spark):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stored = spark.createDataFrame([("a", 1, h("old")), ("b", 3, h("same"))], "document string, version int, checksum string")
    arriving = spark.createDataFrame([("a", "new"), ("b", "same"), ("c", None)], "document string, text string")
    assert {(r.document, r.status, r.version) for r in ingest.versioned(stored, arriving).collect()} == {("a", "bump", 2), ("b", "skip", 3), ("c", "insert", 1)}
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "document string, chunk_index int")
    assert sorted(map(tuple, ingest.upsert(old, spark.createDataFrame([("a", 7)], old.schema)).collect())) == [("a", 7), ("b", 0)]


def test_documents_are_found_again_by_filename_or_title(spark):
    rows = spark.createDataFrame([("o", "f.txt", "t", "txt"), ("o", " f.txt ", "other", "pdf"), ("p", "f.txt", "t", "txt"), ("o", None, " ", "txt"), ("o", "", "untitled", "txt"), ("o", None, "untitled", "pdf")], "o string, f string, t string, k string")
    ids = [r[0] for r in rows.select(ingest.document_key(F.col("o"), F.col("f"), F.col("t"), F.col("k"))).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] == ids[4] != ids[5] and all(retrieval._UUID.fullmatch(i) for i in ids)


def test_uploads_have_a_status(spark, tmp_path):
    rows = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.md", 30 << 20)], "f string, n long")
    assert [r[0] for r in rows.select(ingest.upload_status(F.col("f"), F.col("n"))).collect()] == [200, 400, 413]
    for name, size in (("a.txt", 10), ("b.bin", 10), ("c.html", 3 << 20)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert {(r.path[-5:], r.status) for r in files.file_report(spark, str(tmp_path), most_mb=2).collect()} == {("a.txt", 200), ("b.bin", 400), (".html", 413)}
    assert files.load_files(spark, str(tmp_path), most_mb=2).count() == 1


def test_whole_ingestion(spark, tmp_path):
    store = Corpus(spark, str(tmp_path / "c"), dim=512)
    make = models.hashed_embedder(512)

    def arrive(rows, versions):
        arriving = spark.createDataFrame(rows, "owner_id string, title string, filename string, kind string, text string")
        docs = arriving.withColumn("document", ingest.document_key(F.col("owner_id"), F.col("filename"), F.col("title"), F.col("kind"))).withColumn("ingested_at", F.timestamp_seconds(F.lit(len(versions))))
        known = ingest.versioned(spark.createDataFrame(versions, "document string, version int, checksum string"), docs)
        fresh = known.where("status <> 'skip'")
        parts = fresh.select("document", "kind", F.lit(None).cast("int").alias("page"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("section"), "text")
        store.update(ingest.described(ingest.chunks(parts), fresh, make, 512))
        return [(r.document, r.version, r.checksum) for r in known.collect()]

    seen = arrive([("u", "one", "one.txt", "txt", "apples and pears"), ("u", "two", None, "txt", "rivers and lakes")], [])
    arrive([("u", "one", "one.txt", "txt", "apples and plums"), ("u", "two", None, "txt", "rivers and lakes")], seen)
    assert sorted((r.text, r.version) for r in store.active().collect()) == [("apples and plums", 2), ("rivers and lakes", 1)]
    asked = models.embed_queries(spark.createDataFrame([(1, "plums"), (2, "lakes")], "query_id long, text string"), make, 512)
    deleted = store.chunks().join(store.deleted(), "chunk_id", "left_semi").select("corpus_row")
    for index in (None, store.index()):
        found = retrieval.search_corpus(store.chunks(), asked, 1, deleted=deleted, index=index)
        named = found.join(store.ids(), "corpus_row").withColumnRenamed("chunk_id", "citation_id")
        texts = {r.query_id: r.text for r in retrieval.hydrate(named, store.chunks()).collect()}
        assert texts == {1: "apples and plums", 2: "rivers and lakes"}
    some = retrieval.search_corpus(store.chunks(), asked, 5, where=retrieval.filters("TXT", "ONE."), deleted=deleted)
    assert {r.corpus_row for r in some.collect()} == {2}


def test_filters_hold_for_kind_name_and_date(spark):
    rows = spark.createDataFrame([(1, "pdf", "Report.PDF", "2024-01-01 00:00:00"), (2, "txt", "notes.txt", "2024-03-01 00:00:00"), (3, None, None, None)], "i int, source_type string, filename string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    of = lambda **x: [r.i for r in rows.where(retrieval.filters(**x)).collect()]
    assert of() == [1, 2, 3] and of(source_type=" PDF") == [1] and of(filename_contains="NOTE") == [2]
    assert of(date_from="2024-02-01") == [2] and of(date_to="2024-02-01") == [1] and of(source_type="pdf", filename_contains="notes") == []


def test_scopes_of_requests(spark):
    docs = spark.createDataFrame([(U + "1", "me"), (U + "2", "you")], "document string, owner_id string")
    assert [r.document for r in retrieval.owned(docs, "me", [U + "1", U + "2"]).collect()] == [U + "1"]
    with pytest.raises(ValueError):
        retrieval.owned(docs, "me", ["no id"])
    with pytest.raises(LookupError):
        retrieval.owned(docs, "me", [U + "2"])
    rows = spark.createDataFrame([(["a", "b"], "c", 3), ([], "c", 0), (None, None, None)], "m array<string>, o string, k int")
    assert [tuple(r) for r in rows.select(retrieval.asked_documents(F.col("m"), F.col("o")), retrieval.top_k_or(F.col("k"))).collect()] == [(["a", "b"], 3), (["c"], 6), ([], 6)]


def test_ids_lead_to_chunks_of_their_version(spark):
    chunks = spark.createDataFrame([(U + "1", 1, 0, "old"), (U + "1", 2, 0, "new"), (U + "2", 1, 4, "other")], "document string, version int, chunk_index int, text string")
    found = spark.createDataFrame([(0, 1, U + "1:v2:0"), (0, 2, U + "2:4"), (0, 3, "bad"), (0, 4, U + "1:v3:0"), (1, 1, U + "1:0")], "query_id int, rank int, citation_id string")
    got = sorted((r.query_id, r.rank, r.text) for r in retrieval.hydrate(found, chunks).collect())
    assert got == [(0, 1, "new"), (0, 2, "other"), (1, 1, "new"), (1, 1, "old")]


def test_answers_and_where_there_is_none(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, text string")
    contexts = spark.createDataFrame([(1, 1, [("src", "because")])], "query_id int, n int, contexts array<struct<citation:string,text:string>>")
    shout = lambda: lambda prompts: [f" {p.splitlines()[-1].upper()} " for p in prompts]
    assert {r.query_id: r.answer for r in retrieval.answers(asked, contexts, shout).collect()} == {1: "QUESTION: WHY?", 2: retrieval.NOTHING}


def test_rewrites_are_variants_after_the_question(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "query_id int, text string")

    def make():
        return lambda questions: ['["x", "a b", "y", "z"]' if q == "a b" else '["p"]' if q == "c" else "broken" for q in questions]

    got = sorted((r.query_id, r.variant, r.text) for r in models.rewrite(asked, make).collect())
    assert got == [(1, 1, "a b"), (1, 2, "x"), (1, 3, "y"), (2, 1, "c"), (2, 2, "p"), (3, 1, "d")]

    def failing():
        def ask(questions):
            raise OSError("no model")

        return ask

    assert sorted((r.query_id, r.text) for r in models.rewrite(asked, failing).collect()) == [(1, "a b"), (2, "c"), (3, "d")]


def test_embeddings_are_unit_vectors_of_the_stated_width(spark):
    rows = spark.createDataFrame([("x y",), (None,)], "t string")
    got = [r[0] for r in rows.select(models.embedding(F.col("t"), models.hashed_embedder(8), models.QUERY, 8)).collect()]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got)
    with pytest.raises(Exception, match="numbers for a text"):
        rows.select(models.embedding(F.col("t"), models.hashed_embedder(8), dim=9)).collect()


def test_a_model_of_pairs_re_ranks(spark):
    make = lambda: lambda questions, texts: [float(len(t)) for t in texts]
    corpus = spark.createDataFrame([(1, "a"), (2, "aaa"), (3, None)], "corpus_row long, text string")
    found = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id long, corpus_row long")
    asked = spark.createDataFrame([(0, "q")], "query_id long, text string")
    assert [r.corpus_row for r in hybrid.rerank(found, asked, corpus, 2, models.scorer(make)).orderBy("rank").collect()] == [2, 1]


def test_raw_vectors_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(9)], "corpus_row long, embedding array<float>")
    assert files.write_vectors(rows, str(tmp_path / "raw"), 2) == 9
    assert sorted(files.read_raw(spark, str(tmp_path / "raw"), 2).collect()) == sorted(rows.collect())
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "j"), "corpus_row long, embedding array<float>").collect()) == sorted(rows.collect())


def test_sweep_and_determinism(spark):
    rng = np.random.default_rng(8)
    seeds = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(20)], "corpus_row long, embedding array<float>")
    made = sweep.synthetic(seeds, 50)
    got = made.orderBy("corpus_row").collect()
    base = {i: np.array(r.embedding) for i, r in enumerate(seeds.orderBy("corpus_row").collect())}
    off = np.array([np.array(r.embedding) - base[r.seed_row] for r in got])
    assert len(got) == 50 and 0.008 < off.std() < 0.012 and [r.seed_row for r in got] == [i % 20 for i in range(50)]
    assert sorted(made.repartition(7).collect()) == sorted(got)
    asked = seeds.where("corpus_row < 5").withColumnRenamed("corpus_row", "query_id")
    table = sweep.sweep(seeds, asked, [30, 60], times=1).collect()
    assert [r.n for r in sorted(table)] == [30, 60] and all(0 <= r.recall <= 1 and r.exact > 0 for r in table)
    assert {r.same for r in sweep.same_after_loading(seeds, asked).collect()} == {True}


def test_first_hit_windows_go_on_over_batches(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.id: r.allowed for r in metrics.limit_first_hit(rows, 2, 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, wanted = {}, {}
    for i in range(3000):
        opened, n = state.get(i % 3, (-1e18, 0))
        opened, n = (i * 7, 1) if i * 7 >= opened + 300 else (opened, n + 1)
        state[i % 3] = opened, n
        wanted[i] = n <= 2
    assert got == wanted


def test_checked_rows_have_one_id_each(spark):
    with pytest.raises(ValueError):
        vectors.checked(spark.createDataFrame([(1, [1.0]), (1, [2.0])], "corpus_row long, embedding array<float>"), 1)
