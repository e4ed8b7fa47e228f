"""Every query with SQL gives what DuckDB gives for it, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from tidewell.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        return plain(x.item())
    return round(x, 6) if isinstance(x, float) else x


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalogue.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(1).count() == 1


def test_vectors_of_neighbouring_cells_are_mostly_found(spark):
    found = catalogue.ann_recalls(spark, SF).toPandas()
    assert found["recall"].mean() >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_whole_passages_reach_contexts_and_prompts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {}
    for r in catalogue.bm25.best(catalogue.bm25.scores(*catalogue.rows_and_questions(spark, SF)), 3).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.corpus_row))
    listed = {q: "\n\n".join(f"[{docs[x].source} > {docs[x].lang}]\n{docs[x].text}" for _, x in sorted(rows)) for q, rows in found.items()}
    assert max(len(docs[x].text) for rows in found.values() for _, x in rows) > 200
    assert {r.query_id: r.sources for r in catalogue.QUERIES["context_assembly"](spark, SF).collect()} == listed
    wanted = {q: f"Answer from the sources below and cite them.\n\nSources:\n{x}\n\nQuestion: {asked[q].strip()}" for q, x in listed.items()}
    assert {r.query_id: r.prompt for r in catalogue.QUERIES["prompt_build"](spark, SF).collect()} == wanted


def test_change_detection_sees_every_row(spark, tmp_path):
    from hashlib import sha256

    docs = [(i, f"text {i % 37}") for i in range(200)] + [(207, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = {}
    for i, t in docs:
        first.setdefault((f"d{i // 30}", i % 30 // 10 + 1), sha256((t or "").encode()).hexdigest())
    newest = {d: max(v for x, v in first if x == d) for d, _ in first}
    wanted = []
    for (d, v), checksum in first.items():
        if d.endswith("3"):
            wanted.append((d + "-new", f"changed{v}", "insert", 1))
        elif d.endswith("5") and checksum == first[d, newest[d]]:
            wanted.append((d, checksum, "skip", newest[d]))
        else:
            wanted.append((d, checksum if d.endswith("5") else f"changed{v}", "bump", newest[d] + 1))
    assert sorted(map(tuple, catalogue.QUERIES["change_detection"](spark, str(tmp_path)).collect())) == sorted(wanted) and len(wanted) > 15


def test_normalizing_composes(spark, tmp_path):
    import re
    import unicodedata

    def by_hand(text):
        text = unicodedata.normalize("NFKC", (text or "").replace("\x00", ""))
        text = re.sub(r"(\w)-\n(\w)", r"\1\2", text).replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()

    texts = [None, "", " \n", "\ufb01ne \ufb02ow o\ufb03ce", "\uff21\uff22\uff23\uff11 \uff5e", "a\u00a0\u00a0b\u2003c", "e\u0301te\u0301", "exam-\nple \ufb01-\n\ufb01", "\u00bd \u2460 \u212b \u2126 x\u00b2", "a\r\n\r\n\r\nb\rc", "\u3000\uac01 \u1100\u1161\u11a8\u3000", "\uff76\uff9e\x00", "a \t\u2009 b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in catalogue.QUERIES["normalize_text_nfkc"](spark, str(tmp_path)).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_normalizing_composes_whole_tables(spark):
    import unicodedata

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalogue.QUERIES["normalize_text_nfkc"](spark, SF).collect()}
    assert got.keys() == docs.keys() and all(unicodedata.is_normalized("NFKC", t) for t in got.values())
