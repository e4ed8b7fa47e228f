"""The engine's queries over the test tables, and beside each its DuckDB SQL where there is one.

Documents stand for corpus rows, benchmark items for questions, and embeddings
with the same id for their vectors. All read whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell import models
from tidewell.functions import text as T
from tidewell.operators import bm25, chunking, cleaning, corpus, hybrid, ingest, metrics, retrieval, vectors
from tidewell.plans import sweep
from tidewell.sources import files
from tidewell.sources.store import Corpus
from tidewell.storage import materialize, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_and_questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_row"), "text")
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def rows_and_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_row"), "embedding", "label")
    asked = rows.join(table(spark, d, "benchmark").select(F.col("item_id").alias("corpus_row")), "corpus_row").select(F.col("corpus_row").alias("query_id"), "embedding")
    return rows, asked


def hybrid_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, asked = rows_and_vectors(spark, d)
    docs, questions = rows_and_questions(spark, d)
    # Both sides of a hybrid search read them, and re-ranking and diversifying do again.
    return materialize(docs.join(rows.select("corpus_row", "embedding"), "corpus_row"), "corpus"), materialize(questions.join(asked, "query_id"), "questions")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Thirty documents in a row are one document: three versions of ten chunks each."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    version = (F.expr("(doc_id % 30) div 10") + 1).cast("int")
    checksum = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select(F.expr("concat('d', doc_id div 30)").alias("document"), version.alias("version"), F.col("doc_id").alias("corpus_row"), F.expr("cast(doc_id % 10 as int)").alias("chunk_index"), checksum.alias("checksum"))


def signatures(rows: DataFrame) -> DataFrame:
    """What the first chunk of every version of a document says."""
    return rows.groupBy("document", "version").agg(F.min_by("checksum", "chunk_index").alias("checksum"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), "text")


# Keyword search

_POSTINGS = """
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM {docs}),
flat AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM flat GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, stats GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {questions}),
q AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term), stats GROUP BY ALL)"""
_WITH = "WITH " + _POSTINGS.format(docs="documents", questions="(SELECT item_id AS query_id, text FROM benchmark)")


@query(
    _WITH
    + """, every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every)
SELECT query_id, doc_id AS corpus_row, score, rank::INT AS rank FROM ranked WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(*rows_and_questions(spark, d), k=K)


@query(
    _WITH
    + """, every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN (SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1) d
  LEFT JOIN scored s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every)
SELECT query_id, doc_id AS corpus_row, score, rank::INT AS rank FROM ranked WHERE rank <= 10"""
)
def bm25_doc_filtered(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("corpus_row")).distinct()
    return bm25.search(*rows_and_questions(spark, d), k=K, allowed=allowed)


@query(_WITH + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = rows_and_questions(spark, d)
    return bm25.inverse_frequencies(bm25.frequencies(docs))[0].select("term", "df", F.round("idf", 6).alias("idf"))


# Vector search

_SCORES = {
    "cosine": "list_dot_product(e, q) / ((sqrt(list_dot_product(e, e)) + 1e-12) * (sqrt(list_dot_product(q, q)) + 1e-12))",
    "dot": "list_dot_product(e, q)",
    "l2": "2 * list_dot_product(e, q) - list_dot_product(e, e) - list_dot_product(q, q)",
}


def _nearest(metric: str = "cosine", where: str = "true") -> str:
    return f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE {where}),
asked AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings JOIN benchmark ON item_id = vec_id),
near AS (SELECT query_id, vec_id, label, round({_SCORES[metric]}, 6) + 0.0 AS score FROM e CROSS JOIN asked),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)"""


def _vector_sql(metric: str) -> str:
    return f"WITH {_nearest(metric)} SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM dense WHERE rank <= 10"


@query(_vector_sql("cosine"))
def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(*rows_and_vectors(spark, d), k=K)


@query(_vector_sql("dot"))
def vector_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(*rows_and_vectors(spark, d), k=K, metric="dot")


@query(_vector_sql("l2"))
def vector_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(*rows_and_vectors(spark, d), k=K, metric="l2")


@query(f"WITH {_nearest(where='label = 3')} SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM dense WHERE rank <= 5")
def vector_strict_filter(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search_scoped(*rows_and_vectors(spark, d), 5, F.col("label") == 3)


@query(
    f"""WITH {_nearest()}, kept AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense WHERE rank <= 200 AND label = 3)
SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM kept WHERE rank <= 5"""
)
def vector_post_filter(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search_scoped(*rows_and_vectors(spark, d), 5, F.col("label") == 3, fetch=200)


@query(
    f"""WITH {_nearest()}, kept AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dense WHERE rank <= 15 AND vec_id % 7 <> 3)
SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM kept WHERE rank <= 5"""
)
def vector_tombstone_overfetch(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = rows_and_vectors(spark, d)
    deleted = rows.where("corpus_row % 7 = 3").select("corpus_row")
    return corpus.overfetch(vectors.search(rows, asked, 15), deleted, 5)


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(list_sum(e) / sqrt(list_dot_product(e, e)), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def ann_index(spark: SparkSession, d: str) -> vectors.CellIndex:
    return vectors.CellIndex.build(rows_and_vectors(spark, d)[0], scratch(spark, "cells"))


@query()
def vector_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Its exact counterpart is ``vector_cosine_topk``; ``ann_recall`` says how much of that it finds."""
    return ann_index(spark, d).search(rows_and_vectors(spark, d)[1], k=5)


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT item_id FROM benchmark JOIN embeddings ON item_id = vec_id))::BIGINT AS queries, true AS mean_recall_at_least_90")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many queries were asked, and whether the index finds nine tenths of their exact best five."""
    return ann_recalls(spark, d).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("mean_recall_at_least_90"))


def ann_recalls(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = rows_and_vectors(spark, d)
    return metrics.recall(vectors.search(rows, asked, 5), ann_index(spark, d).search(asked, 5), 5)


@query(
    f"""WITH {_nearest()}, a AS (SELECT query_id, vec_id FROM dense WHERE rank <= 5),
few AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense WHERE label < 8)
SELECT q.query_id, count(f.vec_id) / 5.0::DOUBLE AS recall FROM a q LEFT JOIN (SELECT * FROM few WHERE rank <= 5) f ON f.query_id = q.query_id AND f.vec_id = q.vec_id GROUP BY q.query_id"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = rows_and_vectors(spark, d)
    return metrics.recall(vectors.search(rows, asked, 5), vectors.search(rows.where("label < 8"), asked, 5), 5)


# Hybrid search

_BOTH = (
    "WITH both_rows AS (SELECT d.doc_id, d.text, e.embedding, e.label, e.vec_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), "
    + _POSTINGS.format(docs="both_rows", questions="questions").replace("words AS", "questions AS (SELECT {variants} FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),\nwords AS", 1)
    + """,
e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM both_rows),
near AS (SELECT query_id, vec_id, round({cosine}, 6) + 0.0 AS score FROM e CROSS JOIN (SELECT query_id, embedding::DOUBLE[] AS q FROM questions)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 200),
every AS (SELECT x.query_id, b.doc_id AS vec_id, coalesce(s.score, 0) AS score FROM questions x CROSS JOIN both_rows b LEFT JOIN scored s ON s.query_id = x.query_id AND s.doc_id = b.doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM every) WHERE rank <= 200),
scaled AS (
  SELECT query_id, vec_id, {semantic} * part AS part FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM dense WINDOW w AS (PARTITION BY query_id))
  UNION ALL
  SELECT query_id, vec_id, {keyword} * part AS part FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM sparse WINDOW w AS (PARTITION BY query_id))),
fused AS (SELECT query_id, vec_id, round(sum(part), 6) AS score FROM scaled GROUP BY ALL),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fused)
"""
).replace("{cosine}", _SCORES["cosine"])
_ONE = "b.item_id AS query_id, b.text, e.embedding"


def _hybrid_sql(semantic: float = 0.65, keyword: float = 0.35, variants: str = _ONE) -> str:
    return _BOTH.replace("{semantic}", str(semantic)).replace("{keyword}", str(keyword)).replace("{variants}", variants)


_FINAL = "SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM final WHERE rank <= 30"


@query(_hybrid_sql() + _FINAL)
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.retrieve(*hybrid_tables(spark, d))


@query(_hybrid_sql(1.0, 0.0) + _FINAL)
def semantic_only(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.retrieve(*hybrid_tables(spark, d), semantic=1.0, keyword=0.0)


@query(
    f"""WITH {_nearest()} SELECT query_id, vec_id AS corpus_row, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS scaled FROM dense WHERE rank <= 200 WINDOW w AS (PARTITION BY query_id)"""
)
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.minmax(vectors.search(*rows_and_vectors(spark, d), k=200)).select("query_id", "corpus_row", F.round("scaled", 6).alias("scaled"))


def question_variants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Item i is the question, the next item its rewrite."""
    rows, questions = hybrid_tables(spark, d)
    n = questions.count()
    shifted = questions.withColumn("query_id", F.pmod(F.col("query_id") - 1, F.lit(n))).withColumn("variant", F.lit(2))
    return rows, questions.withColumn("variant", F.lit(1)).unionByName(shifted)


_VARIANTS = "unnest([b.item_id * 1000 + 1, ((b.item_id - 1 + (SELECT count(*) FROM benchmark)) % (SELECT count(*) FROM benchmark)) * 1000 + 2]) AS query_id, b.text, e.embedding"


@query(
    _hybrid_sql(variants=_VARIANTS)
    + """, merged AS (SELECT query_id // 1000 AS query_id, vec_id, query_id % 1000 AS variant, score, row_number() OVER (PARTITION BY query_id // 1000, vec_id ORDER BY score DESC, query_id % 1000) AS nth FROM final WHERE rank <= 30),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM merged WHERE nth = 1)
SELECT query_id, vec_id AS corpus_row, variant::INT AS variant, score, rank::INT AS rank FROM best WHERE rank <= 30"""
)
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    rows, variants = question_variants(spark, d)
    found = hybrid.retrieve_variants(rows, variants)
    return bm25.best(hybrid.merge_variants(found), 30).withColumn("rank", F.col("rank").cast("int"))


#: Greedy choice of up to 18 of each query's candidates in {found} (query_id, vec_id, score, rank).
_MMR = """, cand AS (SELECT f.query_id, f.vec_id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.vec_id) AS i, list_transform(e.e, lambda x: x / (sqrt(list_dot_product(e.e, e.e)) + 1e-12)) AS u
  FROM {found} f JOIN e USING (vec_id) WHERE f.rank <= 30),
lists AS (SELECT query_id, list(vec_id ORDER BY i) AS ids, list(score ORDER BY i) AS sc, list(u ORDER BY i) AS us FROM cand GROUP BY query_id),
walk AS (SELECT query_id, ids, sc, us, [1::BIGINT] AS chosen, 1 AS n FROM lists
  UNION ALL SELECT query_id, ids, sc, us, list_append(chosen, next), n + 1 FROM (SELECT *, list_sort(list_filter(list_transform(list_filter(range(1, len(ids) + 1), lambda i: NOT list_contains(chosen, i)),
    lambda i: {{'v': -(0.7 * sc[i] - 0.3 * list_max(list_transform(chosen, lambda c: list_dot_product(us[c], us[i])))), 'i': i, 'near': list_max(list_transform(chosen, lambda c: list_dot_product(us[c], us[i])))}}), lambda x: x.near < 0.92))[1].i AS next FROM walk WHERE n < 18) WHERE next IS NOT NULL),
picked AS (SELECT query_id, ids, sc, chosen FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1),
diverse AS (SELECT query_id, ids[c] AS vec_id, sc[c] AS score, pos AS mmr_rank FROM (SELECT query_id, ids, sc, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS pos FROM picked))
"""


@query(_hybrid_sql().replace("WITH ", "WITH RECURSIVE ", 1) + _MMR.format(found="final") + "SELECT query_id, vec_id AS corpus_row, score, mmr_rank::INT AS mmr_rank FROM diverse")
def mmr_diverse(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = hybrid_tables(spark, d)
    return hybrid.diversify(hybrid.retrieve(rows, asked), rows, 18)


@query(
    _hybrid_sql()
    + """, sets AS (SELECT f.query_id, f.vec_id, list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9_]+')) AS q, regexp_extract_all(lower(b.text), '[a-z0-9_]+') AS t
  FROM final f JOIN both_rows b ON b.doc_id = f.vec_id JOIN questions x ON x.query_id = f.query_id WHERE f.rank <= 30),
again AS (SELECT query_id, vec_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM sets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM again)
SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM ranked WHERE rank <= 6"""
)
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = hybrid_tables(spark, d)
    return hybrid.rerank(hybrid.retrieve(rows, asked), asked, rows, 6)


@query(
    _hybrid_sql(variants=_VARIANTS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, merged AS (SELECT query_id // 1000 AS query_id, vec_id, score, row_number() OVER (PARTITION BY query_id // 1000, vec_id ORDER BY score DESC, query_id % 1000) AS nth FROM final WHERE rank <= 30),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM merged WHERE nth = 1)"""
    + _MMR.format(found="best")
    + """, sets AS (SELECT f.query_id, f.vec_id, list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9_]+')) AS q, regexp_extract_all(lower(b.text), '[a-z0-9_]+') AS t
  FROM diverse f JOIN both_rows b ON b.doc_id = f.vec_id JOIN questions x ON x.query_id = f.query_id * 1000 + 1),
again AS (SELECT query_id, vec_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM sets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM again)
SELECT query_id, vec_id AS corpus_row, score, rank::INT AS rank FROM ranked WHERE rank <= 6"""
)
def smart_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.smart_retrieve(*question_variants(spark, d))


# Text

_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0b\x{{85}}\x{{a0}}\p{{Z}}]+', ''), '[\s\x0b\x{{85}}\x{{a0}}\p{{Z}}]+$', '')"
_SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_CLEAN = _STRIP.format(_SQUEEZE.format(r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"))


@query("SELECT doc_id, " + _STRIP.format(_SQUEEZE.format(r"regexp_replace(coalesce(text, ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')")) + " AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize("text", compose=False).alias("text"))


@query()
def normalize_text_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """``normalize_text`` with the NFKC step, which DuckDB SQL can't express."""
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("text"))


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS text FROM documents")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sanitize("text").alias("text"))


_LINES = (
    "WITH lines AS (SELECT source AS file, doc_id AS page, pos, " + _STRIP.format("line") + " AS line FROM (SELECT source, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT source, doc_id, string_split("
    + _CLEAN + """, chr(10)) AS parts FROM documents))),
sizes AS (SELECT source AS file, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
repeated AS (SELECT file, line, count(*) AS n FROM lines JOIN sizes USING (file) WHERE line <> '' AND length(line) <= 80 GROUP BY file, line HAVING count(*) >= greatest(2, floor(any_value(pages) * 0.35)))
"""
)


@query(_LINES + "SELECT * FROM repeated")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.repeated_lines(pages(spark, d))


@query(
    _LINES
    + """SELECT s.source AS file, s.doc_id AS page, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos), '') AS text FROM documents s
LEFT JOIN (SELECT * FROM lines WHERE line <> '' AND (file, line) NOT IN (SELECT (file, line) FROM repeated)) l ON l.page = s.doc_id GROUP BY 1, 2"""
)
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_pages(pages(spark, d))


_TITLE = "array_to_string(list_transform(range(1, length(raw) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(raw[i - 1], '[A-Z]') THEN raw[i] ELSE lower(raw[i]) END), '')"


@query(
    "WITH p AS (SELECT source AS file, doc_id AS page, regexp_split_to_array(" + _CLEAN + r", '\n(?:[^\S\n]*\n)+') AS ps FROM documents),"
    + " q AS (SELECT file, page, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM p),"
    + " l AS (SELECT file, page, i, list_filter(list_transform(string_split(para, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') AS ls FROM q),"
    + r" h AS (SELECT *, len(ls) > 0 AND length(ls[1]) <= 80 AND regexp_full_match(ls[1], '[A-Z0-9][A-Z0-9 \-,:;()]{6,}') AS head FROM l),"
    + " s AS (SELECT *, last_value(CASE WHEN head THEN ls[1] END IGNORE NULLS) OVER (PARTITION BY page ORDER BY i) AS raw, CASE WHEN head THEN ls[2:] ELSE ls END AS rest FROM h)"
    + f" SELECT file, page, (row_number() OVER (PARTITION BY page ORDER BY i) - 1)::INT AS block, CASE WHEN raw IS NOT NULL THEN {_TITLE} END AS section, array_to_string(rest, chr(10)) AS text FROM s WHERE len(rest) > 0"
)
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.page_blocks(pages(spark, d))


_SUMMARY = (
    r"array_to_string(list_filter(list_transform(string_split(regexp_replace(" + _STRIP.format("text") + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _STRIP.format("s") + "), lambda s: length(s) > 30)[1:3], ' ')"
)


@query(
    _LINES
    + """, cleaned AS (SELECT s.source AS file, s.doc_id AS page, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos), '') AS text FROM documents s
LEFT JOIN (SELECT * FROM lines WHERE line <> '' AND (file, line) NOT IN (SELECT (file, line) FROM repeated)) l ON l.page = s.doc_id GROUP BY 1, 2),
summed AS (SELECT file, page, """ + _SUMMARY + """ AS summary FROM cleaned)
SELECT file, page, 'Page Summary' AS section, 'Page ' || page || ' summary: ' || summary AS text FROM summed WHERE summary <> ''"""
)
def page_summary_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.page_summaries(cleaning.clean_pages(pages(spark, d)))


@query(
    r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(" + _STRIP.format("coalesce(text, '')")
    + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _STRIP.format("s") + "), lambda s: length(s) > 30)[1:3], ' ') AS summary FROM documents"
)
def page_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.summary("text").alias("summary"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s\x0b]+') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) <= 450 THEN least(len(w), 1) ELSE ceil((len(w) - 450) / 370.0)::INT + 1 END AS n FROM t)
SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * 370 + 1 : i * 370 + 450], ' ') AS text FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM n)"""
)
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_tokens(table(spark, d, "documents"))


@query(
    "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(" + _STRIP.format("coalesce(text, '')") + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _STRIP.format("s") + "), lambda s: s <> '') AS s FROM documents),"
    + " r AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {'done': []::VARCHAR[], 'now': x}), lambda a, x: CASE WHEN length(a.now) + length(x.now) + 1 <= 1800"
    + " THEN {'done': a.done, 'now': a.now || ' ' || x.now} ELSE {'done': list_append(a.done, a.now), 'now': x.now} END) AS r FROM s WHERE len(s) > 0),"
    + r" w AS (SELECT doc_id, list_transform(list_append(r.done, r.now), lambda p: regexp_extract_all(p, '[^\s\x0b]+')) AS w FROM r),"
    + " c AS (SELECT doc_id, flatten(list_transform(w, lambda t: list_transform(range(CASE WHEN len(t) <= 450 THEN least(len(t), 1) ELSE ceil((len(t) - 450) / 370.0)::INT + 1 END), lambda i: array_to_string(t[i * 370 + 1 : i * 370 + 450], ' ')))) AS c FROM w)"
    + " SELECT doc_id, (i - 1)::INT AS chunk_index, text FROM (SELECT doc_id, unnest(c) AS text, generate_subscripts(c, 1) AS i FROM c)"
)
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_sentences(table(spark, d, "documents"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_doc, doc_id <> min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS duplicate FROM documents")
def sha256_dedup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.checksums(table(spark, d, "documents"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return files.html_blocks(table(spark, d, "pages"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN lower(url) LIKE '%.docx' THEN 'docx' WHEN lower(url) LIKE '%.html' OR lower(url) LIKE '%.htm' THEN 'html' WHEN lower(url) LIKE '%.txt' OR lower(url) LIKE '%.md' THEN 'txt' END AS kind FROM pages")
def ext_source_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.source_type(F.col("url")).alias("kind"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) <= 4096 AS fits, coalesce(nullif(trim(lang), ''), 'untitled') AS title FROM documents")
def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) <= 4096).alias("fits"), T.title_or(F.col("lang"), F.lit(None)).alias("title"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source || CASE WHEN doc_id % 5 = 0 THEN ' p. ' || doc_id WHEN doc_id % 5 = 1 THEN '' ELSE ' p. ' || doc_id || '–' || (doc_id + doc_id % 5) END
ELSE source || CASE WHEN lang = 'fr' THEN '' ELSE ' > ' || lang END END AS citation FROM documents"""
)
def citation_format(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "en", "pdf").otherwise("html")
    first = F.when(F.col("doc_id") % 5 != 1, F.col("doc_id"))
    label = T.citation(kind, F.lit(None).cast("string"), F.col("source"), first, F.col("doc_id") + F.col("doc_id") % 5, F.when(F.col("lang") != "fr", F.col("lang")))
    return docs.select("doc_id", label.alias("citation"))


@query(
    r"""WITH ids AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x:v1:' || doc_id WHEN 1 THEN u || ':' || doc_id WHEN 2 THEN u || ':v' || (doc_id % 9) || ':' || doc_id ELSE u || ':v2:z' END AS id
  FROM (SELECT doc_id, '00000000-0000-4000-8000-' || lpad(doc_id::VARCHAR, 12, '0') AS u FROM documents))
SELECT doc_id, string_split(id, ':')[1] AS document_id, CASE WHEN doc_id % 4 = 2 THEN (doc_id % 9)::INT ELSE -1 END AS version, string_split(id, ':')[-1]::INT AS chunk_index FROM ids WHERE doc_id % 4 IN (1, 2)"""
)
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    u = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n, 12, "0"))
    kind = F.col("doc_id") % 4
    made = F.when(kind == 0, F.concat(F.lit("x:v1:"), n)).when(kind == 1, F.concat(u, F.lit(":"), n)).when(kind == 2, F.concat(u, F.lit(":v"), (F.col("doc_id") % 9).cast("string"), F.lit(":"), n)).otherwise(F.concat(u, F.lit(":v2:z")))
    return table(spark, d, "documents").select("doc_id", T.citation_parts(made).alias("p")).where("p is not null").select("doc_id", "p.document_id", F.coalesce("p.version", F.lit(-1)).alias("version"), "p.chunk_index")


_CONTEXT = _WITH + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
top AS (SELECT r.query_id, r.rank, r.score, d.source || ' > ' || d.lang AS citation, d.text FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 3)
"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = bm25.best(bm25.scores(*rows_and_questions(spark, d), k=3), 3)
    label = T.citation(F.lit("html"), F.lit(None).cast("string"), F.col("source"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("lang"))
    return corpus.assemble(found, docs.select(F.col("doc_id").alias("corpus_row"), label.alias("citation"), "text"))


def _sources(contexts: DataFrame) -> DataFrame:
    listed = F.transform("contexts", lambda x: F.concat(F.lit("["), x["citation"], F.lit("]\n"), x["text"]))
    return contexts.select("query_id", "n", F.array_join(listed, "\n\n").alias("sources"), F.col("contexts")[0]["score"].alias("best"))


@query(_CONTEXT + "SELECT query_id, count(*)::INT AS n, string_agg('[' || citation || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS sources, max(score) AS best FROM top GROUP BY query_id")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return _sources(_contexts(spark, d))


@query(
    _CONTEXT
    + """SELECT t.query_id, 'Answer from the sources below and cite them.' || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || citation || ']' || chr(10) || t.text, chr(10) || chr(10) ORDER BY rank)
|| chr(10) || chr(10) || 'Question: ' || any_value(trim(b.text)) AS prompt FROM top t JOIN benchmark b ON b.item_id = t.query_id GROUP BY t.query_id"""
)
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    _, questions = rows_and_questions(spark, d)
    return _contexts(spark, d).join(questions, "query_id").select("query_id", T.prompt(F.col("text"), F.col("contexts")).alias("prompt"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CASE WHEN trim(text) = '' THEN text ELSE trim(text) END ELSE text END AS variants FROM conversations""")
def rewrite_parse(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations")
    response = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("text", F.lit(" ")))).when(F.col("turn") % 3 == 1, F.lit("{}")).otherwise(F.lit("[not json"))
    return said.select("conv_id", "turn", F.array_join(T.rewrites(response, F.col("text")), " | ").alias("variants"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'user:' || user_id WHEN user_id % 3 = 1 THEN 'ip:10.0.0.' || user_id ELSE 'ip:unknown' END AS caller FROM events")
def rate_limit_key(spark: SparkSession, d: str) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("user_id") % 3
    forwarded = F.when(kind == 1, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 10.9.9.9")))
    return table(spark, d, "events").select("event_id", T.caller(F.when(kind == 0, user), forwarded, F.lit(None).cast("string")).alias("caller"))


# Corpus

_VERSIONS = """WITH v AS (SELECT 'd' || (doc_id // 30) AS document, (doc_id % 30) // 10 + 1 AS version, doc_id AS corpus_row, doc_id % 10 AS chunk_index, sha256(coalesce(text, '')) AS checksum, text FROM documents),
sig AS (SELECT document, version, min_by(checksum, chunk_index) AS checksum FROM v GROUP BY document, version) """


@query(_VERSIONS + "SELECT document, version::INT AS version, checksum FROM sig")
def docs_signature(spark: SparkSession, d: str) -> DataFrame:
    return signatures(versions(spark, d))


@query(_VERSIONS + "SELECT document, version::INT AS version, checksum FROM sig QUALIFY row_number() OVER (PARTITION BY document ORDER BY version DESC) = 1")
def doc_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(signatures(versions(spark, d)))


_NEWEST = "SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY document)"


@query(_VERSIONS + f"SELECT document, version::INT AS version, min(corpus_row) AS corpus_start, count(*) AS corpus_count, max(checksum) AS checksum FROM ({_NEWEST}) GROUP BY document, version")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.manifest(versions(spark, d))


@query(_VERSIONS + f"SELECT document, version::INT AS version, corpus_row FROM ({_NEWEST}) WHERE document IN ('d1', 'd2', 'none')")
def allowed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d)
    wanted = spark.createDataFrame([("d1",), ("d2",), ("none",)], "document string")
    return corpus.rows_of(corpus.manifest(rows), wanted, rows).select("document", "version", "corpus_row")


@query("SELECT doc_id, 5000 + row_number() OVER (ORDER BY source, doc_id) - 1 AS corpus_row FROM documents")
def corpus_append_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.append_rows(5000, table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "corpus_row")


@query(_VERSIONS + f"SELECT document, version::INT AS version, row_number() OVER (ORDER BY corpus_row) - 1 AS corpus_row, corpus_row AS old_row FROM ({_NEWEST})")
def corpus_compact(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d)
    return corpus.compact(rows, corpus.tombstones(rows)).select("document", "version", "corpus_row", "old_row")


@query(
    _VERSIONS
    + """, now AS (SELECT * FROM sig QUALIFY version = max(version) OVER (PARTITION BY document)),
arriving AS (SELECT document || CASE WHEN document LIKE '%3' THEN '-new' ELSE '' END AS document, CASE WHEN document LIKE '%5' THEN checksum ELSE 'changed' || version END AS checksum FROM sig)
SELECT a.document, a.checksum, CASE WHEN n.version IS NULL THEN 'insert' WHEN a.checksum = n.checksum THEN 'skip' ELSE 'bump' END AS status,
(CASE WHEN n.version IS NULL THEN 1 WHEN a.checksum = n.checksum THEN n.version ELSE n.version + 1 END)::INT AS version FROM arriving a LEFT JOIN now n USING (document)"""
)
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Every version arrives, under its name, a new one or changed, and is held against all stored versions."""
    stored = signatures(versions(spark, d))
    name = F.concat("document", F.when(F.col("document").like("%3"), "-new").otherwise(""))
    arriving = stored.select(name.alias("document"), F.when(F.col("document").like("%5"), F.col("checksum")).otherwise(F.concat(F.lit("changed"), "version")).alias("checksum"))
    return corpus.changes(stored, arriving)


_UPDATED = """, one AS (SELECT *, row_number() OVER (ORDER BY document, chunk_index) - 1 AS pos FROM v WHERE version = 1),
three AS (SELECT *, (SELECT count(*) FROM one) + row_number() OVER (ORDER BY document, chunk_index) - 1 AS pos FROM v WHERE version = 3),
kept AS (SELECT * FROM three UNION ALL SELECT * FROM one WHERE document NOT IN (SELECT document FROM three))
"""


@query(
    _VERSIONS
    + _UPDATED
    + """SELECT document, version::INT AS version, min(pos) AS corpus_start, count(*) AS corpus_count, string_agg(document || ':v' || version || ':' || chunk_index, ' ' ORDER BY pos) AS active,
  (SELECT count(*) FROM one WHERE document IN (SELECT document FROM three)) AS tombstones FROM kept GROUP BY document, version"""
)
def corpus_update(spark: SparkSession, d: str) -> DataFrame:
    """A corpus that takes in the first versions, is opened again and takes in the third ones."""
    rows = versions(spark, d).withColumn("chunk_id", T.chunk_id(F.col("document"), F.col("version"), F.col("chunk_index"))).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    path = scratch(spark, "corpus")
    Corpus(spark, path, dim=2).update(rows.where("version = 1"), index=False)
    Corpus(spark, path).update(rows.where("version = 3"), index=False)
    store = Corpus(spark, path)
    gone = store.deleted().agg(F.count("*").alias("tombstones"))
    return store.manifest().crossJoin(F.broadcast(gone)).select("document", "version", "corpus_start", "corpus_count", F.array_join("active_chunk_ids", " ").alias("active"), "tombstones")  # gone is one row


@query(_VERSIONS + f"SELECT document, version::INT AS version, corpus_row, chunk_index::INT AS chunk_index FROM (SELECT * FROM v WHERE version = 2 UNION ALL SELECT * FROM v WHERE version = 1 AND document NOT IN (SELECT document FROM v WHERE version = 2))")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of first versions, superseded by those of second ones."""
    rows = versions(spark, d).select("document", "version", "corpus_row", "chunk_index")
    return ingest.upsert(rows.where("version = 1"), rows.where("version = 2"))


@query(_VERSIONS + "SELECT corpus_row, document || ':v' || version || ':' || chunk_index AS chunk_id, text FROM v")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read again, with ids made by ``chunk_id``."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_row"), "text")
    rows = versions(spark, d).join(texts, "corpus_row").select("corpus_row", T.chunk_id(F.col("document"), F.col("version"), F.col("chunk_index")).alias("chunk_id"), "text")
    path = scratch(spark, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "corpus_row bigint, chunk_id string, text string")


@query("SELECT vec_id AS corpus_row, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as float32 bytes and read again."""
    rows, path = table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_row"), "embedding"), scratch(spark, "raw")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    files.write_vectors(rows, path, width)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.read_raw(spark, path, width).select("corpus_row", F.size("embedding").alias("dim"), (F.round(total, 6) + 0.0).alias("total"))


# Requests


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with vectors as chunks of a corpus: language for kind, source for filename, an hour for each id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_row"), F.col("lang").alias("source_type"), F.col("source").alias("filename"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("ingested_at"), F.concat(F.lit("d"), F.expr("doc_id % 50")).alias("document"))
    return docs.join(rows_and_vectors(spark, d)[0].select("corpus_row", "embedding"), "corpus_row")


def _filtered(where: str) -> str:
    return f"""WITH e AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id WHERE {where}),
asked AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings JOIN benchmark ON item_id = vec_id),
near AS (SELECT query_id, doc_id, round({_SCORES["cosine"]}, 6) + 0.0 AS score FROM e CROSS JOIN asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near) SELECT query_id, doc_id AS corpus_row, score, rank::INT AS rank FROM ranked WHERE rank <= 6"""


@query(_filtered("lower(lang) = 'en' AND contains(lower(source), 'src1') AND doc_id * 3600 BETWEEN 36000 AND 3600000"))
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = retrieval.filters("EN ", "SRC1", "1970-01-01 10:00:00", "1970-02-11 16:00:00")
    return retrieval.search_corpus(_corpus(spark, d), rows_and_vectors(spark, d)[1], where=where)


@query(_filtered("doc_id % 50 IN (3, 7, 11) AND doc_id % 4 <> 1"))
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _corpus(spark, d)
    wanted = spark.createDataFrame([("d3",), ("d7",), ("d11",), ("none",)], "document string")
    return retrieval.search_corpus(rows, rows_and_vectors(spark, d)[1], documents=wanted, deleted=rows.where("corpus_row % 4 = 1").select("corpus_row"))


@query("SELECT '00000000-0000-4000-8000-' || lpad((doc_id % 10)::VARCHAR, 12, '0') AS document FROM documents WHERE source = 'src3' AND doc_id % 10 IN (1, 3) GROUP BY 1")
def owned_documents(spark: SparkSession, d: str) -> DataFrame:
    u = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    docs = table(spark, d, "documents").select(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.expr("doc_id % 10").cast("string"), 12, "0")).alias("document"), F.col("source").alias("owner_id"))
    return retrieval.owned(docs, "src3", [u(1), u(3), u(77)])


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id || ',' || turn WHEN 1 THEN conv_id::VARCHAR ELSE '' END AS documents, CASE WHEN turn % 4 IN (0, 1) THEN 6 ELSE turn % 4 END::INT AS k FROM conversations")
def request_scope(spark: SparkSession, d: str) -> DataFrame:
    conv, kind = F.col("conv_id").cast("string"), F.col("turn") % 3
    several = F.when(kind == 0, F.array(conv, F.col("turn").cast("string"))).when(kind == 1, F.array().cast("array<string>"))
    k = F.when(F.col("turn") % 4 != 0, F.when(F.col("turn") % 4 == 1, 0).otherwise(F.col("turn") % 4))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(retrieval.asked_documents(several, F.when(kind != 2, conv)), ",").alias("documents"), retrieval.top_k_or(k).alias("k"))


@query("SELECT doc_id, 'passage: ' || coalesce(text, '') AS passage, 'query: ' || coalesce(lang, '') AS question FROM documents")
def embedding_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", models.prefixed(F.col("text"), models.PASSAGE).alias("passage"), models.prefixed(F.col("lang"), models.QUERY).alias("question"))


@query("SELECT item_id AS query_id, unnest([1, 2]) AS variant, unnest([coalesce(text, ''), 'what is ' || coalesce(text, '')]) AS text FROM benchmark")
def query_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites by a model that knows one other wording."""
    make = lambda: lambda questions: [json.dumps([f"what is {q}", q]) for q in questions]
    _, questions = rows_and_questions(spark, d)
    return models.rewrite(questions, make)


@query(
    _VERSIONS
    + """, ids AS (SELECT 'd' || (item_id // 30) AS document, (item_id % 30) // 10 + 1 + (item_id % 7 = 0)::INT AS version, item_id % 10 AS chunk_index, item_id FROM benchmark)
SELECT i.item_id AS query_id, v.text FROM ids i JOIN v USING (document, version, chunk_index)"""
)
def hydrated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts by document, version and index; some ids name a version that isn't there."""
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("n").cast("string"), 12, "0"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("item_id div 30").alias("n"), (F.expr("(item_id % 30) div 10") + 1 + (F.col("item_id") % 7 == 0).cast("int")).cast("int").alias("version"), F.expr("cast(item_id % 10 as int)").alias("i"))
    found = asked.select("query_id", T.chunk_id(uuid, F.col("version"), F.col("i")).alias("citation_id"))
    rows = versions(spark, d).withColumn("n", F.expr("cast(substring(document, 2) as bigint)")).withColumn("document", uuid)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_row"), "text")
    return retrieval.hydrate(found, rows.join(texts, "corpus_row")).select("query_id", "text")


@query(
    """SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n, CASE WHEN item_id % 2 = 0 THEN
'Answer from the sources below and cite them.' || chr(10) || chr(10) || 'Sources:' || chr(10) || '[src]' || chr(10) || 'text' || chr(10) || chr(10) || 'Question: ' || trim(text)
ELSE 'I could not find relevant context for that question in your indexed documents.' END AS answer FROM benchmark"""
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Every other question has a passage; the stand-in model answers with its prompt."""
    _, questions = rows_and_questions(spark, d)
    contexts = questions.where("query_id % 2 = 0").select("query_id", F.lit(1).alias("n"), F.array(F.struct(F.lit("src").alias("citation"), F.lit("text").alias("text"))).alias("contexts"))
    return retrieval.answers(questions, contexts)


@query()
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as PDF pages of their source, HTML blocks and plain texts, chunked by kind; NFKC has no SQL."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    kind = F.element_at(F.array(F.lit("txt"), F.lit("html"), F.lit("pdf")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat_ws("/", F.when(F.col("doc_id") % 3 == 2, F.expr("concat('file', doc_id div 60)")).otherwise(F.col("doc_id").cast("string")))
    return ingest.chunks(docs.select(name.alias("document"), kind.alias("kind"), F.when(kind == "pdf", F.col("doc_id").cast("int")).alias("page"), F.lit(0).alias("nth"), F.col("lang").alias("section"), "text"))


# Sweeps


@query("SELECT n.seed_row, count(*) AS times FROM (SELECT i % (SELECT count(*) FROM embeddings) AS seed_row FROM range(3000) t(i)) n GROUP BY 1")
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_row"), "embedding")
    return sweep.synthetic(seeds, 3000).groupBy("seed_row").agg(F.count("*").alias("times"))


@query("SELECT item_id AS query_id, true AS same FROM benchmark JOIN embeddings ON vec_id = item_id")
def index_determinism(spark: SparkSession, d: str) -> DataFrame:
    return sweep.same_after_loading(*rows_and_vectors(spark, d))


# Measures and limits


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, max(value) FILTER (WHERE i = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (WHERE i = floor(0.95 * (n - 1))) AS p95, round(count(*) / sum(value), 6) AS rate FROM r GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latencies(table(spark, d, "events"), "event_type", "value")


_SWEEP = "SELECT count(*) AS n, avg(l_quantity) AS exact, avg(l_extendedprice) / 2000 + l_linenumber AS approximate FROM lineitem GROUP BY l_linenumber"


@query(
    f"""WITH s AS (SELECT n, round(exact, 6) AS exact, round(approximate, 6) AS approximate FROM ({_SWEEP})), r AS (SELECT *, round(CASE WHEN approximate > 0 THEN exact / approximate ELSE 0 END, 6) AS speedup FROM s)
SELECT *, speedup > 1 AND coalesce(lag(speedup) OVER (ORDER BY n) <= 1, true) AS crossover FROM r"""
)
def crossover(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("exact"), F.round(F.avg("l_extendedprice") / 2000 + F.col("l_linenumber"), 6).alias("approximate"))
    return metrics.crossover(items.select("n", "exact", "approximate"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


@query("SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def rate_limit_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return metrics.limit_aligned(requests(spark, d), 3).select("key", "id", "allowed")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT key, id, i, moment AS opened, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.key, e.id, e.i, CASE WHEN e.moment >= w.opened + 86400000000 THEN e.moment ELSE w.opened END, CASE WHEN e.moment >= w.opened + 86400000000 THEN 1 ELSE w.n + 1 END FROM walk w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, id, n <= 3 AS allowed FROM walk"""
)
def rate_limit_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.limit_first_hit(requests(spark, d), 3)
