"""Each stage of the pipeline against what it is to do with what the stage before kept."""

from __future__ import annotations

import random

import corpus_pipeline
from test_llm import by_hand_components, by_hand_lines, made, near_copies, words_of


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    texts = made(21, 300, vocabulary=300, longest=60) + near_copies(22, 10, 6, 120, 5) + ["a line that is shared by some\nown"] * 5 + [None, "", "x" * 3000]
    bad = [t is not None and rng.random() < 0.25 for t in texts]
    docs = [(i, (t or "") + (" grumbleword" if b else "") if t is not None else None, "en", f"src{i % 3}", 0) for i, (t, b) in enumerate(zip(texts, bad, strict=True))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(now.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    clean, lines, single, packed = kept
    assert {r.doc_id for r in clean} >= {i for i, b in enumerate(bad) if not b}
    assert sum(r.doc_id in {i for i, b in enumerate(bad) if b} for r in clean) <= 0.1 * sum(bad)
    wanted = by_hand_lines([(r.doc_id, r.text) for r in clean])
    assert sorted((r.doc_id, r.text) for r in lines) == [(d, t) for d, _, _, t in wanted]
    assert all(r.n_chars == len(r.text) for r in lines) and lines[0].asDict().keys() == set(schema.replace(" long", "").replace(" string", "").split(", "))
    low = by_hand_components([(r.doc_id, r.text) for r in lines], 5, 80)
    assert sorted(r.doc_id for r in single) == [d for d, _, c in low if d == c]
    assert sum(r.n_tokens for r in packed) == sum(len(words_of(r.text)) + 1 for r in single)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.piece, r.n_tokens) for r in packed)


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __score string, __kept int, __gone int, __keep int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = [(1, long), (2, long), (3, None), (4, ""), (None, "no id here"), (5, "twice"), (5, "twice")]
    rows = [(d, t, "en", "src", len(t or ""), "s", 1, 2, 3) for d, t in docs]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.toxicity(spark, now, str(tmp_path)).count() == len(docs)
    spark.createDataFrame([(5, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.toxicity(spark, now, str(tmp_path))
    assert kept.columns == now.columns and kept.count() <= len(docs)
    lines = corpus_pipeline.line_dedup(spark, now, str(tmp_path))
    assert lines.columns == now.columns and sorted((r.doc_id or 0, len(r.text)) for r in lines.collect()) == sorted((d or 0, 0 if d == 2 else len(t or "")) for d, t in docs)
    single = corpus_pipeline.near_dedup(spark, now, str(tmp_path))
    assert single.columns == now.columns and sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 3, 4, 5, 5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 2, 3, 4, 5, None}
