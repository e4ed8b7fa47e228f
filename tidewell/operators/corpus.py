"""A corpus that keeps versions: change detection, appends, tombstones, manifest, compaction.

Documents are rows (document, version, checksum, text, ...); a corpus has one
row for each stored version, numbered by ``corpus_row`` in the order of appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.storage import materialize


def checksums(docs: DataFrame) -> DataFrame:
    """Each text's SHA-256, and the smallest doc_id of those that share it."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    first = hashed.groupBy("checksum").agg(F.min("doc_id").alias("first_doc"))
    return hashed.join(first, "checksum").select("doc_id", "checksum", "first_doc", (F.col("doc_id") != F.col("first_doc")).alias("duplicate"))


def changes(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """What to do with each of ``arriving`` (document, checksum): skip, insert or bump, and its version."""
    now = latest(stored).select("document", F.col("checksum").alias("stored"), "version")
    joined = arriving.join(now, "document", "left")
    status = F.when(F.col("version").isNull(), "insert").when(F.col("checksum").eqNullSafe(F.col("stored")), "skip").otherwise("bump")
    return joined.select("document", "checksum", status.alias("status"), F.when(status == "insert", 1).when(status == "skip", F.col("version")).otherwise(F.col("version") + 1).cast("int").alias("version"))


def latest(stored: DataFrame, key: str = "document", version: str = "version") -> DataFrame:
    """The row of the largest version of each document."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(version))
    return stored.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def append_rows(corpus_size: int, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` numbered on from ``corpus_size`` in the given order, without one task that holds them all.

    Rows are range-partitioned by ``order``; a partition's numbers begin where
    the counts of those before end, one count for each partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counted = materialize(counted, "counted")  # its parts are counted and then numbered, and must be the same ones
    sizes = counted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return counted.join(F.broadcast(starts), "__part").withColumn("corpus_row", F.col("__at") + F.col("__before") + corpus_size).drop("__part", "__at", "__before", "__n")


def manifest(corpus: DataFrame) -> DataFrame:
    """For each document its newest version, and where that version's rows lie."""
    newest = corpus.withColumn("__newest", F.max("version").over(Window.partitionBy("document"))).where("version = __newest")
    return newest.groupBy("document", "version").agg(F.min("corpus_row").alias("corpus_start"), F.count("*").alias("corpus_count"), F.max("checksum").alias("checksum"))


def rows_of(manifested: DataFrame, documents: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of the newest version of the given documents; unknown ones have none."""
    wanted = manifested.join(documents, "document", "left_semi").select("document", "corpus_start", "corpus_count")
    met = corpus.join(wanted, "document")
    return met.where((F.col("corpus_row") >= F.col("corpus_start")) & (F.col("corpus_row") < F.col("corpus_start") + F.col("corpus_count"))).drop("corpus_start", "corpus_count")


def tombstones(corpus: DataFrame) -> DataFrame:
    """(corpus_row) of every row that a newer version of its document supersedes."""
    newest = F.max("version").over(Window.partitionBy("document"))
    return corpus.withColumn("__newest", newest).where("version < __newest").select("corpus_row")


def compact(corpus: DataFrame, deleted: DataFrame) -> DataFrame:
    """The corpus without deleted rows, numbered from 0 in the old order."""
    kept = corpus.join(deleted, "corpus_row", "left_anti").withColumnRenamed("corpus_row", "old_row")
    return append_rows(0, kept, ["old_row"])


def overfetch(ranked: DataFrame, deleted: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the first ``3 * k`` ranks that aren't deleted: there may be fewer."""
    kept = ranked.where(F.col("rank") <= 3 * k).join(deleted, "corpus_row", "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("query_id", "corpus_row", "score", F.col("nth").cast("int").alias("rank"))


def assemble(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each query: its passages in rank order with their citations. Passages without a chunk are left out."""
    joined = found.join(chunks, "corpus_row")
    one = F.struct("rank", "citation", "text", "score")
    listed = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("contexts"))
    return listed.select("query_id", F.size("contexts").alias("n"), "contexts")
