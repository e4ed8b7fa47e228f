"""A durable corpus below a path: chunks with their vectors, tombstones, manifest, parameters and an index of vectors.

Tables are Parquet. A manifest or a compacted corpus is written to a folder of
its own and becomes the current one when the small file that names it is
written, so a job that fails leaves the corpus as it was. There is one writer at
a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import corpus as C
from tidewell.operators import vectors
from tidewell.storage import materialize

CHUNKS = (
    "corpus_row bigint, document string, version int, chunk_index int, chunk_id string, checksum string, owner_id string, title string, filename string, source_type string, "
    "ingested_at timestamp, page_start int, page_end int, section string, text string, embedding array<float>"
)
MANIFEST = "document string, version int, checksum string, corpus_start bigint, corpus_count bigint, active_chunk_ids array<string>"


class Corpus:
    """Opens the corpus at ``path``, or begins an empty one there."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, metric: str = "cosine"):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._state()
        if found is None:
            if dim is None:
                raise FileNotFoundError(path)
            found = {"dim": dim, "metric": metric, "generation": 0, "manifest": 0, "count": 0}
            self._save(**found)
        self.state = found

    def _state(self) -> dict | None:
        """The newest state; None where there is none."""
        try:
            rows = self.spark.read.json(f"{self.path}/state").orderBy(F.desc("step")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        return {k: v for k, v in rows[0].asDict().items() if k != "step"} if rows else None

    def _save(self, **state) -> None:
        step = getattr(self, "step", 0) + 1
        last = self._state()
        if last is not None:
            step = self.spark.read.json(f"{self.path}/state").agg(F.max("step")).first()[0] + 1
        row = self.spark.range(1).select(F.lit(step).alias("step"), *(F.lit(v).alias(k) for k, v in state.items()))
        row.coalesce(1).write.mode("append").json(f"{self.path}/state")
        self.step, self.state = step, state

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}/generation={self.state['generation']}"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def meta(self) -> dict:
        return dict(self.state)

    def count(self) -> int:
        return self.state["count"]

    def chunks(self) -> DataFrame:
        """Every row that was appended, those of old versions included."""
        return self._read(self._at("chunks"), CHUNKS).where(F.col("corpus_row") < self.count())  # a failed append isn't there

    def ids(self) -> DataFrame:
        return self.chunks().select("corpus_row", "chunk_id")

    def vectors(self) -> DataFrame:
        return self.chunks().select("corpus_row", "embedding")

    def deleted(self) -> DataFrame:
        """(chunk_id) of tombstones, each once; none where nothing was deleted."""
        return self._read(self._at("tombstones"), "chunk_id string").distinct()

    def active(self) -> DataFrame:
        return self.chunks().join(self.deleted(), "chunk_id", "left_anti")

    def add_tombstones(self, ids: DataFrame) -> None:
        ids.select("chunk_id").where("chunk_id is not null").write.mode("append").parquet(self._at("tombstones"))

    def manifest(self) -> DataFrame:
        """What is the newest version of each document, and where its rows lie."""
        return self._read(f"{self.path}/manifest/step={self.state['manifest']}", MANIFEST)

    def append(self, fresh: DataFrame) -> tuple[int, int]:
        """Append chunks, in the order of document and index; where they begin and how many they are."""
        start, have = self.count(), set(fresh.columns)
        names = [c.split()[0] for c in CHUNKS.split(", ")][1:]
        kinds = dict(c.split(" ", 1) for c in CHUNKS.split(", "))
        rows = fresh.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in names))
        rows = vectors.checked(materialize(rows, "fresh"), self.state["dim"], "chunk_id")
        C.append_rows(start, rows, ["document", "version", "chunk_index"]).select("corpus_row", *names).write.mode("append").parquet(self._at("chunks"))
        n = rows.count()
        self._save(**(self.state | {"count": start + n}))
        return start, n

    def signatures(self, fresh: DataFrame) -> DataFrame:
        """(document, checksum, version) as the first chunk of each document says."""
        first = F.min_by(F.struct("checksum", "version"), "chunk_index").alias("x")
        return fresh.groupBy("document").agg(first).select("document", "x.checksum", "x.version")

    def update(self, fresh: DataFrame, index: bool = True) -> DataFrame:
        """Bring the corpus to the versions in ``fresh`` (chunks of whole documents); (document, changed).

        Documents whose checksum and version are those of the manifest are left
        alone. Of the others, rows of the version before get tombstones, the new
        rows are appended, and the index of vectors takes them in.
        """
        fresh = materialize(fresh, "fresh")
        now = self.manifest().select("document", F.col("checksum").alias("was"), F.col("version").alias("before"))
        state = self.signatures(fresh).join(now, "document", "left")
        same = F.col("checksum").eqNullSafe(F.col("was")) & F.col("version").eqNullSafe(F.col("before"))
        state = materialize(state.select("document", (~same).alias("changed")), "changes")
        moved = state.where("changed")
        old = self.manifest()
        self.add_tombstones(old.join(moved, "document", "left_semi").select(F.explode("active_chunk_ids").alias("chunk_id")))
        start, n = self.append(fresh.join(moved, "document", "left_semi"))
        made = self.chunks().where(F.col("corpus_row") >= start)
        self._keep(old.join(moved, "document", "left_anti").unionByName(listed(made)))
        if index and n:
            self.extend_index(made)
        return state

    def _keep(self, manifest: DataFrame) -> None:
        step = self.state["manifest"] + 1
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/step={step}")
        self._save(**(self.state | {"manifest": step}))

    def index(self) -> vectors.CellIndex:
        return vectors.CellIndex(self.spark, self._at("index"))

    def build_index(self) -> vectors.CellIndex:
        return vectors.CellIndex.build(self.vectors(), self._at("index"), self.state["metric"])

    def extend_index(self, rows: DataFrame) -> None:
        try:
            kept = self.index()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.build_index()
            return
        kept.add(rows.select("corpus_row", "embedding"))

    def compact(self) -> None:
        """Only active rows, numbered from 0, with a new manifest and a new index; there are no tombstones then."""
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kept = C.compact(self.active(), self.spark.createDataFrame([], "corpus_row bigint")).select(names)
        step = self.state["generation"] + 1
        kept.write.mode("overwrite").parquet(f"{self.path}/chunks/generation={step}")
        rows = self._read(f"{self.path}/chunks/generation={step}", CHUNKS)
        self._keep_generation(step, rows)

    def _keep_generation(self, step: int, rows: DataFrame) -> None:
        at = self.state["manifest"] + 1
        listed(rows).write.mode("overwrite").parquet(f"{self.path}/manifest/step={at}")
        self._save(**(self.state | {"generation": step, "manifest": at, "count": rows.count()}))
        self.build_index()


def listed(rows: DataFrame) -> DataFrame:
    """A manifest of chunks: one row for each document, with the ids of its rows in their order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("corpus_row", "chunk_id"))), lambda x: x["chunk_id"])
    kept = rows.groupBy("document", "version").agg(F.max("checksum").alias("checksum"), F.min("corpus_row").alias("corpus_start"), F.count("*").alias("corpus_count"), ids.alias("active_chunk_ids"))
    return kept.select("document", "version", "checksum", "corpus_start", "corpus_count", "active_chunk_ids")
