"""Files to text: plain text, HTML, DOCX and, with an extractor of the caller's, PDF; JSON lines and vectors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import source_type

BLOCKS = "section string, text string"


class _Outline(HTMLParser):
    """Paragraphs and list items under the headings before them, end tags implied as in HTML."""

    HEADINGS, ITEMS, SKIP = ("h1", "h2", "h3"), ("p", "li"), ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.section = "root"
        self.open: list[tuple[str, int, list[str]]] = []
        self.blocks: list[tuple[int, str, str]] = []
        self.all: list[str] = []
        self.skipped = 0
        self.starts: list[tuple[int, str]] = []
        self.number = 0

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, number, parts in reversed(self.open[i:]):
                    text = " ".join("".join(parts).split())
                    if name in self.HEADINGS:
                        self.starts.append((number, text[:200]))
                    elif text and name in self.ITEMS:
                        self.blocks.append((number, name, text))
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag in self.HEADINGS or tag in self.ITEMS or tag in ("ul", "ol", "div", "section", "article", "table"):
            if any(x[0] == "p" for x in self.open):
                self._close("p")
            if tag == "li" and next((x[0] for x in reversed(self.open) if x[0] in ("li", "ul", "ol")), "") == "li":
                self._close("li")
            if tag in self.HEADINGS or tag in self.ITEMS or tag in ("ul", "ol"):
                self.number += 1
                self.open.append((tag, self.number, []))
        for _, _, parts in self.open:
            parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.HEADINGS or tag in self.ITEMS or tag in ("ul", "ol"):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.all.append(data)
            for _, _, parts in self.open:
                parts.append(data)

    def outline(self) -> list[tuple[str, str]]:
        while self.open:
            self._close(self.open[0][0])
        events = sorted([(n, "", t) for n, t in self.starts] + self.blocks)
        out, section = [], "root"
        for _, name, text in events:
            if name:
                out.append((section, text))
            elif text:
                section = text
        whole = " ".join("".join(self.all).split())
        return out or ([("root", whole)] if whole else [])


def html_outline(page: str | None) -> list[tuple[str, str]]:
    """(section, text) of every paragraph and list item; the whole text under ``root`` if there is none."""
    parser = _Outline()
    parser.feed(page or "")
    parser.close()
    return parser.outline()


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, section, text) for ``pages`` (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, s, t) for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, (s, t) in enumerate(html_outline(page))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["page_id", "block", "section", "text"])

    return pages.select("page_id", F.col("html").cast("string")).mapInArrow(run, f"page_id bigint, block int, {BLOCKS}")


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file that aren't blank; text in tables is left out."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{name}body")
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{name}t")) for p in (body.findall(f"{name}p") if body is not None else []))
    return "\n".join(p for p in paragraphs if p.strip())


def plain_text(content: bytes) -> str:
    """UTF-8 text; bytes that aren't are dropped."""
    return content.decode("utf-8", errors="ignore")


def _no_pdf(content: bytes) -> list[str]:
    raise NotImplementedError("no PDF library is here: pass an extractor that gives the pages of a file")


def _reported(spark: SparkSession, path: str, most_mb: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("kind", source_type(F.col("path"))).withColumn("status", F.when(F.col("length") > most_mb << 20, 413).when(F.col("kind").isNull(), 400).otherwise(200))


def file_report(spark: SparkSession, path: str, most_mb: int = 20) -> DataFrame:
    """(path, kind, length, status) of every file below ``path``: 413 if it is too large, 400 if of no known kind, else 200.

    Only ``load_files`` reads contents; this reads names and sizes.
    """
    return _reported(spark, path, most_mb).select("path", "kind", "length", "status")


def load_files(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = _no_pdf, most_mb: int = 20) -> DataFrame:
    """(path, kind, page, nth, section, text) of all files below ``path`` that ``file_report`` finds good.

    ``nth`` numbers the parts of a file from 0. Texts are as they are extracted.
    """
    files = _reported(spark, path, most_mb).where("status = 200")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "html":
                    rows += [(path, kind, None, i, s, t) for i, (s, t) in enumerate(html_outline(plain_text(content)))]
                elif kind == "pdf":
                    rows += [(path, kind, i + 1, i, None, t or "") for i, t in enumerate(pdf(content))]
                else:
                    rows.append((path, kind, None, 0, None, docx_text(content) if kind == "docx" else plain_text(content)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "kind", "page", "nth", "section", "text"])

    return files.select("path", "kind", "content").mapInArrow(run, f"path string, kind string, page int, nth int, {BLOCKS}")


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(corpus_row, embedding) of a file of row-major float32 numbers without a header.

    The file is read as records of a fixed size, so its parts are read apart.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    if size % (4 * dim):
        raise IllegalArgumentException(f"{size} bytes aren't a whole number of {dim}-dimensional vectors")
    records = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    kept = spark.createDataFrame(records, "corpus_row bigint, record binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f4")
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["corpus_row", "embedding"])

    return kept.mapInArrow(run, "corpus_row bigint, embedding array<float>")


def write_vectors(df: DataFrame, path: str, dim: int) -> int:
    """Write (corpus_row, embedding) as one table of float32 bytes for each part, in the order of rows; how many rows.

    ``read_raw`` gives it back; a row of another width is an error.
    """
    raw = df.select(F.col("corpus_row").cast("long"), F.col("embedding").cast("array<float>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
            if len(flat) != batch.num_rows * dim:
                raise ValueError(f"a vector has not {dim} numbers")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat.reshape(-1, dim)], pa.binary())], names=["corpus_row", "raw"])

    raw.mapInArrow(run, "corpus_row bigint, raw binary").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def read_raw(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(corpus_row, embedding) of a table that ``write_vectors`` wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f4")
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["corpus_row", "embedding"])

    return spark.read.parquet(path).select("corpus_row", "raw").mapInArrow(run, "corpus_row bigint, embedding array<float>")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_table(df: DataFrame, path: str, owner: str | None = "owner_id", mode: str = "append") -> None:
    """Parquet, in a folder for each owner so that a query of one reads only theirs."""
    writer = df.write.mode(mode)
    (writer.partitionBy(owner) if owner and owner in df.columns else writer).parquet(path)


def latest_leaf(spark: SparkSession, root: str) -> str:
    """The deepest, then newest folder below ``root`` with chunks and vectors; an error if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "modificationTime")
    full = named.where(F.col("name").isin("docstore.jsonl", "embeddings.bin")).groupBy("folder").agg(F.countDistinct("name").alias("n"), F.max("modificationTime").alias("at")).where("n = 2")
    found = full.orderBy(F.size(F.split("folder", "/")).desc(), F.desc("at"), "folder").limit(1).collect()
    if not found:
        raise FileNotFoundError(root)
    return found[0]["folder"]
