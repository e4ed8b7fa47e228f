"""Ingestion: files or texts to chunks with sections and pages, by kind of source; new versions supersede old ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as T
from tidewell.models import Embedder, Tokenizer, embedding, token_windows
from tidewell.operators import chunking, cleaning, corpus

# The mark of a scanner that is dropped with its line, and what a page's summary is called.
MARKER, SUMMARY = "TLFeBOOK", "Page Summary"
STRATEGIES = ("tokens", "sentences")
#: Columns of a part of a document: pages of a PDF, blocks of an HTML page, or the whole text.
PARTS = "document string, kind string, page int, nth int, section string, text string"


def chunker(strategy: str = "tokens", size: int = chunking.TOKENS, overlap: int = chunking.OVERLAP, tokenizer: Callable[[], Tokenizer] | None = None) -> Callable[[Column], Column]:
    """The strategy by its name, as a function from a text to its chunks."""
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy must be one of {STRATEGIES}")
    windows = (lambda c: token_windows(c, tokenizer, size, overlap)) if tokenizer else (lambda c: chunking.windows(chunking.words(c), size, overlap))
    if strategy == "tokens":
        return windows
    if tokenizer:
        raise ValueError("packs of sentences are cut by words; a tokenizer needs the strategy of tokens")
    return lambda c: F.flatten(F.transform(chunking.packed_sentences(c, 4 * size), windows))


def page_summaries(pages: DataFrame, most: int = 3) -> DataFrame:
    """(file, page, section, text) of a chunk that sums a cleaned page up; pages without a long sentence have none."""
    found = pages.withColumn("summary", T.summary("text", most)).where("summary <> ''")
    text = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" summary: "), F.col("summary"))
    return found.select("file", "page", F.lit(SUMMARY).alias("section"), text.alias("text"))


def blocks(parts: DataFrame) -> DataFrame:
    """(document, kind, page, block, section, text, cut) of ``parts``: what is chunked, and whether it is cut at all.

    Pages of a PDF lose repeated lines and are parted at headings, with their
    summary first; blocks of HTML keep their sections; anything else is one text.
    """
    pdf = parts.where("kind = 'pdf'")
    pages = cleaning.clean_pages(pdf.select(F.col("document").alias("file"), "page", T.normalize("text").alias("text")), marker=MARKER).where("text <> ''")
    sections = cleaning.page_blocks(pages).select("file", F.col("page").cast("int").alias("page"), (F.col("block") + 1).alias("block"), "section", "text", F.lit(True).alias("cut"))
    summaries = page_summaries(pages).select("file", F.col("page").cast("int").alias("page"), F.lit(0).alias("block"), "section", "text", F.lit(False).alias("cut"))
    paged = sections.unionByName(summaries).select(F.col("file").alias("document"), F.lit("pdf").alias("kind"), "page", "block", "section", "text", "cut")
    part = F.nullif(T.strip(F.coalesce("section", F.lit(""))), F.lit(""))
    html = parts.where("kind = 'html'").select("document", "kind", F.lit(None).cast("int").alias("page"), F.col("nth").alias("block"), part.alias("section"), "text", F.lit(True).alias("cut"))
    rest = parts.where("kind is null or kind not in ('pdf', 'html')")
    whole = rest.select("document", "kind", F.lit(None).cast("int").alias("page"), F.col("nth").alias("block"), F.lit(None).cast("string").alias("section"), T.normalize("text").alias("text"), F.lit(True).alias("cut"))
    return paged.unionByName(html).unionByName(whole)


def chunks(parts: DataFrame, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """(document, chunk_index, page_start, page_end, section, text) of ``parts``, in the order of page, block and chunk.

    Blank chunks are left out before they are numbered, so numbers have no gaps.
    """
    cut = cut or chunker()
    listed = F.when(F.col("cut"), cut(F.col("text"))).otherwise(F.array("text"))
    found = blocks(parts).select("document", "page", "block", "section", F.posexplode(listed).alias("part", "text")).where(T.strip(F.col("text")) != "")
    order = Window.partitionBy("document").orderBy(F.asc_nulls_first("page"), "block", "part")
    return found.select("document", (F.row_number().over(order) - 1).cast("int").alias("chunk_index"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "section", "text")


def document_key(owner: Column, filename: Column, title: Column, kind: Column) -> Column:
    """A UUID by what a document is found again: its owner and its filename, or its title and kind where it has none."""
    name = F.nullif(F.trim(filename), F.lit(""))
    key = F.when(name.isNotNull(), F.concat_ws("\x1f", F.lit("file"), name)).otherwise(F.concat_ws("\x1f", F.lit("text"), T.title_or(title, filename), kind))
    h = F.md5(F.concat_ws("\x1f", owner.cast("string"), key))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def upload_status(filename: Column, length: Column, most_mb: int = 20) -> Column:
    """413 for a file that is too large, 400 for one of an unknown kind, else 200."""
    return F.when(length > most_mb << 20, 413).when(T.source_type(F.trim(filename)).isNull(), 400).otherwise(200)


def versioned(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` (document, text, ...) with its checksum, status (insert, bump or skip) and version."""
    known = arriving.withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    state = corpus.changes(stored, known.select("document", "checksum").distinct())
    return known.join(state, ["document", "checksum"])


def upsert(chunks_stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks without those of documents that ``fresh`` has, and the fresh ones."""
    return chunks_stored.join(fresh.select("document").distinct(), "document", "left_anti").unionByName(fresh, allowMissingColumns=True)


def described(fresh: DataFrame, documents: DataFrame, make: Callable[[], Embedder], dim: int | None = None) -> DataFrame:
    """Chunks with their document's version, checksum, title, filename and kind, their ids and embeddings."""
    about = documents.select("document", "version", "checksum", "owner_id", "title", "filename", F.col("kind").alias("source_type"), "ingested_at")
    joined = fresh.join(about, "document")
    return joined.withColumn("chunk_id", T.chunk_id(F.col("document"), F.col("version"), F.col("chunk_index"))).withColumn("embedding", embedding(F.col("text"), make, dim=dim))
