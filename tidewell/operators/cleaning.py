"""Cleaning of extracted pages: lines that repeat over a file's pages, and sections within a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import page_text, strip
from tidewell.storage import broadcast_if_small, materialize

RATIO, LONGEST = 0.35, 80


def page_lines(pages: DataFrame) -> DataFrame:
    """(file, page, pos, line) of ``pages`` (file, page, text), each line stripped."""
    lines = pages.select("file", "page", F.posexplode(F.split(page_text("text"), "\n")).alias("pos", "line"))
    return lines.withColumn("line", strip(F.col("line")))


def repeated_lines(pages: DataFrame, ratio: float = RATIO, longest: int = LONGEST) -> DataFrame:
    """(file, line, n): short lines that occur at least max(2, ratio * pages) times in a file, every occurrence counted."""
    counts = page_lines(pages).where((F.col("line") != "") & (F.length("line") <= longest)).groupBy("file", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy("file").agg(F.countDistinct("page").alias("pages"))
    return counts.join(size, "file").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio))).select("file", "line", "n")


def clean_pages(pages: DataFrame, ratio: float = RATIO, marker: str | None = None) -> DataFrame:
    """(file, page, text) without blank lines, repeated lines and lines that hold ``marker``.

    A file's repeated lines are few: no more than three of its pages hold. They
    meet the pages as one list, so lines aren't shuffled again.
    """
    few = repeated_lines(pages, ratio).groupBy("file").agg(F.collect_list("line").alias("repeated"))
    few = materialize(few, "repeated-lines")
    held = F.aggregate("repeated", F.lit(64), lambda n, x: n + F.octet_length(x))
    lines = F.transform(F.split(page_text("text"), "\n"), strip)
    met = pages.select("file", "page", lines.alias("lines")).join(broadcast_if_small(few, held), "file", "left")
    again = F.coalesce("repeated", F.array().cast("array<string>"))
    kept = F.filter("lines", lambda x: (x != "") & ~F.array_contains(again, x) & (F.lit(True) if marker is None else ~x.contains(marker)))
    return met.select("file", "page", F.array_join(kept, "\n").alias("text"))


_HEADING = re.compile(r"[A-Z0-9][A-Z0-9 \-,:;()]{6,}\Z")


def split_sections(text: str | None) -> list[tuple[str | None, str]]:
    """(section, text) of each paragraph; a first line in capitals names the section from there on."""
    out: list[tuple[str | None, str]] = []
    section: str | None = None
    for paragraph in re.split(r"\n(?:[^\S\n]*\n)+", text or ""):
        lines = [x for x in (line.strip() for line in paragraph.split("\n")) if x]
        if lines and len(lines[0]) <= 80 and _HEADING.match(lines[0]):
            section = lines.pop(0).title()
        if lines:
            out.append((section, "\n".join(lines)))
    return out


def page_blocks(pages: DataFrame) -> DataFrame:
    """(file, page, block, section, text) for every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, p, i, s, t) for f, p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (s, t) in enumerate(split_sections(text))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "page", "block", "section", "text"])

    return pages.select(F.col("file").cast("string"), F.col("page").cast("long"), page_text("text").alias("text")).mapInArrow(run, "file string, page bigint, block int, section string, text string")
