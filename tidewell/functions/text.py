"""Text functions as Spark column expressions; Python only where Spark has no counterpart.

A null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark SQL lacks."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize(c: Column | str, compose: bool = True) -> Column:
    """NUL out, NFKC, words joined over a hyphen at a line's end, line ends and blanks unified."""
    x = F.regexp_replace(_text(c), "\x00", "")
    if compose:
        x = nfkc(x)
    x = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def sanitize(c: Column | str) -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(_text(c), CONTROL, "")


def page_text(c: Column | str) -> Column:
    """A page of an extracted file: no control characters, unified line ends and blanks."""
    x = F.regexp_replace(sanitize(c), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def terms(c: Column | str) -> Column:
    """Search terms: runs of a-z, 0-9 and _ in lower case, in order, repeats included."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9_]+"), F.lit(0))


def sentences(c: Column | str) -> Column:
    return F.split(strip(_text(c)), r"(?<=[.!?])\s+")


def summary(c: Column | str, most: int = 3, longer_than: int = 30) -> Column:
    """The first few sentences of some length."""
    kept = F.filter(F.transform(sentences(c), strip), lambda s: F.length(s) > longer_than)
    return F.array_join(F.slice(kept, 1, most), " ")


def citation(source_type: Column, filename: Column, title: Column, first: Column, last: Column, section: Column) -> Column:
    """What a passage is cited as: pages for a PDF, the section for anything else."""
    name = F.coalesce(F.nullif(F.trim(filename), F.lit("")), F.nullif(F.trim(title), F.lit("")), F.lit("source"))
    pages = F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(F.lit(" p. "), first.cast("string"), F.lit("–"), last.cast("string"))).when(first.isNotNull(), F.concat(F.lit(" p. "), first.cast("string"))).otherwise("")
    part = F.nullif(F.trim(section), F.lit(""))
    return F.when(F.lower(source_type) == "pdf", F.concat(name, pages)).otherwise(F.when(part.isNotNull(), F.concat(name, F.lit(" > "), part)).otherwise(name))


def citation_parts(c: Column) -> Column:
    """Document, version and index from ``doc:vN:i`` or ``doc:i``; null where any is malformed."""
    parts = F.split(c, ":")
    doc, index = parts[0], F.element_at(parts, -1)
    mark = F.when(F.size(parts) >= 3, F.element_at(parts, -2))
    version = F.when(mark.rlike("^v[0-9]+$"), F.substring(mark, 2, 18).cast("int"))
    good = (F.size(parts) >= 2) & doc.rlike("^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$") & index.rlike("^[0-9]{1,9}$")
    return F.when(good, F.struct(doc.alias("document_id"), version.alias("version"), F.when(good, index).cast("int").alias("chunk_index")))


def chunk_id(doc: Column, version: Column, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(":v"), version.cast("string"), F.lit(":"), index.cast("string"))


def title_or(title: Column, filename: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.trim(title), blank), F.nullif(F.trim(filename), blank), F.lit("untitled"))


def source_type(filename: Column) -> Column:
    """Kind of file by its ending; null for those that aren't taken."""
    name = F.lower(filename)
    out = F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".docx"), "docx")
    out = out.when(name.endswith(".html") | name.endswith(".htm"), "html")
    return out.when(name.endswith(".txt") | name.endswith(".md"), "txt")


def rewrites(response: Column, question: Column, most: int = 3) -> Column:
    """Query variants from a JSON list; the question itself where there is none."""
    listed = F.when(F.trim(response).startswith("["), F.from_json(response, "array<string>"))
    good = F.filter(F.transform(listed, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.when(F.size(good) > 0, F.slice(good, 1, most)).otherwise(F.array(question))


def caller(user: Column, forwarded: Column, host: Column) -> Column:
    """Whom a request counts for: the user, else the first forwarded address, else the host."""
    blank = F.lit("")
    first = F.nullif(F.trim(F.split(F.coalesce(forwarded, blank), ",")[0]), blank)
    return F.coalesce(F.concat(F.lit("user:"), F.nullif(user, blank)), F.concat(F.lit("ip:"), F.coalesce(first, F.nullif(host, blank), F.lit("unknown"))))


def prompt(question: Column, contexts: Column) -> Column:
    """Numberless prompt: each context under its citation, in order, then the question."""
    blocks = F.transform(contexts, lambda x: F.concat(F.lit("["), x["citation"], F.lit("]\n"), x["text"]))
    return F.concat(F.lit("Answer from the sources below and cite them.\n\nSources:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), F.trim(question))
