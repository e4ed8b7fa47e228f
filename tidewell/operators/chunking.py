"""Chunks of texts: windows of tokens, or sentences packed up to a size and then cut into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import sentences, strip

TOKENS, OVERLAP = 450, 80


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and under the size of a chunk")


def windows(tokens: Column, size: int = TOKENS, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` tokens, each ``overlap`` into the one before; the last ends with the text."""
    _check(size, overlap)
    step = size - overlap
    n = F.when(F.size(tokens) <= size, F.least(F.size(tokens), F.lit(1))).otherwise(F.ceil((F.size(tokens) - size) / F.lit(step)).cast("int") + 1)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), " "))


def words(text: Column) -> Column:
    """The tokens used where no tokenizer is given: runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def chunk_tokens(docs: DataFrame, size: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, text) for every window of every text."""
    tokens = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.posexplode(windows(F.col("tokens"), size, overlap)).alias("chunk_index", "text"))


def packed_sentences(text: Column, most: int) -> Column:
    """Neighbouring sentences joined while they stay within ``most`` characters."""
    found = F.filter(F.transform(sentences(text), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) + 1 <= most
        empty = acc["now"] == ""
        now = F.when(empty, s).when(fits, F.concat(acc["now"], F.lit(" "), s)).otherwise(s)
        done = F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(found, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def chunk_sentences(docs: DataFrame, size: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """As ``chunk_tokens``, over packs of sentences of at most four characters for each token."""
    _check(size, overlap)
    chunks = F.flatten(F.transform(packed_sentences(F.col("text"), 4 * size), lambda pack: windows(words(pack), size, overlap)))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))
