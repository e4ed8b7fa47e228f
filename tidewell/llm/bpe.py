"""BPE encoding and decoding (operator 6) with a byte-level vocabulary file of the tokenizers library.

A text beyond a leaf is encoded by tree concatenation, whatever it holds: its
halves are encoded on their own, the upper ones in parallel, and the text around
the join is encoded again, in a window that grows to both sides until it ends at
places where the vocabulary's pattern parts the text for certain, in the half as
in the whole. There both sides agree, so the tokens beyond the window are those
of the whole text. Where the window is one piece that the pattern doesn't part,
and may be as long as the text, bytes are merged in windows of tokens that grow
until their first and last token agree with what either half had; byte-pair
merging is decided by adjacent tokens, so this too is exact.

The vocabulary file is read once, on the driver, and sent to the executors. A
file with settings that aren't handled here (a normalizer, another pattern or
decoder, dropout, added tokens with flags) is refused.

Defined cases: a null text counts as empty and has no tokens. Special tokens in
a text are encoded as such. Ids that are no UTF-8 together decode with U+FFFD.
Very long texts are encoded whole; repeated rows and rows with a null doc_id have
a result each; an empty table gives no rows; columns beyond doc_id and text are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.textvec import pieces
from tidewell.storage import bound_batches

#: Characters that are encoded in one go, and from which halves are encoded in parallel.
LEAF, PARALLEL = 2048, 1 << 16

#: The pattern of byte-level pre-tokenization, a fixed value of such vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Between these characters every text is parted, whatever is beside them: no piece has white space after anything
#: else, and runs of letters or digits end with them.
CERTAIN = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"

#: Settings of a vocabulary file that are handled.
HANDLED = {
    "normalizer": [None], "pre_tokenizer.type": ["ByteLevel"], "pre_tokenizer.add_prefix_space": [False], "pre_tokenizer.use_regex": [True, None], "decoder.type": ["ByteLevel"],
    "model.type": ["BPE", None], "model.dropout": [None, 0.0], "model.unk_token": [None], "model.continuing_subword_prefix": [None, ""], "model.end_of_word_suffix": [None, ""],
    "model.byte_fallback": [False, None], "model.ignore_merges": [False, None],
}
FLAGS = ("single_word", "lstrip", "rstrip", "normalized")


def check(spec: dict) -> None:
    """Raise ValueError for a vocabulary whose settings would give other ids than ``Codec`` does."""
    for name, values in HANDLED.items():
        found = spec
        for part in name.split("."):
            found = (found or {}).get(part)
        if found not in values:
            raise ValueError(f"{name} of this vocabulary is {found!r}, which isn't handled")
    for token in spec["added_tokens"]:
        if any(token.get(flag) for flag in FLAGS):
            raise ValueError(f"the added token {token['content']!r} has flags that aren't handled")


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with a vocabulary file of this content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        check(spec)
        byte_of = _alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError("the ids of this vocabulary don't follow the order of its merges")
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._piece, self._certain = regex.compile(PATTERN), regex.compile(CERTAIN)

    def _leaf(self, data: bytes) -> list[int]:
        return self.core._core_bpe.encode_single_piece(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring byte strings, made those of the whole."""
        if not left or not right:
            return left or right
        reach = 4
        while True:
            a, b = min(reach, len(left)), min(reach, len(right))
            window = self._leaf(b"".join([self.bytes_of[i] for i in [*left[-a:], *right[:b]]]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return [*left[:-a], *window, *right[b:]]
            reach *= 2

    def _parted(self, text: str, low: int, high: int, last: bool) -> int | None:
        """The last or first place between ``low`` and ``high`` where the text is parted for certain."""
        places = (m.start() for m in self._certain.finditer(text, max(low - 1, 0), high + 1))
        found = [x for x in places if low < x < high]
        return (found[-1] if last else found[0]) if found else None

    def _window(self, text: str, low: int, middle: int, high: int) -> tuple[int, int]:
        """The smallest span around ``middle`` that ends where both the half and the whole are parted, or with the text."""
        start = end = None
        reach = 64
        while start is None:
            start = self._parted(text, max(low, middle - reach), middle, True)
            if start is None and middle - reach <= low:
                start = low
            reach *= 4
        reach = 64
        while end is None:
            end = self._parted(text, middle, min(high, middle + reach), False)
            if end is None and middle + reach >= high:
                end = high
            reach *= 4
        return start, end

    def _tokens(self, ids: list[int], size: int, last: bool) -> int:
        """How many tokens at an end of ``ids`` make ``size`` bytes."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n if last else n - 1]])
        return n

    def _halves(self, text: str, low: int, high: int, pool: ThreadPoolExecutor | None) -> list[int]:
        if high - low <= LEAF:
            return self.core._core_bpe.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        if pool is not None and high - low <= PARALLEL:
            pool = None
        if pool is not None:
            coming = pool.submit(self._halves, text, low, middle, None)
            right, left = self._halves(text, middle, high, pool), coming.result()
        else:
            left, right = self._halves(text, low, middle, None), self._halves(text, middle, high, None)
        start, end = self._window(text, low, middle, high)
        a = self._tokens(left, len(text[start:middle].encode()), True)
        b = self._tokens(right, len(text[middle:end].encode()), False)
        whole = self._piece.match(text, start, end)
        if end - start > LEAF and whole.end() == end and all(self._piece.match(text, x, y).end() == y for x, y in ((start, middle), (middle, end))):
            inside = self.join(left[len(left) - a :], right[:b])
        else:
            inside = self.core._core_bpe.encode_ordinary(text[start:end])
        return left[: len(left) - a] + inside + right[b:]

    def tree(self, text: str) -> list[int]:
        """Tokens of a text without special tokens, by halves."""
        if len(text) <= LEAF:
            return self.core._core_bpe.encode_ordinary(text)
        if len(text) <= PARALLEL:
            return self._halves(text, 0, len(text), None)
        with ThreadPoolExecutor(2) as pool:
            return self._halves(text, 0, len(text), pool)

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self._specials is None or not any(s in text for s in self.special):
            return self.tree(text)
        out: list[int] = []
        at = 0
        for found in self._specials.finditer(text):
            out += self.tree(text[at : found.start()])
            out.append(self.special[found.group()])
            at = found.end()
        return out + self.tree(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(content: str) -> Codec:
    return Codec(content)


def _sent(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB) for all executors, which may not have it."""
    bound_batches(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _round_trip(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary.value)
        for batch in pieces(batches):
            counts, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                ids = code.encode(text.as_py())
                counts.append(len(ids))
                ids_hash.append(sha256(",".join([code.digits[i] for i in ids]).encode()).hexdigest())
                text_hash.append(sha256(code.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _counts(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(code.encode(t.as_py())) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def _texts(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ids(_sent(docs.sparkSession, path)), "doc_id bigint, ids array<int>")


def counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens): how many ids ``encode`` gives for every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counts(_sent(docs.sparkSession, path)), "doc_id bigint, n_tokens bigint")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of ``tokens`` (doc_id, ids)."""
    return tokens.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(_texts(_sent(tokens.sparkSession, path)), "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number and SHA-256 of each document's ids, and SHA-256 of what they decode to."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_round_trip(_sent(docs.sparkSession, path)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
