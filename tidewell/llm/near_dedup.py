"""MinHash near-dedup (operator 2): components of documents whose sets of word shingles are alike.

One permutation gives a document's whole signature: the range of shingle hashes
is cut into bins, each bin keeps its smallest hash, and an empty bin borrows
from the bin that a universal hash sequence reaches first (optimal
densification). Bands of bins are the buckets.

Documents with equal sets collapse to one before that, so groups of copies cost
a row. In every bucket the smallest document is the centre of a star, and only
the edges of the star are candidates: their number is at most that of bucket
entries. Where a bucket's documents still lie in several components, those
outside its largest component are held against all others of the bucket. One
rule holds for buckets of any size: whole sets are compared, and only sizes
that rule a link out spare a comparison. Small buckets list such pairs, at most
``SMALL`` for a document; large ones are cut into blocks, and whole sets of two
blocks are compared at once, which gives only links. So no star hides a link
between two of its leaves, no bucket is capped, and no group's pairs are listed.

Within a comparison words are told apart by their bytes and shingles by their
words, so a link rests on no hash. Elsewhere a word is known by 128 bits of xxh3,
and a set by 128 bits of its shingles'.

Defined cases: a text without words has an empty set and is linked with
nothing; with fewer words than a shingle, the whole sequence is the one
shingle; equal sets are always linked; rows that repeat a doc_id and its text
are one document. Rows with a null doc_id are left out of the graph and come
back with a null component. Very long texts are read whole, in slices of words;
an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components, joined
from tidewell.llm.textvec import coded, mix, names, numbered, pieces, sets, shingles
from tidewell.storage import bound_batches, broadcast_if_small, discard, join_often, materialize, often, scope

BINS = 128
#: 32 bands of 4 bins: a pair at 0.8 shares no bucket with a probability of 5e-8.
BAND = 4
#: Documents of a large bucket that are compared at a time, and the most in a small one.
BLOCK, SMALL = 256, 32
#: Bytes of text that make a block of a large bucket, where long texts come to that sooner.
BLOCK_BYTES = 4 << 20
#: Set members that are compared at a time.
CELLS = 30_000


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    return np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """The densified one-permutation signature of each non-empty set of well-mixed hashes."""
    out = np.zeros((len(found), BINS), dtype=np.uint64)
    full = np.zeros((len(found), BINS), dtype=bool)
    for i, own in enumerate(found):
        at = np.searchsorted(own, _edges())
        full[i] = at < np.append(at[1:], len(own))
        out[i, full[i]] = own[at[full[i]]]
    rows, bins = (~full).nonzero()
    step = 0
    while len(rows):
        step += 1
        lender = (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) >> np.uint64(57)).astype(np.int64)
        hit = full[rows, lender]
        out[rows[hit], bins[hit]] = out[rows[hit], lender[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def named_sets(column: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, by the two halves of their names."""
    rows, codes, distinct = coded(column)
    lanes = names(distinct)
    of, first = shingles(rows, lanes[codes, 0], size)
    _, second = shingles(rows, lanes[codes, 1], size, 1)
    order = np.lexsort((second, first, of))
    of, first, second = of[order], first[order], second[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    of, first, second = of[new], first[new], second[new]
    at = np.searchsorted(of, np.arange(len(column) + 1))
    return [(first[a:b], second[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            found = named_sets(batch.column(1), size)
            some = [i for i in range(n) if len(found[i][0])]
            signs = signatures([found[i][0] for i in some])
            banded = np.zeros((len(some), BINS // BAND), dtype=np.uint64) + np.arange(BINS // BAND, dtype=np.uint64)
            for k in range(BAND):
                banded = mix(banded * np.uint64(0xA0761D6478BD642F) + signs[:, k::BAND])
            keys: list = [None] * n
            bands: list = [None] * n
            for j, i in enumerate(some):
                keys[i] = xxhash.xxh3_128_digest(found[i][0].tobytes() + found[i][1].tobytes())
                bands[i] = banded[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x, _ in found], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def exact_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The shingles of each text as numbers that are equal, among these texts, only for equal words."""
    return list(sets(*numbered(*coded(texts)[:2], size), len(texts)))


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = exact_sets(pa.concat_arrays([part.column(2), part.column(3)]), size)
            good = []
            for a, b in zip(found[: part.num_rows], found[part.num_rows :], strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
                good.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def texts_of(docs: DataFrame, ids: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with the given ids, one for each. ``like``: the table that the ids are from."""
    ids = materialize(ids, "ids", (like,))
    found = docs.join(broadcast_if_small(ids, 16), docs["doc_id"] == ids["id"], "left_semi")
    return materialize(found.dropDuplicates(["doc_id"]), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are alike: 100 * intersection >= percent * union."""
    texts = texts_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), pairs)
    centres = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = join_often(right, centres, "a", often(pairs, "a"), F.octet_length("text_a") + 16).select("a", "b", "text_a", "text_b")
    out = materialize(full.mapInArrow(_confirm(size, percent), "a bigint, b bigint"), "confirmed")
    discard(texts)
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096):
        flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BINS // BAND)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat)], names=["id", "bucket"])


def _across(percent: int):
    """Pairs within a small bucket that lie in different components and whose sizes allow a link.

    A pair that meets in several buckets comes from the first of them alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for row in batch.to_pylist():
                side = sorted(row["members"], key=lambda m: m["id"])
                ids, parts, sizes = (np.array([m[x] for m in side]) for x in ("id", "component", "n_shingles"))
                bands = np.frombuffer(b"".join(m["bands"] for m in side), dtype=np.int64).reshape(len(side), -1)
                for i in range(len(ids) - 1):
                    near = (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])) & (parts[i + 1 :] != parts[i])
                    near = near.nonzero()[0] + i + 1
                    if len(near):
                        near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == row["bucket"]]
                    xs.append(np.full(len(near), ids[i]))
                    ys.append(ids[near])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs), pa.int64()), pa.array(np.concatenate(ys), pa.int64())], names=["a", "b"])

    return run


def _parts(found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Neighbouring sets with at most ``CELLS`` members together, or one alone."""
    at = 0
    while at < len(found):
        end, size = at + 1, len(found[at])
        while end < len(found) and size + len(found[end]) <= CELLS:
            size += len(found[end])
            end += 1
        yield at, end
        at = end


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for a, b in _parts(left):
        for c, d in _parts(right):
            sides = []
            for found in (left[a:b], right[c:d]):
                flat = np.concatenate(found)
                sides.append((flat, np.repeat(np.arange(len(found)), [len(x) for x in found])))
            common = np.intersect1d(sides[0][0], sides[1][0])
            grids = []
            for (flat, owner), n in zip(sides, (b - a, d - c), strict=True):
                at = np.searchsorted(common, flat)
                hit = at < len(common)
                hit[hit] = common[at[hit]] == flat[hit]
                grid = np.zeros((n, len(common)), dtype=np.float32)
                grid[owner[hit], at[hit]] = 1
                grids.append(grid)
            out[a:b, c:d] = np.rint(grids[0] @ grids[1].T)
    return out


def _between_blocks(size: int, percent: int):
    """Links of two blocks of a bucket: for each document of the first, one to each other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for row in batch.to_pylist():
                sides = []
                whole = exact_sets(pa.array([m["text"] for side in ("small", "block") for m in row[side]], pa.string()), size)
                for side, found in ((row["small"], whole[: len(row["small"])]), (row["block"], whole[len(row["small"]) :])):
                    sides.append((np.array([m["id"] for m in side]), np.array([m["component"] for m in side]), found, np.array([len(x) for x in found])))
                (ids, parts, found, sizes), (others, other_parts, other_found, other_sizes) = sides
                common = overlaps(found, other_found)
                linked = 100 * common >= percent * (sizes[:, None] + other_sizes - common)
                linked &= parts[:, None] != other_parts
                for i in linked.any(axis=1).nonzero()[0]:
                    y = linked[i].nonzero()[0]
                    y = y[np.unique(other_parts[y], return_index=True)[1]]
                    xs.append(np.full(len(y), ids[i]))
                    ys.append(others[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs), pa.int64()), pa.array(np.concatenate(ys), pa.int64())], names=["a", "b"])

    return run


def _left_over(entries: DataFrame, reps: DataFrame, labels: DataFrame, tried: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that share a bucket. entries: (bucket, id) of buckets with several documents."""
    placed = entries.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("held"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", -F.col("component"))).alias("largest"), F.sum("n").alias("total"), F.sum("held").alias("held"), F.count("*").alias("kinds")).where("kinds > 1 and total > 2")
    split = split.select("bucket", (-F.col("largest.col2")).alias("main"), "total", "held", (F.col("total") > SMALL).alias("big"))
    # Of large buckets that hold the same documents one will do.
    split = split.groupBy("big", "total", "held", "main", F.when(~F.col("big"), F.col("bucket")).alias("own")).agg(F.min("bucket").alias("bucket"))
    split = materialize(split.select("bucket", "main", "big", "total"), "split-buckets")
    members = materialize(join_often(placed, split, "bucket", often(split, "bucket", "total"), 48), "split-members")

    few = members.where("not big").join(reps.select("id", "n_shingles", "bands"), "id")
    few = few.groupBy("bucket").agg(F.collect_list(F.struct("id", "component", "n_shingles", "bands")).alias("members"))
    pairs = few.mapInArrow(_across(percent), "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti")
    found = confirmed(materialize(pairs, "pairs"), docs, size, percent)

    many = members.where("big")
    if many.isEmpty():
        return found
    texts = texts_of(docs, many.select("id").distinct(), members).withColumnRenamed("doc_id", "id")
    sizes = many.join(texts.select("id", F.octet_length("text").cast("long").alias("bytes")), "id").groupBy("bucket")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks"))
    sizes = materialize(sizes.withColumn("grid", F.ceil(F.sqrt("blocks")).cast("int")), "block-counts")
    many = many.join(broadcast_if_small(sizes, 16), "bucket").join(texts, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = F.struct("id", "component", "text")
    blocks = many.groupBy("bucket", "part", "grid").agg(F.collect_list(member).alias("block"))
    small = many.where("component <> main").groupBy("bucket", "part", "grid").agg(F.collect_list(member).alias("small"))
    # Pairs of blocks are dealt to a square of cells, so that no bucket's pairs meet in one task.
    every = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    small = small.select("bucket", (F.col("part") % F.col("grid")).alias("down"), every.alias("across"), "small")
    blocks = blocks.select("bucket", every.alias("down"), (F.col("part") % F.col("grid")).alias("across"), "block")
    met = small.join(blocks, ["bucket", "down", "across"]).select("small", "block")
    return found.unionByName(materialize(met.mapInArrow(_between_blocks(size, percent), "a bigint, b bigint"), "links-between"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scope() as keep:
        described = materialize(docs.mapInArrow(_describe(size), "doc_id bigint, n_shingles bigint, set_key binary, bands binary"), "signatures")
        reps = described.where("set_key is not null and doc_id is not null").groupBy("set_key")
        reps = reps.agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
        reps = materialize(reps, "representatives")
        entries = materialize(reps.select("id", "bands").mapInArrow(_entries, "id bigint, bucket bigint"), "all-entries")
        centres = entries.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
        centres = materialize(centres, "centres", (entries,))
        shared = materialize(join_often(entries, centres, "bucket", often(centres, "bucket", "n"), 40).select("bucket", "id", "centre"), "entries")
        pairs = materialize(shared.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs", (shared,))
        links = confirmed(pairs, docs, size, percent)
        labels = components(links)
        more = _left_over(shared.select("bucket", "id"), reps, labels, pairs, docs, size, percent)
        if not more.isEmpty():
            labels = joined(labels, more)
        classes = reps.join(labels, reps["id"] == labels["node"], "left").select(F.col("set_key").alias("of"), F.coalesce("component", "id").alias("component_id"))
        known = described.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", F.col("set_key").alias("of"))
        out = join_often(known, classes, "of", often(reps.select(F.col("set_key").alias("of"), "copies"), "of", "copies"), 48).select("doc_id", "n_shingles", "component_id")
        rest = described.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return keep(materialize(out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates", (described,)))
