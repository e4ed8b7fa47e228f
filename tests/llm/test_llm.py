"""The training-data operators against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, fingerprints, html_text, licenses, line_dedup, near_dedup, packing, queries, search, sharding, textvec, toxicity

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words_of(text):
    return [w for w in (text or "").translate(FOLD).translate({ord(c): " " for c in BLANK}).split(" ") if w]


def made(seed, n, vocabulary=60, longest=60):
    rng = random.Random(seed)
    names = ["w%d" % i for i in range(vocabulary)] + ["É", "ß", "漢字", "A.b"]
    out = [" ".join(rng.choice(names) for _ in range(rng.randrange(longest))) for _ in range(n)]
    return out


ODD = [None, "", " \n ", "a", "A  b", "x" * 5000, "\n\n\n"]


THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))


# Hashes


def test_words_are_told_apart_as_by_splitting(monkeypatch):
    monkeypatch.setattr(textvec, "SLICE", 37)
    texts = [*ODD, *made(1, 50), "word " * 40, "y" * 200 + " z"]
    rows, hashes = textvec.words(pa.array(texts, pa.string()))
    flat = [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    assert rows.tolist() == [i for i, _ in flat]
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), flat, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    rows, hashes = textvec.shingles(*textvec.words(pa.array(["a b c", "a", "", "a b", "A"])), 3)
    assert rows.tolist() == [0, 1, 3, 4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


# 1


def by_hand_lines(docs):
    first = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(FOLD)
            if len(key) >= 10:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(x.strip(BLANK).translate(FOLD)) < 10 or first[x.strip(BLANK).translate(FOLD)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(2)
    common = ["A line that many hold", " a line that many hold\t", "short", "", "Another line here", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü"]
    docs = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"own line number {rng.randrange(30)}" for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [docs[3], (7, "a line that many hold\nsomething else entirely")]
    given = frame(spark, docs).withColumn("line_hash", F.lit(1)).withColumn("keep", F.lit("x")).repartition(5)
    out = line_dedup.drop_repeated_lines(given)
    assert {"line_hash", "keep"} <= set(out.columns)
    assert sorted((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in out.collect()) == by_hand_lines(docs)
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_line_dedup_with_columns_of_any_name(spark):
    docs = frame(spark, [(1, "a line that is shared"), (2, "a line that is shared\nown")])
    for name in ("__keep", "__doc", "__hash", "__text_hash", "positions"):
        out = line_dedup.drop_repeated_lines(docs.withColumn(name, F.lit("x"))).collect()
        assert sorted((r.doc_id, r["__kept"], r[name]) for r in out) == [(1, "a line that is shared", "x"), (2, "own", "x")]
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(docs.withColumn("__kept", F.lit("x")))


def test_line_dedup_of_very_long_texts(spark):
    long = "\n".join(f"line number {i % 50_000} of a long text" for i in range(150_000))
    docs = [(1, long), (2, "x\n" + long), (3, "line number 7 of a long text"), (4, "y" * 6_000_000)]
    out = line_dedup.drop_repeated_lines(frame(spark, docs).repartition(2)).collect()
    assert sorted((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in out) == by_hand_lines(docs)


def test_line_held_by_every_partition(spark):
    docs = [(i, f"this line is everywhere\nline of number {i:09d}") for i in range(400)]
    bitmaps = line_dedup.keep_bitmaps(frame(spark, docs).repartition(6), partitions=16).collect()
    assert {r.doc_id for r in bitmaps} == set(range(1, 400)) and {tuple(line_dedup.unpack(r.keep, r.n_lines)) for r in bitmaps} == {(False, True)}


def test_line_marks_of_few_lines_are_written_in_few_files(spark, monkeypatch):
    from tidewell import storage

    written = {}

    def counted(df, label="table", *rest):
        out = storage.materialize(df, label, *rest)
        written[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    docs = [(i, f"this line is everywhere\nline of number {i % 90:09d}") for i in range(400)]
    bitmaps = line_dedup.keep_bitmaps(frame(spark, docs).repartition(3), partitions=64)
    assert bitmaps.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert {r.doc_id: int((~line_dedup.unpack(r.keep, r.n_lines)).sum()) for r in bitmaps.collect()} == {i: 1 + (i >= 90) for i in range(1, 400)}
    assert written["line-marks"] <= 2 * spark.sparkContext.defaultParallelism


# 2


def by_hand_components(docs, size, percent):
    found = {}
    for doc, text in docs:
        w = words_of(text)
        found[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    low = {d: d for d in found}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(found), 2):
        n = len(found[a] & found[b])
        if n and 100 * n >= percent * (len(found[a]) + len(found[b]) - n):
            low[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(s), root(d)) for d, s in found.items())


def near_copies(seed, families, members, length, edits):
    rng = random.Random(seed)
    docs = []
    for _ in range(families):
        base = [f"v{rng.randrange(10_000)}" for _ in range(length)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(length)] = f"e{rng.randrange(10_000)}"
            docs.append(" ".join(own).upper() if rng.random() < 0.1 else "  ".join(own))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    texts = near_copies(3, 12, 9, 60, 9) + made(4, 40) + ["p q r s t", "P q  r s t", "p q r s t u", "solo", "SOLO"] + ODD
    docs = list(enumerate(texts))
    out = near_dedup.near_duplicates(frame(spark, docs).withColumn("bucket", F.lit(0)).repartition(4), size=size)
    rows = out.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == by_hand_components(docs, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4096)
    docs = list(enumerate(near_copies(5, 2, 70, 80, 14)))
    out = near_dedup.near_duplicates(frame(spark, docs).repartition(4), size=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == by_hand_components(docs, 2, 80)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(near_dedup, "CELLS", 25)
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(n)] for n in (7, 9))
    assert near_dedup.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_words_with_equal_polynomials_are_not_linked(spark):
    docs = [(1, THUE_MORSE), (2, THUE_MORSE.translate(str.maketrans("ab", "ba"))), (3, THUE_MORSE.upper())]
    out = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("often", [3, 25])
def test_hubs_and_one_hot_bucket(spark, monkeypatch, often):
    from tidewell import storage

    monkeypatch.setattr(storage, "OFTEN", often)
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    texts = near_copies(23, 1, 120, 80, 20) + ["one text that has copies"] * 40 + near_copies(24, 3, 20, 30, 6) + ODD
    docs = list(enumerate(texts))
    out = near_dedup.near_duplicates(frame(spark, docs).withColumn("component", F.lit(0)).repartition(4), size=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == by_hand_components(docs, 2, 80)


def test_short_and_very_long_texts_are_compared_whole(spark):
    rng = random.Random(25)
    long = [f"l{rng.randrange(10**6)}" for _ in range(200_000)]
    near = [w if rng.random() < 0.97 else "changed" for w in long]
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100_000])), (4, "a b c d e"), (5, "a b c d"), (6, "a b c d f"), (7, "A  b c d")]
    out = near_dedup.near_duplicates(frame(spark, docs).repartition(3), size=5).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == by_hand_components(docs, 5, 80)


def test_exact_shingles_are_those_of_the_words():
    texts = [*ODD, *made(26, 30, vocabulary=9, longest=12)]
    for size in (1, 2, 3, 5):
        found = near_dedup.exact_sets(pa.array(texts, pa.string()), size)
        by_number = {}
        for t, own in zip(texts, found, strict=True):
            w = words_of(t)
            runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
            assert len(own) == len(runs) == len(near_dedup.named_sets(pa.array([t], pa.string()), size)[0][0])
            by_number[frozenset(runs)] = frozenset(own.tolist())
        assert len(set(by_number.values())) == len(by_number)
        for a, b in itertools.combinations(by_number, 2):
            assert len(a & b) == len(by_number[a] & by_number[b])


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    out = near_dedup.near_duplicates(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_a_chain_of_links_is_one_component(spark):
    from tidewell.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (500, 501)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    from tidewell import storage
    from tidewell.llm import components

    most, written = 2 * spark.sparkContext.defaultParallelism, []

    def counted(df, label="table", *rest):
        out = storage.materialize(df, label, *rest)
        written.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "materialize", counted)
    was = {key: spark.conf.get(key, None) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = storage.materialize(frame(spark, [(i, i + 1) for i in range(300)], "a long, b long"))
        assert {r.node: r.component for r in components.components(links).collect()} == {i: 0 for i in range(301)}
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert {label for label, _ in written} == {"links", "labels"} and max(n for _, n in written) <= most
    monkeypatch.setattr(storage, "FILE_BYTES", 16)
    assert storage.files(links) > most and storage.files(links, frame(spark, [])) is None


# 3


def test_best_fit():
    rng = random.Random(6)
    lengths = [rng.randrange(1, 65) for _ in range(400)]
    bins, offsets, ends = packing.best_fit(lengths, (16, 32, 64))
    held = defaultdict(list)
    for i, b in enumerate(bins):
        held[b].append((offsets[i], lengths[i]))
    for b, parts in held.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))]
        used = sum(n for _, n in parts)
        assert ends[b] == min(s for s in (16, 32, 64) if s >= used)
    assert sum(ends) <= 1.05 * sum(lengths)


def test_best_fit_chooses_as_a_plain_search_does():
    lengths = sorted((random.Random(7).randrange(1, 33) for _ in range(80)), reverse=True)
    room, wanted = [], []
    for n in lengths:
        fit = [r for r in range(len(room)) if room[r] >= n]
        if not fit:
            room.append(32)
            fit = [len(room) - 1]
        b = min(fit, key=lambda r: room[r])
        wanted.append(room[b])
        room[b] -= n
    bins, offsets, _ = packing.best_fit(lengths, (8, 16, 32))
    assert [32 - o for o in offsets] == wanted and max(bins) + 1 == len(room)


def all_packings(lengths):
    if not lengths:
        yield []
        return
    for rest in all_packings(lengths[1:]):
        yield [[lengths[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [lengths[0], *rest[i]], *rest[i + 1 :]]


def test_sizes_chosen_jointly_cost_little_more_than_the_best_of_all_packings():
    rng, sizes, ratios = random.Random(33), (512, 1024, 2048, 4096), []
    price = lambda used: packing.sequence_cost(next(s for s in sizes if s >= used))
    for _ in range(40):
        lengths = [int(2 ** rng.uniform(5, 11.5)) for _ in range(rng.randrange(1, 7))]
        best = min(sum(price(sum(b)) for b in bins) for bins in all_packings(lengths) if all(sum(b) <= sizes[-1] for b in bins))
        ratios.append(sum(map(packing.sequence_cost, packing.best_fit(lengths, sizes)[2])) / best)
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.05


def test_several_sizes_open(monkeypatch):
    rng, opened = random.Random(34), Counter()
    real = packing._opened
    monkeypatch.setattr(packing, "_opened", lambda *a: opened.update([real(*a)]) or real(*a))
    lengths = [min(8192, int(2 ** rng.gauss(8.5, 1.8)) + 1) for _ in range(2000)]
    ends = packing.best_fit(lengths)[2]
    assert len(opened) >= 4
    joint = sum(map(packing.sequence_cost, ends))
    for size in packing.SIZES:  # each length as the one that opens, where it can
        monkeypatch.setattr(packing, "_opened", lambda need, rest, n, sizes, cost: max(size, next(s for s in sizes if s >= need)))  # noqa: B023
        fixed = sum(map(packing.sequence_cost, packing.best_fit(lengths)[2]))
        assert joint <= fixed and (joint < fixed or size <= 1024)


def test_packing_keeps_every_token(spark):
    docs = [(i, t) for i, t in enumerate(ODD + made(8, 60) + ["tok " * 1000])] + [(3, "a")]
    out = packing.pack_documents(frame(spark, docs).withColumn("bin_id", F.lit(0)), sizes=(64, 128)).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(d for d, _ in docs)
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
        assert r.start == r.piece * 128 and r.bin_offset + r.n_tokens <= r.bin_size
    assert total == sum((Counter({d: len(words_of(t)) + 1}) for d, t in docs), Counter())
    used = defaultdict(set)
    for r in out:
        span = set(range(r.bin_offset, r.bin_offset + r.n_tokens))
        assert not used[r.bin_id] & span
        used[r.bin_id] |= span
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_by_the_vocabulary_cuts_texts_without_blanks(spark, tmp_path):
    rng, library = random.Random(16), Tokenizer.from_file(PATH)
    long = ["".join(rng.choice(alphabet) for _ in range(30_000)) for alphabet in ("漢字日本語文", "ABCDxyz0189+/", "ab")]
    docs = list(enumerate([*ODD, *made(17, 20), *long, "antidisestablishmentarianism " * 2000]))
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op3_best_fit_packing(spark, str(tmp_path)).collect()
    wanted = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in docs}
    assert max(wanted.values()) > packing.SIZES[-1]
    for d, n in wanted.items():
        held = sorted((r.start, r.n_tokens) for r in out if r.doc_id == d)
        assert held == [(a, min(8192, n - a)) for a in range(0, n, 8192)]
    assert all(r.bin_offset + r.n_tokens <= r.bin_size <= 8192 for r in out)


# 4


def test_sharding(spark):
    docs = [(i, t) for i, t in enumerate(ODD + made(9, 500))] + [(0, None)] * 300
    out = sharding.shard_documents(frame(spark, docs).withColumn("shard", F.lit(9)).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_slots_over_several_cuts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SORTED_ROWS", 10)
    out = sharding.shard_rows(spark.range(700).withColumnRenamed("id", "doc_id"), shards=5).collect()
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(140)) for s in range(5))


def test_communication_matrix_has_exact_margins_and_the_right_mean():
    total = np.zeros((3, 4))
    for seed in range(300):
        m = np.array(sharding.communication_matrix([10, 30, 60], [25, 25, 25, 25], seed))
        assert m.sum(axis=1).tolist() == [10, 30, 60] and m.sum(axis=0).tolist() == [25] * 4
        total += m
    assert np.abs(total / 300 - np.array([[2.5], [7.5], [15]])).max() < 0.6


def test_hypergeometric_draws_follow_their_law_at_any_size():
    rng = np.random.default_rng(4)
    for good, bad, draws in ((7, 5, 6), (1, 9, 3), (40, 3, 41)):
        drawn = Counter(sharding._hypergeometric(rng, good, bad, draws) for _ in range(4000))
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert abs(drawn[k] / 4000 - p) < 5 * math.sqrt(p * (1 - p) / 4000) + 1e-9
    assert [sharding._hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 4, 0), (4, 4, 8))] == [0, 3, 0, 4]
    big = np.array([sharding._hypergeometric(rng, 10**12, 39 * 10**12, 10**7) for _ in range(400)])
    assert abs(big.mean() - 250_000) < 5 * 494 / 20 and 0.85 < big.std() / 493.7 < 1.15


def test_sharding_of_null_ids_and_long_texts(spark):
    docs = [(None, "a"), (None, None), (1, "é" * 3_000_000), (1, "é" * 3_000_000)]
    out = sharding.shard_documents(frame(spark, docs).withColumn("__part", F.lit(1)), shards=3).collect()
    assert Counter((r.doc_id, r.size) for r in out) == {(None, 17): 1, (None, 16): 1, (1, 6_000_016): 2}
    assert sorted(Counter(r.shard for r in out).values()) == [1, 1, 2]


# 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><p>Slogan of the site for all to see.</p></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><main><article class="post">
<h1>The &amp; title</h1><p>First   paragraph, with a <a href="x">link</a> &lt;and&gt; more.<div class="ad">Buy this great thing now, today.</div><p>Short.<ul><li>one<li>two</ul>
<form><input><p>Your mail address</p><button>Send</button></form><aside>By the way, there is more.</aside><p>The end of the text.</p></article>
<section id="comments"><article class="comment"><p>I think that this is a very good article indeed, and I have read it three times over by now, thank you so much.</p></article></section></main>
<div class="sidebar"><p>The most read pieces of this week.</p></div><footer><p>&copy; 2024, all rights reserved.</p></footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The & title\nFirst paragraph, with a link <and> more.\nShort.\none\ntwo\nThe end of the text."


TALE = "".join(f"<p>The river went down to the sea, and nobody knew why it did so in year {i}.</p>" for i in range(6))
SAID = '<div class="comments">' + "".join(f'<div class="comment"><p>I think that this is a very good tale, and I have read it {i} times by now.</p></div>' for i in range(30)) + "</div>"


@pytest.mark.parametrize("said", ["", SAID])
@pytest.mark.parametrize("start", ["<div class='layout has-sidebar'>", "<div class=no-sidebar>", "<div class='share-enabled'>", "<div id='search-results'>", "<div class='entry discussion'>", "<article class='post comments-open'>", "<article class=discussion>"])
def test_a_wrapper_named_for_something_else_keeps_its_article(start, said):
    page = f"<body><nav><a href=x>Home</a></nav><div class='sidebar'><p>The most read pieces of this week are here for you.</p></div>{start}<h1>The tale</h1>{TALE}<form><p>Your mail address, please.</p></form></{start[1:].split()[0]}>{said}</body>"
    lines = html_text.main_text(page).split("\n")
    assert lines == ["The tale", *(f"The river went down to the sea, and nobody knew why it did so in year {i}." for i in range(6))]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- x", "<script>a", "&#xZZ;", "<p>" * 3000, "<div><a href='" * 50])
def test_broken_pages_have_a_result(page):
    assert isinstance(html_text.main_text(page), str)


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(10)
    for _ in range(60):
        n = rng.randrange(1, 9)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        ties = [(a, b, rng.randrange(6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda x: sum(max(g, 0) if not on else max(-g, 0) for g, on in zip(gain, x, strict=True)) + sum(w for a, b, w in ties if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_text.minimum_cut(gain, ties)) == min(cost(x) for x in itertools.product((True, False), repeat=n))


PROSE_PARTS = "".join(f"<p>The valley lay under snow for the whole of that long winter, and the people of the town stayed at home in year {i}.</p>" for i in range(3))
PROSE_LINES = [f"The valley lay under snow for the whole of that long winter, and the people of the town stayed at home in year {i}." for i in range(3)]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<body><form action=x><div><h1>Title of it</h1>{PROSE_PARTS}</div></form></body>", ["Title of it", *PROSE_LINES]),
        (f"<body><div class='layout has-sidebar'><h1>Title of it</h1>{PROSE_PARTS}</div></body>", ["Title of it", *PROSE_LINES]),
        (f"<article><h1>Title of it</h1>{TALE}<section id='discussion'><h2>Discussion</h2>{PROSE_PARTS}</section>{TALE}</article>", None),
        (f"<article><h1>Title of it</h1>{TALE}<div class='survey-results'>{PROSE_PARTS}</div>{TALE}</article>", None),
        (f"<article><h1>Title of it</h1>{TALE}<div class='print-body'>{PROSE_PARTS}</div>{TALE}</article>", None),
        (f"<div class='ad'><p>{'Buy this thing now and be happy for ever. ' * 20}</p></div><article><h1>Title of it</h1><p>A short text.</p></article>", ["Title of it", "A short text."]),
    ],
)
def test_names_of_parts_do_not_lose_them(page, lines):
    found = html_text.main_text(page).split("\n")
    assert found == lines if lines else set(PROSE_LINES) <= set(found) and found[0] == "Title of it"


def test_the_cut_labels_pages_better_than_the_classifier_alone():
    weights, strength, across = html_text.fitted()
    wrong = np.zeros(2, dtype=int)
    moved = 0
    for blocks, right in html_text._labelled(200, 9):
        found = html_text.odds(blocks, np.array(weights))
        labels = np.array(html_text.cut(blocks, found, strength, across))
        wrong += ((found > 0) != right).sum(), (labels != right).sum()
        moved += ((found > 0) != labels).sum()
    assert moved > 0 and wrong[1] < wrong[0] and strength > 0


def test_logistic_fit_has_no_slope_left():
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(300), rng.normal(size=(300, 4))]
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [0.3, 1, -2, 0, 0.5]))).astype(float)
    w = html_text.logistic(x, y)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - w).max() < 1e-6


def test_pages_of_a_table_are_labelled_as_by_trying_all_labellings(spark, tmp_path):
    weights, strength, across = html_text.fitted()
    pages, wanted = [], {}
    for page in html_text.html_sample.pages(1200, 31):
        page = html_text.html_sample.truth(page)[0]
        blocks = html_text.blocks_of(page)
        if len(blocks) <= 12 and len(pages) < 20:
            gain = [round(html_text.UNIT * x) for x in html_text.odds(blocks, np.array(weights)).tolist()]
            edges = html_text.ties(blocks, strength, across)
            cost = lambda x: sum(max(g, 0) if not on else max(-g, 0) for g, on in zip(gain, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
            best = min(itertools.product((False, True), repeat=len(blocks)), key=cost)
            wanted[len(pages)] = "\n".join(b.text for b, on in zip(blocks, best, strict=True) if on)
            pages.append((len(pages), "u", page))
    pages += [(900, None, None), (901, "u", ""), (None, "u", "<p>x</p>"), (0, "u", pages[0][2])]
    frame(spark, pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op5_html_text(spark, str(tmp_path)).collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    assert {(r.page_id, r.text) for r in out if r.page_id is not None} == {*wanted.items(), (900, ""), (901, "")} and len(wanted) == 20


def test_a_very_long_page_is_read_to_its_end():
    page = "<article><h1>Title</h1>" + "<p>The river went down to the sea, and nobody knew why it did so.</p>" * 20_000 + "<p>The end of all of it.</p></article>"
    assert html_text.main_text(page).endswith("\nThe end of all of it.") and html_text.main_text(page).count("\n") == 20_001


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None)]
    out = html_text.extract_pages(frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [(r.page_id, r.n_chars) for r in out] == [(1, len(html_text.main_text(PAGE)))] * 2 + [(2, 0)]
    assert html_text.extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0


# 6


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_as_the_library_does():
    code, library, rng = bpe.codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), random.Random(11)
    texts = [t or "" for t in ODD] + made(12, 30) + ["a<|endoftext|>b <|endoftext|>", "it's we'll 'S", "  \n\t x", "é" * 3, "\u0085  a b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(9000)) for alphabet in ("ab", "the ", "漢字", "!?", " \n", "12", "aé")]
    runs = ["x" * 5000, "\n" * 4500, " " * 4400 + "\n", "!" * 4300, "é" * 4300, "\x1c" * 4200]
    texts += [before + run + after for run in runs for before in ("a \n\n", "a\u00a0\u00a0", "a  \n", "  ", "b\r\n ") for after in ("", " \n\n", "  b", "\u3000c")]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert code.encode(text) == ids
        assert code.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_tree_of_windows_is_exact():
    code, rng = bpe.codec(open(PATH, encoding="utf-8").read()), random.Random(13)
    for alphabet in ("a", "ab", "aab", "ther", "日本", " a", "'s t", "1a!", " \n", "é'll ", "\u3000x", "!?.", "\u0301a"):
        text = "".join(rng.choice(alphabet) for _ in range(12_000))
        assert code.tree(text) == code.core._core_bpe.encode_ordinary(text)


@pytest.mark.parametrize("leaf", [3, 17, 200])
def test_halves_meet_exactly_wherever_they_are_cut(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "PARALLEL", 400)
    code, library, rng = bpe.codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), random.Random(32)
    for n in range(60):
        parts = ["it's", " we'll", "'s", "  ", "\n\n", " ", "\t ", "don't", "1234", " 12", "漢字", "é", "!!", "...", " (", "'", "''ve", "x" * rng.randrange(1, 40), " " * rng.randrange(1, 30), "\u00a0", "e\u0301", "🙂"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 400)))
        assert code.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("where", "value"), [(("normalizer",), {"type": "NFC"}), (("pre_tokenizer", "add_prefix_space"), True), (("pre_tokenizer", "type"), "Whitespace"), (("model", "dropout"), 0.1), (("added_tokens", 0, "lstrip"), True), (("decoder",), None)])
def test_vocabularies_with_other_settings_are_refused(where, value):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    inner = spec
    for part in where[:-1]:
        inner = inner[part]
    inner[where[-1]] = value
    with pytest.raises(ValueError):
        bpe.check(spec)


def test_bpe_of_an_empty_table_and_of_repeated_rows(spark):
    assert bpe.round_trip_digests(frame(spark, []), PATH).count() == 0
    rows = bpe.round_trip_digests(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]), PATH).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == {(1, 2): 2, (None, 2): 1, (None, 0): 1}


def test_bpe_digests(spark):
    docs = list(enumerate(ODD + made(14, 20)))
    library = Tokenizer.from_file(PATH)
    for r in bpe.round_trip_digests(frame(spark, docs).withColumn("ids", F.lit(1)), PATH).collect():
        ids = library.encode(docs[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id][1] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, docs), PATH), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {d: t or "" for d, t in docs}


# 7


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    docs = [(0, "Some words.\nReleased under the MIT License.\nMore words."), (1, f"Intro\n{mit.replace('Software', 'Program')}\nOutro"), (2, "Licensed under CC BY-NC 4.0."), (3, "They warrant nothing."), *((10 + i, t) for i, t in enumerate(ODD))]
    out = {r.doc_id: r for r in licenses.license_scan(frame(spark, docs).withColumn("license", F.lit("x"))).collect()}
    assert {d: r.license for d, r in out.items()} == {0: "MIT", 1: "MIT", 2: "CC-BY-NC-4.0"}
    assert docs[0][1][out[0].block_start : out[0].block_end] == "Released under the MIT License." and out[0].words_missing == 0
    assert out[1].words_missing == out[1].words_extra > 0


PROSE = "The river went down to the sea, and nobody knew why. It was a long year for all of us there. " * 9


@pytest.mark.parametrize("nth", range(len(licenses.ALL)))
def test_every_template_is_found_amid_prose(nth):
    name, notice = licenses.ALL[nth]
    text = PROSE + notice + " " + PROSE
    assert [(text[a:b], *f[:1], *f[2:]) for a, b, *f in licenses.notices(text)] == [(notice, name, 0, 0)]


def plain_scan(text):
    """All templates over all of the text: no blocks, no ranks."""
    words = licenses._words(text)
    out, todo = [], [(0, len(words))]
    while todo:
        low, high = todo.pop()
        part, found, taken = words[low:high], [], []
        for i, (_, notice) in enumerate(licenses.ALL):
            own = licenses._words(notice)
            for a, b, lacks in licenses.align(own, part):
                if b - a <= 2 * len(own) and licenses.Template(notice).tells(part[a:b]) and licenses._gain(part[a:b], i) >= licenses.LEAST_GAIN:
                    found.append((lacks - (len(own) - lacks), b - a - (len(own) - lacks), i, a, b, lacks))
        for _, more, i, a, b, lacks in sorted(found):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((low + a, low + b, licenses.ALL[i][0], lacks, more))
        edges = [0, *(x for span in sorted(taken) for x in span), len(part)]
        todo += [(low + a, low + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if taken and a < b]
    return sorted(out)


def test_licence_scan_of_a_table_is_that_of_a_plain_scan(spark, tmp_path):
    rng = random.Random(30)
    texts = list(ODD)
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = licenses.ALL[rng.randrange(len(licenses.ALL))][1].split() if rng.random() < 0.6 else PROSE.split()[: rng.randrange(40)]
            words = [w for w in words if rng.random() > 0.04]
            for _ in range(rng.randrange(3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["the", "license", "Jane", "software", "2", "MIT", "as", "is"]))
            parts.append(" ".join(words))
        texts.append(rng.choice([" ", ".\n", "\n\n"]).join(parts))
    docs = [*enumerate(texts), (3, texts[-1]), (None, texts[-2])]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op7_license_scan(spark, str(tmp_path)).collect()
    wanted = Counter((d, name, lacks, more) for d, t in docs for _, _, name, lacks, more in plain_scan(t or ""))
    assert Counter((r.doc_id, r.license, r.words_missing, r.words_extra) for r in out) == wanted and sum(wanted.values()) > 40
    assert all(0 <= r.block_start < r.block_end for r in out)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: MIT */", ["MIT"]),
        ("Mozilla Public License 2.0", ["MPL-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", ["GPL-3.0"]),
        ("Released under the Foo License.", []),
        ("Licensed under CC BY-NC-ND 4.0.", []),
        ("Copyright is held by all of us, and nobody may license it.", []),
    ],
)
def test_what_names_a_licence_and_what_does_not(text, names):
    assert [x[2] for x in licenses.notices(text)] == names


def test_a_long_text_is_scanned_to_its_end(spark):
    text = PROSE * 300 + licenses.TEMPLATES[0][1] + PROSE * 300 + "Licensed under CC BY 4.0."
    out = licenses.license_scan(frame(spark, [(1, text)]).withColumn("gain", F.lit("x"))).collect()
    assert [r.license for r in out] == ["MIT", "CC-BY-4.0"] and out[1].block_end == len(text)
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_several_notices_and_what_stands_beside_them(spark):
    held = "Copyright (c) 2021 Jane Doe and the Example project contributors. All rights reserved. "
    docs = [(0, held + "Released under the MIT License."), (1, held * 9 + "Licensed under CC BY 4.0. " + held * 9), (2, licenses.TEMPLATES[0][1] + "\n" + licenses.TEMPLATES[3][1]), (3, "\n".join(t for _, t in licenses.TEMPLATES)), (4, held)]
    out = sorted(licenses.license_scan(frame(spark, docs)).collect())
    names = {d: [r.license for r in out if r.doc_id == d] for d, _ in docs}
    assert names == {0: ["MIT"], 1: ["CC-BY-4.0"], 2: ["MIT", "Apache-2.0"], 3: [n for n, _ in licenses.TEMPLATES], 4: []}
    assert all(r.words_missing == r.words_extra == 0 for r in out)


def test_alignment_is_the_cheapest():
    rng = random.Random(15)
    for _ in range(200):
        own, words = ([rng.choice("abcd") for _ in range(rng.randrange(1, most))] for most in (6, 9))
        common = lambda w: max(len(c) for k in range(len(own) + 1) for c in itertools.combinations(own, k) if (it := iter(w)) and all(x in it for x in c))  # noqa: B023, E731
        costs = {(a, b): licenses.LACK * (len(own) - (c := common(words[a:b]))) + b - a - c for a in range(len(words)) for b in range(a + 1, len(words) + 1)}
        found = licenses.align(own, words)
        assert all(costs[a, b] == licenses.LACK * lacks + b - a - (len(own) - lacks) for a, b, lacks in found)
        if any(costs[s] == 0 for s in costs):
            assert any(costs[a, b] == 0 for a, b, _ in found)


# 8


def test_toxicity(spark):
    rng = random.Random(15)
    texts = made(16, 900, vocabulary=300, longest=50)
    bad = [rng.random() < 0.3 for _ in texts]
    texts = [t + " " + rng.choice(["grumbleword", "nastyterm, x", "VILE!"]) if b else t for t, b in zip(texts, bad, strict=True)]
    docs = list(enumerate(texts)) + [(2000 + i, t) for i, t in enumerate(ODD)]
    labels = [(i, int(b)) for i, b in enumerate(bad)] + [(5000, 1), (None, 1), (1, None)]
    out = toxicity.toxicity_scores(frame(spark, docs).withColumn("label", F.lit(0)), frame(spark, labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == bad[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.score for r in toxicity.toxicity_scores(frame(spark, docs), frame(spark, [], "doc_id long, toxic int")).collect()} == {0.5}


def test_toxicity_of_odd_tables(spark, monkeypatch):
    labels = frame(spark, [(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(frame(spark, []), labels).count() == 0
    docs = frame(spark, [(1, "vile"), (1, "vile"), (2, "kind words"), (None, "vile"), (3, "long words " * 400_000)]).withColumn("__score", F.lit("x")).withColumn("nth", F.lit(0))
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == {1: 2, 2: 1, None: 1, 3: 1} and len({r.score for r in out if r.doc_id in (1, None)}) == 1
    monkeypatch.setattr(toxicity, "PLACES", 0)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels).collect()} == {0.5}


def plain_score(text, model):
    """As the words, stems, pairs and skip-grams say, one by one."""
    words = [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").translate(FOLD)).split(" ") if w]
    rows, places = toxicity.features(pa.array([" ".join(words)], pa.string()))
    assert len(places) == 4 * len(words) + max(0, len(words) - 1) + max(0, len(words) - 2)
    weight = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    return 1 / (1 + math.exp(-sum(weight.get(p, 0.0) for p in {*places.tolist(), 1 << toxicity.BITS})))


def test_toxicity_query_scores_as_the_model_says(spark, tmp_path):
    rng = random.Random(35)
    texts = [t + (" nastyterm" if i % 3 == 0 else "") for i, t in enumerate(made(36, 300, vocabulary=200))] + ODD
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    labels = frame(spark, [(i, int(i % 3 == 0)) for i in range(300) if rng.random() < 0.9], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels, where=~toxicity.held_out("doc_id"))
    for r in queries.op8_toxicity(spark, str(tmp_path)).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], model), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_ftrl_as_written_out():
    model, z, n = toxicity.Ftrl(8), [0.0] * 8, [0.0] * 8
    rng = random.Random(17)
    for _ in range(60):
        at, label = sorted(rng.sample(range(8), 3)), rng.randrange(2)
        w = [0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) for i in at]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(at, w, strict=True):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * x
            n[i] += g * g
        model.learn(np.array(at), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# 9


def test_phrases_inside_equal_substrings_are_equal():
    rng = random.Random(18)
    part = bytes(rng.randrange(97, 123) for _ in range(3000))
    names = [fingerprints.names_by_level([pad + part + pad[::-1]]) for pad in (b"", b"q", bytes(rng.randrange(97, 123) for _ in range(501)))]
    for level in range(3):
        sets = [set(x[level][0].tolist()) for x in names]
        assert len(sets[0] & sets[1] & sets[2]) >= 0.9 * len(sets[0]) - 8


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_phrases(symbols, first):
    """One level of parsing, symbol by symbol."""
    runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    name = [(plain_mix((s + 1) * 0xD1342543DE82EF95 & M64) | 1) if first else s for s, _ in runs]
    name = [plain_mix(x + n & M64) if n > 1 else x for x, (_, n) in zip(name, runs, strict=True)]
    labels = [s for s, _ in runs]
    for _ in range(4):
        before = [labels[0] ^ 1, *labels[:-1]]
        place = [((x ^ y) & -(x ^ y)).bit_length() - 1 if x != y else 0 for x, y in zip(labels, before, strict=True)]
        labels = [p << 1 | x >> p & 1 for p, x in zip(place, labels, strict=True)]
    n = len(labels)
    starts = [i for i in range(n) if i == 0 or 1 < i < n - 1 and labels[i - 1] < labels[i] > labels[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        total = sum(x * (plain_mix(i + 1) | 1) for i, x in enumerate(name[a:b]))
        out.append(plain_mix(total + b - a & M64))
    return out


def plain_fingerprint(text):
    least = {}
    symbols = list((text or "").encode())
    for level in range(1, 5 if symbols else 0):
        symbols = plain_phrases(symbols, level == 1)
        if level > 1:
            for x in symbols:
                x = plain_mix(x + level & M64)
                least[x >> 58] = min(least.get(x >> 58, M64), x)
    return [plain_mix(least[b]) % (16**8 - 1) + 1 if b in least else 0 for b in range(64)]


def plain_likeness(a, b):
    known = sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True))
    return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / known if known else 1.0


def test_fingerprint_query_as_parsed_symbol_by_symbol(spark, tmp_path):
    texts = ODD + made(40, 25, vocabulary=900, longest=200) + ["ab" * 300, "a" * 700 + "b" * 300, "".join(chr(97 + i % 23) for i in range(3000)), "é漢" * 200]
    docs = [(3 * i, t) for i, t in enumerate(texts)] + [(9, "a"), (9, None), (9, "b" * 50), (None, "text without an id")]
    frame(spark, docs).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    ordered = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    wanted = Counter()
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (following or "")[:half]
        own, other, after = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(following)
        shown = ["".join(f"{x:08x}" for x in y) for y in (own, other)]
        wanted[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, round(plain_likeness(own, other), 9), round(plain_likeness(own, after), 9)] += 1
    out = queries.op9_fingerprints(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == wanted


def test_fingerprints_of_a_very_long_text(spark):
    text = "".join(random.Random(41).choices("abcdefgh ", k=3_000_000))
    out = fingerprints.fingerprints(frame(spark, [(1, text), (2, text), (3, "z" * 500_000)])).collect()
    assert len({r.fingerprint for r in out if r.doc_id < 3}) == 1 and {r.n_chars for r in out} == {3_000_000, 500_000}


def test_fingerprints(spark):
    texts = ODD + made(19, 80, vocabulary=5000, longest=400) + ["ab" * 700, "a" * 900]
    docs = list(enumerate(texts)) + [(3, "a")]
    rows = sorted(fingerprints.fingerprints(frame(spark, docs).withColumn("part", F.lit(0)).repartition(3)).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(docs)
    ordered = sorted(docs, key=lambda x: (x[0], x[1] or ""))
    wanted = Counter()
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, half = text or "", len(text or "") // 2
        wanted[doc, len(text), hashlib.sha256((text[: len(text) - half] + (following or "")[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == wanted
    prints = defaultdict(set)
    for r in rows:
        prints[texts[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) > 80
    long = [r for r in rows if r.n_chars > 400]
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    only = fingerprints.fingerprints(frame(spark, [(1, "some text of one")])).first()
    assert only.near_next == 1.0


# 10


def by_hand_search(docs, every, k):
    split = lambda t: [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").translate(FOLD)).split(" ") if w]
    found = [(d, Counter(split(t))) for d, t in docs]
    n, mean = len(docs), sum(sum(c.values()) for _, c in found) / len(docs)
    df = Counter(w for _, c in found for w in c)
    out = {}
    for q, asked in found:
        if q % every:
            continue
        scores = []
        for d, c in found:
            s = sum(asked[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in asked if w in c)
            if s > 0:
                scores.append((-round(s, 6), d))
        out[q] = [(i + 1, d, pytest.approx(-s, abs=2e-6)) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("dense", [4, 512])
def test_search_is_exact(spark, monkeypatch, dense):
    docs = list(enumerate(ODD + made(20, 300, vocabulary=400, longest=80) + ["w1 " * 300]))
    given = frame(spark, docs).withColumn("shard", F.lit(0)).repartition(9)
    out = defaultdict(list)
    for r in search.search_documents(given, every=10, k=7).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.doc_id, r.score))
    assert dict(out) == by_hand_search(docs, 10, 7)
    monkeypatch.setattr(search, "DENSE", dense)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "SHORT", 3)
    made_of = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    (batch,) = search._build(iter([made_of]))
    shard = search.Shard({x: batch.column(x)[0].as_buffer() for x in batch.schema.names[3:]}, 30.0)
    names = shard.terms.to_pylist()
    asked = [(np.array([names.index(w.encode()) for w in set(words_of(docs[q][1]))  if w.encode() in names]), None) for q in (20, 50, 90)]
    asked = [(at, np.linspace(1, 2, len(at))) for at, _ in asked]
    found = np.arange(len(names))
    full = list(shard.search(found, asked, np.zeros(3), len(docs)))
    few = list(shard.search(found, asked, np.zeros(3), 5))
    assert [(a[:5].tolist(), b[:5].tolist()) for a, b in full] == [(a.tolist(), b.tolist()) for a, b in few]
    shard.seen[:] = 0
    again = list(shard.search(found, asked, np.array([b[-1] for _, b in few]), 5))
    assert [(a.tolist(), b.tolist()) for a, b in again] == [(a.tolist(), b.tolist()) for a, b in few]
    assert shard.seen[1] < shard.seen[0] and shard.seen[3] < shard.seen[2]


def shard_of(docs):
    made_of = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    (batch,) = search._build(iter([made_of]))
    return search.Shard({x: batch.column(x)[0].as_buffer() for x in batch.schema.names[3:]}, 30.0)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 4, "PART_BLOCKS": 2, "SHORT": 2, "TAKEN": 16, "PAIRS": 3}, {"BLOCK": 8, "SHORT": 1, "CELLS": 900}, {"SHORT": 10**6, "GROUPS": 2, "FEATURES": 1}])
def test_search_of_queries_together(monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(search, name, size)
    plain_words = lambda seed: [" ".join(w for w in words_of(t) if w.isalnum()) for t in made(seed, 150, vocabulary=300, longest=90)]
    two = [(2 * i, t) for i, t in enumerate(plain_words(21))] + [(2 * i + 1, t.replace("w", "v") + " v0") for i, t in enumerate(plain_words(22))]
    shard = shard_of(two)
    names = {w: i for i, w in enumerate(shard.terms.to_pylist())}
    asked = [sorted({names[w.encode()] for w in words_of(t)}) for _, t in two[::3]]
    asked = [(np.array(at), 1 + np.arange(len(at)) % 7 / 3) for at in asked]
    calls, plain = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda *a: calls.append(1) or plain(*a))
    out = list(shard.search(np.arange(len(names)), asked, np.zeros(len(asked)), 6))
    if not sizes:  # calls for each query would take longer than its sums
        assert len(calls) < len(asked) / 10
    counts = {d: Counter(names[w.encode()] for w in words_of(t)) for d, t in two}
    for (ids, scores), (at, weight) in zip(out, asked, strict=True):
        by_hand = {d: sum(w * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / 30)) for t, w in zip(at.tolist(), weight, strict=True) if c[t]) for d, c in counts.items()}
        best = sorted((-round(s, 6), d) for d, s in by_hand.items() if s > 0)[:6]
        assert ids.tolist() == [d for _, d in best] and scores.tolist() == pytest.approx([-s for s, _ in best], abs=2e-6)
    least = np.array([scores[-1] for _, scores in out])
    again = list(shard.search(np.arange(len(names)), asked, least, 6))
    assert [(a.tolist(), b.tolist()) for a, b in again] == [(a.tolist(), b.tolist()) for a, b in out]


@pytest.mark.parametrize(
    "docs",
    [
        [(0, "apple pie"), (1, "banana"), (2, "apple"), (3, ""), (4, None)],
        [(0, THUE_MORSE), (1, THUE_MORSE.translate(str.maketrans("ab", "ba"))), (2, "a b " + THUE_MORSE)],
        [(0, "one"), *((i, None) for i in range(1, 30))],
        [(0, "same words here"), (7, "same words here"), (3, "same words here"), (50, "words")],
        [(0, " ".join(f"t{i}" for i in range(30_000)) + " x" * 200_000), (1, "t7 x"), (2, "y")],
    ],
)
def test_search_of_few(spark, docs):
    out = defaultdict(list)
    for r in search.search_documents(frame(spark, docs).withColumn("term", F.lit("t")).withColumn("score", F.lit(0)).repartition(3)).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.doc_id, r.score))
    assert dict(out) == by_hand_search(docs, 50, 10)


def test_search_with_repeated_and_null_ids(spark):
    docs = [(0, "a b c"), (1, "a"), (1, "a b"), (None, "a b c"), (None, None)]
    out = [(r.query_id, r.doc_id) for r in search.search_documents(frame(spark, docs)).orderBy("query_id", "rank").collect()]
    assert out == [(0, 0), (0, 1), (0, 1)]


def test_search_of_nothing(spark):
    assert search.search_documents(frame(spark, [])).count() == 0
    assert search.search_documents(frame(spark, [(0, None), (50, "")])).count() == 0
