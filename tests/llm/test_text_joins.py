"""Decontamination, line dedup and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, ngram_join
from loomgraph.llm.common import segment_hashes
from loomgraph.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(n=60, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.choice([3, 8, 40, 120, 400]))) for _ in range(n)]
    shared = " ".join(r.choices(words, k=60))
    for i in range(0, n, 3):  # near copies of growing distance, and a passage that many texts share
        w = texts[i].split()
        for _ in range(max(1, len(w) * (i % 7) // 100)):
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w).upper())
        texts.append(texts[i] + "\n" + shared)
    texts += [texts[0], texts[0] + "  ", None, "", " \t\n", "One", "one", "a b c d", "A  b\tc d", "a b c d e", "a b c d f", "É x y z q", "é x y z q"]
    return [(i, t) for i, t in enumerate(texts)]


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def test_jaccard_components(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("x")).withColumn("cid", F.lit(1)).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def near_group(seed=5, n=40):
    """Chains: each text edits the one before, so far ones don't link; and a passage in all of them."""
    r = random.Random(seed)
    out, w = [], [f"g{r.randrange(500)}" for _ in range(80)]
    for i in range(n):
        w = list(w)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(len(w))] = f"e{i}"
        out.append((1000 + i, " ".join(w)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("hot", "block"), [(3, 4), (100_000, 4)])
def test_jaccard_hot_words_and_blocks(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_group() + corpus(9, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, hot).collect()}
    assert got == brute_components(rows)


def test_forest_is_smaller_than_its_block(spark):
    """A block of copies of one component each returns fewer links than members, and all that join them."""
    texts = [t for _, t in near_group(2, 30)]
    sets = [np.sort(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], np.uint64)) for t in texts]
    flat = [next(iter(ngram_join.shingle_sets(pa.array([t]))))[0] for t in texts]
    n = len(texts)
    rows = {"bucket": [1] * n, "bi": [0] * n, "bj": [0] * n, "side": [0] * n, "cid": list(range(n)), "root": list(range(n)), "n": [len(f) for f in flat], "bits": [ngram_join.bit_sketch(f) for f in flat]}
    rows["packed"] = [zstandard.compress(t.encode()) for t in texts]
    (out,) = ngram_join._forest(iter([pa.RecordBatch.from_pydict(rows)]))
    links = list(zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True))
    whole = brute_components(list(enumerate(texts)))
    assert len(links) == n - len({c for _, c in whole.values()}) < n
    assert all(len(np.intersect1d(sets[u], sets[v])) * 100 >= 75 * len(np.union1d(sets[u], sets[v])) for u, v in links)


def test_jaccard_long_text(spark):
    r = random.Random(8)
    long = " ".join(r.choices([f"w{i}" for i in range(5000)], k=180_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, long[: len(long) // 2])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, None)]
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9), (None, 0, None)], key=str)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "other words here", "en", "s", 1), (4, None, None, None, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (3, 9, 40, 500, 3000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for cut in (0, 1, max(1, len(x) // 8)):
            y = np.unique(np.concatenate([x[cut:], r.integers(0, 2**63, cut, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            apart = len(x) + len(y) - 2 * both
            assert ngram_join.hamming(ngram_join.bit_sketch(x), ngram_join.bit_sketch(y)) <= apart
            if 100 * both >= 75 * (len(x) + len(y) - both):  # then they post a word in common
                none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                a, b = (set(ngram_join.posted(s, np.array([len(s)]), *none)[1].tolist()) for s in (x, y))
                assert a & b


def test_common_words_do_not_hide_links():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
    y = np.unique(np.concatenate([x[20:], r.integers(0, 2**63, 20, dtype=np.uint64)]))
    sizes = [np.array([len(s)]) for s in (x, y)]
    every = np.unique(np.concatenate([k for s, n in zip((x, y), sizes, strict=True) for _, _, k, _, _ in ngram_join.sketches(s, n)]))
    for seed in range(20):
        rank = np.random.default_rng(seed).integers(1, 1000, len(every))
        a, b = (set(ngram_join.posted(s, n, every, rank)[1].tolist()) for s, n in zip((x, y), sizes, strict=True))
        assert a & b


def test_segment_hashes_do_not_depend_on_place():
    a, b = (np.frombuffer(t, np.uint8) for t in (b"xxabcyyABC", b"abcZZabc"))
    h = segment_hashes(a, np.array([2, 7]), np.array([5, 10]))
    g = segment_hashes(b, np.array([0, 5]), np.array([3, 8]))
    assert len({*h.tolist(), *g.tolist()}) == 1


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (4, 5)], "u long, v long")
    assert sorted(map(tuple, components(e).collect())) == [(4, 3), (5, 3), (9, 8)]


def leak_rows():
    r = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate([12, 20, 30, 50, 4, 5])] + [(6, None), (7, "")]
    docs = []
    for i in range(40):
        body = r.choices(words, k=r.choice([5, 60, 300]))
        if i % 4 == 0:
            part = items[i // 4 % 6][1].split()
            part = part[: max(1, round(len(part) * r.choice([0.5, 0.8, 1.0])))]
            body[2:2] = part
        docs.append((i, " ".join(body).upper() if i % 8 == 0 else "\n".join(body)))
    return [*docs, (40, None), (41, ""), (3, docs[4][1]), (4, docs[4][1])], items


@pytest.mark.parametrize("broadcast_bytes", [1 << 27, 0])
def test_leaks(spark, broadcast_bytes):
    docs, items = leak_rows()
    want = {}
    for i, t in docs:
        for j, u in items:
            q, n = shingles(u), len(shingles(u) & shingles(t))
            if q and 4 * n >= 3 * len(q):
                want[i, j] = max((n, len(q)), want.get((i, j), (0, 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("h", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2))
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontaminate.leaks(d, b, broadcast_bytes=broadcast_bytes).collect()}
    assert got == want and len(want) >= 4


def test_clean(spark):
    docs, items = leak_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.leaks(d, b).collect()}
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, b).collect()) == sorted(i for i, _ in docs if i not in bad)
    assert decontaminate.leaks(d.limit(0), b).count() == decontaminate.leaks(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 27, 0])
def test_leaks_share_of_every_size(spark, broadcast_bytes):
    """Items of all sizes to 40 shingles, in a document that holds any number of them; ids null, repeated and very long texts."""
    r = random.Random(3)
    items = [(q, " ".join(f"i{q}x{j}" for j in range(q + 4))) for q in range(1, 41)] + [(None, "n1 n2 n3 n4 n5"), (1, "again a b c d"), (99, None)]
    docs = []
    for q, t in items[:40]:
        w = t.split()
        for _ in range(3):
            held = r.sample(range(q), r.randint(0, q))
            docs.append((len(docs), " . ".join(" ".join(w[i : i + 5]) for i in held)))
    docs += [(500, "pad " * 300_000 + items[20][1]), (None, items[20][1]), (501, "n1 n2 n3 n4 n5"), (502, items[0][1] + " again a b c d"), (502, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(1))
    sets = {}
    for i, t in items:
        if i is not None:
            sets[i] = sets.get(i, set()) | shingles(t)
    want = {}
    for i, t in docs:
        s = shingles(t)
        for j, x in sets.items():
            if x and 4 * len(s & x) >= 3 * len(x):
                want[i, j] = (max(len(s & x), want.get((i, j), (0,))[0]), len(x))
    got = {(x["doc_id"], x["item_id"]): (x["n_shared"], x["n_item"]) for x in decontaminate.leaks(d, b, broadcast_bytes=broadcast_bytes).collect()}
    assert got == want and (None, 21) in want and (500, 21) in want
    one = spark.createDataFrame([(7, items[39][1])], "item_id long, text string").select("item_id", F.lit(1).alias("h"), "text")
    bands = decontaminate.sketches(decontaminate._shingles(one, ["item_id"], 5, False)).select("band", "k", "q", "need", "hits").distinct().collect()
    assert [tuple(x) for x in bands] == [(5, 16, 40, 30, 6)]


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_line_dedup(spark, broadcast_lines):
    rows = [(i, "h" if i < 8 else None, f"own {i}\nmenu\n\nmenu\nlast {i % 2}") for i in range(12)] + [(12, "h", None), (13, "h", ""), (14, "one", "menu"), (14, "one", "menu")]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash"))
    got = line_dedup.dedup_lines(pages, max_ratio=0.5, min_pages=3, broadcast_lines=broadcast_lines).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[0] == "own 0\n\nlast 0" and text[9] == "own 9\n\nlast 1" and text[12] is None and text[13] == "" and text[14] == "menu"
    assert {r["doc_id"]: r["n_dropped"] for r in got}[0] == 2 and len(got) == 16
    assert line_dedup.dedup_lines(pages.limit(0), broadcast_lines=broadcast_lines).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_line_dedup_of_many_and_long_lines(spark, broadcast):
    """A host with thousands of boilerplate lines and one long text, on either branch, against plain Python."""
    r = random.Random(4)
    plate = [f"line {i}" for i in range(1500)] + ["z" * 200_000]
    pages = [("a", "\n".join(r.sample(plate, 900) + ["", f"own {i}", f"own {i}"])) for i in range(6)] + [("b", "line 1\nx"), (None, None), (None, ""), ("b", "x" * 1_000_000)]
    rows = [(i, t, h) for i, (h, t) in enumerate(pages)]
    hosts = {}
    for _, t, h in rows:
        hosts.setdefault(h, []).append(set((t or "").split("\n")) if t is not None else set())
    bad = {h: {x for p in ps for x in p if x and (n := sum(x in q for q in ps)) >= 3 and n > 0.05 * len(ps)} for h, ps in hosts.items()}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if x not in bad[h]) for i, t, h in rows}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_lines=broadcast)
    assert {x["doc_id"]: x["text"] for x in got.collect()} == want


def thue_morse(k, a, b):
    word = a
    for _ in range(k):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_that_a_polynomial_hash_maps_alike(spark):
    """A Thue-Morse word of 1,024 letters and its complement share nothing, alone or in shingles."""
    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    assert len(one) == 1024 and one != two
    rows = [(1, one), (2, two), (3, f"x y z {one} w v u"), (4, f"x y z {two} w v u"), (5, one.upper()), (6, two + "c")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6}
