"""Whitening, fill-in-the-middle and SimHash against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import fim, simhash, whitening

SPACES = " \t\n\x0b\x0c\r"


# ---- whitening ----


def test_jacobi_keeps_small_deviations():
    r = np.random.default_rng(0)
    for d in (1, 2, 5, 16, 33):
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        s = 10.0 ** -np.arange(d) if d <= 5 else np.linspace(3, 1, d)
        u, _ = np.linalg.qr(r.normal(size=(2 * d, d)))
        lengths, v = whitening.jacobi(whitening.triangle(u * s @ q.T))
        assert np.allclose(lengths, s, rtol=1e-9) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        assert np.allclose(np.abs((v * q).sum(0)), 1, atol=1e-9)
    assert {frozenset(p) for a in whitening.rounds(7) for p in zip(*map(np.ndarray.tolist, a), strict=True)} == {frozenset((i, j)) for i in range(7) for j in range(i)}


def check_whitening(got, rows, components):
    good = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in rows]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    c = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for _, x in good])
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1], vec[:, ::-1]
    assert set(got["n"]) == {n} and sorted(got["component"].unique()) == list(range(1, min(components, d) + 1))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k, part in got.groupby("component"):
        assert np.allclose(part["explained"], e[k - 1] / e.sum(), rtol=1e-9)
        want = dict(zip([i for i, _ in good], c @ vec[:, k - 1] / np.sqrt(e[k - 1]), strict=True))
        have = dict(zip(part["vec_id"], part["whitened"], strict=True))
        sign = np.sign(sum(want[i] * have[i] for i in want))
        assert set(have) == set(want) and all(abs(have[i] * sign - want[i]) < 1e-8 for i in want)
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in good}
    assert all(exact[i] == v for i, v in zip(got["vec_id"], got["deviation"], strict=True))


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    monkeypatch.setattr(whitening, "FAN_BYTES", 1)
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 12)) * np.geomspace(3, 0.05, 12) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    bad = [(2000, None), (2001, [None] + [0.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0]), (2005, [])]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("x", F.lit("x")).repartition(5)
    for k in (12, 4):
        check_whitening(whitening.whitened(t, k).toPandas(), rows, k)


def test_whitening_corner_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, None)])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(make([(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    line = whitening.whitened(make([(i, [float(i), float(i), 0.0]) for i in range(5)] + [(None, [9.0, 9.0, 0.0])] * 2)).toPandas()
    assert set(line["component"]) == {1} and len(line) == 7 and line["vec_id"].isna().sum() == 2
    assert np.allclose(line["explained"], 1) and line["identity_error"].max() < 1e-9
    huge = whitening.whitened(make([(0, [3e38, 0.0]), (1, [0.0, 1.0]), (2, [-3e38, 5.0])])).toPandas()
    assert dict(zip(huge["vec_id"], huge["deviation"].isna(), strict=True)) == {0: True, 1: False, 2: True} and np.isfinite(huge["whitened"]).all()


# ---- fill-in-the-middle ----

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_by_hand(doc_id, text):
    text = text or ""
    pieces = TOKEN.findall(text)
    n, h = len(pieces), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 50:
        return n, "plain", None, None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(pieces[:lo]), "".join(pieces[lo:hi]), "".join(pieces[hi:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    r = random.Random(5)
    texts = ["", " ", "a", " a", "a ", "\na  b\t", None, "<P>", "x <S> y", "a<M>b", "<<P", "S>a <P b", "é ü   x", "\U0001f600 \U0001f601\U0001f602  ", "\x85a\x1cb", "x" * 300_000, "ab \n" * 100_000]
    texts += ["".join(r.choice("ab<PSM>é\U0001f600" + SPACES) for _ in range(r.randint(0, 40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a b c")]


def test_fill_in_middle(spark):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("form", F.lit("x")).withColumn("units", F.lit("x"))
    cut = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back) for r in cut.collect()), key=repr)
    want = sorted(((i, t or "", *fim_by_hand(i, t), t or "") for i, t in rows), key=repr)
    assert got == want and {g[3] for g in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_sql(spark, tmp_path):
    docs = spark.createDataFrame(fim_rows(), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in fim.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(fim.OP12_SQL).fetchall(), key=repr)


@pytest.mark.parametrize(
    ("unit", "text", "want"),
    [
        ("run", " a  b", [" ", "a", "  ", "b"]),
        ("line", "a\n\nb\n", ["a\n", "\n", "b\n"]),
        ("sentence", "One. Two!\nThree", ["One.", " Two!", "\n", "Three"]),
        ("character", "a\U0001f600b", ["a", "\U0001f600", "b"]),
        ("token", "", []),
    ],
)
def test_units(spark, unit, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fim.units(F.col("t"), unit)).first()[0] == want


def test_sentinels_that_overlap(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string")
    with pytest.raises(ValueError, match="overlap"):
        fim.fill_in_middle(docs, sentinels=("<a", "a>", "b"))
    cut = fim.fill_in_middle(docs, rate=100, sentinels=("[.*", "\\E|", "$1?")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[.*", "\\E|", "$1?")))
    assert {r.back for r in cut.collect()} == {"a b c d"}


# ---- SimHash ----


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(fps, bits=4):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def near_texts():
    r = random.Random(7)
    word = lambda: r.choice(["Alpha", "beta", "GAMMA", "é", "日本", "x"]) + str(r.randint(0, 300))
    texts = [None, "", "  \n", "one", "ONE", "a b c", "a b c d", "A  b\tc d e", "w" * 700_000]
    for _ in range(25):
        base = [word() for _ in range(r.randint(30, 300))]
        for _ in range(r.choice([1, 2, 5])):
            near = list(base)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = word()
            texts.append(r.choice(SPACES).join(near))
    return texts


def test_fingerprints(spark, monkeypatch):
    texts = near_texts()
    for piece in (1 << 18, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts] == [fingerprint_by_hand(t) for t in texts]


@pytest.mark.parametrize(("block", "bucket"), [(4096, 256), (3, 256), (4096, 1e-6)])
def test_simhash_components(spark, block, bucket, monkeypatch):
    if bucket < 1:
        monkeypatch.setattr(simhash, "tables", lambda n, bits, b: tables(10**9, bits, 256))
    texts = near_texts()
    ids = [3 * i + 1 for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[-1]), (None, "alone in all the world"), (ids[-1], texts[-1]), (ids[9], texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2)).repartition(3)
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = components_by_hand(fps)
    least = {}
    for k, (i, _) in zip(root, rows, strict=True):
        least[k] = min(least.get(k, i or 10**9), i or 10**9)
    want = sorted(((i, f, least[k] if least[k] < 10**9 else None) for (i, _), f, k in zip(rows, fps, root, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs, block=block).collect()), key=repr)
    assert got == want and len({g[2] for g in got}) < len(set(texts))
    assert simhash.simhash_components(docs.limit(0)).count() == 0


tables = simhash.tables


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12])
def test_tables_lose_no_pair(n):
    masks, r = simhash.tables(n), random.Random(n)
    assert len(masks) == {10: 5, 10**7: 15, 10**9: 35, 10**12: 70}[n]
    for _ in range(300):
        off = sum(1 << b for b in r.sample(range(64), 4))
        assert any(off & m & (2**64 - 1) == 0 for m in masks)


def test_clusters_in_blocks(spark):
    """Chains of fingerprints, dense clusters and lonely ones, in buckets that are dealt out, against brute force."""
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 4, 5])))
    dense = r.getrandbits(64)
    fps = sorted(fps | {dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)} | {0})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    t = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (4096, 16):
        links = simhash.near_links(t, block=block).collect()
        assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in links)
        at, root = {f: i for i, f in enumerate(signed)}, list(range(len(fps)))
        for u, v in links:
            a, b = root[at[u]], root[at[v]]
            root = [a if x == b else x for x in root]
        same = components_by_hand(fps)
        assert len(set(zip(root, same, strict=True))) == len(set(root)) == len(set(same))


def test_labels_by_join(spark, monkeypatch):
    """The labels of often seen fingerprints go another way than the rest where there are too many to broadcast."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_texts() + ["same old text again"] * 20)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.simhash_components(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, simhash.simhash_components(docs, hot=10).collect())) == want
