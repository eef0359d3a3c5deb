"""Nearest neighbours, token output, secrets and mixing."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, mixing, secrets, token_rans

P = pytest.importorskip("public_tokenizers")


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    codes = ann.buckets(x, 0, 2, 6, 1)
    assert codes.shape == (5, 6) and all(len(set(c)) == 6 for c in codes.tolist())
    assert (ann.buckets(x, 0, 2, 1, 1)[:, 0] == codes[:, 0]).all()


@pytest.mark.parametrize("hashes", [1, 2])
def test_nearest(spark, hashes):
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(30, 20)), 10, 0) + 0.3 * r.normal(size=(300, 20))
    rows = [(i, [float(v) for v in v_]) for i, v_ in enumerate(x)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (2000, None), (2100, [0.0] * 20), (2200, [None] * 20), (2300, [float("nan")] * 20), (2400, [1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).withColumn("rank", F.lit(0))
    got = ann.nearest(t, F.col("vec_id") % 20 == 0, 5, hashes=hashes, probes=10 * hashes, block=16).toPandas()
    assert set(got["query_id"]) == {*range(0, 300, 20), 1000}
    hits = 0
    good = [(i, np.array(v)) for i, v in dict(rows[:302]).items()]
    for q, part in got.sort_values("rank").groupby("query_id"):
        own = dict(good)[q]
        best = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in good if i != q)[:5]
        hits += len({i for _, i in best} & set(part["vec_id"]))
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(part["vec_id"])
        assert np.allclose(part["score"], [dict((i, s) for s, i in [(float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in good])[v] for v in part["vec_id"]])
    assert hits >= 0.9 * 5 * 16
    zero = got[got["query_id"] == 0].sort_values("rank")
    assert zero["vec_id"].tolist()[:2] == [1000, 1001] and zero["score"].tolist()[:2] == [0, 0]
    assert ann.nearest(t.limit(0), F.lit(True)).count() == 0


def test_nearest_in_blocks(spark):
    """Small blocks of entries and of queries, all of one bucket, give the rows of large ones."""
    x = np.random.default_rng(3).normal(size=(60, 4)) * 0.01 + [1, 0, 0, 0]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wide, small = (sorted(map(tuple, ann.nearest(t, F.col("vec_id") % 2 == 0, 3, block=b).collect())) for b in (4096, 4))
    assert small == wide and len(wide) == 90


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from loomgraph.llm.common import shared_dir

    conf = {"spark.checkpoint.dir": None}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(spark)



def test_rans_round_trip():
    r = np.random.default_rng(0)
    for n, high in ((1, 1), (5, 3), (token_rans.BLOCK + 12_345, 50_000), (70_000, 2)):
        ids = np.minimum(r.geometric(0.001, n) - 1, high) if high > 3 else r.integers(0, high, n)
        frame = token_rans.encode_shard([3, None, 7], np.array([n, 0, 0]), ids)
        docs, lengths, back = token_rans.decode_shard(frame)
        assert docs == [3, None, 7] and lengths.tolist() == [n, 0, 0] and (back == ids).all()
    ids = r.integers(0, 1000, token_rans.BLOCK + 500)
    frame = token_rans.encode_shard([1], np.array([len(ids)]), ids)
    assert (token_rans.decode_shard(frame, [1])[2] == ids[token_rans.BLOCK :]).all()
    assert list(token_rans.read_frames(frame + frame)) == [frame, frame]
    broken = bytearray(frame)
    broken[len(broken) // 4] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        token_rans.decode_shard(bytes(broken))


TEXTS = ["", None, "Plain words, here.", "a\xa0b   c", "it's 12½ x²\n\n  y", "<|endoftext|> in a text", " lead and trail \n", "tab\tand\x0bfeed", "\x85 next\x1cline", "日本語 text", "x" * 3000, "é mark", "don't 'quote' we'll"]


def test_pieces_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choices("ab ,.'\n\t9é😀Z-", k=40)) for _ in range(300)]
    whole, mine = Tokenizer.from_str(spec), token_rans.PieceTokenizer(spec, cache=50)
    for _ in range(2):
        got = [x.tolist() for x in mine.texts(pa.array(texts), budget=200)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_of_equal_hashes(monkeypatch):
    """Pieces whose hashes clash, and a hash of zero, still get their own ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    hashes = token_rans.segment_hashes
    monkeypatch.setattr(token_rans, "segment_hashes", lambda *a: hashes(*a) & np.uint64(7))
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    r = random.Random(1)
    texts = TEXTS + [" ".join("".join(r.choices("abcdef", k=r.randrange(1, 4))) for _ in range(50)) for _ in range(40)]
    mine, whole = token_rans.PieceTokenizer(spec), Tokenizer.from_str(spec)
    for _ in range(2):
        assert [x.tolist() for x in mine.texts(pa.array(texts), budget=300)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_file(spark):
    from tokenizers import Tokenizer

    rows = [(i * 7 % 31 - 3, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5, "b"), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("n_ids", F.lit(1))
    got = [tuple(r) for r in token_rans.token_file(docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()]
    t, want, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_rans.token_file(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


BASE = {
    "assign": re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"([0-9a-f]+)"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[m.lastindex]) >= LEAST[kind]]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets(spark):
    r = random.Random(4)
    hexes = ["".join(r.choices("0123456789abcdef", k=k)) for k in (23, 24, 40)]
    live = "Zx9" + "".join(r.choices("ABCDEFabcdef0123456789XYZ", k=30))
    copied = "Qw7" + "".join(r.choices("ABCDEFabcdef0123456789XYZ", k=30))
    texts = [f"é😀 password={hexes[0]} x", f'Token : "{hexes[2]}"', "api_key=abc", "APIKEY = 'abcdef'", "token=token:abcdefg secret=x", f"AKIA{'A' * 15} AKIA{'B' * 16}", hexes[1], "paſſword=abcdefgh toKen=abcdefgh", None, "", f"see {live} here"]
    rows = [(i, t, "one") for i, t in enumerate(texts)] + [(100 + i, f"doc {copied} {i}", f"s{i}") for i in range(5)] + [(0, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("x")).withColumn("found", F.lit(0))
    got = secrets.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        assert by[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [by[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in spans) for k in BASE]
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(by[i]["spans"].split(",")) | {""}
    assert f"generic:4:{4 + len(live)}" in by[10]["spans"] and by[100]["spans"] == ""
    assert secrets.scan(docs.limit(0)).count() == 0


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}, [5, 2, 1]) == {"a": 187.5, "b": 75, None: 37.5}
    t = mixing.targets({"a": 10, "b": 100, "c": 100}, [5, 2, 1])
    assert t["a"] == 30 and t["b"] == 120 and t["c"] == 60
    assert mixing.targets({}, [1]) == {}


def test_subset_sums():
    r = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(r.integers(1, 60, 6))
        counts = r.integers(0, 4, len(lengths))
        budget = int(r.integers(0, max(1, (lengths * counts).sum()) + 1))
        take = mixing.nearest_subset(lengths, counts, budget)
        sums = {0}
        for length, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + length * k for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and (lengths * take).sum() == max(s for s in sums if s <= budget)
    lengths = np.arange(1, 4000)
    counts = np.full(len(lengths), 50)
    take = mixing.fit_lengths(lengths, counts, 123_456_789)
    assert (lengths * take).sum() == 123_456_789 and (take <= counts).all() and (take >= 0).all()


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), ["a", "b", "c", None][i % 4]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b")] + [(2000, "same text here", "b")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x")).withColumn("target", F.lit(0)).withColumn("c", F.lit(1)).withColumn("k", F.lit(1))
    got = mixing.mix(docs, [5, 2, 1], seed=3).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    taken = (got["size"] * got["copies"]).groupby(got["source"].fillna("null")).sum()
    target = got.groupby(got["source"].fillna("null"))["target"].first()
    total = got.groupby(got["source"].fillna("null"))["size"].sum()
    assert (abs(taken - target) <= 1).all() and target.sum() == pytest.approx(total.sum())
    again = mixing.mix(docs.repartition(5), [5, 2, 1], seed=3).toPandas()
    key = lambda f: sorted(zip(f["doc_id"], f["copies"], strict=True))
    assert key(got) == key(again)
    kept = mixing.repeated(mixing.mix(docs, [5, 2, 1], seed=3))
    assert kept.count() == got["copies"].sum()
    assert mixing.mix(docs.limit(0), [1]).count() == 0


def test_fit_beyond_the_programme():
    fit = lambda lengths, counts, budget: mixing.fit_lengths(np.array(lengths), np.array(counts), budget).tolist()
    assert fit([1_000_000], [1], 900_000) == [1] and fit([1_000_000], [1], 400_000) == [0]
    assert fit([60], [1], 50) == [1] and fit([60], [1], 30) == [0]
    assert fit([40_000, 900_000], [2, 1], 80_001) == [2, 0] and fit([50_000, 900_000], [1, 1], 870_000) == [0, 1]
    r = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.unique(r.integers(5, 90, 5))
        counts = r.integers(0, 3, len(lengths))
        budget = int(r.integers(0, (lengths * counts).sum() + 1))
        below = mixing.nearest_subset(lengths, counts, budget)
        take = mixing.nearest_subset(lengths, counts, budget, budget - int((lengths * below).sum()))
        sums = {0}
        for length, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + length * k for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and abs((lengths * take).sum() - budget) == min(abs(s - budget) for s in sums)


def test_fit_of_long_documents():
    """Few long documents: the nearest of all sums."""
    r = np.random.default_rng(7)
    for _ in range(40):
        lengths = np.unique(r.integers(70_000, 400_000, r.integers(3, 9)))
        counts = r.integers(1, 5, len(lengths))
        budget = int(r.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit_lengths(lengths, counts, budget)
        sums = {0}
        for length, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + length * k for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all() and abs((lengths * take).sum() - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = np.array([206_280, 216_360, 284_032, 286_205]), np.array([2, 3, 1, 1])
    assert (lengths * mixing.fit_lengths(lengths, counts, 848_035)).sum() - 848_035 == -2755


def test_secrets_in_a_text_of_a_million_characters():
    for text in ("eyJ" * 350_000, "eyJ" + "a" * 1_000_000, "-----BEGIN PRIVATE " * 60_000, "token " * 170_000, "A1b" * 350_000 + " ", "secret" + " " * 1_000_000):
        began = time.perf_counter()
        secrets.base_spans(text)
        secrets.wider_spans(text)
        assert time.perf_counter() - began < 10
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF"
    assert ("jwt", 3, 3 + len(jwt), jwt) in secrets.wider_spans(f"at {jwt} end")


def test_secrets_go_by_owners(spark):
    """One owner's value stays in however many repositories; a value of three owners goes."""
    own, shared = "Zx9BcDeF0123abcdEF4567XYZ89abQ", "Qw7BcDeF0123abcdEF4567XYZ89abQ"
    rows = [(i, f"see {own}", "one") for i in range(25)] + [(100 + i, f"see {shared}", f"s{i}") for i in range(3)]
    got = {x["doc_id"]: (x["spans"], x["n_live"], x["n_copied"]) for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == ("generic:4:34", 1, 0) for i in range(25)) and all(got[100 + i] == ("", 0, 0) for i in range(3))


def test_secrets_at_the_limit_of_repositories(spark):
    r = random.Random(9)
    held = {i: [] for i in range(1000)}
    for _ in range(400):
        value = "Zx9" + "".join(r.choices("ABCDEFabcdef0123456789XYZ", k=31))
        for i in r.sample(range(1000), 11):
            held[i].append(value)
    rows = [(i, " ".join(v), "one") for i, v in held.items()]
    rows += [(2000 + i, "see Qw7BcDeF0123abcdEF4567XYZ89abQ twice Qw7BcDeF0123abcdEF4567XYZ89abQ", "two") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(docs, max_repos=10).collect()}
    assert not any(got[i] for i in range(1000)) and all(got[2000 + i].count("generic") == 2 for i in range(10))
