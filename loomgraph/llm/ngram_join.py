"""N-gram Jaccard join of texts by parity sketches.

A text's set is its distinct five-word shingles; two texts link when their sets' Jaccard similarity is at least 0.75. The
result is each text's connected component and number of shingles; texts with equal sets form one class, and links are
between classes.

Sketch. In a size band each shingle falls by its hash into one of C chunks, and is XORed, as a 64-bit word, into the chunk's
parity word. An element of the symmetric difference of two sets changes one chunk, so the Hamming distance of two sketches,
counted in words, is at most the size of the symmetric difference. A pair that links with sizes a and b has a difference of
at most D = (a + b) / 7, so at least C - D of their chunk words agree (pigeonhole). Bands are powers of two; a set that may
link to one of the next band has a sketch in that band too.

Candidates. With one order of all chunk words, frequent ones last, each set needs to post only its D + 1 rarest words (D for
its largest partner): of the C - D words two linked sets share, the rarest is among the posted ones of both. The order comes
from a table of the corpus's most frequent words of bounded size; any order gives the same result, a good one keeps passages
that many texts share from filling buckets.

Candidate pairs are first held against bit sketches of the whole sets, two to six bits a shingle: each shingle flips one bit,
so their Hamming distance, too, is at most the symmetric difference, and pairs beyond (a + b) / 7 drop out. Sketches of
different lengths are folded to the shorter one by XOR, which keeps the bound.

Verification is on the sets of whole texts, by a second hash of each shingle that is independent of the one that found the pair. A bucket first pairs each member with its smallest member. Linked classes
are contracted, and only buckets that still hold members of different components look further, buckets of equal members once:
they are dealt in blocks to tasks that compare bit sketches across components by vector operations. What leaves such a task is
a row for each member that has a partner within the bound, never a pair. These members meet once more, with their texts, in the
same blocks; there pairs are verified, and linked components are united at once, so that a block returns a forest: true links,
fewer than it has members. The first look takes one bucket of those with the same components, and after another contraction
all that are left are taken. Every pair that links shares a bucket and passes the bounds, so the components are exact.

Scale: texts are read where they lie; what moves is posted words (20 bytes each, about n / 3 of a text's n shingles), compressed
texts of classes that have a candidate, and links. Words of more than ``HOT`` classes are dealt by salts, so that no bucket
meets in one task; blocks are bounded by members and by shingles. Sets are identified by 64-bit hashes of their shingles.

Defined cases: null texts and texts without words have n_shingles 0 and are components of their own; repeated rows share
their component; a null doc_id is no smallest id: its component_id is the smallest other one, or null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loomgraph.llm.common import buffers, lean, mix, small_enough, to_python, written
from loomgraph.llm.components import components
from loomgraph.llm.shingles import set_ids, shingle_sets

MIN_CHUNKS = 16
BLOCK = 3000  #: members of a bucket that are compared in one piece
BLOCK_SHINGLES = 2_000_000  #: shingles of a block
HOT = 100_000  #: classes of a chunk word that meet in one task; more are dealt by salts
FILTER_BITS = 1 << 25  #: of the filter of classes that have a candidate
BROADCAST_ROWS = 2_000_000  #: rows of numbers that are broadcast to where texts lie; beyond it both sides move
FREQUENT = 1_000_000  #: entries of the table of frequent chunk words
FREQUENT_FROM = 6
BITS = (256, 16_384)  #: least and most bits of a class's bit sketch


def _sketch(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, chunk, key) of the non-empty chunk words of the sets in their own band, or the next one (up), and each band."""
    with np.errstate(divide="ignore"):
        band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64) + up
    bits = np.maximum(band, int(np.log2(MIN_CHUNKS)))
    chunk = (flat >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])
    at = np.flatnonzero(new)
    word = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x51ED270B)), at) if len(at) else np.zeros(0, np.uint64)
    whose, which = owner[at], chunk[at]
    key = mix(word ^ mix((band[whose].astype(np.uint64) << np.uint64(40)) + which.astype(np.uint64)))
    return whose, which, key, band


def _empty_key(band: int, chunk: int) -> int:
    return int(mix(mix(np.array([(band << 40) + chunk], np.uint64)))[0])


def sketches(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the two bands of a set: owner, chunk and key of its chunk words, the bands, and how many words each set posts.

    In its own band a set meets partners up to the band's end; in the next one, larger partners of at most 4/3 its size.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    end = (np.int64(2) << own) - 1
    whose, which, key, band = _sketch(flat, owner, sizes, False)
    yield whose, which, key, band, (sizes + np.minimum(4 * sizes // 3, end)) // 7 + 1
    up = 4 * sizes // 3 > end
    if up.any():
        kept = up[owner]
        whose, which, key, band = _sketch(flat[kept], owner[kept], sizes, True)
        yield whose, which, key, band, np.where(up, (sizes + 4 * sizes // 3) // 7 + 1, 0)


def posted(flat: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the words that the sets post; frequent: sorted keys, rank: their places in the order, rare ones 0."""
    sets, keys = [], []
    for whose, which, key, band, post in sketches(flat, sizes):
        if not len(key):
            continue
        order = np.zeros(len(key), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
            hit = frequent[at] == key
            order[hit] = rank[at[hit]]
        value = (order.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
        begin = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        count = np.diff(np.append(begin, len(whose)))
        keep = np.ones(len(key), bool)
        for b, c in zip(begin.tolist(), count.tolist(), strict=True):
            p = int(post[whose[b]])
            if p < c:
                v = value[b : b + c]
                keep[b : b + c] = v <= np.partition(v, p - 1)[p - 1]  # equal values are all posted
            elif p > c:  # then empty chunks are posted too, in their order
                chunks = max(MIN_CHUNKS, 1 << int(band[whose[b]]))
                free = sorted(set(range(chunks)) - set(which[b : b + c].tolist()))[: p - c]
                sets.append(np.full(len(free), whose[b]))
                keys.append(np.array([_empty_key(int(band[whose[b]]), x) for x in free], np.uint64))
        sets.append(whose[keep])
        keys.append(key[keep])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


class _Classes:
    """Which sets a task has not met before; forgets all beyond a bound, which only costs repeated rows."""

    def __init__(self, bound: int = 2_000_000):
        self.seen: set[int] = set()
        self.bound = bound

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.bound:
            self.seen.clear()
        out = np.zeros(len(ids), bool)
        for i, x in enumerate(ids.tolist()):
            if x and x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _only(flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[np.repeat(keep, sizes)], sizes[keep]


_SETS = "doc_id long, n int, cid long, key long, cnt long"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows of chunk words that a run of a task's classes holds repeatedly."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cid", pa.int64()), ("key", pa.int64()), ("cnt", pa.int64())])
    classes, held, total = _Classes(), [], 0

    def counted() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        keys, counts = keys[counts > 1], counts[counts > 1]
        none = pa.nulls(len(keys))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)

    for batch in batches:
        docs, at = batch.column("doc_id"), 0
        for flat, sizes in shingle_sets(batch.column("text")):
            ids = set_ids(flat, sizes)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([docs.slice(at, len(ids)), pa.array(sizes.astype(np.int32)), pa.array(ids), none, none], schema=schema)
            at += len(ids)
            for _, _, key, _, _ in sketches(*_only(flat, sizes, classes.fresh(ids))):
                held.append(key)
                total += len(key)
            if total > 1_500_000:
                yield counted()
                held, total = [], 0
    if total:
        yield counted()


def _poster(shared: Broadcast):  # noqa: ANN202
    """shared: sorted frequent keys, their places in the order, sorted hot keys and over how many salts each is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        frequent, rank, hot, salts = shared.value
        for batch in batches:
            for flat, sizes in shingle_sets(batch.column("text")):
                ids = set_ids(flat, sizes)
                fresh = classes.fresh(ids)
                whose, keys = posted(*_only(flat, sizes, fresh), frequent, rank)
                out = {"key": pa.array(keys.view(np.int64)), "cid": pa.array(cid := ids[fresh][whose])}
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                    own, salt = np.flatnonzero(hot[at] == keys), np.full(len(keys), -1, np.int32)
                    salt[own] = (mix(cid[own].view(np.uint64)) % salts[at[own]]).astype(np.int32)
                    out["salt"] = pa.array(salt)
                yield pa.RecordBatch.from_pydict(out)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, salt and cid: the members of each bucket with the smallest. Buckets of one member and, in a
    task, repeated ones are left out; of a salted key (salt 0 and above) every part stays."""
    seen: set[bytes] = set()
    none = np.full(1, -1, np.int32)
    held: list[tuple] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None and len(batch):
            salt = batch.column("salt").to_numpy() if "salt" in batch.schema.names else none.repeat(len(batch))
            held.append((batch.column("key").to_numpy(), salt, batch.column("cid").to_numpy()))
            size += len(batch)
            if size < 1 << 16 or held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1] and size < 1 << 22:
                continue
        if not held or batch is not None and not len(batch):
            continue
        key, salt, cid = (np.concatenate(c) for c in zip(*held, strict=True))
        other = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        new = other.copy()
        new[1:] |= cid[1:] != cid[:-1]
        key, salt, cid, begin = key[new], salt[new], cid[new], np.flatnonzero(other[new])
        done = len(key) if batch is None else int(begin[-1])
        if batch is not None and done == 0:  # one bucket larger than the buffer: its members go out in parts that share the first
            yield _members(key, salt, cid, np.full(len(key), cid[0]))
            held, size = [(key[:1], salt[:1], cid[:1])], 1
            continue
        begin = begin[begin < done]
        count = np.diff(np.append(begin, done))
        some = (count > 1) | (salt[begin] >= 0)
        begin, count = begin[some], count[some]
        if len(begin):
            rows = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            members = cid[rows]
            place = np.cumsum(count) - count
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(members.view(np.uint64)), place)
                xors = np.bitwise_xor.reduceat(members.view(np.uint64), place)
            mark = np.stack([sums, xors, count.astype(np.uint64)], 1)
            _, one = np.unique(mark, axis=0, return_index=True)
            if len(seen) > 500_000:
                seen.clear()
            keep = salt[begin] >= 0
            for i in one.tolist():
                m = mark[i].tobytes()
                if m not in seen:
                    seen.add(m)
                    keep[i] = True
            stay = np.repeat(keep, count)
            yield _members(*(np.repeat(x, count)[stay] for x in (key[begin], salt[begin])), members[stay], np.repeat(cid[begin], count)[stay])
        held, size = [(key[done:], salt[done:], cid[done:])] if done < len(key) else [], len(key) - done


def _members(bucket: np.ndarray, salt: np.ndarray, cid: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(salt), pa.array(cid), pa.array(pivot)], ["bucket", "salt", "cid", "pivot"])


def _packer(shared: Broadcast):  # noqa: ANN202
    """shared: a filter of the classes that are needed; it lets others pass now and then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The size, bit sketch and compressed text of each class of a task."""
        classes, packer, words = _Classes(), zstandard.ZstdCompressor(3), shared.value
        for batch in batches:
            text, at = batch.column("text"), 0
            for flat, sizes in shingle_sets(text):
                ids = set_ids(flat, sizes)
                fresh = np.flatnonzero(classes.fresh(ids) & _passes(ids, words))
                data, offsets = buffers(text.slice(at, len(ids)))
                packed = [packer.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in fresh]
                ends = np.cumsum(sizes)
                bits = [bit_sketch(flat[ends[i] - sizes[i] : ends[i]]) for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array(sizes[fresh].astype(np.int32)), pa.array(bits, pa.binary()), pa.array(packed, pa.binary())], ["cid", "n", "bits", "packed"])
                at += len(ids)

    return run


def _filter_of(needed: DataFrame) -> np.ndarray:
    """A bit for the hash of each class of needed (cid); FILTER_BITS bits, however many classes there are."""
    slot = F.shiftrightunsigned("cid", 64 - FILTER_BITS.bit_length() + 1)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = needed.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = ids.view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Bits that each shingle flips one of; their number is a power of two, three to six times the shingles', within BITS."""
    bits = min(max(BITS[0], 1 << int(3 * len(shingles) - 1).bit_length()), BITS[1])
    flips = np.bincount((mix(shingles + np.uint64(0xB5297A4D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """The Hamming distance of two bit sketches, the longer one folded; at most their sets' symmetric difference."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


class _Block:
    """Members of a block: those within the bounds of a member and of another component."""

    def __init__(self, rows: pa.Table):
        col = lambda c: rows.column(c).to_numpy()
        self.cid, self.n, self.side = col("cid"), col("n").astype(np.int64), col("side")
        self.label = np.unique(col("root"), return_inverse=True)[1]
        bits = rows.column("bits").to_pylist()
        length = min(map(len, bits))
        self.words = np.stack([_folded(b, length) for b in bits])
        left = np.flatnonzero(self.side == 0)
        right = np.flatnonzero(self.side == 1)
        self.left, self.right, self.same = left, right if len(right) else left, not len(right)

    def near(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each member of the left side: partners on the right side, each pair once, and their distances."""
        for at, i in enumerate(self.left.tolist()):
            js = self.right[at + 1 :] if self.same else self.right
            n = self.n[js]
            js = js[(self.label[js] != self.label[i]) & (4 * np.minimum(n, self.n[i]) >= 3 * np.maximum(n, self.n[i]))]
            if len(js):
                apart = np.bitwise_count(self.words[js] ^ self.words[i]).sum(1).astype(np.int64)
                close = 7 * apart <= self.n[js] + self.n[i]
                if close.any():
                    yield i, js[close], apart[close]

    def unite(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]


def _folded(bits: bytes, length: int) -> np.ndarray:
    w = np.frombuffer(bits, "<u8")
    while len(w) * 8 > length:
        half = len(w) // 2
        w = w[:half] ^ w[half:]
    return w


@F.pandas_udf(BinaryType())
def _shorter(bits: pd.Series) -> pd.Series:
    """Sketches folded to half their length, for buckets; pairs that pass are held against the whole ones."""
    return bits.map(lambda b: _folded(bytes(b), max(len(b) // 2, 8)).tobytes())


BLOCK_KEYS = ["bucket", "bi", "bj"]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from rows sorted by BLOCK_KEYS."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BLOCK_KEYS], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and not (keys[a] == last).all():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a partner within the bounds, a row each."""
    for rows in _by_block(batches):
        block = _Block(rows)
        some = np.zeros(len(block.cid), bool)
        for i, js, _ in block.near():
            some[i] = True
            some[js] = True
        for out in rows.select([*BLOCK_KEYS, "side", "cid", "root"]).filter(pa.array(some)).to_batches():
            yield out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each block that unite all its components that link; fewer than it has members."""
    for rows in _by_block(batches):
        block, us, vs = _Block(rows), [], []
        sets = _Sets(rows.column("packed"))
        for i, js, apart in block.near():
            js = js[np.argsort(apart, kind="stable")]
            while len(js := js[block.label[js] != block.label[i]]):
                now, js = js[:64], js[64:]
                for j in now[sets.linked(i, now)].tolist():
                    if block.label[j] != block.label[i]:
                        block.unite(i, j)
                        us.append(min(block.cid[i], block.cid[j]))
                        vs.append(max(block.cid[i], block.cid[j]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _unpacked(packed: bytes) -> np.ndarray:
    text = zstandard.ZstdDecompressor().decompress(packed)
    return next(iter(shingle_sets(pa.array([text], pa.binary()).cast(pa.string()), other=True)))[0]


class _Sets:
    """The shingle sets of packed texts, unpacked when they are asked for."""

    def __init__(self, packed: pa.ChunkedArray):
        self.packed, self.known = packed, {}

    def of(self, i: int) -> np.ndarray:
        if i not in self.known:
            self.known[i] = _unpacked(self.packed[i].as_py())
        return self.known[i]

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        """Which of the sets js have a Jaccard similarity of at least 0.75 with the set i."""
        x, others = self.of(i), [self.of(j) for j in js.tolist()]
        size = np.array([len(y) for y in others])
        flat = np.concatenate(others)
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        return 100 * both >= 75 * (len(x) + size - both)


STAR_KEYS = ["u", "b"]


def _star(check, column: str):  # noqa: ANN001, ANN202
    """The partners that pass check(pivot, partner), from rows sorted by STAR_KEYS and side: each block's pivot, then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("b", pa.int32()), ("v", pa.int64())])
        last = pivot = None
        for batch in batches:
            out = []
            rows = (batch.column(c).to_pylist() for c in (*STAR_KEYS, "cid", "n"))
            for u, b, cid, n, x in zip(*rows, batch.column(column), strict=True):
                if (u, b) != last:
                    last, pivot = (u, b), (n, x.as_py(), {})
                elif check(pivot, (n, x.as_py(), {})):
                    out.append((u, b, cid))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def _close(pivot: tuple, partner: tuple) -> bool:
    (m, a, _), (n, b, _) = pivot, partner
    return 4 * min(m, n) >= 3 * max(m, n) and hamming(a, b) <= (m + n) // 7


def _links(pivot: tuple, partner: tuple) -> bool:
    x, y = (row[2].get("set") if "set" in row[2] else row[2].setdefault("set", _unpacked(row[1])) for row in (pivot, partner))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _star_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes that link; texts: (cid, n, bits, packed) of classes. What a pivot u has moves once a block."""

    def passed(pairs: DataFrame, check, column: str) -> DataFrame:  # noqa: ANN001
        partners = pairs.select(*STAR_KEYS, F.lit(1).alias("side"), F.col("v").alias("cid"))
        members = partners.union(pairs.select(*STAR_KEYS, F.lit(0), F.col("u")).distinct())
        members = F.broadcast(members) if small_enough(pairs, BROADCAST_ROWS) else members
        placed = texts.select("cid", "n", column).join(members, "cid")
        rows = placed.repartition(*STAR_KEYS).sortWithinPartitions(*STAR_KEYS, "side").select(*STAR_KEYS, "cid", "n", column)
        return rows.mapInArrow(lean(_star(check, column)), "u long, b int, v long")

    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = pairs.join(counts, "u", "left").select("u", F.coalesce(F.pmod(F.xxhash64("v"), "blocks"), F.lit(0)).cast("int").alias("b"), "v")
    near = written(passed(dealt, _close, "bits"), "near")
    return passed(near, _links, "packed").select("u", "v")


def _block_links(buckets: DataFrame, texts: DataFrame, roots: DataFrame, once: bool) -> DataFrame:
    """Verified links between components within buckets that hold several; once: a first look, in one bucket of those with
    the same smallest and largest components."""
    info = texts.select("cid", "n").join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    hint = lambda df, known: F.broadcast(df) if small_enough(known, BROADCAST_ROWS) else df
    marked = buckets.join(hint(info, texts.select("cid")), "cid")
    whole = (F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("s"), F.bit_xor("cid").alias("x"), F.count("*").alias("c"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    several = marked.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), blocks, *whole).filter("a <> b")
    several = several.groupBy("s", "x", "c").agg(F.min_by(F.struct("bucket", "a", "b", "blocks"), "bucket").alias("i")).select("i.*")
    if once:
        several = several.groupBy("a", "b").agg(F.max_by(F.struct("bucket", "blocks"), F.struct("blocks", "bucket")).alias("i")).select("i.*")
    members = marked.join(several.select("bucket", "blocks"), "bucket").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = members.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"), (F.col("own") > F.col("to")).cast("int").alias("side"), "bucket", "cid", "root")
    sketched = dealt.join(texts.select("cid", "n", _shorter("bits").alias("bits")), "cid")
    near = sketched.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    near = written(near.mapInArrow(lean(_partnered), "bucket long, bi int, bj int, side int, cid long, root long"), "partnered")
    alike = near.groupBy(*BLOCK_KEYS).agg(F.sum(F.xxhash64("cid", "side").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("side", "cid")).alias("x"), F.count("*").alias("c"))
    alike = alike.groupBy("s", "x", "c").agg(F.min(F.struct(*BLOCK_KEYS)).alias("i")).select("i.*")
    placed = texts.select("cid", "n", "bits", "packed").join(hint(near.join(alike, BLOCK_KEYS, "left_semi"), near), "cid")
    return placed.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(lean(_forest), "u long, v long")


def jaccard_components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); hot: see HOT, and the module's text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = to_python(docs.select("text"))
    first = written(docs.mapInArrow(lean(_sets), _SETS), "sets")
    rows = first.filter("n is not null").select("doc_id", "n", "cid")
    words = first.filter("n is null").groupBy("key").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= FREQUENT_FROM)
    table = words.orderBy(F.desc("cnt"), "key").limit(FREQUENT).toPandas()
    keys, cnt = table["key"].to_numpy(np.int64).view(np.uint64), table["cnt"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, cnt = keys[order], cnt[order]
    many = cnt > hot
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast((keys, np.minimum(cnt, (1 << 24) - 1), keys[many], (-(-cnt[many] // hot)).astype(np.uint64)))

    by = ["key", "salt"] if many.any() else ["key"]
    post = texts.mapInArrow(lean(_poster(shared)), "key long, cid long" + (", salt int" if many.any() else ""))
    buckets = post.repartition(*by).sortWithinPartitions(*by, "cid")
    buckets = written(buckets.mapInArrow(lean(_buckets), "bucket long, salt int, cid long, pivot long"), "buckets")
    stars = buckets.filter("cid <> pivot").select(F.col("pivot").alias("u"), F.col("cid").alias("v"))
    if many.any():  # the parts of a salted word hang on its smallest member
        parts = buckets.filter("salt >= 0").select("bucket", "pivot").distinct()
        least = parts.groupBy("bucket").agg(F.min("pivot").alias("u"))
        stars = stars.union(parts.join(least, "bucket").filter("u <> pivot").select("u", F.col("pivot").alias("v")))
    stars = written(stars.distinct(), "stars")
    needed = stars.select(F.col("u").alias("cid")).union(stars.select("v")).distinct()
    packed = texts.mapInArrow(lean(_packer(spark.broadcast(_filter_of(needed)))), "cid long, n int, bits binary, packed binary")
    packed = written(packed.join(needed, "cid", "left_semi").dropDuplicates(["cid"]), "packed")
    links = written(_star_links(stars, packed), "links")
    roots = components(links)
    for once in (True, False):
        more = written(_block_links(buckets.select("bucket", "cid"), packed, roots, once), "more-links")
        if more.limit(1).count():
            links = written(links.union(more), "links")
            roots = components(links)

    label = lambda df: df.join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    class_min = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("m"))
    whole = label(class_min)
    smallest = whole.groupBy("root").agg(F.min("m").alias("component_id"))
    by_class = whole.join(smallest, "root").select("cid", "component_id")
    out = rows.withColumn("cid", F.when(F.col("n") > 0, F.col("cid"))).join(by_class, "cid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; rows that repeat a doc_id are one document."""
    groups = written(jaccard_components(docs), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = written(groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.max(stays).alias("stays")).filter("not stays").select("_gone"), "gone")
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    again = groups.filter(stays).groupBy("doc_id").count().filter("count > 1")
    return kept.dropDuplicates(["doc_id"]) if again.limit(1).count() else kept


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


