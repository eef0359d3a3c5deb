"""Token ids in a binary file format coded by a static range asymmetric numeral system (rANS).

Documents are put in ascending order of doc_id, tokenized with the tokenizers library, closed with an end id each and packed
into shards of whole documents, about ``shard_ids`` ids each. A shard is one self-contained frame of bytes:

    magic "LGR1" | header lengths | zlib(JSON header) | documents | frequency table | block payloads

The frequency table is static and shared by all blocks of the shard; it counts all ids of the shard, scaled to 2^SCALE.
Blocks of up to BLOCK ids are independent; in a block LANES states are interleaved, each id's lane being its index modulo
LANES, so that whole rows of lanes are coded by one vector operation. Every CHECK rows a checkpoint keeps the states and the
place in the words, with a CRC32 of the ids up to the next one, so that decoding may start at any block or checkpoint, in
parallel. The states are 63 bits wide and renormalise by 32-bit words.

A file is a Parquet table of frames with their order (part, shard) and sizes, written by Spark to any store it reads; the
frames of a table in order, one after another, are also a valid flat file (see read_frames).

Scale: texts shuffle once, to their range of doc_ids, and a task holds one shard's ids at a time.
Starts come from sums over parts, a row each. Tokenizing is by distinct pieces: a text is cut before white space that follows
other characters, where no token can cross, and the library encodes each distinct piece once a worker while the bounded cache
holds it; texts with unusual white space or special-token strings go to the library whole.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows with the same doc_id are ordered by
their text; an empty table writes no frame and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import BYTE_WORDS, SPACE, buffers, lean, segment_hashes, shared_dir, to_python

MAGIC = b"LGR1"
SCALE = 18
LANES = 2048
ROWS = 512
CHECK = 256
BLOCK = LANES * ROWS
SHARD_IDS = 1 << 21
LOW = np.uint64(1 << 31)

# ---- coding ----


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^SCALE, from counts of at least 1."""
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    freq = np.maximum(1, counts * (total - len(counts)) // counts.sum())
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    i = 0
    while over > 0:  # from the largest, which lose least
        cut = min(over, int(freq[order[i]]) - 1)
        freq[order[i]] -= cut
        over -= cut
        i += 1
    return freq


def encode_block(rank: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[list, bytes]:
    """Checkpoints [(row, words before it, states)] in decoding order and the 32-bit words; rank: symbols by table index."""
    n = len(rank)
    rows = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    parts, checks, emitted = [], [], 0
    f_all, s_all = freq.astype(np.uint64), start.astype(np.uint64)
    shift = np.uint64(63 - SCALE)
    for row in range(rows - 1, -1, -1):
        symbols = rank[row * LANES : (row + 1) * LANES]
        m = len(symbols)
        f, x = f_all[symbols], state[:m]
        full = np.flatnonzero(x >= (f << shift))
        if len(full):
            parts.append(x[full].astype(np.uint32))  # the low word
            emitted += len(full)
            x[full] >>= np.uint64(32)
        q = x // f
        state[:m] = (q << np.uint64(SCALE)) + (x - q * f) + s_all[symbols]
        if row % CHECK == 0:
            checks.append((row, emitted, state.copy()))
    checks = [(row, emitted - at, s) for row, at, s in reversed(checks)]
    words = np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)
    return checks, words.astype("<u4").tobytes()


def decode_rows(words: np.ndarray, at: int, state: np.ndarray, n: int, slots: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """n table indices from a checkpoint: words from place at on, the lanes' states."""
    out = np.empty(n, np.int64)
    mask, state = np.uint64((1 << SCALE) - 1), state.copy()
    bias = np.arange(1 << SCALE, dtype=np.uint64) - start.astype(np.uint64)[slots]
    f_all = freq.astype(np.uint64)
    for i in range(0, n, LANES):
        m = min(LANES, n - i)
        x = state[:m]
        low = x & mask
        symbols = slots[low]
        out[i : i + m] = symbols
        x = f_all[symbols] * (x >> np.uint64(SCALE)) + bias[low]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
        state[:m] = x
    return out


def encode_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame: the documents' ids and numbers of token ids, and all their token ids."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, table = counts[symbols], np.zeros(len(counts), np.int32)
    table[symbols] = np.arange(len(symbols))
    rank = table[ids]
    freq = scaled(counts)
    start = np.cumsum(freq) - freq
    blocks, payloads = [], []
    for b in range(0, len(ids), BLOCK):
        piece = ids[b : b + BLOCK]
        checks, words = encode_block(rank[b : b + BLOCK], freq, start)
        crc = [zlib.crc32(piece[r * LANES : (r + CHECK) * LANES].astype("<u4").tobytes()) for r, _, _ in checks]
        states = b"".join(s.astype("<u8").tobytes() for _, _, s in checks)
        blocks.append({"n": len(piece), "checks": [[r, at, c] for (r, at, _), c in zip(checks, crc, strict=True)], "bytes": [len(states), len(words)]})
        payloads += [states, words]
    ints = np.array([-1 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits([d is None for d in doc_ids]).tobytes()
    docs = zlib.compress(np.diff(ints, prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + null, 1)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    header = zlib.compress(json.dumps({"docs": len(doc_ids), "ids": len(ids), "symbols": len(symbols), "scale": SCALE, "lanes": LANES, "blocks": blocks}).encode())
    body = docs + table + b"".join(payloads)
    return MAGIC + struct.pack("<IIIQ", len(header), len(docs), len(table), len(body)) + header + body


def decode_shard(frame: bytes, blocks: list[int] | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of token ids, and the token ids of all or the named blocks; checks every CRC32."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame")
    n_header, n_docs, n_table, n_body = struct.unpack_from("<IIIQ", frame, 4)
    at = 4 + struct.calcsize("<IIIQ")
    header = json.loads(zlib.decompress(frame[at : at + n_header]))
    if (header["scale"], header["lanes"]) != (SCALE, LANES):
        raise ValueError("a frame of other parameters")
    at += n_header
    raw, n = zlib.decompress(frame[at : at + n_docs]), header["docs"]
    null = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool)
    doc_ids = [None if z else int(d) for d, z in zip(np.cumsum(np.frombuffer(raw, "<i8", n)), null, strict=True)]
    lengths = np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)
    raw, k = zlib.decompress(frame[at + n_docs : at + n_docs + n_table]), header["symbols"]
    symbols, freq = np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, "<u4", k, 4 * k).astype(np.int64)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(k), freq)
    at += n_docs + n_table
    out = []
    for i, block in enumerate(header["blocks"]):
        n_states, n_words = block["bytes"]
        if blocks is None or i in blocks:
            states = np.frombuffer(frame, "<u8", n_states // 8, at).reshape(-1, LANES).astype(np.uint64)
            words = np.frombuffer(frame, "<u4", n_words // 4, at + n_states).astype(np.uint64)
            for (row, place, crc), state in zip(block["checks"], states, strict=True):
                ids = symbols[decode_rows(words, place, state, min(block["n"] - row * LANES, CHECK * LANES), slots, freq, start)]
                if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                    raise ValueError(f"block {i}, row {row}: checksum")
                out.append(ids)
        at += n_states + n_words
    return doc_ids, lengths, np.concatenate(out) if out else np.zeros(0, np.int64)


def read_frames(data: bytes) -> Iterator[bytes]:
    """The frames of a flat file."""
    at = 0
    while at < len(data):
        n_header, _, _, n_body = struct.unpack_from("<IIIQ", data, at + 4)
        end = at + 4 + struct.calcsize("<IIIQ") + n_header + n_body
        yield data[at:end]
        at = end


# ---- tokenizing ----

ODD_SPACE = re.compile("[\x1c-\x1f" + "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp") or c == 0x85) + "]")
CACHE = 400_000
#: of a byte: 1 white space, 2 punctuation that ends a run of letters (an apostrophe may not), 3 an ASCII letter
KIND = np.where(SPACE, 1, 0).astype(np.int8)
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
KIND[[b for b in range(128) if chr(b).isalpha()]] = 3


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the rest as the letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTokenizer:
    """Token ids of many texts; the library encodes each distinct piece once while the cache holds it.

    The cache finds pieces by a 64-bit hash of their bytes: first in a table with a slot a piece, then, for pieces whose slot
    was taken, in sorted arrays. The bytes of what is found are compared with the piece's; pieces of equal hashes and other
    bytes are encoded anew. The cache is emptied when it holds more than ``cache`` pieces.
    """

    SLOTS = 1 << 20

    def __init__(self, spec: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model, self.letters, self.cache = self.whole.model, byte_letters(), cache
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD_SPACE.pattern, *map(re.escape, special)]))
        rules = json.loads(spec)
        pre = rules.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not rules.get("normalizer")
        self.clear()

    def clear(self) -> None:
        self.slot_hash, self.slot_number = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.length, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.int32), 0
        self.byte_at, self.size, self.bytes, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint8), 0

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Pieces of one space and letters are one token of the pre-tokenizer, which the model takes as it is."""
        out: list = []
        rest: list[int] = []
        tokenize, letters = self.model.tokenize, self.letters
        for i, p in enumerate(pieces):
            if p.isalpha() or (p[:1] == " " and p[1:].isalpha()):
                out.append([t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))])
            else:
                out.append(None)
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _numbers(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """The number in the cache of each piece; new pieces enter it."""
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.slot_number[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if not len(miss):
            return out
        distinct, where, number = np.unique(h[miss], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        found = np.zeros(len(distinct), bool)
        if len(self.hashes):
            found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        k = np.zeros(len(distinct), np.int64)
        k[found] = self.numbers[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            at_new = miss[where[new]]
            k[new] = self._entered([raw[a:b] for a, b in zip(starts[at_new].tolist(), ends[at_new].tolist(), strict=True)])
            fresh = distinct[new]
            slots = (fresh & np.uint64(self.SLOTS - 1)).astype(np.int64)
            free = self.slot_hash[slots] == 0
            self.slot_hash[slots[free]], self.slot_number[slots[free]] = fresh[free], k[new][free]
            lost = self.slot_hash[slots] != fresh
            self.hashes, self.numbers = np.concatenate([self.hashes, fresh[lost]]), np.concatenate([self.numbers, k[new][lost]])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.numbers = self.hashes[order], self.numbers[order]
        out[miss] = k[number]
        return out

    def _entered(self, raw: list[bytes]) -> np.ndarray:
        """The numbers of new pieces: their ids and bytes are kept."""
        pieces = self._encode([r.decode() for r in raw])
        lengths, sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (pieces, raw))
        flat = np.fromiter(chain.from_iterable(pieces), np.int32, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + int(sizes.sum()) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.bytes[self.held : self.held + int(sizes.sum())] = np.frombuffer(b"".join(raw), np.uint8)
        numbers = len(self.first) + np.arange(len(raw))
        self.first, self.length = np.concatenate([self.first, self.used + np.cumsum(lengths) - lengths]), np.concatenate([self.length, lengths])
        self.byte_at, self.size = np.concatenate([self.byte_at, self.held + np.cumsum(sizes) - sizes]), np.concatenate([self.size, sizes])
        self.used, self.held = self.used + len(flat), self.held + int(sizes.sum())
        return numbers

    def _checked(self, k: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, raw: bytes) -> np.ndarray:
        """k, with new numbers for pieces whose bytes are not those of the number found; pieces follow one another."""
        sizes = ends - starts
        other = sizes != self.size[k]
        if not other.any():
            held = self.bytes[np.repeat(self.byte_at[k] - starts, sizes) + np.arange(len(data))]
            if (held == data).all():
                return k
            other = np.add.reduceat(held != data, starts) > 0
        else:
            other |= np.array([raw[a:b] != self.bytes[c : c + b - a].tobytes() for a, b, c in zip(starts.tolist(), ends.tolist(), self.byte_at[k].tolist(), strict=True)], bool)
        out = k.copy()
        out[other] = self._entered([raw[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        return out

    def texts(self, column: pa.Array, budget: int = 2 << 20) -> Iterator[np.ndarray]:
        """Token ids of each text in order; bytes beyond the budget wait for the next round."""
        data, at = buffers(column)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + budget, "right")) - 1)
            yield from self._some(data[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j

    def _some(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        raw = data.tobytes()
        odd = [not self.by_piece] * (len(at) - 1)
        if self.by_piece and self.odd.search(raw.decode()):
            odd = [bool(self.odd.search(raw[a:b].decode())) for a, b in zip(at[:-1], at[1:], strict=True)]
        kind = KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 2) & (kind[:-1] == 3))
        cut[at[:-1][at[:-1] < at[-1]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(self.first) > self.cache:
            self.clear()
        k = self._numbers(segment_hashes(data, starts, ends, BYTE_WORDS) | np.uint64(1), starts, ends, raw)  # 0 is a free slot
        k = self._checked(k, starts, ends, data, raw)
        bounds = np.searchsorted(starts, at)
        length = self.length[k]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(self.first[k] - total[:-1], length) + np.arange(total[-1])]
        for d in range(len(at) - 1):
            if odd[d]:
                yield np.array(self.whole.encode(raw[at[d] : at[d + 1]].decode(), add_special_tokens=False).ids, np.int32)
            else:
                yield flat[total[bounds[d]] : total[bounds[d + 1]]]


_tokenizers: dict[str, PieceTokenizer] = {}


def _tokenizer(spec: str) -> PieceTokenizer:
    """One a worker process, so that the next task finds the cache filled."""
    if spec not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[spec] = PieceTokenizer(spec)
    return _tokenizers[spec]


# ---- tables ----

FRAMES = "part int, shard int, n_docs long, n_ids long, frame binary"


def _encoder(spec: str, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokenizer(spec), TaskContext.get().partitionId()
        shard, docs, pieces, held = 0, [], [], 0

        def frame() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in pieces], np.int64)
            data = encode_shard(docs, lengths, np.concatenate(pieces).astype(np.int64))
            types = [("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("frame", pa.binary())]
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(docs), "n_ids": held, "frame": data}], pa.schema(types))

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), tokens.texts(batch.column("text")), strict=True):
                if held >= shard_ids:
                    yield frame()
                    docs, pieces, held, shard = [], [], 0, shard + 1
                docs.append(d)
                pieces.append(np.append(t, np.int32(end_id)))
                held += len(t) + 1
        if docs:
            yield frame()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the frames of docs (doc_id, text) to path, in ascending doc_id order; tokenizer: a tokenizers JSON file's text.

    A part is a range of doc_ids, as many as shuffle partitions, whose shards one task writes in order.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = to_python(docs.select(F.col("doc_id").cast("long"), "text"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(_encoder(tokenizer, end_id, shard_ids)), FRAMES).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, frame in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("frame"), strict=True):
            doc_ids, lengths, ids = decode_shard(frame.as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends, strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    frames = spark.read.parquet(path)
    sizes = frames.select("part", "shard", "n_ids")
    before = lambda *by: F.coalesce(F.sum("n_ids").over(Window.partitionBy(*by).orderBy("shard" if by else "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before().alias("p"))
    shards = sizes.select("part", "shard", before("part").alias("s"))
    docs = frames.mapInArrow(lean(_decode), "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = docs.join(shards.join(parts, "part"), ["part", "shard"])
    return placed.select("doc_id", (F.col("p") + F.col("s") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids and return what their files hold (see read_index)."""
    import uuid

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    path = f"{shared_dir(spark)}/loomgraph-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, spec, end_id)
    return read_index(spark, path)


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
