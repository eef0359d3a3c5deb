"""Shared pieces: written tables in the cluster's shared folder, and vectorised hashing of text segments."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, as in tests, a temporary one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _own_dir[0]


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Delete the tables made by written(); called when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is then the cluster's to clear
            return


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


ARROW_ROWS = 2000


def to_python(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in batches of at most ARROW_ROWS rows; lowers the session's setting if it is above."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker process gives the memory it no longer needs back to the machine: workers wait for their next task
    beside the executor's JVM, and what they hold counts against it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return task


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


# ---- hashing of byte segments, vectorised ----

_rng = np.random.default_rng(20240229)
BYTE_WORDS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_WORDS = BYTE_WORDS[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
OTHER_WORDS = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_WORDS = OTHER_WORDS[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
LONG = 32  #: bytes beyond which a segment is hashed by XXH64
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, _PIECE)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray = LOWER_WORDS) -> np.ndarray:
    """64-bit hash of data[start:end] for each ascending, non-overlapping segment; pieces of about 256 KB at a time.

    A polynomial modulo 2^64 over the values that words gives to bytes, whatever its base, maps some long segments alike, such as
    a Thue-Morse sequence of 1,024 bytes and its complement; segments beyond LONG bytes, their A-Z lowered, are hashed by XXH64.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = _power_tables(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(words[data[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        seed = int(words[0])
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes().translate(LOWERED), seed)
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each text in them, the end too; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.array([], pa.large_string()) if not len(column) else column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the index of each text's first word (the end too)."""
    lo, hi = int(at[0]), int(at[-1])
    word = ~SPACE[data[lo:hi]]
    if not word.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = at[(at > lo) & (at < hi)] - lo
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins) + lo, np.flatnonzero(stops) + lo + 1
    return starts, ends, np.searchsorted(starts, at)
