"""Secret scan with corpus-wide ownership frequency.

Each text is searched for base patterns (assignments, access keys, hexadecimal strings) and for wider candidates: long
tokens of mixed character classes and high entropy, private-key blocks and signed web tokens. The values' hashes are
aggregated over the corpus by distinct repositories (documents) and owners (sources). A value that many owners hold is a
widely copied example; one that at most ``max_owners`` owners hold, in however many repositories (in at most ``max_repos``, where
that is given), is owner-specific and looks live. Base spans always stay; wider candidates become spans only if they are owner-specific. The verdict on base
spans is returned as counts (n_live, n_copied).

Scale: texts do not shuffle; one pass writes small rows of spans. Values are counted by (hash, owner) with map-side
aggregation, each once a document and exactly, so a value in a third of all documents is a few rows a task. The verdicts join candidates by hash, a plain
inner join whose hot keys adaptive execution splits.

Defined cases: a null or empty text has no spans; very long texts are scanned whole; spans that start alike go by kind, then end; a null source is one owner; repeated rows keep a row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, small_enough, to_python, written

KINDS = ("assign", "access", "hex", "generic", "jwt", "pem")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the runs of [0-9a-f]+ that are long enough
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_BITS = 3.5
BROADCAST_ROWS = 1_000_000  #: values whose verdicts are broadcast; beyond it both sides move by value


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def wider_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Candidates that become spans only if the corpus shows them as owner-specific."""
    found = []
    for m in GENERIC.finditer(text):
        v = m[0]
        classes = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search("[0-9]", v))
        if classes == 3 and entropy(v) >= MIN_BITS:
            found.append(("generic", m.start(), m.end(), v))
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", m.start(), m.end(), m[0]) for m in PEM.finditer(text)]
    return found


def spelled(spans: list[tuple]) -> str:
    """kind:start:end of all spans, by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("base", pa.bool_())])
    for batch in slices(batches):
        counts, digests, spans = {k: [] for k in KINDS[:3]}, [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            n = Counter(x[0] for x in base)
            for k, column in counts.items():
                column.append(n[k])
            digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
            wide = wider_spans(text) if text else []
            taken = {x[:3] for x in base}
            wide = [x for x in wide if x[:3] not in taken]
            spans.append([{"kind": k, "start": s, "end": e, "h": xxhash.xxh64_intdigest(v) - (1 << 63), "base": i < len(base)} for i, (k, s, e, v) in enumerate(base + wide)])
        ints = [pa.array(counts[k], pa.int64()) for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *ints, pa.array(digests, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", "source", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(docs: DataFrame, max_owners: int = 2, max_repos: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id long, text, source): counts, base_sha256, spans and the verdicts' counts."""
    schema = "doc_id long, source string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:long,end:long,h:long,base:boolean>>"
    rows = to_python(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")).mapInArrow(_scan, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    one = rows.select("row", "doc_id", "source", F.explode("found").alias("f")).select("row", "doc_id", "source", "f.*")
    held = rows.select("source", F.explode(F.array_distinct("found.h")).alias("h"))  # once a row
    owners = held.groupBy("h", "source").agg(F.count("*").alias("repos"))
    few = (F.col("owners") <= max_owners) & (F.lit(True) if max_repos is None else F.col("repos") <= max_repos)
    verdicts = owners.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).select("h", few.alias("live"))
    verdicts = written(verdicts, "verdicts")
    if small_enough(verdicts, BROADCAST_ROWS):
        verdicts = F.broadcast(verdicts)
    judged = one.select("row", "h", "kind", "start", "end", "base").join(verdicts, "h").filter("base or live")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))).alias("s"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    by_row = by_row.select("row", "n_live", "n_copied", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"))
    out = rows.join(by_row, "row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
