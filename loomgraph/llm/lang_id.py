"""Language identification by language-bitmask n-gram filters.

The filters are bit-sliced Bloom filters: one array of slots whose bit l is the Bloom filter of language l, so that two
lookups return all languages that contain an n-gram, as a mask. A text's popcount of a language is the number of its n-grams
whose mask has the language's bit; it is corrected for the filter's false positives, (hits - n f) / (1 - f) with f the share
of set slots squared, and the language with the largest corrected count is returned. The score is its share of all
languages' corrected counts.

An n-gram (3 or 4 letters or word ends, lower case) is put into a language's filter if it makes up at least ``min_rate`` of
the language's n-grams and at least ``min_share`` of its rate in the language where it is most frequent; foreign passages in
training texts stay out that way. The filters are fitted on a bounded sample of labelled rows, at most about ``sample`` whole
texts a language, chosen by a hash of the doc_id.

Scale: fitting aggregates counts with Spark; at most 1 / min_rate n-grams a language reach the driver. The filters are
8 MB for each 64 languages, whatever the corpus; prediction is a map over the texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; null languages are not learned; without any
training rows every text is ``und``; ties go to the first language by name; each language has a bit, in as many 64-bit words a
slot as they need; repeated rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, slices, to_python

SLOTS = 1 << 20
WORD = 64  # languages in a word of a slot
GRAMS = (3, 4)
SAMPLE = 5000

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the n-grams of a text, in lower case; runs of other characters are one word end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    gap = ~letter
    c = np.where(letter, points, 32)[letter | ~np.concatenate([[False], gap[:-1]])].astype(np.uint64)
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for i in range(n):
                    h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
                out.append(h)
        return mix(np.concatenate(out)) >> np.uint64(32) if out else np.zeros(0, np.uint64)


def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(grams + np.uint64(0x1234567))
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(gram_hashes(text).astype(np.uint32))
            size += len(held[lang][-1])
            if size > 8_000_000:
                yield from rows()
                held, size = {}, 0
    yield from rows()


class Filters:
    """The languages, their bit-sliced filter and its rates of false positives."""

    def __init__(self, langs: list[str], grams: np.ndarray, masks: np.ndarray):
        self.langs = langs
        words = max(1, -(-len(langs) // WORD))
        self.slots = np.zeros((words, SLOTS), np.uint64)
        for at in _slots(grams):
            for slots, mask in zip(self.slots, masks.reshape(len(grams), words).T.astype(np.uint64), strict=True):
                np.bitwise_or.at(slots, at, mask)
        self.false = np.array([np.square(((self.slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(langs))])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(ch.isalpha() for ch in text):
            return "und", 0.0
        hits, n = np.zeros(len(self.langs)), 0
        grams = gram_hashes(text)
        for i in range(0, len(grams), 1 << 20):
            a, b = _slots(grams[i : i + (1 << 20)])
            for w, slots in enumerate(self.slots):
                masks, count = np.unique(slots[a] & slots[b], return_counts=True)
                own = hits[w * WORD : (w + 1) * WORD]
                own += (((masks[:, None] >> np.arange(len(own), dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * count[:, None]).sum(0)
            n += len(a)
        corrected = np.maximum((hits - n * self.false) / (1 - self.false), 0)
        best = int(corrected.argmax())
        total = corrected.sum()
        return self.langs[best], float(corrected[best] / total) if total else 1 / len(self.langs)


def fit(docs: DataFrame, sample: int = SAMPLE, min_rate: float = 2e-5, min_share: float = 0.1) -> Filters:
    """Filters from docs (doc_id, text, lang), learned from rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in sizes.items()], "lang string, rate double")
    rows = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    counts = rows.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rates = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("rate") >= min_rate)
    kept = rates.select("lang", "gram", "rate").toPandas()
    kept = kept[kept["rate"] >= min_share * kept.groupby("gram")["rate"].transform("max")]
    at = kept["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(np.int64)
    grams, row = np.unique(kept["gram"].to_numpy(np.int64), return_inverse=True)
    masks = np.zeros((len(grams), -(-len(langs) // WORD)), np.uint64)
    np.bitwise_or.at(masks, (row, at // WORD), np.uint64(1) << (at % WORD).astype(np.uint64))
    return Filters(langs, grams.astype(np.uint64), masks)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return to_python(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))
