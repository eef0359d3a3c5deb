"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says between which neighbouring classes of characters a text may be cut: pairs of a left and a right class. Each
pair is translated to a zero-width regex, a look-behind at the left class and a look-ahead at the right one, and Spark's split
by their alternation gives the units; nothing is matched, so nothing is lost. Two of three drawn cuts bound prefix, middle and
suffix, which sentinels mark in the order prefix-suffix-middle (psm) or suffix-prefix-middle (spm).

All draws come from a hash of seed and doc_id, so rows do not depend on partitions, and a rerun agrees. The work is a map over
rows; nothing moves.

Defined cases: a null text is an empty one; an empty text has no units and stays plain, as do texts that hold a sentinel; a null
doc_id draws like an empty one; repeated rows give the same row again; extra columns of any name are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_LOW, _ANY = r"[\uDC00-\uDFFF]", r"[\s\S]"
#: unit grammars: the pairs of neighbouring classes (left, right) between which a unit ends
UNITS: dict[str, Sequence[tuple[str, str]]] = {
    "token": [(_WORD, _GAP)],
    "run": [(_WORD, _GAP), (_GAP, _WORD)],
    "line": [(r"\n", _ANY)],
    "sentence": [(r"[.!?]", _GAP), (r"\n", _WORD)],
    "character": [(_ANY, f"(?!{_LOW}){_ANY}")],
}
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(grammar: Sequence[tuple[str, str]]) -> str:
    """The zero-width regex of all places where a left class meets its right class."""
    return "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def units(text: Column, unit: str | Sequence[tuple[str, str]] = "token") -> Column:
    """The units of a text in order; joined they are the text. An empty text, for which split gives one empty piece, has none."""
    grammar = UNITS[unit] if isinstance(unit, str) else unit
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _quoted(sentinel: str) -> str:
    return "\\Q" + sentinel.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(map(_quoted, sentinels)), -1)
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(back)


def fill_in_middle(docs: DataFrame, unit: str | Sequence[tuple[str, str]] = "token", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output for each row of docs (doc_id, text).

    rate: of a hundred texts so many are cut; spm: of a hundred cut ones so many lead with the suffix. The parts of a plain text
    are null. Sentinels must not overlap one another (no end of one begins another), or cut texts could not be told apart.
    """
    for a in sentinels:
        for b in sentinels:
            if not a or a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    p, s, m = map(F.lit, sentinels)
    one = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = one.withColumn("units", units(F.col("text"), unit)).withColumn("n", F.size("units").cast("long"))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    holds = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when((F.col("text") == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cut = cut.withColumn("form", form).withColumn("c1", h1 % (F.col("n") + 1)).withColumn("c2", h2 % (F.col("n") + 1))
    lo, hi = F.least("c1", "c2").cast("int"), F.greatest("c1", "c2").cast("int")
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    cut = cut.select("doc_id", "text", "n", "form", part(F.lit(1), lo).alias("prefix"), part(lo + 1, hi - lo).alias("middle"), part(hi + 1, F.size("units") - hi).alias("suffix"))
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm_ = F.concat(s, "suffix", p, "prefix", m, "middle")
    return cut.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
