"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words: its weight's share of the whole budget, stopped at ``max_repeat`` times what
the source holds; what is above goes to the others by weight until none is above. Whole passes over a source come first.
For the rest of the target, documents are counted by exact length; each length first gives its proportional share of
documents, and a bounded-knapsack dynamic programme over the remaining counts finds the subset that comes nearest to the
remaining budget, from below or above. While that misses the budget, shares are given back and the programme runs over a wider
window, at last over the whole budget; only beyond 2^25 words (or four of the longest documents) does the window end, and the
sum is then the nearest that changes within it reach. Which documents of a length
are taken is decided by a seeded hash, so reruns agree.

Scale: texts never shuffle. One pass writes (source, size, hash) rows; they are counted by (source, size), and a source's
lengths, not its documents, meet in one task. The hash of the last document taken is found with counts of hash buckets, and
only the rows of the one bucket at the edge are ranked. The result is a filter on the hash next to the documents; its table
(one row for each length of each source) is broadcast only below a checked size, else joined.

Defined cases: a null text has size 0; null sources form one source, which comes last in the order of weights; empty tables
give empty results; rows that repeat are single documents and are ranked among themselves where the edge falls on them;
columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import n_words, small_enough, written

FIRST = 1 << 16  #: words of the first window of the dynamic programme
WINDOW = 1 << 25  #: words of the widest one
BROADCAST_ROWS = 1_000_000
BUCKET = 1000


def targets(totals: dict, weights: list, max_repeat: int = 3) -> dict:
    """Target words of each source; totals: words it holds, None last. Exact fractions."""
    names = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    budget, out, free = Fraction(sum(totals.values())), {}, list(names)
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: budget * weight[s] / whole for s in free}
        above = [s for s in free if share[s] > max_repeat * totals[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = Fraction(max_repeat * totals[s])
            budget -= out[s]
            free.remove(s)
    return out


def nearest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, above: int = 0) -> np.ndarray:
    """Bounded knapsack: how many of each length to take so that the sum comes nearest to budget, by at most ``above`` from
    above; the lower one of equals.

    Sums that can be reached are the bits of one large integer. A length's count is split into powers of two, each one item that
    shifts the integer; the item that reaches a sum first is kept, so the way back to zero uses each item at most once.
    """
    take, top = np.zeros(len(lengths), np.int64), budget + above
    last = np.full(top + 1, -1, np.int32)
    reached, within, items = 1, (1 << (top + 1)) - 1, []
    for i in np.flatnonzero((lengths > 0) & (lengths <= top) & (counts > 0)):
        left, power = min(int(counts[i]), top // int(lengths[i])), 1
        while left and not reached >> budget & 1:
            n = min(power, left)
            left, power = left - n, power * 2
            shift = n * int(lengths[i])
            fresh = (reached << shift) & within & ~reached
            if fresh:
                at = shift & ~7  # no bit below the shift is fresh
                bits = np.frombuffer((fresh >> at).to_bytes((top - at) // 8 + 1, "little"), np.uint8)
                last[at + np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(items)
                items.append((i, n, shift))
                reached |= fresh
    below = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reached >> (budget + 1)
    gap = (over & -over).bit_length()  # how far the nearest sum above is, 0 for none
    at = budget + gap if gap and gap < budget - below else below
    while at:
        i, n, shift = items[last[at]]
        take[i] += n
        at -= shift
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to budget.

    The programme first runs over what proportional shares leave; long lengths fill that down to a window of at least four of the
    longest documents. While it misses the budget, shares are given back and it runs over windows four times as wide, until
    all is in the programme or a window reaches WINDOW words.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    share = np.array([int(c) * budget // total for c in counts], np.int64)
    longest = int(lengths[counts > 0].max())
    window, most = max(FIRST, 4 * longest), max(WINDOW, 4 * longest)
    best, missed = None, 0
    while True:
        held = int((lengths * share).sum())
        wanted = max(0, window - (budget - held)) if best is not None else 0
        base = share - np.array([min(int(n), -(-int(n) * wanted // held)) if held else 0 for n in share], np.int64)
        rest = budget - int((lengths * base).sum())
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= window:
                break
            if lengths[i]:
                more = min(int(counts[i] - base[i]), -(-(rest - window) // int(lengths[i])))
                base[i] += more
                rest -= more * int(lengths[i])
        left = counts - base
        out = base + nearest_subset(lengths, left, rest, min(longest, rest))
        now = abs(budget - int((lengths * out).sum()))
        if best is None or now < missed:
            best, missed = out, now
        if not missed or not base.any() or window >= most:
            return best
        window = min(4 * window, most)


def mix(docs: DataFrame, weights: list, seed: int = 0, max_repeat: int = 3, size: str | None = None) -> DataFrame:
    """docs with the columns size, source_size, target and copies (how often the mix takes the row).

    docs: doc_id, text, source and any others; size names a column that already holds the words of each row.
    """
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "copies", "_h", "_src") if c in docs.columns and c != size])
    docs = docs.withColumn("size", F.col(size) if size else n_words(F.col("text")))
    # the bits below 2^40 of the hash decide; a row without text hashes by its id and size
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "source"), 24)
    docs = docs.withColumn("_h", h).withColumn("_src", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    rows = written(docs.select("_src", "size", "_h"), "mix-rows")
    counts = written(rows.groupBy("_src", "size").agg(F.count("*").alias("c")), "mix-counts")
    totals = {None if r["_src"]["n"] else r["_src"]["s"]: r["t"] for r in counts.groupBy("_src").agg(F.sum(F.col("size") * F.col("c")).alias("t")).collect()}
    goal = targets(totals, weights, max_repeat)
    plan = {s: (totals[s], float(goal[s]), int(goal[s] // totals[s]) if totals[s] else 0, round(goal[s] - goal[s] // totals[s] * totals[s]) if totals[s] else 0) for s in totals}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        n, s = rows["n"].iloc[0], rows["s"].iloc[0]
        total, target, whole, rest = plan[None if n else s]
        rows = rows.sort_values("size")
        rows["k"] = fit_lengths(rows["size"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), rest)
        return rows.assign(source_size=total, target=target, whole=whole)

    flat = counts.select(F.col("_src.n").alias("n"), F.col("_src.s").alias("s"), "size", "c")
    picks = flat.groupBy("n", "s").applyInPandas(fit, "n boolean, s string, size long, c long, k long, source_size long, target double, whole int")
    picks = written(picks.select(F.struct("n", "s").alias("_src"), "size", "c", "k", "source_size", "target", "whole"), "mix-picks")

    # the hash of the last document taken of each length: counts of hash buckets, then ranks in the bucket at the edge
    some = picks.filter("k > 0 and k < c").withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("c") / F.greatest(F.lit(BUCKET), F.sqrt("c")))))
    some = some.select("_src", "size", "k", "nb")
    some_small = small_enough(some, BROADCAST_ROWS)
    hint = F.broadcast if some_small else (lambda x: x)
    with_bucket = rows.join(hint(some), ["_src", "size"]).withColumn("b", F.expr("(_h * nb) div 1099511627776"))
    by_bucket = with_bucket.groupBy("_src", "size", "k", "b").agg(F.count("*").alias("cb"))
    before = F.sum("cb").over(Window.partitionBy("_src", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    edge = by_bucket.withColumn("before", F.coalesce(before, F.lit(0))).filter("before < k and k <= before + cb").select("_src", "size", "b", (F.col("k") - F.col("before")).alias("need"))
    edge = written(edge, "mix-edges")
    in_edge = with_bucket.join(hint(edge), ["_src", "size", "b"])
    ranked = in_edge.withColumn("rn", F.row_number().over(Window.partitionBy("_src", "size", "b").orderBy("_h")))
    ranked = ranked.withColumn("rk", F.rank().over(Window.partitionBy("_src", "size", "b").orderBy("_h"))).withColumn("tied", F.count("*").over(Window.partitionBy("_src", "size", "b", "_h")))
    last = ranked.filter("rn = need").select("_src", "size", F.col("_h").alias("last"), (F.col("need") - F.col("rk") + 1).alias("of_tied"), "tied")
    picks = picks.join(last, ["_src", "size"], "left").select("_src", "size", "source_size", "target", "whole", (F.col("k") == F.col("c")).alias("every"), "last", "of_tied", "tied")
    picks = written(picks, "mix-chosen")

    chosen = docs.join(F.broadcast(picks) if small_enough(picks, BROADCAST_ROWS) else picks, ["_src", "size"])
    one = F.when(F.col("every") & (F.col("size") > 0), 1).when(F.col("_h") < F.col("last"), 1)
    keep = [c for c in docs.columns if c not in ("_src", "_h")]
    out = chosen.withColumn("copies", F.col("whole") + one.when((F.col("_h") == F.col("last")) & (F.col("tied") == F.col("of_tied")), 1).otherwise(0))
    if picks.filter("of_tied < tied").limit(1).count():
        tie = (F.col("_h") == F.col("last")) & (F.col("of_tied") < F.col("tied"))
        tied = chosen.filter(tie).withColumn("rn", F.row_number().over(Window.partitionBy("_src", "size", "_h").orderBy("doc_id")))
        tied = tied.withColumn("copies", F.col("whole") + (F.col("rn") <= F.col("of_tied")).cast("int"))
        columns = [*keep, "source_size", "target", "copies"]
        return out.filter(F.coalesce(~tie, F.lit(True))).select(columns).unionByName(tied.select(columns))
    return out.select(*keep, "source_size", "target", "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_i")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    docs = written(docs, "mix-sizes")
    out = mix(docs, [5, 2, 1], seed=10, max_repeat=3, size="words")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
