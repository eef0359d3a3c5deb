"""Label prediction from community features: assignment table, frequency filters and cross-validated accuracy."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS_AT_ONCE = 8  #: folds whose models are trained side by side
FOLD_ROWS = 50_000  #: rows of a task of training


def assignment(cover: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, communities, label): sorted communities of each labelled node, empty for none."""
    c = cover.groupBy("node").agg(F.array_sort(F.collect_set("c")).alias("communities"))
    return labels.join(c, "node", "left").select("node", F.coalesce("communities", F.array().cast("array<long>")).alias("communities"), "label")


def by_size(cover: DataFrame) -> DataFrame:
    """cover with communities of equal nodes once, numbered from 0 by size descending, then id; a row for each community is ranked."""
    m = cover.groupBy("c").agg(F.array_sort(F.collect_set("node")).alias("m")).groupBy("m").agg(F.min("c").alias("c"))
    ranked = m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.size("m")), "c")).cast("long") - 1)
    return ranked.select(F.col("rank").alias("c"), F.explode("m").alias("node"))


def filtered(cover: DataFrame, labels: DataFrame, least_label: int = 10, least_feature: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (node, label) without label 0 and labels of fewer nodes, and features (node, feature) with dense ids from 0,
    without communities that hold fewer of the rows that are left."""
    known = labels.filter("label <> 0")
    rows = known.join(known.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least_label).select("label"), "label", "left_semi").select("node", "label")
    held = cover.distinct().join(rows.select("node"), "node", "left_semi")
    kept = held.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") >= least_feature).select("c")
    ids = kept.withColumn("feature", F.dense_rank().over(Window.orderBy("c")).cast("long") - 1)  # a row for each community
    return rows, held.join(F.broadcast(ids), "c").select("node", "feature")


def folds(rows: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """rows with fold, stratified by label: nodes of a label in a seeded order, dealt in turn."""
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "node"), "node")) % n).cast("int"))


def accuracy(cover: DataFrame, labels: DataFrame, n_folds: int = 10, use: int = 10, trees: int = 20, rate: float = 0.1, sample: float = 0.4, least_label: int = 10, least_feature: int = 4, seed: int = 0) -> DataFrame:
    """(fold, n, accuracy) of boosted trees, one against the rest, over the first ``use`` folds.

    Of two labels one model tells both: that of the other would be its negative. Folds are trained side by side, since a level of a tree is
    a job of its own and most of its time is its start. Rows lie by node in partitions of a stated size, so that what a tree draws does
    not depend on the session.
    """
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows, features = filtered(cover, labels, least_label, least_feature)
    width = max(int(features.agg(F.coalesce(F.max("feature"), F.lit(-1))).first()[0]) + 1, 1)
    vector = F.udf(lambda ids: SparseVector(width, sorted(set(ids or [])), [1.0] * len(set(ids or []))), VectorUDT())
    x = rows.join(features.groupBy("node").agg(F.collect_set("feature").alias("f")), "node", "left").withColumn("features", vector("f"))
    classes = x.select("label").distinct().withColumn("y", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("double"))  # a row for each label
    x = folds(x.join(F.broadcast(classes), "label"), n_folds, seed).select("node", "features", F.col("y").alias("label"), "fold")
    x = x.repartition(-(-rows.count() // FOLD_ROWS) or 1, "node").sortWithinPartitions("node").cache()
    two = x.agg(F.max("label")).first()[0] == 1

    def fold_of(fold: int) -> tuple:
        test = x.filter(F.col("fold") == fold)
        trees_ = GBTClassifier(maxIter=trees, stepSize=rate, subsamplingRate=sample, seed=seed)
        model = (trees_ if two else OneVsRest(classifier=trees_)).fit(x.filter(F.col("fold") != fold))
        right = model.transform(test).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
        return fold, right["n"], right["a"]

    with ThreadPool(min(FOLDS_AT_ONCE, max(use, 1))) as pool:
        out = pool.map(inheritable_thread_target(rows.sparkSession)(fold_of), range(use), 1)
    x.unpersist()
    return rows.sparkSession.createDataFrame(out, "fold int, n long, accuracy double")
