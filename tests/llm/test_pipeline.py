"""The pipeline's stages on the smallest tables, and the registered SQL."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import ngram_join, toxicity
from loomgraph.llm.decontaminate import leaks
from loomgraph.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(k.columns == docs.columns for k in kept[:-1])
    clean, single, safe, mix, out = kept[1:]
    scorer = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert clean.count() == toxicity.scored(docs, scorer).filter("score < 0.3").count() <= docs.count()
    parts = ngram_join.jaccard_components(clean).select("component_id").distinct().count()
    assert single.count() == parts and ngram_join.jaccard_components(single).select("component_id").distinct().count() == parts
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert leaks(safe, items).count() == 0 and safe.count() == single.count() - leaks(single, items).select("doc_id").distinct().count()
    assert {r[0] for r in mix.select("doc_id").collect()} <= {r[0] for r in safe.select("doc_id").collect()}
    assert out.count() == mix.count() and out.agg({"n_tokens": "sum"}).first()[0] == out.selectExpr("max(start + n_tokens)").first()[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    text = lambda x: sorted(map(str, x[columns].itertuples(index=False, name=None)))
    assert columns == sorted(want.columns) and text(got) == text(want)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
