"""The pipeline's stages, each on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tidelog.llm import decontaminate, quality
from tidelog.llm.common import WORD


def test_stages_take_effect_and_lose_nothing_else(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, stages[-1], str(DATA)).write.parquet(str(tmp_path / str(k)))
        stages.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in stages[:-1]:
        assert df.columns == docs.columns
    ids = [[r["doc_id"] for r in df.select("doc_id").collect()] for df in stages]
    kept = quality.score_quality(docs).where("kept").count()
    assert len(ids[1]) == kept and set(ids[2]) <= set(ids[1]) and len(set(ids[2])) == len(ids[2])
    # no two equal texts are left
    assert stages[2].select("text").distinct().count() == len(ids[2])
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.digest(decontaminate.find_windows(stages[2], bench)).where("contaminated").collect()}
    assert set(ids[3]) == set(ids[2]) - hit
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    assert set(ids[4]) <= set(ids[3]) and 1.4 * words(stages[3]) <= words(stages[4]) <= 1.5 * words(stages[3])
    assert sorted(ids[5]) == sorted(ids[4])
    sizes = [r["count"] for r in stages[5].groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    same = stages[5].join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert same.where("text <> t").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
