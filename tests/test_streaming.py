"""A stream gives the batch's rows, takes each file once and keeps failures apart."""

from pyspark.sql import functions as F

from noteloom.functions import spans as S
from noteloom.streaming import ingest


def step(df):
    return df.select("id", F.explode(S.matches(F.col("text"), S.phrase_pattern(["stop", "start"]))).alias("m")).select("id", "m.*")


def put(spark, tmp_path, k, texts):
    spark.createDataFrame([(k * 10 + i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_available(spark, tmp_path):
    args = (spark, f"{tmp_path}/in", "id int, text string", step, f"{tmp_path}/out", f"{tmp_path}/cp")
    put(spark, tmp_path, 0, ["start now", "nothing", None])
    assert ingest.run_available(*args)["rows"] == 3
    put(spark, tmp_path, 1, ["stop, then start"])
    assert ingest.run_available(*args)["rows"] == 1
    assert ingest.run_available(*args) == {"batches": 0, "rows": 0}
    batch = step(spark.read.schema("id int, text string").parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_isolated(spark, tmp_path):
    def strict(df):
        return df.select("id", F.when(F.col("text") == "bad", F.raise_error(F.lit("bad text"))).otherwise(F.col("text")).alias("text"))

    put(spark, tmp_path, 0, ["good"])
    put(spark, tmp_path, 1, ["bad"])
    schema, out, failed = "id int, text string", f"{tmp_path}/out", f"{tmp_path}/failed"
    ingest.run_isolated(spark, f"{tmp_path}/in", schema, strict, out, failed, f"{tmp_path}/cp")
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [0]
    assert "bad text" in spark.read.parquet(failed).first()["error"]
    assert ingest.retry_failed(spark, schema, strict, out, failed) == 1
    assert ingest.retry_failed(spark, schema, lambda df: df, out, failed) == 0
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 10]
    assert ingest.retry_failed(spark, schema, strict, out, failed) == 0


def test_unprocessed(spark):
    assert [r[0] for r in ingest.unprocessed(spark.range(3), spark.range(2), "id").collect()] == [2]
