"""Texts of addresses and blocks are read once a row, in as many tasks as the session shuffles into."""

from pyspark.sql import functions as F

from tidewatch.operators import addresses


def _reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")


def test_texts_are_read_once(spark):
    rows = spark.range(40).select("id", F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip"))
    table = spark.range(40).select("id", F.concat(F.lit("10.0.0."), (F.col("id") - F.col("id") % 2).cast("string"), F.lit("/31")).alias("cidr"))
    got = addresses.longest_match(rows, table)
    # texts of another plan each, so nothing is worked out of how they are made
    texts = spark.createDataFrame([("10.0.0.1",)], "x string")
    assert _reads(got) <= _reads(texts.select(addresses.digits(F.col("x")))) + _reads(texts.select(addresses.blocks(F.col("x"))))
    assert {(r.id, r.ip, r.cidr) for r in got.collect()} == {(i, f"10.0.0.{i}", f"10.0.0.{i - i % 2}/31") for i in range(40)}
