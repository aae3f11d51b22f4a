"""The registered query downsamples every lineitem row, each at a time of its own."""

from pyspark.sql import functions as F

from tidemark.plans import catalogue


def test_extremes_of_all_rows_are_kept(spark, sf):
    got = catalogue.queries()["downsample_query"](spark, sf).where("field = 'discount'")
    found = {(r.id, r.low, r.high) for r in got.groupBy("id").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    every = lineitem.groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(F.min("l_discount").alias("low"), F.max("l_discount").alias("high")).collect()
    assert found == {(r.id, r.low, r.high) for r in every}
    # times end in the row's number of microseconds
    assert {r.k for r in got.select((F.col("time_us") % 86_400_000_000 % 7).alias("k")).distinct().collect()} == set(range(7))
