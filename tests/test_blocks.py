"""Blocks of the item factors by ranges of ids."""

from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from millrace.operators import jobs


def test_items_go_to_few_blocks_where_near_ids_rate_with_each_other(spark, monkeypatch):
    rows = spark.range(40_000).select((F.col("id") % 40).alias("k"), F.xxhash64("id").alias("h"))
    ratings = rows.select((F.col("k") * 50 + F.pmod("h", F.lit(50))).cast("int").alias("user"), (F.col("k") * 100 + F.pmod(F.shiftright("h", 20), F.lit(100))).cast("int").alias("item")).distinct().withColumn("rating", F.lit(1.0).cast("float"))
    seen = []
    fit = ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: seen.append((self, df)) or fit(self, df))
    got = jobs.item_factors(ratings, rank=2, iterations=1)
    assert {r.id for r in got.collect()} == {r.item for r in ratings.select("item").distinct().collect()}
    als, df = seen[0]
    user, item = als.getUserCol(), als.getItemCol()
    copies = df.groupBy(item).agg(F.count_distinct(F.col(user) % als.getNumUserBlocks()).alias("n"))
    assert copies.agg(F.avg("n")).first()[0] < 2
    assert df.count() == ratings.count() and df.select(user).distinct().count() == ratings.select("user").distinct().count()
