"""What the item factors leave on disk while they are fitted and after."""

import time

from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.operators import jobs


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def gone(spark, files: set[str], collect: bool) -> bool:
    until = time.time() + 15
    while files & shuffle_files(spark):
        if time.time() > until:
            return False
        if collect:
            spark._jvm.System.gc()
        time.sleep(0.2)
    return True


def test_shuffles_go_while_items_are_fitted_and_the_result_refers_to_none(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECT_S", 0.2, raising=False)
    spark._jvm.System.gc()
    time.sleep(1)
    before, seen = shuffle_files(spark), []
    fit = ALS.fit

    def watched(self, df):
        spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save()
        made = shuffle_files(spark) - before
        seen.append((self.getCheckpointInterval(), spark.sparkContext.getCheckpointDir(), bool(made), gone(spark, made, collect=False)))
        return fit(self, df)

    monkeypatch.setattr(ALS, "fit", watched)
    ratings = spark.range(2000).select((F.col("id") % 40).cast("int").alias("user"), F.pmod(F.xxhash64("id"), F.lit(60)).cast("int").alias("item")).distinct().withColumn("rating", F.lit(1.0).cast("float"))
    got = jobs.item_factors(ratings, rank=2, iterations=6)
    interval, checkpoints, made, went = seen[0]
    assert interval == 1 and checkpoints and made and went
    of_fit = shuffle_files(spark) - before
    assert got.count() == ratings.select("item").distinct().count()
    assert gone(spark, of_fit, collect=True)
