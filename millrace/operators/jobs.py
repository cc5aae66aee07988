"""Keyed map, combine and reduce jobs, and the worked jobs built of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that splits words and fields.
SPACES = r"[ \t\n\r\f]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def map_records(df: DataFrame, records: Column) -> DataFrame:
    """A mapper: each row's array of (key, value) structs as rows, without a shuffle. The default key is null."""
    return df.select(F.inline(records))


def reduce_by_key(pairs: DataFrame, *aggregates: Column) -> DataFrame:
    """A combiner and reducer in built-in aggregates, combined before the shuffle."""
    return pairs.groupBy("key").agg(*aggregates)


def reduce_groups(pairs: DataFrame, reducer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A reducer that sees all values of a key in one Arrow table; a key's values must fit into a task's memory."""
    return pairs.groupBy("key").applyInArrow(reducer, schema)


Batches = Iterator[pa.RecordBatch]


def _groups(batches: Batches, key: str) -> Iterator[tuple[object, Batches]]:
    """(key, batches of its rows) of a stream sorted by key. A group's batches are cut from the stream as they are asked
    for; what its reader leaves is passed over before the next group is told."""
    rest: list[pa.RecordBatch] = []  # the batch at hand, from the next row on

    def more() -> pa.RecordBatch | None:
        while not rest or not rest[0].num_rows:
            rest[:] = [b for b in [next(batches, None)] if b is not None]
            if not rest:
                return None
        return rest[0]

    def same(column: pa.Array, value: pa.Scalar) -> int:
        """How many of the first rows have the value."""
        if not value.is_valid:
            equal = column.is_null()
        elif value.as_py() != value.as_py():  # NaN is a key as well
            equal = pc.fill_null(pc.is_nan(column), False)
        else:
            equal = pc.fill_null(pc.equal(column, value), False)
        at = pc.index(equal, False).as_py()
        return len(column) if at < 0 else at

    def group(value: pa.Scalar) -> Batches:
        while (batch := more()) is not None:
            n = same(batch[key], value)
            rest[0] = batch.slice(n)
            if n:
                yield batch.slice(0, n)
            if rest[0].num_rows:
                return

    while (batch := more()) is not None:
        value = batch[key][0]
        one = group(value)
        yield value.as_py(), one
        for _ in one:
            pass


def reduce_sorted(pairs: DataFrame, reducer: Callable[[object, Batches], Batches], schema: str, *order: Column | str, combiner: Callable[[Batches], Batches] | None = None, parts: int | None = None) -> DataFrame:
    """A reducer over a sorted stream: ``reducer(key, batches)`` gets a key's rows as an iterator of Arrow batches, by
    ``order``, and gives batches.

    A group is never in memory: rows are sorted by Spark, which spills, and a batch is read when the reducer asks for it.
    A reducer may stop early. ``combiner`` is applied to each task's rows before the shuffle and must give the columns of
    ``pairs``; it is what keeps a hot key's rows from one task, since a key's stream is read by one reducer. ``parts``
    output partitions if given. Null and NaN are keys; a key must not be nested.
    """

    def run(batches: Batches) -> Batches:
        for key, group in _groups(batches, "key"):
            yield from reducer(key, group)

    if combiner:
        pairs = pairs.mapInArrow(combiner, pairs.schema)
    dealt = pairs.repartition(parts, "key") if parts else pairs.repartition("key")
    return dealt.sortWithinPartitions("key", *order).mapInArrow(run, schema)


def map_records_udtf(rows: DataFrame, mapper: type, partition_by: list[str] | None = None, order_by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """A mapper as a Python table function over a whole table, for records that no expression gives.

    ``mapper`` is a class with ``analyze`` (its result schema, from that of the table), ``eval(row)`` and, if it has one,
    ``terminate()`` at the end of each partition. With ``partition_by`` rows of equal values go to one instance, by
    ``order_by``; without it rows stay in their tasks' order and number.
    """
    function = F.udtf(mapper)
    argument = rows.asTable()
    if partition_by:
        argument = argument.partitionBy(*partition_by)
        if order_by:
            argument = argument.orderBy(*order_by)
    return function(argument)


def map_with_final(df: DataFrame, mapper: Callable, final: Callable, schema: str) -> DataFrame:
    """A mapper over Arrow batches whose ``final()`` batches come after a partition's last; aggregate them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from mapper(batch)
        yield from final()

    return df.mapInArrow(run, schema)


def grouped_and_sorted(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows of a key together in one partition, sorted by key; ``parts`` output partitions if given."""
    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key)


def counters(df: DataFrame, group: str, **counts: Column) -> DataFrame:
    """(group, name, n) of conditions counted over the rows, in one pass."""
    one = df.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(group).alias("group"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts))))


def observed(df: DataFrame, group: str, **counts: Column) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df`` to be written as usual, and a function that tells (group, name, n) of conditions once it has been.

    The counts are taken by the job that writes the rows, as they pass: no second scan, and one row reaches the driver.
    """
    seen = Observation()
    named = {f"c{i}": (name, condition) for i, (name, condition) in enumerate(counts.items())}
    watched = df.observe(seen, *(F.count_if(condition).alias(c) for c, (_, condition) in named.items()))

    def told() -> DataFrame:
        found = seen.get
        rows = [(group, name, found[c]) for c, (name, _) in named.items()]
        return df.sparkSession.createDataFrame(rows, "group string, name string, n long")

    return watched, told


def count_by_key(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def toplist(counts: DataFrame, key: str, k: int = 10, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The k largest (n, key); ties go to the larger key. With dates, date_to is exclusive."""
    top = counts.orderBy(F.desc("n"), F.desc(key)).limit(k)
    if date_from is None:
        return top
    return top.select(F.lit(date_from).cast("date").alias("date_from"), F.lit(date_to).cast("date").alias("date_to"), key, "n")


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """Count and share of each word; the total is one row and reaches every task as such."""
    counts = word_count(df, text)
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__total")))).withColumn("frequency", F.col("n") / F.col("__total")).drop("__total")


def column_statistics(df: DataFrame, mean: str, total: str) -> DataFrame:
    return df.agg(F.avg(mean).alias("mean"), F.sum(total).alias("total"))


#: Blocks of users and of items, as many as ALS makes of its own accord.
BLOCKS = 10


def _block_ids(ids: DataFrame, name: str) -> DataFrame:
    """(name, label): an int for each distinct id. Ids of a range share ``label % BLOCKS``, by which ALS deals them."""
    from ..llm.common import written

    dealt = ids.select(name).distinct().repartitionByRange(BLOCKS, name).sortWithinPartitions(name).select(name, F.monotonically_increasing_id().alias("at"))
    label = F.shiftright("at", 33) + BLOCKS * F.col("at").bitwiseAND((1 << 33) - 1)
    return written(dealt.select(name, label.cast("int").alias("label")), f"{name}-labels")


def item_factors(ratings: DataFrame, rank: int = 40, iterations: int = 20, reg: float = 0.8, alpha: float = 150.0) -> DataFrame:
    """Implicit ALS over user, item and rating: id and factors text, comma-separated with six decimals.

    ALS sends a side's factors in each iteration to all blocks of the other side that rate with them, up to BLOCKS copies
    of each. Its blocks are made ranges of ids here, so that where ids that lie near each other rate with each other, most
    factors go to one or two. Where ids tell nothing, there are as many copies as without.

    Each iteration is checkpointed, so that it refers to no earlier one, and the driver's garbage is collected meanwhile:
    the disk holds the shuffles of an iteration or two, not of all, and none of the joins that told the labels.
    """
    from pyspark.ml.recommendation import ALS

    from ..llm.common import delete, garbage_collected, shared_path, stored, written

    spark = ratings.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    with garbage_collected(spark):
        ratings, path = stored(ratings.select("user", "item", "rating"), "ratings")
        users, items = _block_ids(ratings, "user"), _block_ids(ratings, "item")
        labelled = written(ratings.join(users.withColumnRenamed("label", "u"), "user").join(items.withColumnRenamed("label", "i"), "item").select("u", "i", "rating"), "labelled")
        delete(spark, path)
        als = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="rating", seed=1, numUserBlocks=BLOCKS, numItemBlocks=BLOCKS, checkpointInterval=1)
        factors = written(als.fit(labelled).itemFactors, "factors").join(items.withColumnRenamed("item", "item_id"), F.col("id") == F.col("label"))
    return factors.select(F.col("item_id").alias("id"), F.array_join(F.transform("features", lambda x: F.format_string("%.6f", x.cast("double"))), ",").alias("factors"))


def second_read(data: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a dataset for ids that another one lists."""
    return data.join(ids.select(key), key, "left_semi")


def generated_ratings(spark: SparkSession, n: int, tracks: int = 1000, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("user"), F.floor(F.rand(seed) * tracks).cast("long").alias("item"), F.lit(1.0).alias("rating"))


def generated_streams(spark: SparkSession, n: int = 1000, users: int = 100, artists: int = 100, tracks: int = 1000, seed: int = 1) -> DataFrame:
    """``n`` random rows of user, artist and track."""
    pick = lambda i, most: F.floor(F.rand(seed + i) * most).cast("long")
    return spark.range(n).select(pick(0, users).alias("user"), pick(1, artists).alias("artist"), pick(2, tracks).alias("track"))


def generated_records(spark: SparkSession, n: int, size: int = 100) -> DataFrame:
    """``n`` records of ``size`` characters with a random key in front."""
    return spark.range(n).select(F.rpad(F.substring(F.md5(F.col("id").cast("string")), 1, 10), size, "x").alias("record"))


