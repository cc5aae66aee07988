"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target words over its words say how many copies each of its documents gets. The whole part is taken for
certain. The rest is a share of the source's words that is sampled with unequal probabilities: a document's inclusion
probability p goes with its preference, by default with the root of its words, scaled so that the expected words are
those that remain. Documents are ranked by random odds divided by inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``,
and taken in that order until the remaining words are used up, so the size of the sample is fixed, not random.

No task ranks a whole source. A source of n documents is cut into about sqrt(n) buckets of the rank; sums by bucket
find the bucket in which the words run out, and only that bucket's documents are ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, row_key, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources in code-point order, null last, take ``weights`` in turn. Targets share ``share`` of all words by weight
    and stop at ``max_repeat`` times their source's words; what is above goes to the others by weight. That is the
    level L with sum(min(cap, L * weight)) = total: with sources by cap / weight, the first k at their caps, L is the
    first (total - caps so far) / (weights from there on) that stays below the next cap / weight. One row per source
    meets in one task here; documents never do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("__fill", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sizes.withColumn("__w", F.element_at(F.lit(list(map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", max_repeat * F.col("source_size")).withColumn("__fill", F.col("__cap") / F.col("__w"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("__total", F.lit(share) * F.sum("source_size").over(every))
    ranked = ranked.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
    ranked = ranked.withColumn("__k", F.row_number().over(by_fill))
    first = F.min(F.when(F.col("__level") <= F.col("__fill"), F.struct("__k", "__level"))).over(every)
    ranked = ranked.withColumn("__l", first["__level"])
    return ranked.withColumn("target", F.when(F.col("__l").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__l") * F.col("__w")))).drop("__w", "__cap", "__fill", "__total", "__level", "__k", "__l")


#: Preferences are taken relative to a source's average, within this many octaves of it, in steps of an eighth octave.
OCTAVES = 3


def _levels(preference: Column) -> Column:
    """A preference rounded to one of 16 * OCTAVES + 1 levels; null, zero and less are the lowest."""
    step = F.round(8 * F.log2(F.greatest(preference, F.lit(1e-9))))
    return F.pow(2.0, F.coalesce(F.greatest(F.lit(-8.0 * OCTAVES), F.least(F.lit(8.0 * OCTAVES), step)), F.lit(-8.0 * OCTAVES)) / 8)


def inclusion_scales(levels: DataFrame) -> DataFrame:
    """(source, scale) from one row per source and level: source, liking, words, rest.

    Inclusion probabilities are min(1, scale * liking), and the scale is such that sum(words * min(1, scale * liking))
    is ``rest``: with the levels from the highest down, the first k of them certain, it is (rest - words so far) /
    (words * liking from there on) for the first k at which the next level isn't certain.
    """
    down = Window.partitionBy("source").orderBy(F.desc("liking"))
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scaled = levels.withColumn("scale", (F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * F.col("liking")).over(after))
    fits = F.col("scale") * F.col("liking") <= 1 + 1e-12
    return scaled.groupBy("source").agg(F.coalesce(F.max_by("scale", F.when(fits, F.col("liking"))), F.lit(1e9)).alias("scale"))


def _fill(ranked: DataFrame, max_repeat: int, name: str) -> DataFrame:
    """Give one more copy, in rank order, to documents that got none yet until the need of their source is met.

    The last document that would overshoot gets no copy.
    """
    have = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("need"))
    ranked = attach(ranked, written(have, f"{name}-need"), "source")
    fits = (F.col("copies") < max_repeat) & (F.col("copies") == F.col("first")) & (F.col("size") <= F.col("need")) & (F.col("size") > 0)
    sums = ranked.filter(fits).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Buckets that fit whole end before the first one whose running sum is above the need.
    cuts = sums.withColumn("to", F.sum("words").over(upto)).groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("to") > F.col("need"), F.col("bucket"))), F.lit(2**62)).alias("cut"), F.coalesce(F.max(F.when(F.col("to") <= F.col("need"), F.col("to"))), F.lit(0)).alias("whole")
    )
    placed = attach(ranked, written(cuts, f"{name}-cuts"), "source", how="left").withColumn("fits", fits & F.col("cut").isNotNull())
    at_cut = F.col("fits") & (F.col("bucket") == F.col("cut"))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter(at_cut).withColumn("more", (F.col("whole") + F.sum("size").over(inside) <= F.col("need")).cast("int"))
    rest = placed.filter(~at_cut).withColumn("more", (F.col("fits") & (F.col("bucket") < F.col("cut"))).cast("int"))
    out = rest.unionByName(edge).withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return written(out.drop("need", "cut", "whole", "fits", "more"), name)


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, preference: Column | None = None, rounds: int = 3, seed: int = 20) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, row, inclusion.

    size is the number of words (null text: 0; texts of any length are counted whole), taken is copies * size, and
    inclusion the probability of one copy more than the certain ones. ``preference``, a column of ``docs``, takes the
    place of the root of the number of words; both count relative to the source's average, see ``_levels``. After the
    first pass, ``rounds - 1`` more passes give the words that the last document left over to documents that fit into
    them, in the same order; these favour short documents, by less than one document's words a source. Sources are
    split by value; a null source is one of its own. Documents without words take nothing. Repeated rows are documents
    of their own; ties in rank go by doc_id, size and text. Other columns are not looked at. An empty table gives no
    rows. The same input gives the same mix: the random number comes from a hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    liking = F.sqrt("size") if preference is None else F.col("liking")
    own = [] if preference is None else [preference.cast("double").alias("liking")]
    base = docs.select("doc_id", "source", size.alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("row"), *own)
    base = written(base.withColumn("liking", liking), "mix-sizes")
    sources = base.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"), F.avg("liking").alias("average"))
    sources = source_targets(sources, weights, share, max_repeat).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    docs_ = attach(base, written(sources, "mix-sources"), "source").withColumn("liking", _levels(F.col("liking") / F.nullif(F.col("average"), F.lit(0.0))))
    docs_ = docs_.withColumn("copies", F.floor("ratio").cast("int"))

    rest = F.col("ratio") - F.col("copies")
    levels = docs_.filter("size > 0").groupBy("source", "liking").agg(F.sum("size").alias("words"), F.max(rest * F.col("source_size")).alias("rest"))
    docs_ = attach(docs_, written(inclusion_scales(levels), "mix-scales"), "source", how="left")
    p = F.when(rest > 0, F.least(F.lit(1.0), F.col("scale") * F.col("liking"))).otherwise(0.0)
    docs_ = docs_.withColumn("inclusion", F.coalesce(p, F.lit(0.0)))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row"), F.col("doc_id")), 12) + 0.5) / float(1 << 52)
    # Random odds over inclusion odds, times the source's mean odds: an increasing map of the rank that is uniform
    # when all of a source's documents are alike, so that buckets of it are even.
    odds = (u / (1 - u)) * ((1 - F.col("inclusion")) / F.col("inclusion")) * (rest / (1 - rest))
    docs_ = docs_.withColumn("rank", F.when((F.col("inclusion") <= 0) | (rest <= 0), F.lit(1.0)).otherwise(odds / (1 + odds)))
    buckets = F.ceil(F.sqrt("n"))
    docs_ = docs_.withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), buckets - 1).cast("long"))

    mixed = written(docs_.withColumn("first", F.col("copies")).drop("liking", "n", "ratio", "average", "scale"), "mix-ranked")
    for i in range(rounds):
        mixed = _fill(mixed, max_repeat, f"mix-round-{i}")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "row", "inclusion")
