"""Lineage over dependency edges: src depends on dst.

Walks go round by round: each joins what changed to the edges. A round's result is written to the shared folder, so
that plans stay short, nothing is computed twice, and lost executors cost a round, not the whole walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

#: Severity of a dependency's status, low to high.
SEVERITY = {"RUNNING": 1, "MISSING": 2, "FAILED": 3, "DISABLED": 4}
#: Statuses of dependencies that say why a node doesn't run, and the flag of each.
REASONS = {"FAILED": "upstream_failure", "MISSING": "upstream_missing", "RUNNING": "run_by_other", "UNKNOWN": "scheduling_error"}


def closure(edges: DataFrame, roots: DataFrame, upward: bool = False, most: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): what each root depends on, directly or not, or with ``upward`` what depends on it.

    Roots are in it at depth 0; a node counts at its least depth, cycles end. ``done`` nodes are not entered.
    With ``most`` only so many nodes per root, nearest first; a root that has them isn't followed further.
    """
    a, b = ("dst", "src") if upward else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    if done is not None:
        steps = steps.join(done.select(F.col("id").alias("next")), "next", "left_anti")
    front = saved(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while True:
        depth += 1
        if most is not None:
            full = seen.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
            front = front.join(full.select("root"), "root", "left_anti")
        new = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        front = saved(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    if most is None:
        return seen
    nearest = Window.partitionBy("root").orderBy("depth", "node")
    return seen.withColumn("__n", F.row_number().over(nearest)).filter(F.col("__n") <= most).drop("__n")


def reached(edges: DataFrame, starts: DataFrame, upward: bool = False) -> DataFrame:
    """(node) that is a start or that any start depends on (``upward``: depends on a start), each once."""
    a, b = ("dst", "src") if upward else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = front = saved(starts.select(F.col("id").alias("node")).distinct())
    while True:
        front = saved(front.join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def with_status(closure_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Status of each node; ids that no table knows are UNKNOWN."""
    return closure_.join(nodes.select(F.col("id").alias("node"), "status"), "node", "left").withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


def inherited(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(id, bits): what a node takes over from all that it depends on, the union of their ``own`` (node, bits).

    Only nodes whose bits grew pass them on, so a node is passed on at most once for each bit, and no node's
    dependencies are listed.
    """
    steps = edges.select("src", "dst").distinct()
    with_own = steps.join(own.filter("bits != 0").select(F.col("node").alias("dst"), "bits"), "dst")
    state = grown = saved(with_own.groupBy(F.col("src").alias("id")).agg(F.bit_or("bits").alias("bits")))
    while not grown.isEmpty():
        passed = grown.withColumnRenamed("id", "dst").join(steps, "dst").groupBy(F.col("src").alias("id")).agg(F.bit_or("bits").alias("more"))
        both = saved(state.join(passed, "id", "full_outer").select("id", F.coalesce("bits", F.lit(0)).alias("old"), F.coalesce(F.col("bits").bitwiseOR(F.col("more")), "bits", "more").alias("bits")))
        grown = both.filter("old != bits").select("id", "bits")
        state = both.select("id", "bits")
    return state


def upstream_severity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, severity): the worst status in each node's dependencies; DONE nodes take nothing over and pass nothing on."""
    live = nodes.filter(F.coalesce(F.col("status") != "DONE", F.lit(True)))
    done = nodes.filter(F.col("status") == "DONE").select("id")
    steps = edges.join(done.withColumnRenamed("id", "dst"), "dst", "left_anti").join(done.withColumnRenamed("id", "src"), "src", "left_anti")
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("status")), F.lit(0))
    own = live.select(F.col("id").alias("node"), F.when(level > 0, F.pow(F.lit(2), level)).otherwise(0).cast("int").alias("bits"))
    worst = inherited(steps, own).select("id", F.floor(F.log2("bits")).cast("int").alias("severity"))
    return nodes.select("id").join(worst, "id", "left").withColumn("severity", F.coalesce("severity", F.lit(0)))


def blocked_because(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per PENDING node: upstream_failure, upstream_missing, run_by_other and scheduling_error in its dependencies, or not_run."""
    known = edges.select(F.col("dst").alias("node")).distinct()
    bit = F.create_map(*(F.lit(x) for i, s in enumerate(REASONS) for x in (s, 1 << i)))
    own = with_status(known, nodes).select("node", F.coalesce(F.try_element_at(bit, F.col("status")), F.lit(0)).alias("bits"))
    out = nodes.filter(F.col("status") == "PENDING").select("id").join(inherited(edges, own), "id", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    flags = [(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(REASONS.values())]
    return out.select("id", *flags, (F.col("bits") == 0).alias("not_run"))


def on_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Nodes on any path from a start to a goal; without goals all that the starts depend on."""
    below = reached(edges, starts)
    return below if goals is None else below.join(reached(edges, goals, upward=True), "node", "left_semi")
