"""Quality rules: text statistics, fixed limits, and robust multivariate outliers, in DataFrame operations only.

The minimum covariance determinant is sought per language and source from several starts: medians, all documents, and
hashed eighths of them. A concentration step keeps the CORE share of documents nearest to the centre, takes their mean
and covariance, and measures all again, which doesn't raise the determinant; steps go on for each start until it stops
falling, and the start that ends with the least determinant gives the estimate. Small groups are judged by the estimate
of a larger one that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, attach, written

GROUP = ("lang", "source")
#: What rows share that an estimate is made of: a small group is judged by the first of these that is large enough.
LEVELS = (GROUP, ("lang",), ("source",), ())
#: Share of a group's documents in the concentrated core.
CORE = 0.75
#: Quantile 0.9999 of the chi-square distribution with four degrees of freedom.
CUTOFF = 23.51
#: The covariance of the nearest 75 % of four normal features is too small by this factor: 0.75 over the share of a
#: chi-square distribution with six degrees of freedom below the 0.75 quantile (5.3853) of that with four.
CONSISTENCY = 1.487
#: Hashed parts of a group of which two are starts, most steps from a start, and what a determinant's logarithm must
#: fall by to go on.
HASHED, MOST_STEPS, FALL = 8, 20, 1e-3


def text_stats(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words to every row.

    Null text has none of them. Columns of ``docs`` named so are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__words", F.array_remove(F.split(text, SPACE_RUN), ""))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.expr("slice(__words, 1, size(__words) - 2)"), lambda w, i: F.xxhash64(w, F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2))),
    ).otherwise(F.expr("array()").cast("array<bigint>"))
    df = df.withColumn("__windows", windows)
    # Windows sorted by hash lie beside their repeats; the places of repeated ones, in order, each cover three words
    # or as many as lie before the next place.
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    df = df.withColumn("__placed", F.when(repeats, placed))
    same = lambda x, j: (F.get(F.col("__placed"), j)["h"] == x["h"])
    df = df.withColumn("__found", F.array_sort(F.transform(F.filter("__placed", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__found", lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col("__found"), j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("__words", "__lines", "__windows", "__placed", "__found")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[tuple[str, Column, float]]:
    """Name, transformed statistic and least standard deviation of each feature."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        ("x0", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), 0.06),
        ("x1", F.log1p(20 * F.col("n_symbols") / words), 0.25),
        ("x2", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), 0.16),
        ("x3", F.sqrt(F.col("n_repeat_words") / words), 0.12),
    ]


def _models(stats: DataFrame, least_rows: int) -> DataFrame:
    """lang, source, model and feeds: the estimate a group is judged by, and all those that its rows count towards.

    A group of fewer than ``least_rows`` rows that pass the fixed limits is judged by its language; if that has fewer,
    by its source; if that has fewer too, by all rows, however many these are.
    """
    counts = written(stats.groupBy(*GROUP).agg(F.count_if(~F.col("base_failed")).alias("n")), "mcd-counts")
    sized = counts
    for g in GROUP:
        sums = counts.groupBy(F.col(g).alias(f"__{g}")).agg(F.sum("n").alias(f"n_{g}"))
        sized = sized.join(sums, F.col(g).eqNullSafe(F.col(f"__{g}"))).drop(f"__{g}")
    level = F.when(F.col("n") >= least_rows, 0).when(F.col("n_lang") >= least_rows, 1).when(F.col("n_source") >= least_rows, 2).otherwise(3)
    part = lambda i, g: F.when(F.lit(LEVELS[i].count(g) > 0), F.col(g)).alias(f"__{g}")
    keys = F.array(*(F.struct(F.lit(i).alias("__level"), *(part(i, g) for g in GROUP)) for i in range(len(LEVELS))))
    member = written(sized.withColumn("level", level).select(*GROUP, "level", F.inline(keys)), "mcd-members")
    used = member.filter(F.col("level") == F.col("__level")).select("__level", *(f"__{g}" for g in GROUP)).distinct()
    used = written(used.select(F.col("__level").alias("level_"), *(F.col(f"__{g}").alias(f"{g}_") for g in GROUP), F.monotonically_increasing_id().alias("model")), "mcd-models")
    same = (F.col("__level") == F.col("level_")) & F.col("__lang").eqNullSafe(F.col("lang_")) & F.col("__source").eqNullSafe(F.col("source_"))
    own = F.max(F.when(F.col("level") == F.col("__level"), F.col("model"))).alias("model")
    return written(member.join(used, same).groupBy(*GROUP).agg(own, F.collect_list("model").alias("feeds")), "mcd-groups")


def _factor(groups: DataFrame, names: list[str], least: list[float]) -> DataFrame:
    """From means m_i and second moments s_ij to the lower factor l_ij of the covariance and log_det.

    A variance below that of the least standard deviation is raised to it, so that a feature which is constant in the
    core (no repeated line, say) doesn't reject every other value of it.
    """
    for i in range(len(names)):
        for j in range(i + 1):
            cov = (F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * CONSISTENCY
            cov = F.greatest(cov, F.lit(least[i] ** 2)) if i == j else cov
            for k in range(j):
                cov = cov - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # What the features before leave of a variance is at least a hundredth of the least one.
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(cov, F.lit(0.01 * least[i] ** 2))) if i == j else cov / F.col(f"l_{j}_{j}"))
    log_det = 2 * sum((F.log(f"l_{i}_{i}") for i in range(1, len(names))), F.log("l_0_0"))
    return groups.withColumn("log_det", log_det).drop(*(f"s_{i}_{j}" for i in range(len(names)) for j in range(i + 1)))


def _moments(names: list[str]) -> list[Column]:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)] + [F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in pairs]


def _distance(df: DataFrame, names: list[str]) -> DataFrame:
    """Squared Mahalanobis distance from the joined centre and factor, by forward substitution."""
    for i, x in enumerate(names):
        y = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"__y{k}")
        df = df.withColumn(f"__y{i}", y / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"__y{i}") ** 2 for i in range(1, len(names))), F.col("__y0") ** 2)
    own = [f"m_{i}" for i in range(len(names))] + [f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)]
    return df.withColumn("distance2", total).drop(*own, "log_det", *(f"__y{i}" for i in range(len(names))))


def _starts(fit: DataFrame, names: list[str], least: list[float]) -> DataFrame:
    """One row per model and start (0: medians, 1: all rows, 2 and 3: hashed parts) with centre, factor and log_det."""
    d = len(names)
    medians = written(fit.groupBy("model").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(names))), "mcd-medians")
    mads = attach(fit, medians, "model").groupBy("model").agg(
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(d)), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"__mad{i}") for i, x in enumerate(names))
    )
    factor = {f"l_{i}_{j}": (F.greatest(1.4826 * F.col(f"__mad{i}"), F.lit(least[i])) if i == j else F.lit(0.0)) for i in range(d) for j in range(i + 1)}
    # No core's determinant yet: a first step from the medians always counts.
    mads = mads.withColumns(factor | {"log_det": F.lit(float("inf")), "start": F.lit(0)}).drop(*(f"__mad{i}" for i in range(d)))
    part = F.pmod(F.xxhash64(*names), F.lit(HASHED).cast("long"))
    of = F.explode(F.array_compact(F.array(F.lit(1), F.when(part == 0, F.lit(2)), F.when(part == 1, F.lit(3)))))
    others = _factor(fit.withColumn("start", of).groupBy("model", "start").agg(*_moments(names)), names, least)
    return written(mads.unionByName(others.withColumn("log_det", F.lit(float("inf")))), "mcd-starts")


def covariance_determinants(fit: DataFrame, names: list[str], least: list[float], steps: int = MOST_STEPS) -> DataFrame:
    """One row per model of ``fit`` (model and the features): centre m_i, factor l_ij and log_det of the least core.

    A core is cut at the approximate CORE quantile of the distances (within a thousandth of the rows), and holds all
    rows that tie there. Every step writes one row per model and start; starts whose determinant no longer falls stay
    out of the next.
    """
    best = now = _starts(fit, names, least)
    for step in range(steps):
        far = _distance(attach(fit, now, "model"), names)
        edges = written(far.groupBy("model", "start").agg(F.percentile_approx("distance2", CORE, 1000).alias("edge")), f"mcd-edge-{step}")
        core = attach(far, edges, "model", "start").filter(F.col("distance2") <= F.col("edge"))
        new = written(_factor(core.groupBy("model", "start").agg(*_moments(names)), names, least), f"mcd-step-{step}")
        before = best.select("model", "start", F.col("log_det").alias("before"))
        now = written(new.join(before, ["model", "start"]).filter(F.col("log_det") < F.col("before") - FALL).drop("before"), f"mcd-fell-{step}")
        if now.isEmpty():
            break
        kept = best.join(now.select("model", "start"), ["model", "start"], "left_anti")
        best = written(kept.unionByName(now), f"mcd-best-{step}")
    rest = [c for c in best.columns if c not in ("model", "start", "log_det")]
    chosen = best.groupBy("model").agg(F.min(F.struct("log_det", "start", *rest)).alias("x"))
    return chosen.select("model", F.col("x.log_det").alias("log_det"), *(F.col(f"x.{c}").alias(c) for c in rest))


def robust_outliers(stats: DataFrame, steps: int = MOST_STEPS, least_rows: int = 30) -> DataFrame:
    """Add base_failed, distance2 and kept to a table of ``text_stats`` with lang and source.

    Estimates come from all rows of a language and source that pass the fixed limits; null is a value of either. A
    group of fewer than ``least_rows`` of them takes that of a parent, see ``_models``. distance2 is null only if no
    row at all passes the fixed limits.
    """
    feats = features()
    names, least = [n for n, _, _ in feats], [s for _, _, s in feats]
    stats = stats.withColumns({n: x for n, x, _ in feats} | {"base_failed": base_failed()})
    keyed = _models(stats, least_rows)
    fit = attach(stats.filter(~F.col("base_failed")).select(*GROUP, *names), keyed.select(*GROUP, "feeds"), *GROUP)
    fit = written(fit.select(F.explode("feeds").alias("model"), *names), "mcd-fit")
    groups = written(covariance_determinants(fit, names, least, steps), "mcd-models")
    judged = written(keyed.select(*GROUP, "model").join(groups, "model", "left").drop("model"), "mcd-judged")
    out = _distance(attach(stats, judged, *GROUP, how="left"), names).drop(*names)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, the statistics, base_failed, distance2, kept.

    Null and empty texts have no words and fail the fixed limits. Texts of any length are counted whole. Repeated rows
    each get a row and count as often. Null lang and source are groups of their own. Other columns, whatever their
    names, are not looked at. An empty table gives no rows.
    """
    stats = text_stats(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return robust_outliers(written(stats, "quality-stats"))
