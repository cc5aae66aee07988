"""Parsing, rules, identifiers and text replacement as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters escaped in text exports, in this order.
ESCAPES = {"\\": r"\\", "\t": r"\t", "\n": r"\n", "\r": r"\r", "\v": r"\v", "\b": r"\b", "\f": r"\f"}


def multi_replace(text: Column, pairs: Mapping[str, str]) -> Column:
    """Replace every key by its value in one pass: keys are tried in order, results are not looked at again."""
    quoted = "|".join("\\Q" + k + "\\E" for k in pairs)
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    parts = F.regexp_extract_all(text, F.lit(f"({quoted}|[\\s\\S])"), F.lit(1))
    return F.when(text.isNotNull(), F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), ""))


def map_nulls(value: Column, null_values: Sequence[str]) -> Column:
    return F.when(~value.isin(*null_values), value)


def escape_text(value: Column) -> Column:
    return multi_replace(value, ESCAPES)


def parse_typed(text: Column, kind: str, optional: bool = False) -> Column:
    """str, int, float or bool (true or false in any case); null if invalid, or if empty and ``optional``."""
    if optional:
        text = F.nullif(text, F.lit(""))
    if kind == "bool":
        low = F.lower(text)
        return F.when(low == "true", True).when(low == "false", False)
    return text.try_cast({"str": "string", "int": "long", "float": "double"}[kind])


def in_range(value: Column, low=None, high=None, low_open: bool = False, high_open: bool = True) -> Column:
    """Within bounds, by default [low, high)."""
    rule = F.lit(True)
    if low is not None:
        rule = rule & ((value > low) if low_open else (value >= low))
    if high is not None:
        rule = rule & ((value < high) if high_open else (value <= high))
    return rule


def choice_list(text: Column) -> Column:
    """Comma-separated values in order, repeats kept; empty text is an empty list."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def all_in(values: Column, allowed: Sequence[str]) -> Column:
    return F.forall(values, lambda x: x.isin(*allowed))


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``errors``, the names of the rules that don't hold (null counts as not holding)."""
    checks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their errors."""
    checked = validate(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


#: UTF-16 units that JSON texts write with a letter or sign of their own.
JSON_ESCAPES = {"0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r", "0022": '\\"', "005C": "\\\\"}


def _json_text(value: Column) -> Column:
    """A JSON text in printable ASCII: other characters as \\u and four hex digits of each UTF-16 unit."""
    named = F.create_map(*(F.lit(x) for kv in JSON_ESCAPES.items() for x in kv))
    plain = lambda u: F.char(F.conv(u, 16, 10).cast("long"))
    unit = lambda u: F.coalesce(F.try_element_at(named, u), F.when(u.between("0020", "007E"), plain(u)).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    units = F.regexp_extract_all(F.hex(F.encode(value, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    escaped = F.when(value.rlike(r'[^ !#-\[\]-~]'), F.array_join(F.transform(units, unit), "")).otherwise(value)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def stable_id(family: str, params: Mapping[str, Column]) -> Column:
    """family, the first three parameters by name cut to 16 characters, and ten hex digits of the md5 of the
    parameters as compact JSON sorted by name; what isn't a letter, digit or underscore becomes an underscore.
    """
    names = sorted(params)
    pairs = [F.concat(F.lit(f'"{n}":'), _json_text(params[n])) for n in names]
    digest = F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))), 1, 10)
    first = [F.substring(params[n], 1, 16) for n in names[:3]]
    return F.regexp_replace(F.concat_ws("_", F.lit(family), *first, digest), "[^A-Za-z0-9_]", "_")


def display_name(family: Column, params: Column) -> Column:
    """family(k=v, ...) of a map, sorted by key."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(family, F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def tags(params: Column, default: Sequence[str] = ()) -> Column:
    """k:v for each entry of a map, sorted by key, after the default tags."""
    own = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.concat(F.array(*map(F.lit, default)).cast("array<string>"), own)


def most_common(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value and its count, by group; ties go to the least value."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m"))
    return best.select(*by, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


#: Names that ``suggestions`` may tell as a whole, in one row.
REGISTER = 10_000


def _pieces(length: Column, n: int) -> Column:
    """How a text is cut into ``n`` runs as long as each other or one longer: structs of number, start and size."""
    base = F.floor(length / n).cast("int")
    even = F.lit(n) - length % n  # runs of the shorter size, which come first
    size = lambda i: base + (i > even).cast("int")
    start = lambda i: (i - 1) * base + F.greatest(i - 1 - even, F.lit(0)) + 1
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("i"), start(i).alias("start"), size(i).alias("size")))


def near_candidates(names: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(name, candidate) pairs, with repeats, that hold all pairs within ``most`` edits.

    A known name is cut into ``most`` + 1 pieces. As many edits leave one of them as it is, and move it by no more
    places than there are edits before it and after it, so that both names meet in that piece: names in the pieces that
    they hold near its place, for each length that the other may have. Known names that are too short for pieces of two
    characters meet those of their length, or up to ``most`` shorter or longer.
    """
    n, least = most + 1, 2 * (most + 1)
    names = names.select(F.col("name")).distinct().withColumn("__l", F.length("name"))
    known = known.select(F.col("candidate")).distinct().withColumn("__n", F.length("candidate"))
    cut = lambda text: lambda x: F.struct(x["i"].alias("i"), F.substring(text, x["start"], x["size"]).alias("piece"))
    index = known.filter(F.col("__n") >= least).select("candidate", "__n", F.inline(F.transform(_pieces(F.col("__n"), n), cut(F.col("candidate")))))
    lengths = F.explode(F.sequence(F.greatest(F.col("__l") - most, F.lit(least)), F.col("__l") + most)).alias("__n")
    asked = names.filter(F.col("__l") + most >= least).select("name", "__l", lengths)
    shift = F.col("__l") - F.col("__n")

    def held(x: Column) -> Column:
        before, after = x["i"] - 1, F.lit(n) - x["i"]
        low = F.greatest(x["start"] - before, x["start"] + shift - after, F.lit(1))
        high = F.least(x["start"] + before, x["start"] + shift + after, F.col("__l") - x["size"] + 1)
        starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(x["i"].alias("i"), F.substring(F.col("name"), p, x["size"]).alias("piece")))

    probes = asked.select("name", "__n", F.inline(F.array_distinct(F.flatten(F.transform(_pieces(F.col("__n"), n), held)))))
    pairs = probes.join(index, ["__n", "i", "piece"]).select("name", "candidate")
    short = known.filter(F.col("__n") < least).select("candidate", F.explode(F.sequence(F.col("__n") - most, F.col("__n") + most)).alias("__l"))
    return pairs.unionByName(names.join(short, "__l").select("name", "candidate"))


def nearest_names(names: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(name, candidate, distance) with edit distance at most ``most`` and below the name's length, each pair once.

    Repeated names are one name, null is none. Pieces that a third of the known names share make as many candidates, as
    they do of near names; their join is split where it is skewed, and distances are taken only as far as ``most``.
    """
    distance = F.levenshtein("name", "candidate", most)
    near = near_candidates(names, known, most).withColumn("distance", distance).filter((F.col("distance") >= 0) & (F.col("distance") < F.length("name")))
    return near.distinct()


def suggestions(names: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(name, candidates): the near known names, nearest first, or all of them in order if none is near.

    A register of more than REGISTER names isn't told as a whole: candidates are null for a name with none near.
    """
    near = nearest_names(names, known, most).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("distance", "candidate"))).alias("near"))
    joined = names.join(near, "name", "left")
    found = F.transform("near", lambda x: x["candidate"])
    if known.limit(REGISTER + 1).count() > REGISTER:
        return joined.select("name", found.alias("candidates"))
    every = known.agg(F.array_sort(F.collect_set("candidate")).alias("every"))
    return joined.join(F.broadcast(every)).select("name", F.coalesce(found, F.col("every")).alias("candidates"))  # one row of REGISTER names at most


def flatten_struct(schema: T.StructType, skip: str = "attributes", prefix: str = "") -> list[Column]:
    """Columns of every leaf by its dotted path; subtrees named ``skip`` and lists are left out."""
    out: list[Column] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if field.name == skip or isinstance(field.dataType, (T.ArrayType, T.MapType)):
            continue
        if isinstance(field.dataType, T.StructType):
            out += flatten_struct(field.dataType, skip, f"{path}.")
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path))
    return out


def deep_flatten(value: Column, kind: T.DataType) -> Column:
    """Nested lists and map values as one flat list; null is empty."""
    while isinstance(kind, (T.ArrayType, T.MapType)):
        if isinstance(kind, T.MapType):
            value, kind = F.map_values(value), T.ArrayType(kind.valueType)
        if not isinstance(kind.elementType, (T.ArrayType, T.MapType)):
            return F.coalesce(value, F.array().cast(kind))
        if isinstance(kind.elementType, T.MapType):
            inner = T.ArrayType(kind.elementType.valueType)
            value, kind = F.transform(value, F.map_values), T.ArrayType(inner)
        value, kind = F.flatten(F.filter(value, lambda x: x.isNotNull())), kind.elementType
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast(T.ArrayType(kind)))


def _leaves(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Every field of nested structs by its dotted path, lists and maps as they are."""
    out: list[Column] = []
    for field in schema.fields:
        path = [*prefix.split("\0"), field.name] if prefix else [field.name]
        if isinstance(field.dataType, T.StructType):
            out += _leaves(field.dataType, "\0".join(path))
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
    return out


def flatten_repeated(df: DataFrame) -> DataFrame:
    """Nested and repeated fields as flat rows: one column for each leaf of the schema, by its dotted path.

    Structs become columns. All lists of a row are unfolded together by position, so that siblings stand side by side
    and make no product: a row gives as many rows as its longest list, shorter ones have nulls there, and one without
    elements stays as one row. Lists inside lists are unfolded the same way, level by level. Maps count as lists of
    entries. Columns of equal dotted path are an error, as in any table.
    """
    while True:
        df = df.select(*_leaves(df.schema))
        quoted = lambda c: F.col(f"`{c}`")
        lists = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))}
        if not lists:
            return df
        entries = {c: F.map_entries(quoted(c)) if isinstance(kind, T.MapType) else quoted(c) for c, kind in lists.items()}
        longest = F.greatest(F.lit(1), *(F.coalesce(F.size(x), F.lit(0)) for x in entries.values()))
        placed = df.withColumn("__at", F.explode(F.sequence(F.lit(0), longest - 1)))
        df = placed.select(*(F.get(entries[c], F.col("__at")).alias(c) if c in lists else quoted(c) for c in df.columns))


def json_list(text: Column, element: str = "string") -> Column:
    """A JSON list as an array; null where the text is none, or an element isn't of the type."""
    listed = F.from_json(text, f"array<{element}>", {"mode": "PERMISSIVE"})
    return F.when(F.ltrim(text).startswith("["), listed)


def json_dict(text: Column, value: str = "string") -> Column:
    """A JSON object as a map in the order of the text; null where the text is none."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, f"map<string,{value}>"))


def json_tuple(text: Column, *kinds: str) -> Column:
    """A JSON list, or a bracketed one such as (1, "a"), as a struct _1, _2, ... of given types; null if it has another length."""
    inner = F.regexp_replace(F.trim(text), r"^\((.*?),?\s*\)$", "[$1]")
    parts = F.from_json(inner, "array<string>")
    fields = [F.get(parts, i).try_cast(kind).alias(f"_{i + 1}") for i, kind in enumerate(kinds)]
    return F.when(F.size(parts) == len(kinds), F.struct(*fields))
