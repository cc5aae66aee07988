"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, collocations, decontamination, line_dedup, mixing, near_dedup, ngram_lm, pii, quality, repeated_passages, token_counts, toxicity, warc
from .common import crc_mod

#: The vocabulary file whose tokens op4 counts.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item, one row for each pair of them."""
    found = decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "equal", "overlap", "at")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.page_captures(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), least_docs=10, least_points=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, over=85, under=100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train_field(pii.example_table(spark))
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"), field)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == F.lit(kind)))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"), fold=1, folds=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.drop_repeats(_table(spark, sf_dir, "documents"), length=100, keep_text=False)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = centroid_clusters.clusters(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)
    text = F.array(*(F.lit(",".join(map(str, c))) for c in centroids)) if centroids else F.array(F.lit(""))
    found = centroid_clusters.with_inertia(assigned)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.get(text, "cluster"), 256).alias("centroid_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, covered=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_mixing, op4_token_counts, op5_warc, op6_line_dedup, op7_near_dedup, op8_pii, op9_lm_scoring, op10_quality, op11_repeated_passages, op12_centroid_clusters, op13_collocations)
}


def _clusters_sql(rounds: int = 10) -> str:
    """Ten rounds written out: a{i} assigns to the centroids c{i}, of which c{i+1} are the means."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS distance FROM (SELECT v.vec_id, v.x, c.cluster, CAST({far} AS BIGINT) AS d FROM v, c{i} c) GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT cluster, dim, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS dim FROM a{i}) GROUP BY 1, 2)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS x FROM m{i} GROUP BY 1) m ON m.cluster = c.cluster)")
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM (SELECT sha256('{3}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),
        {", ".join(steps)}
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op11_repeated_passages": """
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d)),
        again AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS o FROM w) WHERE o > 1),
        runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
          FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
        kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last FROM gaps JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_centroid_clusters": _clusters_sql(),
    "op13_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws
          FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
        totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
        counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
          FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size))) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1),
        cuts AS (SELECT lang, phrase, ws, size, a, unnest(range(1, size)) AS k FROM cand),
        scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, k, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM cuts c
          JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1 : c.size], ' ')
          JOIN totals t ON t.lang = c.lang),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
        kept AS (SELECT lang, phrase, a, l, r, n, score FROM best b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.phrase <> b.phrase
          AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a))
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
        FROM m""",
    "op6_line_dedup": """
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY k.doc_id""",
}
