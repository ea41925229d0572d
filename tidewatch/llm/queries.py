"""The registered queries of this package: each applies an operator to its whole table and shapes the result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    bpe, centroids, conversations, embedding_dedup, licenses, line_dedup, mixing, neighbours, pii, quality, sharding, simhash, toxicity)
from tidewatch.llm.rows import fold, held_out, text_of


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies: ``TIDEWATCH_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TIDEWATCH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.plan(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.stored_features(table(spark, folder, "documents").select("doc_id", "text"))
    model = quality.learn(rows, table(spark, folder, "labels"), quality.learning_rows(5, 0))
    scored = rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), quality.score_features(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.found_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[pii.kind_count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    written = spark.read.parquet(sharding.write_shards(docs, shards=40))
    return written.select(
        "doc_id", sharding.row_bytes().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learns = F.coalesce(fold("doc_id", 3) != F.lit(1), F.lit(False))
    model = toxicity.learn(docs, table(spark, folder, "labels"), learns)
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs).select("doc_id", "text", "n_lines", "n_removed")


OP6_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3),
placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l[pos + 1], l[pos + 2], l[pos + 3] ORDER BY doc_id, pos) AS n FROM windows),
gone AS (SELECT doc_id, list(DISTINCT line) AS g FROM (
  SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM placed WHERE n > 1) GROUP BY doc_id)
SELECT lines.doc_id,
       CASE WHEN g IS NULL THEN text
            ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END AS text,
       CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM lines LEFT JOIN gone USING (doc_id)
"""


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"), 0.98)


_USABLE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""
OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("__tw_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary_path())


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP10_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE})
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)) WHERE n <= 20
"""


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    original = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    left = conversations.damage(original)
    told = conversations.report(conversations.repair(left)).alias("r")
    every = conversations.turn_gaps(original, left).alias("g")
    counts = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(told, F.col("g.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select(
        "g.conv_id", "g.gaps", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(centroids.cluster(table(spark, folder, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another: every round is a table of centroids made from the one before."""
    nearest = """SELECT vec_id, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
        SELECT vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS s FROM v JOIN c{0} USING (d) GROUP BY vec_id, c) GROUP BY vec_id"""
    steps = [f"""
a{r} AS MATERIALIZED ({nearest.format(r)}),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, c{r}.d, coalesce(m, y) AS y FROM c{r} LEFT JOIN (
    SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, d)) USING (c, d))""" for r in range(rounds)]
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(e) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS d, unnest(e) AS y FROM (
    SELECT e, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept) WHERE c < {k}),{",".join(steps)},
last AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM last JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) USING (c)
"""


OP12_SQL = _op12_sql()


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    exact = F.filter("spans", lambda s: s.exact)

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")

    starts = F.transform(exact, lambda s: s.start)
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(exact).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"))


def _op13_sql() -> str:
    """The same grams, diagonals and spans in SQL, from the same templates."""
    def words(text: str) -> str:
        return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    values = ", ".join(
        f"({i}, '{t.label}', {t.exact}, {licenses.NAME_GRAM if t.exact else licenses.NOTICE_GRAM}, '" + t.text.replace("'", "''") + "')"
        for i, t in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT id, label, exact, k, {words("text")} AS w FROM (VALUES {values}) AS t(id, label, exact, k, text)),
tg AS (SELECT id, label, exact, k, len(w) AS n, i AS at_, w[i + 1 : i + k] AS g FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM t)),
dg AS (SELECT doc_id, i AS pos, w[i + 1 : i + 2] AS g2, w[i + 1 : i + 4] AS g4 FROM (SELECT *, unnest(range(len(w) - 1)) AS i FROM d)),
hits AS (SELECT doc_id, pos, tg.* FROM dg JOIN tg ON tg.exact AND g2 = g UNION ALL
         SELECT doc_id, pos, tg.* FROM dg JOIN tg ON NOT tg.exact AND g4 = g),
lines AS (SELECT doc_id, id, label, exact, k, n, pos - at_ AS start, list(DISTINCT at_) AS ats, min(pos) AS low, max(pos) AS high
          FROM hits GROUP BY ALL),
cut AS (SELECT *, coalesce(exact OR start - lag(start) OVER o > least({licenses.DRIFT}, n // 2), true) AS fresh FROM lines
        WINDOW o AS (PARTITION BY doc_id, id ORDER BY start)),
spans AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, id ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM cut),
ends AS (SELECT doc_id, id, label, exact, k, n, span, flatten(list(ats)) AS ats, min(low) AS low, max(high + k) AS high FROM spans GROUP BY ALL),
scored AS (SELECT *, len(list_distinct(flatten(list_transform(ats, lambda a: range(a, a + k))))) / greatest(n, high - low) AS score FROM ends),
kept AS (SELECT * FROM scored WHERE score >= CASE WHEN exact THEN 1.0 ELSE {licenses.LEAST_SCORE} END)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (WHERE exact) AS n_base, CAST(min(low) FILTER (WHERE exact) AS BIGINT) AS first_word,
       CAST(max(low) FILTER (WHERE exact) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id, w
"""


OP13_SQL = _op13_sql()

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_quality, op3_pii, op4_sharding, op5_toxicity, op6_line_dedup,
              op7_embedding_dedup, op8_simhash, op9_bpe, op10_neighbours, op11_conversations, op12_centroids, op13_licenses)
}
ORACLES = {"op6_line_dedup": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op10_neighbours": OP10_SQL,
           "op12_centroids": OP12_SQL, "op13_licenses": OP13_SQL}
