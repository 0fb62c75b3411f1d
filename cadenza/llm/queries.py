"""The queries of the numbered operators, and their SQL where SQL can express them.

Each query reads whole tables and returns whole results; it only renames and
derives columns from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import ball_trees, chat_format, decontamination, embedding_dedup, language_id, line_labels, mixing, near_dedup, product_codes, quality, substring_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


#: Arrow batches between the JVM and Python; the default of 64 MB times cores and copies is most of a small executor.
ARROW_BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
_AWKWARD = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_AWKWARD).alias("text"))
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(awkward)))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS previous,
    length(regexp_replace(regexp_replace(regexp_replace(text, '#(\\*)#', '#\\\1#', 'g'), '#(#)', '#\\\1', 'g'), '<(\\*)/(turn|part)>', '<\\\1/\2>', 'g')) AS text_chars,
    length(regexp_replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<(\\*)/(turn|part)>', '<\\\1/\2>', 'g')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN n > 1 AND previous = role THEN 7 ELSE 14 + role_chars END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.u LEFT JOIN low ON e.vec_id = low.u
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after two edits at places that hashes of its doc_id give."""
    length = F.length(F.coalesce("text", F.lit("")))

    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), length + 1).cast("int")

    def part(seed: int, below: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(below)).cast("int")

    one = F.struct(place(31).alias("start"), part(32, 40).alias("length"), F.concat(F.lit(" edit "), part(33, 1000).cast("string")).alias("replacement"))
    two = F.struct(place(34).alias("start"), part(35, 3).alias("length"), F.lit("").alias("replacement"))
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), F.array(one, two))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), least AS (
  SELECT content, min(doc_id) AS low FROM windows GROUP BY content HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN least USING (content), range(13) AS r(k) WHERE doc_id > low
), cells AS (
  SELECT doc_id, j, words[j] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM w)
), kept AS (
  SELECT c.doc_id, string_agg(c.word, ' ' ORDER BY c.j) AS text, count(*) AS n FROM cells c ANTI JOIN gone g ON c.doc_id = g.doc_id AND c.j = g.j GROUP BY c.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with which every language has the same expected tokens, at the tokens there are."""
    return mixing.mix(table(spark, sf_dir, "documents"), label="lang")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_trees.with_inertia(*ball_trees.cluster(table(spark, sf_dir, "embeddings")))


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _op11_sql(rounds: int = 3) -> str:
    near = "SELECT r, k, d FROM (SELECT v.r, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM kept v, {c} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1"
    steps = []
    for t in range(rounds):
        steps.append(f"""a{t} AS MATERIALIZED ({near.format(c=f"c{t}")}),
m{t} AS MATERIALIZED (
  SELECT k, list({_FLOOR_MEAN} ORDER BY i) AS x FROM (
    SELECT k, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN kept v USING (r), range(1, 65) AS g(i) GROUP BY k, i) GROUP BY k),
c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (k))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, {_integers(64)} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)
), {", ".join(steps)},
last AS MATERIALIZED ({near.format(c=f"c{rounds}")})
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{rounds} c USING (k)
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books, _ = product_codes.compress(table(spark, sf_dir, "embeddings"))
    return product_codes.with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(product_codes.digest(books)).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 6) -> str:
    near = "SELECT r, p, k, d FROM (SELECT v.r, v.p, c.k, CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM parts v JOIN {c} c USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1"
    steps = []
    for t in range(rounds):
        steps.append(f"""a{t} AS MATERIALIZED ({near.format(c=f"c{t}")}),
m{t} AS MATERIALIZED (
  SELECT p, k, list({_FLOOR_MEAN} ORDER BY i) AS x FROM (
    SELECT p, k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT p, k, unnest(v.x) AS x, unnest(range(1, len(v.x) + 1)) AS i FROM a{t} JOIN parts v USING (r, p)) GROUP BY p, k, i) GROUP BY p, k),
c{t + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (p, k))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {_integers(4096)} AS x FROM embeddings WHERE {_FINITE}
), parts AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM kept, range(8) AS g(p)
), c0 AS MATERIALIZED (SELECT p, r - 1 AS k, x FROM parts WHERE r <= 16),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(c=f"c{rounds}")}),
coded AS MATERIALIZED (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


def op13_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_labels.judge(docs, line_labels.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_labels": op13_line_labels,
}

ORACLE: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_centroid_clustering": _op11_sql(),
    "op12_vector_codes": _op12_sql(),
}
