"""The queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian.llm import batches, bpe, centroids, chat, decontaminate, hamming, langid, lattice, quality, resampling, secrets, simhash, substrings, suffixes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(_read(spark, sf_dir, "embeddings"))
    return hamming.nearest(codes, codes.where("id % 20 = 0"), k=10)


def op3_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(chat.from_turns(_read(spark, sf_dir, "conversations")), chat.SCHEMAS)


def op4_quality_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels").where(batches.bucket(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (batches.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    network = langid.fit(docs.where(batches.bucket(F.col("doc_id"), 5) != 0))
    return langid.predict(docs, network).select("doc_id", (batches.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(simhash.fingerprints(_read(spark, sf_dir, "documents"), words=4), distance=4)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_read(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_read(spark, sf_dir, "documents"), length=50)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return decontaminate.find(docs, decontaminate.fit(docs, _read(spark, sf_dir, "benchmark")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(_read(spark, sf_dir, "documents"), length=400)


_ALL = (op1_lattice_lm_scoring, op2_hamming_top_k, op3_chat_tool_calls, op4_quality_attention_mil, op5_language_id, op6_simhash_near_dedup, op7_secret_scans, op8_substring_dedup, op9_benchmark_decontamination, op10_byte_bpe, op11_importance_resampling, op12_centroid_clustering, op13_suffix_dedup)
QUERIES = {f.__name__: f for f in _ALL}


def _clusters_sql(rounds: int = 3) -> str:
    """Each round assigns by (distance, number) and averages by component."""
    parts = ["""WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16))"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
            SELECT r, min((d, cluster)) AS best FROM (
                SELECT r, cluster, CAST(list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS BIGINT) AS d FROM kept, c{k}) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""m{k} AS MATERIALIZED (
            SELECT cluster, list(f ORDER BY j) AS c FROM (
                SELECT best[2] AS cluster, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS f
                FROM kept JOIN a{k} USING (r), range(1, 65) g(j) GROUP BY 1, 2) GROUP BY cluster),
        c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return ",\n        ".join(parts) + f"""
        SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
               CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON cluster = best[2]"""


ORACLE_SQL: dict[str, str] = {
    "op2_hamming_top_k": """
        WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
        pairs AS (
            SELECT q.vec_id AS query_id, d.vec_id AS neighbour_id,
                   CAST(list_sum(list_transform(range(1, len(q.bits) + 1), lambda j: abs(q.bits[j] - d.bits[j]))) AS BIGINT) AS distance
            FROM codes q JOIN codes d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
        SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
    """,
    "op3_chat_tool_calls": """
        WITH RECURSIVE turns AS (
            SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
                   first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
                   count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS nth
            FROM conversations),
        calls AS (
            SELECT c.conv_id, c.turn, c.text, length(c.text) % 7 <> 0 AS fits, r.text AS content, r.turn IS NOT NULL AS answered,
                   CASE WHEN c.conv_id % 3 = 0 AND c.nth = 1 THEN c.later WHEN c.conv_id % 3 = 0 AND c.conv_id % 9 <> 0 AND c.nth = 2 THEN NULL ELSE c.earlier END AS need
            FROM turns c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'
            WHERE c.role = 'user'),
        longest AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM calls GROUP BY conv_id)),
        ways AS (
            SELECT conv_id, turn, turn AS reached, 0 AS steps FROM calls
            UNION ALL
            SELECT w.conv_id, w.turn, c.need, w.steps + 1 FROM ways w JOIN calls c ON c.conv_id = w.conv_id AND c.turn = w.reached, longest
            WHERE c.need IS NOT NULL AND w.steps < most),
        ends AS (SELECT conv_id, turn, max(reached) AS place, max(steps) >= (SELECT most FROM longest) AS circular FROM ways GROUP BY conv_id, turn),
        placed AS (
            SELECT e.conv_id, e.turn, CASE WHEN circular THEN e.turn ELSE place END AS place, circular,
                   CASE WHEN circular OR place = e.turn THEN 0 ELSE (SELECT max(steps) FROM ways w WHERE w.conv_id = e.conv_id AND w.turn = e.turn AND w.reached = e.place) END AS sub
            FROM ends e),
        lines AS (
            SELECT c.conv_id, p.place, CAST(p.sub AS BIGINT) AS sub, c.turn AS seq, 'call' AS kind, 'call_' || c.turn AS call_id, answered, fits AND NOT circular AS valid,
                   '{"arguments":{' || coalesce('"after":"call_' || need || '",', '') || '"limit":'
                   || CASE WHEN fits THEN CAST(length(text) % 10 AS VARCHAR) ELSE '"' || (length(text) % 10) || '"' END
                   || ',"query":' || to_json(text) || '},"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
                   || ',"id":"call_' || c.turn || '","name":"' || CASE WHEN c.turn % 4 = 0 THEN 'search' ELSE 'lookup' END
                   || '","valid":' || CASE WHEN fits AND NOT circular THEN 'true' ELSE 'false' END || '}' AS json
            FROM calls c JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn
            UNION ALL
            SELECT conv_id, turn, 0, turn, 'message', 'call_' || turn, false, false, '{"content":null,"id":"call_' || turn || '","role":"zz_again"}'
            FROM calls WHERE length(text) % 11 = 0
            UNION ALL
            SELECT conv_id, turn, 0, turn, 'message', NULL, false, false, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
            FROM turns WHERE role NOT IN ('user', 'assistant')
            UNION ALL
            SELECT t.conv_id, t.turn, 0, t.turn, CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'message' END, 'call_' || (t.turn - 1), false, false,
                   '{"content":' || to_json(t.text || CASE WHEN k = 1 THEN ' (again)' ELSE '' END) || ',"id":"call_' || (t.turn - 1) || '","role":"assistant"}'
            FROM turns t CROSS JOIN range(2) g(k) LEFT JOIN calls c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1
            WHERE t.role = 'assistant' AND (k = 0 OR length(t.text) % 5 = 0) AND (k = 1 OR c.turn IS NULL))
        SELECT * FROM lines
    """,
    "op12_centroid_clustering": _clusters_sql(),
}
