"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm import byte_bpe, conversation_repair, decontaminate, language_id, packing, personal_data, quality, secret_scan, simhash_dedup, suffix_dedup, topk, toxicity, vector_codes

RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe_digests(byte_bpe.encode_and_decode(_read(spark, sf_dir, "documents"), path, pattern))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_read(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.scan(_read(spark, sf_dir, "documents")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(*vector_codes.compress(_read(spark, sf_dir, "embeddings")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.damaged(conversations), conversations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secret_scan, op2_suffix_dedup, op3_byte_bpe, op4_toxicity, op5_quality, op6_topk, op7_personal_data, op8_simhash_dedup, op9_decontaminate, op10_language_id, op11_vector_codes, op12_packing, op13_conversation_repair)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6, "op9_decontaminate": OP9, "op11_vector_codes": OP11, "op13_conversation_repair": OP13}


#: Exhaustive scoring of every query row against every other row.
OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Every window of an item's size, or the whole text where it is shorter, that shares a five-word shingle with it; items have five words or more.
OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
 ds AS (SELECT doc_id, p, len(w) - 4 AS nd, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
 bs AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(w) - 4 AS n, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM b)) GROUP BY ALL),
 k AS (SELECT DISTINCT doc_id, item_id, n, least(n, nd) AS m, unnest(range(greatest(1, p - least(n, nd) + 1), least(p, nd - least(n, nd) + 1) + 1)) AS start FROM ds JOIN bs USING (s)),
 h AS (SELECT k.doc_id, k.item_id, k.n, k.m, k.start, ds.s, count(*) AS c FROM k JOIN ds ON ds.doc_id = k.doc_id AND ds.p BETWEEN k.start AND k.start + k.m - 1 GROUP BY ALL),
 m AS (SELECT doc_id, item_id, h.n + h.m AS sizes, start, sum(least(h.c, bs.c)) AS shared FROM h JOIN bs USING (item_id, s) GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(shared AS DOUBLE) / (sizes - shared)), 9) AS similarity FROM m WHERE CAST(shared AS DOUBLE) / (sizes - shared) >= 0.8 GROUP BY ALL
"""

#: Three rounds of nearest entries over distinct parts, of vectors of one length; the last gives the codes.
OP11 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, vec_id, label, pos, q[pos * (len(q) // 16) + 1:(pos + 1) * (len(q) // 16)] AS part FROM v, range(16) AS g(pos)
), d AS (
  SELECT pos, part, count(*) AS n FROM p GROUP BY ALL
), c0 AS (
  SELECT pos, e - 1 AS e, part AS c FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY vec_id NULLS LAST, r) AS e FROM p) WHERE e <= 64
), a0 AS MATERIALIZED (
  SELECT d.pos, d.part, n, min({'s': CAST(list_sum(list_transform(range(1, len(c) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i]))) AS BIGINT), 'e': e}) AS b
  FROM d JOIN c0 USING (pos) GROUP BY d.pos, d.part, n
), u0 AS (
  SELECT pos, e, j, sum(n * x) AS s, sum(n) AS n FROM (SELECT pos, b.e AS e, n, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS j FROM a0) GROUP BY ALL
), m0 AS (
  SELECT pos, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM u0 GROUP BY pos, e
), c1 AS MATERIALIZED (
  SELECT pos, e, coalesce(m0.c, c0.c) AS c FROM c0 LEFT JOIN m0 USING (pos, e)
), a1 AS MATERIALIZED (
  SELECT d.pos, d.part, n, min({'s': CAST(list_sum(list_transform(range(1, len(c) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i]))) AS BIGINT), 'e': e}) AS b
  FROM d JOIN c1 USING (pos) GROUP BY d.pos, d.part, n
), u1 AS (
  SELECT pos, e, j, sum(n * x) AS s, sum(n) AS n FROM (SELECT pos, b.e AS e, n, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS j FROM a1) GROUP BY ALL
), m1 AS (
  SELECT pos, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM u1 GROUP BY pos, e
), c2 AS MATERIALIZED (
  SELECT pos, e, coalesce(m1.c, c1.c) AS c FROM c1 LEFT JOIN m1 USING (pos, e)
), a2 AS MATERIALIZED (
  SELECT d.pos, d.part, min({'s': CAST(list_sum(list_transform(range(1, len(c) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i]))) AS BIGINT), 'e': e}) AS b
  FROM d JOIN c2 USING (pos) GROUP BY d.pos, d.part
), o AS (
  SELECT r, vec_id, label, string_agg(format('{:02x}', b.e), '' ORDER BY pos) AS code, CAST(sum(b.s) AS BIGINT) AS error FROM p JOIN a2 USING (pos, part) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) FROM c2) AS codebooks_sha256 FROM o
"""

#: The program over whole audit strings, a turn a step; the checksum is worked out from its polynomial.
OP13 = r"""
WITH RECURSIVE k AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS k FROM range(256) AS g(i)
), h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations
), n AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, k.k[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM h, k
), g AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM n, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g)
), e AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad FROM f
), z AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [{'c': CAST(0 AS BIGINT), 'a': '', 's': 0, 't': CAST([] AS VARCHAR[])}] AS l FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, list_filter(list_transform(range(4), lambda s: list_sort(list_filter(o, lambda x: x.s = s))[1]), lambda x: x IS NOT NULL) FROM (
    SELECT conv_id, i, list_concat(
      list_transform(w, lambda x: {'c': x.c + 3, 'a': x.a || 'D', 's': x.s, 't': x.t}),
      CASE WHEN fault IN (1, 2) THEN [] ELSE list_concat(
        list_transform(list_filter(w, lambda x: CASE role[1] WHEN 's' THEN x.s = 0 WHEN 'u' THEN x.s <> 2 WHEN 'a' THEN x.s = 2 ELSE false END),
          lambda x: {'c': x.c + (fault // 3), 'a': x.a || 'K', 's': CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 't': list_append(x.t, role || ':' || text)}),
        list_transform(w, lambda x: {'c': x.c + 2 + (fault // 3), 'a': x.a || 'R', 's': CASE WHEN x.s = 2 THEN 3 ELSE 2 END, 't': list_append(x.t, CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END || text)})) END) AS o
    FROM (SELECT conv_id, i, role, text, fault, list_concat(l, m, list_transform(m, lambda x: {'c': x.c + 2, 'a': x.a || 'I', 's': CASE WHEN x.s = 2 THEN 3 ELSE 2 END, 't': list_append(x.t, CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END)})) AS w
      FROM (SELECT z.conv_id, e.i, e.role, e.text, e.fault, z.l, list_transform(z.l, lambda x: {'c': x.c + 2, 'a': x.a || 'I', 's': CASE WHEN x.s = 2 THEN 3 ELSE 2 END, 't': list_append(x.t, CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END)}) AS m
        FROM z JOIN e ON z.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = z.i + 1)))
), y AS (
  SELECT conv_id, list_sort(list_transform(arg_max(l, i), lambda x: CASE x.s
    WHEN 2 THEN {'c': x.c + 2, 'a': x.a || 'I', 's': 3, 't': list_append(x.t, 'assistant:')}
    WHEN 1 THEN {'c': x.c + 4, 'a': x.a || 'II', 's': 3, 't': list_concat(x.t, ['user:', 'assistant:'])} ELSE x END))[1] AS b FROM z GROUP BY conv_id
), q AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM e GROUP BY conv_id
)
SELECT y.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256 FROM y LEFT JOIN q ON y.conv_id IS NOT DISTINCT FROM q.conv_id
"""
