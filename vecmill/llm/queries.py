"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, embeddings, filters, langid, licenses, pii, shards, simhash, substrings, suffixes, token_counts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents")).drop("proportions")


def op4_simhash_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_itq_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lstm_crf_pii, op2_fixed_block_anchors, op3_language_mixture, op4_simhash_vantage_tree, op5_byte_bpe, op6_itq_multi_index, op7_suffix_sort, op8_hilbert_shards, op9_benchmark_decontamination, op10_token_counts, op11_filter_interactions, op12_license_scan, op13_vector_codes)}


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
low AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM w JOIN low USING (g) WHERE low < doc_id) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS (SELECT rid, unnest(range(0, length(hx) // 2 - 199)) AS s FROM d),
w AS (SELECT rid, s, md5(substr(hx, CAST(2 * s + 1 AS INTEGER), 400)) AS g FROM p JOIN d USING (rid)),
dup AS (SELECT rid, s FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
edge AS (SELECT rid, s, s > coalesce(max(s) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, -1) AS opens FROM dup),
run AS (SELECT rid, min(s) AS a, max(s) + 200 AS z FROM (SELECT rid, s, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY rid ORDER BY s) AS k FROM edge) GROUP BY rid, k),
keep AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM run),
cut AS (SELECT keep.rid, string_agg(substr(hx, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS head, max(z) AS last, sum(z - a) AS removed, count(*) AS spans FROM keep JOIN d USING (rid) GROUP BY keep.rid)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN cut.rid IS NULL THEN hx ELSE head || substr(hx, CAST(2 * last + 1 AS INTEGER)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""

OP9_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)
), found AS (SELECT pos.rid, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.w = win.w),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents
), f AS (
  SELECT part, doc_id, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, e FROM d
), g AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
  GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS turn
  FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), h AS (
  SELECT part, filter_order, turn, fails, n, good, toxic, coalesce(list_position(list_transform(turn, lambda i: fails[i]), true), 6) AS first, list_sum(list_transform(fails, lambda x: CAST(x AS INTEGER))) AS n_fails FROM g, o
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, sum(n) FILTER (WHERE first > step) AS kept, sum(n) FILTER (WHERE first = step) AS removed, sum(n) FILTER (WHERE fails[turn[step]] AND first < step) AS redundant,
         sum(n) FILTER (WHERE fails[turn[step]] AND n_fails = 1) AS unique_fails, sum(n) FILTER (WHERE first = step AND good = 1) AS good_lost, sum(n) FILTER (WHERE first = step AND toxic = 1) AS toxic_lost
  FROM h, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM steps
"""


def _op13_sql(rounds: int = 6) -> str:
    nearest = "(SELECT v.rid, v.p, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS m FROM v JOIN b{0} b USING (p) GROUP BY v.rid, v.p)"
    ctes = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM k, (SELECT unnest(range(8)) AS p))",
        "b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM v WHERE rid <= 16)",
    ]
    for i in range(rounds):
        ctes += [
            f"n{i} AS MATERIALIZED (SELECT rid, p, m.e AS e FROM {nearest.format(i)})",
            f"s{i} AS (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM v JOIN n{i} USING (rid, p)) GROUP BY p, e, j)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY p, e) m USING (p, e))",
        ]
    ctes += [
        f"final AS MATERIALIZED (SELECT rid, p, m.e AS e, m.d AS d FROM {nearest.format(rounds)})",
        "coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY rid)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN k USING (rid), digest"


def oracle_sql() -> dict[str, str]:
    return {"op2_fixed_block_anchors": OP2_SQL, "op7_suffix_sort": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_filter_interactions": OP11_SQL, "op13_vector_codes": _op13_sql()}
