"""The corpus operators' registered queries, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseq.llm import bpe, clusters, decontaminate, exact_dedup, lang_id, license_scan, lm_score, manifest, quality, secret_scan, simhash, token_counts, toxicity
from polyseq.llm._shared import lower_az, table


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.group_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, t, array_to_string(ws[i:i + t - 1], ' ') AS win
  FROM (SELECT item_id, ws, t, unnest(range(1, len(ws) - t + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS t FROM b WHERE len(ws) > 0))),
dw AS (
  SELECT doc_id, i, t, array_to_string(ws[i:i + t - 1], ' ') AS win
  FROM (SELECT doc_id, ws, t, unnest(range(1, len(ws) - t + 2)) AS i FROM d, (SELECT DISTINCT t FROM bw) WHERE len(ws) >= t)),
m AS (SELECT doc_id, i, t, item_id FROM dw JOIN bw USING (t, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM (SELECT DISTINCT doc_id, i, t FROM m)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(of(*kinds)), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.format_number(x["coverage"], 3))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", one), ",").alias("licenses"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda i: F.coalesce(F.crc32(i.cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels")
    found = toxicity.judge(table(spark, sf_dir, "documents"), labels.filter(~held_out(labels["doc_id"])))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("hits").cast("long").alias("n_hits"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"))


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds unrolled: a{r} has each vector's nearest centroid and distance, c{r} the centroids."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT i, v, vec_id, b.j AS j, b.d AS d FROM (
    SELECT i, any_value(x.v) AS v, any_value(vec_id) AS vec_id, min({{'d': list_sum(list_transform(range(1, 65), lambda p: (x.v[p] - c.v[p]) * (x.v[p] - c.v[p])))::BIGINT, 'j': c.j}}) AS b
    FROM x, c{r} c GROUP BY i))"""
    moved = """c{s} AS MATERIALIZED (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT j, list((t - ((t % n) + n) % n) // n ORDER BY p) AS v
    FROM (SELECT j, p, sum(v[p])::BIGINT AS t, count(*) AS n FROM a{r}, range(1, 65) q(p) GROUP BY j, p) GROUP BY j) m USING (j))"""
    steps = [x.format(r=r, s=r + 1) for r in range(rounds) for x in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, embedding, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, embedding) - 1 AS j, v FROM x QUALIFY j < {k}),
{", ".join(steps)}
SELECT vec_id, a.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (j)"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 5 == 0, lower_az(docs["text"])).otherwise(docs["text"])
    found = manifest.manifest(docs, found={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: The crc32 of the decimal id by bits, trees level by level, then each leaf's climb with the digests to its left and right.
OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS g, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS met FROM d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS k FROM leaf),
lower_tree(level, g, r, n, digest) AS (
  SELECT 0, g, r, n, leaf FROM ranked
  UNION ALL SELECT level + 1, g, r // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY r)) FROM lower_tree WHERE n > 1 GROUP BY level, g, r // 16, n),
subroots AS (SELECT g, digest AS subroot, max(level) OVER () + 1 AS base, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree(level, g, r, n, digest) AS (
  SELECT (SELECT max(base) FROM subroots), '', r, n, subroot FROM subroots
  UNION ALL SELECT level + 1, g, r // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY r)) FROM upper_tree WHERE n > 1 GROUP BY level, g, r // 16, n),
sides AS (
  SELECT level, g, r, coalesce(string_agg(digest, '' ORDER BY r) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY r) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t
  FROM (SELECT * FROM lower_tree WHERE n > 1 UNION ALL SELECT * FROM upper_tree WHERE n > 1) WINDOW w AS (PARTITION BY level, g, r // 16 ORDER BY r)),
climb(k, level, g, r, own, proof) AS (
  SELECT k, 0, g, r, coalesce(met, leaf), '' FROM ranked
  UNION ALL SELECT k, CASE WHEN s.level IS NULL THEN base ELSE c.level + 1 END, CASE WHEN s.level IS NULL THEN '' ELSE c.g END, CASE WHEN s.level IS NULL THEN u.r ELSE c.r // 16 END,
    CASE WHEN s.level IS NULL THEN own ELSE sha256(l || own || t) END, CASE WHEN s.level IS NULL THEN proof ELSE proof || l || t END
  FROM climb c LEFT JOIN sides s USING (level, g, r) LEFT JOIN subroots u ON u.g = c.g WHERE s.level IS NOT NULL OR u.g IS NOT NULL)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM (SELECT k, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM climb GROUP BY k) JOIN ranked USING (k) JOIN subroots USING (g),
  (SELECT digest AS root FROM upper_tree WHERE n = 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_quality": op3_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_lm_score": op6_lm_score,
        "op7_lang_id": op7_lang_id,
        "op8_license_scan": op8_license_scan,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
        "op11_toxicity": op11_toxicity,
        "op12_clusters": op12_clusters,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op10_decontaminate": OP10_SQL,
        "op12_clusters": _op12_sql(),
        "op13_manifest": OP13_SQL,
    }
