"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm import contamination, conversations, exact, extraction, infilling, lines, mixing, neardup, quality, secrets, substrings, tokens, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = secrets.read_dictionary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    found = secrets.scan_secrets(_documents(spark, sf_dir), dictionary)
    named = F.sha2("candidate", 256).alias("candidate_sha256")
    return found.select("doc_id", "pos", "nth", named, F.char_length("candidate").alias("length"), "probability", "is_secret")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    kept = lines.dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), path)
    return quality.quality_rules(docs, path, bands)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(_pages(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(_pages(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.dedup_exact(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(_documents(spark, sf_dir))
    text = infilling.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    )


_BENCH_WORDS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, {_BENCH_WORDS} AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_BENCH_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT p.doc_id, p.k, p.n, win.item FROM p JOIN win ON p.g = win.g AND p.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN cap
              ELSE weight * arg_min(level, cap / weight) FILTER (cap > level * weight) OVER () END AS target
  FROM l
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(16::DOUBLE, 13) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""

OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id < r.keeper) AS dropped
  FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)
"""

OP13_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS hex FROM documents
), g AS (
  SELECT *, ('0x' || hex[1:8])::BIGINT % (n + 1) AS a, ('0x' || hex[9:16])::BIGINT % (n + 1) AS b, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM h
), c AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS low, greatest(a, b) AS high
  FROM g
), p AS (
  SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
