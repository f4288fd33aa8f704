"""The registered queries of this folder, over whole tables, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import alignment, decontaminate, line_dedup, merkle, near_dup, quality, secrets, sentencepiece_arrays, sharding, substrings, token_counts, topk, url_filter
from lithic.llm.common import table, vocabulary

URL_RULES = tuple(url_filter.host_rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair token counts of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them restores its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_arrays.encode_documents(docs, vocabulary("piece_bpe_32k.model"), decoded_col="decoded")
    marked = F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")
    return coded.select("doc_id", "n_tokens", "token_ids", (F.col("decoded") == marked).alias("restored"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, copied or reworded."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("cosine", F.round("cosine", 4))


def _kept(spans: str, kinds: tuple[str, ...]):
    return F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))


def _listed(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document, with linked multipart candidates."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(_kept("strong", (k,))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(_listed("strong"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and compression bands of every document."""
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur again, and whether it
    shares a passage of 256 bytes (50 words, about) with another document."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shared")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing placement of every document in 16 shards of near equal bytes."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document without those that repeat an earlier line up to one edit."""
    cut = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies in every document, their common groups, and counts of linked pairs."""
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates, by integer inner product, of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot of the source, root and proof of every document, and what tampered texts fold to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def _url_sql() -> str:
    blocked = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in url_filter.PATTERNS)
    listed = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in URL_RULES)
    upper, lower = url_filter.UPPER, url_filter.LOWER
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {listed}),
cut AS (
  SELECT page_id, translate(url, '{upper}', '{lower}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS r, page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (r)
"""


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        return f"sha256({' || '.join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} ELSE {leaf('text')} END AS kept
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 16, n),
subroots AS (
  SELECT grp, lvl AS depth, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (SELECT grp, lvl, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS held FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 16),
top_runs AS (SELECT lvl, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS held FROM tops WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT p.grp, p.pos, r.lvl, held, CAST(64 * ((p.pos // CAST(pow(16, r.lvl) AS BIGINT)) % 16) AS BIGINT) AS place
  FROM placed p JOIN runs r ON r.grp = p.grp AND r.run = p.pos // CAST(pow(16, r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.grp, p.pos, s.depth + r.lvl, held, CAST(64 * ((s.pos // CAST(pow(16, r.lvl) AS BIGINT)) % 16) AS BIGINT)
  FROM placed p JOIN subroots s ON s.grp = p.grp JOIN top_runs r ON r.run = s.pos // CAST(pow(16, r.lvl + 1) AS BIGINT)),
sides AS (SELECT grp, pos, lvl, substr(held, 1, place) AS l, substr(held, place + 65) AS r FROM steps),
proofs AS (SELECT grp, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, count(*) AS depth FROM sides GROUP BY grp, pos),
folds AS (
  SELECT grp, pos, 0 AS lvl, kept AS made FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.lvl + 1, sha256(s.l || f.made || s.r) FROM folds f JOIN sides s ON s.grp = f.grp AND s.pos = f.pos AND s.lvl = f.lvl)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.made AS folded_root, f.made = t.node AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp JOIN tops t ON t.n = 1
LEFT JOIN proofs q ON q.grp = p.grp AND q.pos = p.pos
JOIN folds f ON f.grp = p.grp AND f.pos = p.pos AND f.lvl = coalesce(q.depth, 0)
"""


TOP_K_SQL = """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_sharding": op8_sharding,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {"op9_url_filters": _url_sql(), "op12_exact_top_k": TOP_K_SQL, "op13_merkle_manifest": _manifest_sql()}
