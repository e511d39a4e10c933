"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import new_path
from . import chunk_bpe, cross_tokenizer, decontamination, line_dedup, personal_data, quality_rules, quality_trees, sentencepiece_bpe, simhash, token_counts, token_orc, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judged_by_trusted(table(spark, sf_dir, "documents"), trusted)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece_bpe.encode(docs, model, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), path, tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_orc.checksums(token_orc.read(spark, path))


# The rules of the registered query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH RECURSIVE
rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
located AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
tags AS (
  SELECT host, path, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*>')) AS tag, 'link' AS kind FROM located
  UNION ALL SELECT host, path, unnest(regexp_extract_all(html, '(?is)<meta\s[^>]*>')), 'meta' FROM located),
attributes AS (
  SELECT host, path, kind,
    lower(coalesce(nullif(trim(regexp_extract(tag, '(?is)\srel\s*=\s*"([^"]*)"', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\srel\s*=\s*''([^'']*)''', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\srel\s*=\s*([^"''\s>][^\s>]*)', 1)), ''), '')) AS rel,
    coalesce(nullif(trim(regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\shref\s*=\s*''([^'']*)''', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\shref\s*=\s*([^"''\s>][^\s>]*)', 1)), ''), '') AS href,
    lower(coalesce(nullif(trim(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*"([^"]*)"', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*''([^'']*)''', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*([^"''\s>][^\s>]*)', 1)), ''), '')) AS equiv,
    coalesce(nullif(trim(regexp_extract(tag, '(?is)\scontent\s*=\s*"([^"]*)"', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\scontent\s*=\s*''([^'']*)''', 1)), ''), nullif(trim(regexp_extract(tag, '(?is)\scontent\s*=\s*([^"''\s>][^\s>]*)', 1)), ''), '') AS content
  FROM tags),
targets AS (
  SELECT host, path, CASE
    WHEN kind = 'link' AND regexp_matches(rel, '(^|\s)canonical(\s|$)') THEN href
    WHEN kind = 'meta' AND equiv = 'refresh' THEN trim(regexp_extract(content, '(?is)^[^;,]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1))
    ELSE '' END AS target
  FROM attributes),
absolute AS (
  SELECT host, path, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || host || target
    WHEN regexp_matches(target, '^[?#]') THEN 'http://' || host || path || target
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || target END AS url
  FROM targets WHERE target <> '' AND host <> ''),
ends AS (
  SELECT host, path, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS to_host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS to_path
  FROM absolute WHERE url IS NOT NULL),
plain_ends AS (
  SELECT host, path, to_host, to_path, '/' || array_to_string(list_reduce(
    list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(substr(to_path, 2), '/'), lambda x: [x])),
    lambda kept, x: CASE WHEN x[1] = '..' THEN list_slice(kept, 1, len(kept) - 1) WHEN x[1] = '.' THEN kept ELSE list_append(kept, x[1]) END), '/') AS whole
  FROM ends WHERE to_host <> ''),
edges AS (
  SELECT host || path AS u, to_host || CASE WHEN NOT regexp_matches(to_path, '/\.\.?(/|$)') THEN to_path WHEN whole = '/' THEN whole
    WHEN regexp_matches(to_path, '/\.\.?$') THEN whole || '/' ELSE whole END AS v
  FROM plain_ends),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
nodes AS (SELECT DISTINCT host || path AS node, host, path FROM located WHERE host <> ''
  UNION SELECT v, split_part(v, '/', 1), substr(v, strpos(v || '/', '/')) FROM edges),
ruled AS (
  SELECT n.node, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
         arg_max(r.action, length(r.rule_host || r.rule_path)) AS action
  FROM nodes n JOIN rules r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
  GROUP BY n.node),
blocked(node) AS (
  SELECT node FROM ruled WHERE action = 'block'
  UNION SELECT b.v FROM blocked k JOIN both_ways b ON k.node = b.u)
SELECT l.page_id, l.host, l.path, r.rule,
       coalesce(r.action, CASE WHEN k.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM located l LEFT JOIN ruled r ON l.host || l.path = r.node AND l.host <> ''
LEFT JOIN blocked k ON l.host || l.path = k.node AND l.host <> ''
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, text, md5(text) AS tie FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT DISTINCT doc_id, tie, i, l.line, md5(l.line) AS d,
         len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, tie, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) l
),
flagged AS (
  SELECT *, md5(coalesce(lag(d) OVER p, '') || d) AS r, coalesce(lead(w) OVER p, 0) AS next_w
  FROM lines WINDOW p AS (PARTITION BY doc_id, tie ORDER BY i)
),
cuts AS (
  SELECT *, coalesce(sum(CASE WHEN substr(r, 32, 1) IN ('0','2','4','6','8','a','c','e') OR w >= 50 OR next_w >= 50 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY doc_id, tie ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM flagged
),
filled AS (
  SELECT doc_id, tie, i, sum(w) OVER (PARTITION BY doc_id, tie ORDER BY i) - w AS before,
         sum(w) OVER (PARTITION BY doc_id, tie ORDER BY i) AS after FROM lines WHERE w > 0
),
ranges AS (
  SELECT doc_id, tie, min(i) AS a, max(i) AS b FROM cuts GROUP BY doc_id, tie, k HAVING sum(w) > 0 AND (count(*) >= 2 OR max(w) >= 50)
  UNION SELECT x.doc_id, x.tie, x.i, y.i FROM filled x JOIN filled y
    ON y.doc_id = x.doc_id AND y.tie = x.tie AND y.i >= x.i AND y.after - x.before >= 50 AND (y.before - x.before < 50 OR y.after - x.after < 50)
),
texts AS (
  SELECT r.doc_id, r.tie, r.a, r.b, string_agg(l.line, chr(10) ORDER BY l.i) AS range
  FROM ranges r JOIN lines l ON l.doc_id = r.doc_id AND l.tie = r.tie AND l.i BETWEEN r.a AND r.b GROUP BY r.doc_id, r.tie, r.a, r.b
),
placed AS (SELECT *, row_number() OVER (PARTITION BY range ORDER BY doc_id, tie, a) AS place FROM texts),
gone AS (
  SELECT DISTINCT l.doc_id, l.tie, l.i FROM placed p JOIN lines l
    ON p.place > 1 AND l.doc_id = p.doc_id AND l.tie = p.tie AND l.i BETWEEN p.a AND p.b
),
kept AS (
  SELECT l.doc_id, l.tie, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, tie, i) GROUP BY l.doc_id, l.tie
)
SELECT o.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents o LEFT JOIN kept k ON o.doc_id = k.doc_id AND md5(o.text) = k.tie
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured, forest = quality_trees.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_trees.scored(featured, forest)
    return scored.select(
        "doc_id",
        quality_trees.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality_trees.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def joined(kinds):
        chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in personal_data.BASE_KINDS],
        F.sha2(joined(personal_data.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(personal_data.KINDS).alias("spans"),
    )


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = chunk_bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors), keep=["vec_id"])


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_tokenizer.counted(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_token_orc": op5_token_orc,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality_trees": op9_quality_trees,
    "op10_personal_data": op10_personal_data,
    "op11_chunk_bpe": op11_chunk_bpe,
    "op12_whitening": op12_whitening,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
ORACLE_SQL = {"op6_url_filter": OP6_SQL, "op7_line_dedup": OP7_SQL}
