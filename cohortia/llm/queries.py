"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import conversation, language_id, line_dedup, mixing, nearest, ngram_join, packing, pii, quality, spelling, toxicity, url_filter, warc
from cohortia.llm.sql import OP12, OP13
from cohortia.llm.texts import remainder
from cohortia.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held_out(by: int, rest: int):
    return F.coalesce(remainder("doc_id", by) == rest, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.learn(docs.filter(remainder("doc_id", 3) != 1))
    return language_id.identify(docs, model).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write(_table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_equal", "n_near", "text")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.judge(docs, quality.learn(docs, _table(spark, folder, "labels")))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels.filter(remainder("doc_id", 4) != 2)))
    return scored.select("doc_id", _held_out(4, 2), "score", "predicted", F.size("segments").alias("n_segments"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, folder, "documents"))


# The given rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    labels = _table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return url_filter.judge(pages, URL_RULES, url_filter.mined(pages, labels))


def byte_tokens() -> dict[str, str]:
    """The byte-level vocabulary in both forms."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, folder, "documents"), **byte_tokens()))


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


MIX_TARGETS = {"good": 0.85, "low": 0.08, "toxic": 0.07}


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return _table(spark, folder, "labels").select("doc_id", domain.alias("domain"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = mixing.rates(docs, domain_labels(spark, folder), MIX_TARGETS)
    return found.select("doc_id", F.col("n_words").alias("n_tokens"),
                        *(F.coalesce(F.col("p")[name], F.lit(0.0)).alias(f"p_{name}") for name in MIX_TARGETS), "rate", "copies")


def _listed(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.private_spans(_table(spark, folder, "documents"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS long)").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.audited(*conversation.damaged(_table(spark, folder, "conversations")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_mixing": op10_mixing,
    "op11_personal_data": op11_personal_data,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}
# op3: candidates share ten characters at either end, the edit is found after the common beginning.
_OP3_SQL = r"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
every AS (SELECT doc_id, text, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM parts),
lines AS (SELECT doc_id, line_no, line FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM lines),
firsts AS (SELECT line, min(place) AS first, length(line) AS n FROM ranked GROUP BY line),
pairs AS (
  SELECT a.line AS a, b.line AS b, b.n AS nb FROM firsts a JOIN firsts b
    ON left(a.line, 10) = left(b.line, 10) AND a.first < b.first
  WHERE a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1
  UNION
  SELECT a.line, b.line, b.n FROM firsts a JOIN firsts b ON right(a.line, 10) = right(b.line, 10) AND a.first < b.first
  WHERE a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1),
split AS (
  SELECT a, b, coalesce(list_min(list_filter(range(1, least(length(a), nb) + 1),
    lambda i: substr(a, i, 1) <> substr(b, i, 1))), least(length(a), nb) + 1) AS d FROM pairs),
near AS (
  SELECT DISTINCT b AS line FROM split WHERE substr(a, d + 1) = substr(b, d + 1)
    OR substr(a, d) = substr(b, d + 1) OR substr(a, d + 1) = substr(b, d)),
judged AS (
  SELECT r.doc_id, r.line_no, r.place <> f.first AS is_equal, r.place = f.first AND n.line IS NOT NULL AS is_near
  FROM ranked r JOIN firsts f USING (line) LEFT JOIN near n USING (line))
SELECT d.doc_id, count(j.line_no) AS n_lines, count(*) FILTER (WHERE j.is_equal) AS n_equal,
  count(*) FILTER (WHERE j.is_near) AS n_near,
  coalesce(string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (WHERE NOT coalesce(j.is_equal OR j.is_near, false)), '') AS text
FROM documents d LEFT JOIN every e USING (doc_id) LEFT JOIN judged j ON j.doc_id = e.doc_id AND j.line_no = e.line_no
GROUP BY d.doc_id
"""

# op6: token sets of any size, one token more in each round, in place of FP-growth.
_OP6_SQL = """
WITH RECURSIVE cut AS (
  SELECT page_id, url,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', 1), '') AS h,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3), '') AS query
  FROM pages),
rows AS (
  SELECT row_number() OVER () AS row_no, page_id, path, host, list_distinct(
    list_transform(list_filter(regexp_split_to_array(host, '[\\x00-/:-`{-\\x7F]+'), lambda w: w <> ''), lambda w: 'h:' || w)
    || list_transform(list_filter(regexp_split_to_array(low_path, '[\\x00-/:-`{-\\x7F]+'), lambda w: w <> ''), lambda w: 'p:' || w)
    || list_transform(list_filter(regexp_split_to_array(low_query, '[\\x00-/:-`{-\\x7F]+'), lambda w: w <> ''), lambda w: 'q:' || w)
    ) AS held
  FROM (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low_path,
          translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low_query FROM cut)),
known AS (
  SELECT r.row_no, r.held, (l.quality = 0 OR l.toxic = 1) AS blocked
  FROM rows r JOIN labels l ON l.doc_id = r.page_id WHERE (l.quality = 0 OR l.toxic = 1) IS NOT NULL),
marked AS (SELECT row_number() OVER () AS n, held, blocked FROM known),
toks AS (SELECT n, blocked, unnest(held) AS t FROM marked),
least AS (SELECT ceil(0.005 * count(*)) AS rows FROM known),
sets AS (
  SELECT [t] AS s, t AS top, n, blocked FROM toks
  QUALIFY count(*) FILTER (WHERE blocked) OVER (PARTITION BY t) >= (SELECT rows FROM least)
  UNION ALL
  SELECT s, top, n, blocked FROM (
    SELECT list_append(a.s, b.t) AS s, b.t AS top, a.n, a.blocked FROM sets a JOIN toks b ON a.n = b.n AND a.top < b.t)
  QUALIFY count(*) FILTER (WHERE blocked) OVER (PARTITION BY s) >= (SELECT rows FROM least)),
rules AS (SELECT s FROM sets GROUP BY s HAVING count(*) FILTER (WHERE blocked) / count(*) >= 0.7),
bad AS (SELECT DISTINCT r.row_no FROM rows r JOIN rules ON list_has_all(r.held, rules.s)),
fixed AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS f(fh, fp, verdict)),
best AS (
  SELECT r.row_no, arg_max(fh || fp, length(fh || fp)) AS rule, arg_max(f.verdict, length(fh || fp)) AS verdict
  FROM rows r JOIN fixed f ON (r.host = fh OR ends_with(r.host, '.' || fh)) AND starts_with(r.path, fp) GROUP BY 1)
SELECT r.page_id, r.host, r.path, best.rule,
  coalesce(best.verdict, CASE WHEN bad.row_no IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM rows r LEFT JOIN best USING (row_no) LEFT JOIN bad USING (row_no)
"""

ORACLE = {
    "op3_line_dedup": _OP3_SQL,
    "op6_url_filter": _OP6_SQL,
    "op12_spelling_variants": OP12,
    "op13_conversation_repair": OP13,
}
