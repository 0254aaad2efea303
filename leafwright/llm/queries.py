"""The queries of the training-data operators, with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, mixing, pii, simhash, suffix_dedup, tokens, toxicity, url_filter, warc

TOKENIZER = "word_bpe_49k.json"

_FETCHED = "1704067200 + (page_id * 7919) % 31536000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens_of(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated lists about the hosts of pages: an entry for each host, for each domain above one, and for each first part of a
    path of a host. Each is added at a time that follows from the smallest page_id that has it (m); most are removed a
    month later, and most come back after another forty days."""
    p = pages.select(url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"), "page_id").where("host <> ''")
    first = F.min("page_id").alias("m")
    hosts = p.groupBy("host").agg(first).selectExpr("'hosts' AS list", "if(m % 5 = 0, 'allow', 'block') AS verdict", "host", "'' AS path", "m")
    above = p.where("host LIKE '%.%.%'").groupBy(F.regexp_replace("host", r"^[^.]+\.", "").alias("host")).agg(first).selectExpr("'domains' AS list", "'block' AS verdict", "host", "'' AS path", "m")
    parts = p.groupBy("host", F.regexp_extract("path", "^/[^/]+", 0).alias("path")).agg(first).where("path <> ''").selectExpr("'sections' AS list", "if(m % 2 = 0, 'allow', 'block') AS verdict", "host", "path", "m")
    dated = hosts.unionByName(above).unionByName(parts).withColumn("since", F.expr("1704067200 + (m * 104729) % 20000000"))
    steps = "filter(array(struct('add' AS action, since AS at), struct('remove' AS action, if(m % 3 <> 0, since + 2592000, NULL) AS at), struct('add' AS action, if(m % 4 <> 0, since + 6048000, NULL) AS at)), x -> x.at IS NOT NULL)"
    return dated.selectExpr("list", "verdict", "host", "path", f"inline({steps})")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch times and lists are not among the tables: times are spread over a year by page_id, lists are those of
    list_entries."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(_FETCHED).alias("fetched"))
    return url_filter.filter_urls(captures, list_entries(pages))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_tokens, op4_simhash, op5_exact_dedup, op6_warc, op7_mixing, op8_suffix_dedup, op9_url_filter, op10_decontaminate)}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN octet_length(encode(p.h)) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(p.h)) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g ON p.h = g.h
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, 2 * source_size::DOUBLE AS cap, 2 * source_size::DOUBLE / w AS fullness, sum(source_size) OVER ()::DOUBLE AS everything FROM s1),
s3 AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY fullness, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(w) OVER (ORDER BY fullness, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS leftover FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * everything - 2 * capped) / leftover AS level FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 WHERE level <= fullness ORDER BY fullness, source NULLS LAST LIMIT 1) AS final FROM s4),
s AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, w * final) END AS target, 1.5::DOUBLE * everything AS budget FROM s5),
q AS (SELECT d.*, s.source_size, s.target, s.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT q.*, pass, (sent + pass * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS v(pass) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS run FROM c),
t AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken FROM q LEFT JOIN t ON q.doc_id = t.doc_id
"""

_OP8 = """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS before FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.first_id),
k AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM c),
r AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b, lag(max(p) + 50) OVER (PARTITION BY doc_id ORDER BY g) AS last_b FROM k GROUP BY doc_id, g),
z AS (SELECT r.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(x, CAST(2 * coalesce(last_b, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(last_b, 0)) AS BIGINT)), '' ORDER BY g) AS head, max(b) AS end_b
  FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(z.n_removed, 0) AS n_removed, coalesce(z.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(z.head, '') || substr(x, CAST(2 * coalesce(z.end_b, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""

_OP9 = f"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT 'hosts' AS list, CASE WHEN m % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict, host, '' AS path, m FROM (SELECT host, min(page_id) AS m FROM u WHERE host <> '' GROUP BY 1)
  UNION ALL SELECT 'domains', 'block', host, '', m FROM (SELECT regexp_replace(host, '^[^.]+\.', '') AS host, min(page_id) AS m FROM u WHERE host LIKE '%.%.%' GROUP BY 1)
  UNION ALL SELECT 'sections', CASE WHEN m % 2 = 0 THEN 'allow' ELSE 'block' END, host, path, m FROM (SELECT host, regexp_extract(path, '^/[^/]+', 0) AS path, min(page_id) AS m FROM u WHERE host <> '' GROUP BY 1, 2) WHERE path <> ''),
s AS (SELECT *, 1704067200 + (m * 104729) % 20000000 AS since FROM g),
e AS (SELECT list, verdict, host, path, 'add' AS action, since AS ts FROM s UNION ALL SELECT list, verdict, host, path, 'remove', since + 2592000 FROM s WHERE m % 3 <> 0
  UNION ALL SELECT list, verdict, host, path, 'add', since + 6048000 FROM s WHERE m % 4 <> 0),
e1 AS (SELECT *, lag(action) OVER (PARTITION BY list, verdict, host, path ORDER BY ts, action DESC) AS before FROM e),
e2 AS (SELECT *, lead(ts) OVER (PARTITION BY list, verdict, host, path ORDER BY ts, action DESC) AS until FROM e1 WHERE before IS NULL OR before <> action),
v AS (SELECT list, verdict, host AS parent, path AS under, ts AS since, until FROM e2 WHERE action = 'add' AND (until IS NULL OR until > ts)),
c AS (SELECT page_id, {_FETCHED} AS fetched, host, path FROM u),
m AS (SELECT page_id, list, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(parent) DESC, length(under) DESC, verdict) AS rk
  FROM c JOIN v ON (c.host = parent OR ends_with(c.host, '.' || parent)) AND starts_with(c.path, under) AND since <= fetched AND (until IS NULL OR fetched < until)),
a AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(CASE WHEN rk = 1 THEN verdict END) AS decision FROM m GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(decision, 'allow') AS decision
FROM c LEFT JOIN a ON c.page_id = a.page_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP10 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op6_warc": _OP6, "op7_mixing": _OP7, "op8_suffix_dedup": _OP8, "op9_url_filter": _OP9, "op10_decontaminate": _OP10}
