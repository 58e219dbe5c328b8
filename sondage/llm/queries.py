"""The registered queries: one per operator, thin over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    divergence,
    exact_dedup,
    mixing,
    multi_index,
    packing,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    token_shards,
    url_filter,
    vector_codes,
    warc,
)
from .common import prepare, table, written

def tokenizer(name: str) -> str:
    import public_tokenizers  # vocabulary files installed beside the library

    return public_tokenizers.path(name)


QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_inverted_multi_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), top=5, recall=0.97)


@query
def op2_substring_dedup(spark, sf_dir):
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_quality_rules(spark, sf_dir):
    # the counts feed learning and judging; written once, as they cost the most
    counts = written(quality_rules.base_counts(table(spark, sf_dir, "documents")), "quality-counts")
    judged = quality_rules.quality_rules(counts, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query
def op4_warc_chunk_table(spark, sf_dir):
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archive(archive).withColumnRenamed("id", "page_id")


@query
def op5_minimum_slack_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query
def op6_simhash_vp_tree(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_token_transducer(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


@query
def op9_token_shards(spark, sf_dir):
    return token_shards.token_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


@query
def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


ORACLES["op10_url_filter"] = """
WITH r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT c.*, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id
    ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1
"""


ORACLES["op4_warc_chunk_table"] = """
WITH a AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, strlen(t) AS payload_bytes, min(page_id) OVER (PARTITION BY t) AS least,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * (d // 16 % 2) + 8 * (d // 8 % 2) + 4 * (d // 4 % 2)
      + 2 * (d // 2 % 2) + d % 2, 1)
    FOR d IN [list_reduce([strpos('0123456789abcdef', substr(h, 5 * (i // 4) + k, 1)) - 1 FOR k IN [1, 2, 3, 4, 5]],
      lambda x, y: 16 * x + y) // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END) % 32
      FOR i IN range(32)]], '') AS payload_digest FROM a)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM b
"""

ORACLES["op2_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=30, top=50)


ORACLES["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gs AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
ls AS (SELECT lang, sum(n) AS total FROM dense GROUP BY ALL),
p AS (SELECT dense.*, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM dense JOIN gs USING (lang, source) JOIN v USING (lang)),
lq AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(ls.total) + 5 * any_value(v)) AS q
  FROM dense JOIN ls USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS f
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op12_digest_index(spark, sf_dir):
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), deliveries=2)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op12_digest_index"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""


@query
def op13_active_lloyd(spark, sf_dir):
    codes, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return vector_codes.label_errors(codes).select("vec_id", code.alias("code"), "error", "label_error",
                                                   F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int = 4) -> str:
    """Full scans in every round; doubles are exact at these sizes."""
    sql = ["""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
  list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS x FROM v, range(4) AS t(part)),
b0 AS MATERIALIZED (SELECT part, r AS entry, x FROM p WHERE r < 256)"""]
    for i in range(rounds + 1):
        sql.append(f"""a{i} AS MATERIALIZED (SELECT r, part, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b{i}.x)
  + list_dot_product(b{i}.x, b{i}.x) AS BIGINT) * 256 + entry) AS m FROM p JOIN b{i} USING (part) GROUP BY r, part)""")
        if i < rounds:
            sql.append(f"""b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, b{i}.x) AS x FROM b{i} LEFT JOIN (
  SELECT part, entry, list(c ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(c) / count(*)) AS c
    FROM (SELECT part, m % 256 AS entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM p JOIN a{i} USING (r, part))
    GROUP BY part, entry, pos) GROUP BY part, entry) AS n USING (part, entry))""")
    return "WITH " + ",\n".join(sql) + f""",
e AS (SELECT r, string_agg(format('{{:02x}}', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), 'string_agg', ','), ','
  ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v JOIN e USING (r) CROSS JOIN h"""


ORACLES["op13_active_lloyd"] = _lloyd_sql()
