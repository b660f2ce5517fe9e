"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.llm import decontaminate, divergence, hard_negatives, html_wrappers, lines, minhash, packing, pii, quality, substrings, topk, url_filter, warc
from listwarden.llm.common import table

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    archives = warc.normalise(warc.write(pages))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, payload_bytes,
  -- five hexadecimal digits are four digits of base 32
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
    lambda u: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS INT) // u) % 32 + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


# fixed values of the contract: host, path, verdict
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Hosts with one of these labels put their pages' canonical URLs on the list.
URL_LABELS = ["ads-track", "adult-x", "cheap-pills", "free-bets", "spam-farm"]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    on_list = F.arrays_overlap(F.split(url_filter.host(F.col("url")), r"\."), F.array(*[F.lit(x) for x in URL_LABELS]))
    listed = pages.filter(on_list).select(url_filter.canonical(F.col("url")).alias("canonical"))
    return url_filter.judge(pages, rules, listed)


ORACLES["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS after FROM pages),
p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=.*)?$')) AS kept
  FROM cut),
c AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM p),
listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'cheap-pills', 'free-bets', 'spam-farm'])),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT c.*, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY page_id, host, path, canonical ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM c LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
  coalesce(rv, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  canonical, coalesce(canonical IN (SELECT canonical FROM listed), false) AS listed
FROM fit WHERE k = 1
"""


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op7_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op6_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS said FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS said FROM di),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, said)),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("found")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


@query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = given.select("vec_id", label.alias("label"), topk.integers(F.col("embedding")).alias("v"))
    return hard_negatives.mine(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS own
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.own, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.positive_rank, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.own, p.positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.own = s.own AND NOT s.same AND p.positive_rank <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 10
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM groups g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v)::HUGEINT AS p
  FROM gn g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(n) AS n FROM lc GROUP BY lang),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lc.n + 1)) // (ln.n + v.v)::HUGEINT AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q) * (p.p - q)) // q AS value
  FROM p JOIN lp USING (lang, term) WHERE p.n > 0 AND p.p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op13_substrings"] = r"""
WITH d AS (SELECT row_number() OVER () AS own, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wa AS (SELECT own, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
said AS (SELECT own, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS said FROM wa),
first AS (SELECT said, min(doc_id) AS first FROM said GROUP BY said HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT own, list(DISTINCT pos) AS gone FROM (SELECT own, unnest(generate_series(i, i + 12)) AS pos FROM said JOIN first USING (said) WHERE first < doc_id) GROUP BY own),
k AS (
  SELECT doc_id, len(w) AS n_words, CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN gone USING (own))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def _pii_sql() -> str:
    """The kinds differ only in pattern and check; positions are sums of the lengths of what lies before."""
    # patterns as the contract states them
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": pii.KINDS["iban"][0], "ssn": pii.KINDS["ssn"][0],
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    checks = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(p, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) ELSE (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)) // 10 + (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)) % 10 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
        "ssn": "regexp_matches(lower(substr(t, greatest(s - 39, 1), least(s, 40)) || ' ' || substr(t, e + 1, 40)), '\\b(ssn|social|security)\\b')",
    }
    parts = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        parts.append(f"""
SELECT doc_id, {k} AS k, '{kind}' AS kind, s, e FROM (SELECT doc_id, t, x.m AS m, x.s AS s, x.s + length(x.m) AS e FROM (
  SELECT doc_id, t, unnest(list_transform(ms, lambda m, i: {{'m': m, 's': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT)}})) AS x
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))
WHERE {checks[kind]}""")
    union = " UNION ALL ".join(parts)
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in pii.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({union})
SELECT d.doc_id, {counts}, sha256(coalesce({told} FILTER (k < 4), '')) AS base_sha256, coalesce({told} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


ORACLES["op10_pii"] = _pii_sql()
