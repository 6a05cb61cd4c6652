"""The operators as registered queries over the driver tables, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridpulse.llm import alignment, centroids, decontaminate, jaccard, langid, licenses, packing, repeats, secrets, simhash, substring, toxicity, urls
from gridpulse.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def public_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_path() -> str:
    """The public tokenizer file the packing contract names."""
    return public_path(TOKENIZER)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_passages(read(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_substring_dedup, op3_toxicity, op4_url_filter, op5_packing, op6_license_scan, op7_simhash,
        op8_language, op9_secrets, op10_jaccard_join, op11_alignment, op12_centroids, op13_suffix_dedup)
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN.format("text")} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN.format("text")} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT r, doc_id, s, array_to_string(ws[s:s + 12], ' ') AS t
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
f AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM w JOIN f USING (t) WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)),
per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS g,
    array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(ps, []), k)), ' ') AS t
  FROM d LEFT JOIN per USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""

_TEMPLATE_ROWS = ", ".join(
    "('{}', {}, [{}])".format(name, len(s[0].split(" ")), ", ".join(f"'{x}'" for x in s))
    for name, s in ((n, licenses.template_shingles(t)) for n, t in sorted(licenses.TEMPLATES.items())))

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN.format("text")} AS ws FROM documents),
t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS v(name, size, shingles)),
s AS (
  SELECT DISTINCT r, size, array_to_string(ws[p:p + size - 1], ' ') AS shingle
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM t) WHERE len(ws) >= size)),
ts AS (SELECT name, size, len(shingles) AS n, unnest(shingles) AS shingle FROM t),
held AS (SELECT r, name FROM s JOIN ts USING (size, shingle) GROUP BY r, name, n HAVING count(*) >= {licenses.CONTAINED} * n),
per AS (SELECT r, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses FROM held GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN per USING (r)
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format("text")} AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size, string_agg(g, '|' ORDER BY g) AS whole FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.size + y.size - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS copy_of FROM n),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_of, doc_id) AS copy_of, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN class USING (doc_id) LEFT JOIN copies USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_NEAREST = """
d{0} AS (
  SELECT x.r, c.k, sum((x.v - c.v) * (x.v - c.v)) AS distance FROM x JOIN c{0} c USING (i) GROUP BY x.r, c.k),
a{0} AS (SELECT r, k, distance FROM d{0} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""
_MOVED = """,
s{0} AS (SELECT a.k, x.i, sum(x.v) AS s, count(*) AS n FROM a{0} a JOIN x USING (r) GROUP BY a.k, x.i),
c{1} AS (
  SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.v) AS v FROM c{0} c LEFT JOIN s{0} USING (k, i)),"""

# Integer components stand as rows (vector, place, value); each round is a distance table and its nearest centroid.
OP12_SQL = (
    f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (
  SELECT r, i, CAST(floor({centroids.SCALE} * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS v
  FROM (SELECT r, embedding, unnest(range(1, {centroids.COMPONENTS} + 1)) AS i FROM e)),
w AS (SELECT r, list(v ORDER BY i) AS vs FROM x GROUP BY r),
f AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, vs) - 1 AS k
  FROM e JOIN w USING (r) QUALIFY k < {centroids.CLUSTERS}),
c0 AS (SELECT f.k, x.i, x.v FROM f JOIN x USING (r)),"""
    + "".join(_NEAREST.format(k) + _MOVED.format(k, k + 1) for k in range(centroids.ROUNDS)) + _NEAREST.format(centroids.ROUNDS)
    + """,
h AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{0} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{0} JOIN e USING (r) JOIN h USING (k)
""".format(centroids.ROUNDS))

OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT r, s, substr(x, 2 * s + 1, {2 * repeats.WINDOW}) AS t
  FROM (SELECT r, x, unnest(range(0, len(x) // 2 - {repeats.WINDOW - 1})) AS s FROM d WHERE len(x) >= {2 * repeats.WINDOW})),
f AS (SELECT t FROM w GROUP BY t HAVING count(*) > 1),
hit AS (SELECT r, s, s - row_number() OVER (PARTITION BY r ORDER BY s) AS run FROM w SEMI JOIN f USING (t)),
runs AS (SELECT r, min(s) AS a, max(s) + {repeats.WINDOW} AS b FROM hit GROUP BY r, run),
spans AS (
  SELECT r, min(a) AS a, max(b) AS b FROM (
    SELECT *, sum(CASE WHEN a <= before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY a) AS span
    FROM (SELECT *, lag(b) OVER (PARTITION BY r ORDER BY a) AS before FROM runs)) GROUP BY r, span),
gaps AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, -1, 0 FROM d)),
kept AS (
  SELECT r, string_agg(CASE WHEN gaps.b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (gaps.b - a)) END, '' ORDER BY a) AS k
  FROM gaps JOIN d USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM spans GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""

ORACLE: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op6_license_scan": OP6_SQL, "op10_jaccard_join": OP10_SQL, "op12_centroids": OP12_SQL,
                           "op13_suffix_dedup": OP13_SQL}
