"""One query for each corpus operator, over the whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, fixity, html_text, langid, phrase_index, pii, quality, sharded_lloyd, simhash, token_counts, trie_frontier, weighted_sampling
from .common import crc_mod, with_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.visible_text(table(spark, sf_dir, "pages"))


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """The pages as a replica has them in which some records have changed, some are lost and some were written to other numbers."""
    n = F.col("page_id")
    flipped = F.concat(F.substring("html", 1, 20), F.lit("?"), F.expr("substring(html, 22)"))
    rows = pages.select(F.when(n % 199 == 11, n * 2 + 1).otherwise(n).alias("page_id"), "url", F.when(n % 97 == 5, flipped).otherwise(F.col("html")).alias("html"), (n % 149 == 7).alias("lost"))
    return rows.where(~F.coalesce("lost", F.lit(False))).drop("lost")


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, damaged_replica(pages), "page_id", fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edit_report(table(spark, sf_dir, "documents"), k=64)


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(crc_mod("doc_id", 5) > 0).select("doc_id", "quality")
    model = quality.fit(docs, seen)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where((crc_mod("doc_id", 4) != 2) & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_frontier.variants(table(spark, sf_dir, "documents"))


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op13_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which all words of a benchmark item stand within 30 words of its rarest one, in any order."""
    return phrase_index.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 30)


QUERIES = {f.__name__: f for f in (op1_bagminhash, op2_deobfuscated_pii, op3_phrase_index, op4_html_layout, op5_viterbi_counts, op6_byte_bpe, op7_merkle_fixity, op8_weighted_sampling, op9_compression_quality, op10_language_masks, op11_trie_frontier, op12_sharded_lloyd, op13_simhash_blocks, phrase_proximity)}

UPPER = phrase_index.UPPER
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# all pairs that share a shingle, exact similarities, and what can be reached from each document
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
s AS (SELECT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM w)),
c AS (SELECT id, s, count(*) AS c FROM s GROUP BY 1, 2), t AS (SELECT id, sum(c) AS t FROM c GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE shared >= 0.8 * (x.t + y.t - shared) - 1e-9),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT id, id FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT id AS doc_id, min(root) AS class_id, min(root) = id AS representative FROM r GROUP BY id
"""

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, {WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, l, array_to_string(w[s + 1:s + l], ' ') AS k FROM (SELECT item, w, least(13, len(w)) AS l, unnest(range(len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dk AS (SELECT rn, l, p, array_to_string(w[p + 1:p + l], ' ') AS k FROM (SELECT rn, l, w, unnest(range(len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT rn, p, l, item FROM dk JOIN win USING (l, k)),
cov AS (SELECT rn, count(DISTINCT q) AS n FROM (SELECT rn, unnest(range(p, p + l)) AS q FROM hit) GROUP BY 1),
its AS (SELECT rn, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
    coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rn) LEFT JOIN its USING (rn)
"""

PROXIMITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), x AS (SELECT rn, unnest(range(len(w))) AS pos, unnest(w) AS term FROM d),
q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark), f AS (SELECT term, count(*) AS f FROM x GROUP BY 1),
rare AS (SELECT item_id, arg_min(term, (coalesce(f, 0), term)) AS rare, count(*) AS n FROM q LEFT JOIN f USING (term) GROUP BY 1),
o AS (SELECT rn, item_id, pos, term FROM x JOIN q USING (term)), p AS (SELECT rn, item_id, n, pos AS place FROM x JOIN rare ON term = rare)
SELECT doc_id, item_id, place AS "at" FROM (SELECT p.rn, p.item_id, place, n, count(DISTINCT term) AS met FROM p JOIN o ON o.rn = p.rn AND o.item_id IS NOT DISTINCT FROM p.item_id AND abs(o.pos - place) <= 30 GROUP BY ALL) JOIN d USING (rn) WHERE met = n
"""

RECORD = "'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nWARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '-1') || '>\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'"
RECORDS = "SELECT coalesce(page_id, -1) AS number, strlen(r) AS length, sha256(r) AS hash FROM (SELECT page_id, " + "{r} AS r FROM {t})"
LEAVES = "SELECT number, sum(length)::BIGINT AS length, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(count(*) || ',' || concat_ws(',', {p})) END AS hash FROM ({r}) GROUP BY 1"
SUMS = ", ".join(f"sum(('0x' || substring(hash, {15 * i + 1}, 15))::HUGEINT)::VARCHAR" for i in range(4))
PLACED = f"SELECT *, number // {fixity.FANOUT**fixity.LEVELS} AS file, (coalesce(sum(length) OVER (PARTITION BY number // {fixity.FANOUT**fixity.LEVELS} ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin FROM ({{l}})"
FIXITY_SQL = f"""
WITH damaged AS (SELECT CASE WHEN page_id % 199 = 11 THEN page_id * 2 + 1 ELSE page_id END AS page_id, url, CASE WHEN page_id % 97 = 5 THEN substring(html, 1, 20) || '?' || substring(html, 22) ELSE html END AS html FROM pages WHERE NOT coalesce(page_id % 149 = 7, false)),
a AS ({PLACED.format(l=LEAVES.format(p=SUMS, r=RECORDS.format(r=RECORD, t="pages")))}), b AS ({PLACED.format(l=LEAVES.format(p=SUMS, r=RECORDS.format(r=RECORD, t="damaged")))})
SELECT coalesce(a.file, b.file) AS file, coalesce(a.number, b.number) AS number, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'changed' END AS status,
    a.begin AS begin_a, a.begin + a.length AS end_a, a.hash AS sha256_a, b.begin AS begin_b, b.begin + b.length AS end_b, b.hash AS sha256_b
FROM a FULL JOIN b ON a.number = b.number WHERE a.hash IS DISTINCT FROM b.hash OR a.length IS DISTINCT FROM b.length
"""

# three rounds of exact integer means, then a last assignment; arrays are unnested so that everything is joins and sums
LLOYD_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM v),
first AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v QUALIFY k < 16),
c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(x) AS x FROM first)
""" + "".join(
    f""", a{t} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(k, d * 16 + k) AS k FROM (SELECT r, k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{t} c USING (i) GROUP BY 1, 2) GROUP BY 1)
, c{t + 1} AS MATERIALIZED (SELECT k, i, coalesce(m, x)::BIGINT AS x FROM c{t} LEFT JOIN (SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{t} JOIN e USING (r) GROUP BY 1, 2) USING (k, i))"""
    for t in range(3)
) + """
, a3 AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(k, d * 16 + k) AS k FROM (SELECT r, k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c3 c USING (i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, k::INTEGER AS "cluster", d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS sha FROM c3 GROUP BY 1) USING (k)
"""

SQL: dict[str, str] = {"op1_bagminhash": NEAR_SQL, "op3_phrase_index": CONTAMINATION_SQL, "op7_merkle_fixity": FIXITY_SQL, "op12_sharded_lloyd": LLOYD_SQL, "phrase_proximity": PROXIMITY_SQL}
