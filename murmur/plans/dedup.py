"""De-duplication queries over the documents."""

import hashlib

from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import dedup
from murmur.plans.registry import query, with_views
from murmur.plans.text import eff, url_sql

# per-character hash bits, derived from the hash rule for the characters that can occur in the checked texts
_SIGNS = ", ".join(
    f"('{c}', {int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), 'big')}::UBIGINT)"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789"
)
SIM_SQL = f"""sign(ch, h) AS (VALUES {_SIGNS}),
chars AS (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '')) AS ch FROM documents) x WHERE ch <> '' GROUP BY 1, 2),
bit AS (SELECT CAST(unnest(range(0, 64)) AS INT) AS b),
vote AS (SELECT doc_id, b, sum(c * CASE WHEN (h >> CAST(b AS UBIGINT)) & 1::UBIGINT = 1::UBIGINT THEN 1 ELSE -1 END) AS v FROM chars JOIN sign ON chars.ch = sign.ch, bit GROUP BY 1, 2),
sim AS (SELECT doc_id, CAST(sum(CASE WHEN v >= 0 THEN 1::UBIGINT << CAST(b AS UBIGINT) ELSE 0::UBIGINT END) AS UBIGINT) AS sim FROM vote GROUP BY 1)"""
PRINT_SQL = f"""{SIM_SQL},
title AS (SELECT doc_id, text, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents),
prints AS (SELECT t.doc_id, title, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash, sim, {eff('title')} AS len,
  list_sort(list_distinct(CASE WHEN length(regexp_replace(lower(title), '\\s+', '', 'g')) < 2 THEN [regexp_replace(lower(title), '\\s+', '', 'g')]
    ELSE list_transform(range(1, length(regexp_replace(lower(title), '\\s+', '', 'g'))), lambda i: substr(regexp_replace(lower(title), '\\s+', '', 'g'), i, 2)) END)) AS f
  FROM title t JOIN sim s ON t.doc_id = s.doc_id)"""
JACC = "(len(list_intersect(a.f, b.f)) / CAST(len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)) AS DOUBLE))"
HAM = "bit_count(xor(a.sim, b.sim))"


def prints(t):
    return dedup.fingerprinted(t.article.select("article_id", "title", "clean_content"))


def _pairs(t):
    """Every document beside its three predecessors and the first document with the same body."""
    p = prints(t).select("article_id", "title", "content_hash", "sim")
    shift = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumn("other", F.col("article_id") - F.col("k"))
    first = p.groupBy("content_hash").agg(F.min("article_id").alias("other"))
    same = p.join(first, "content_hash").where("article_id > other + 3").select("article_id", "title", "content_hash", "sim", "other")
    left = shift.select("article_id", "title", "content_hash", "sim", "other").unionByName(same)
    right = p.select(F.col("article_id").alias("other"), F.col("title").alias("title_b"), F.col("content_hash").alias("hash_b"), F.col("sim").alias("sim_b"))
    return left.join(right, "other").select("article_id", "other", F.col("title").alias("title_a"), "title_b", F.col("content_hash").alias("hash_a"), "hash_b", F.col("sim").alias("sim_a"), "sim_b")


_PAIR_SQL = f"""pairs AS (SELECT a.doc_id AS article_id, b.doc_id AS other, {JACC} AS j, {HAM} AS h, a.hash = b.hash AS same, least(a.len, b.len) < 10 AS short
  FROM prints a JOIN prints b ON b.doc_id BETWEEN a.doc_id - 3 AND a.doc_id - 1
  UNION ALL SELECT a.doc_id, b.doc_id, {JACC}, {HAM}, true, least(a.len, b.len) < 10 FROM prints a JOIN prints b ON a.hash = b.hash AND b.doc_id = (SELECT min(doc_id) FROM prints c WHERE c.hash = a.hash) WHERE a.doc_id > b.doc_id + 3)"""


@query("D1_content_hash", "SELECT doc_id AS article_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash FROM documents")
def _(t):
    return t.article.select("article_id", dedup.content_hash(F.col("clean_content")).alias("content_hash"))


@query("D2_title_jaccard", f"WITH {PRINT_SQL}, {_PAIR_SQL} SELECT article_id, other, round(j, 6) AS score FROM pairs")
def _(t):
    return _pairs(t).select("article_id", "other", F.round(tx.jaccard(tx.title_features(F.col("title_a")), tx.title_features(F.col("title_b")), 1.0, 0.0), 6).alias("score"))


@query("D3_simhash", f"WITH {SIM_SQL} SELECT doc_id, printf('%016x', sim) AS simhash FROM sim")
def _(t):
    return t.documents.select("doc_id", dedup.simhash_hex(dedup.simhash(F.col("text"))).alias("simhash"))


@query("D4_hamming_distance", f"WITH {PRINT_SQL}, {_PAIR_SQL} SELECT article_id, other, CAST(h AS INT) AS distance FROM pairs")
def _(t):
    return _pairs(t).select("article_id", "other", dedup.hamming(F.col("sim_a"), F.col("sim_b")).alias("distance"))


@query("D5_pair_verdict", f"""WITH {PRINT_SQL}, {_PAIR_SQL} SELECT article_id, other, same OR (NOT short AND j >= 0.85 AND h <= 3) AS is_duplicate,
    CASE WHEN same THEN 'hash' WHEN NOT short AND j >= 0.85 AND h <= 3 THEN 'simhash' END AS method,
    CASE WHEN same OR (NOT short AND j >= 0.85 AND h <= 3) THEN false WHEN short THEN h <= 3 ELSE j >= 0.85 OR h <= 3 END AS dedup_pending FROM pairs""")
def _(t):
    return dedup.pair_verdict(_pairs(t)).select("article_id", "other", "is_duplicate", "method", "dedup_pending")


# brute force over all pairs of the small tables, for checking only
_EDGE_SQL = f"""edges AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM prints a JOIN prints b ON b.doc_id < a.doc_id
    AND (a.hash = b.hash OR (a.len >= 10 AND b.len >= 10 AND {HAM} <= 3 AND len(b.f) >= 0.85 * len(a.f) AND len(a.f) >= 0.85 * len(b.f) AND {JACC} >= 0.85))),
  both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
  groups AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""


@query("D6_duplicate_groups", f"WITH RECURSIVE {PRINT_SQL}, {_EDGE_SQL} SELECT node, component FROM groups")
def _(t):
    return dedup.connected_components(dedup.duplicate_edges(prints(t)))


@query("D6_pending_reviews", f"""WITH {PRINT_SQL} SELECT a.doc_id AS article_id FROM prints a WHERE EXISTS (SELECT 1 FROM prints b WHERE b.doc_id < a.doc_id
    AND ({HAM} <= 3 OR (a.len >= 10 AND b.len >= 10 AND len(b.f) >= 0.85 * len(a.f) AND len(a.f) >= 0.85 * len(b.f) AND {JACC} >= 0.85)))""")
def _(t):
    return dedup.pending_reviews(prints(t))


@query("D7_representative_election", f"""WITH RECURSIVE {PRINT_SQL}, {_EDGE_SQL},
    m AS (SELECT p.doc_id, coalesce(component, p.doc_id) AS g, p.doc_id % 10 / 10e0 AS q, p.doc_id % 3 <> 0 AS ok, CASE WHEN p.doc_id % 17 = 0 THEN 0 ELSE 1 END AS known FROM prints p LEFT JOIN groups ON node = p.doc_id)
    SELECT doc_id AS article_id, g AS group_id, first_value(doc_id) OVER (PARTITION BY g ORDER BY q DESC, ok DESC, known DESC, doc_id) AS representative_id, count(*) OVER (PARTITION BY g) AS group_size FROM m""")
def _(t):
    articles = t.article.withColumns({"quality_score": F.col("article_id") % 10 / 10, "extraction_degraded": F.col("article_id") % 3 == 0})
    out = dedup.elect_representatives(articles, dedup.duplicate_edges(prints(t)))
    return out.select("article_id", "group_id", "representative_id", "group_size")


_CHAIN = "CASE WHEN doc_id % 100 = 55 THEN doc_id + 1 WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id - 1 END"


@query("D8_chain_resolution", """WITH t AS (SELECT doc_id, (SELECT 1) AS one FROM documents)
    SELECT doc_id AS article_id, CASE WHEN doc_id % 100 BETWEEN 55 AND 59 THEN NULL ELSE doc_id - doc_id % 10 END AS root_id, doc_id % 100 BETWEEN 55 AND 59 AS in_cycle FROM t""")
def _(t):
    # the last block of documents may end inside a chain; all targets exist because chains point backwards
    top = t.documents.selectExpr("doc_id AS article_id", f"{_CHAIN} AS duplicate_of_id")
    out = dedup.resolve_chains(top)
    return out.select("article_id", F.when(~F.col("in_cycle"), F.col("root_id")).alias("root_id"), "in_cycle")


@query("D9_url_collisions", f"""WITH u AS (SELECT page_id AS id, sha256({url_sql("regexp_replace(url, '/[^/]*$', '')")}) AS url_hash FROM pages)
    SELECT * FROM (SELECT id, url_hash, min(id) OVER (PARTITION BY url_hash) AS owner_id FROM u) x WHERE id <> owner_id""")
def _(t):
    rows = t.pages.select(F.col("page_id").alias("id"), tx.url_hash(tx.normalize_url(F.regexp_replace("url", "/[^/]*$", "")), F.lit(""), F.lit("")).alias("url_hash"))
    return dedup.url_collisions(rows)


# no key spans two users, so the rows of a user are walked by themselves, with the keys of kept rows in two lists
@query("D10_two_key_dedup", """WITH s AS (SELECT user_id, struct_pack(id := event_id, u := 'u' || CAST(event_id * 7 % 23 AS VARCHAR), k := event_type || CAST(event_id % 11 AS VARCHAR)) AS r FROM events),
    walked AS (SELECT list_reduce(list(r ORDER BY r.id), lambda w, e: CASE WHEN list_contains(w.us, e.u) OR list_contains(w.ks, e.k) THEN w
      ELSE struct_pack(ids := list_append(w.ids, e.id), us := list_append(w.us, e.u), ks := list_append(w.ks, e.k)) END,
      struct_pack(ids := CAST([] AS BIGINT[]), us := CAST([] AS VARCHAR[]), ks := CAST([] AS VARCHAR[]))) AS w FROM (SELECT user_id, r FROM s) GROUP BY user_id)
    SELECT unnest(w.ids) AS event_id FROM walked""")
def _(t):
    rows = t.events.selectExpr(
        "event_id", "concat(event_type, '/', user_id) AS platform", "concat(user_id, '/u', event_id * 7 % 23) AS source_url", "CAST(event_id % 11 AS STRING) AS source_article_id")
    return dedup.two_key_dedup(rows, "event_id").select("event_id")
