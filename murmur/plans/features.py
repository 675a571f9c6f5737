"""Feature, keyword and topic queries over documents, vectors and labels."""

from pyspark.sql import functions as F

from murmur.config import FeatureConfig, TopicConfig
from murmur.functions import text as tx
from murmur.operators import features, topics
from murmur.plans.registry import query, with_views

CFG = FeatureConfig()


def docs(t):
    """Documents as analysis input: tokens of the title and of the text, two derived entities and a hash tag."""
    title = F.substring(F.split("text", "\n")[0], 1, 80)
    empty = F.array().cast("array<string>")
    return t.documents.select(
        F.col("doc_id").alias("article_id"), title.alias("title"), tx.tokens(title).alias("title_tokens"), tx.tokens(F.col("text")).alias("body_tokens"),
        F.col("source").alias("platform"), F.when(F.col("doc_id") % 4 == 0, 0.8).otherwise(1.0).alias("nlp_weight"),
        F.create_map(F.concat(F.lit("place "), F.col("lang")), F.lit("location")).alias("entities"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("#"), F.col("lang"), F.lit("#")))).otherwise(empty).alias("topics"),
        (F.col("doc_id") % 25).alias("event_id"), F.col("text").alias("clean_content"))


_TOK = "list_transform(regexp_extract_all({}, '[\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z]+|\\d+(?:\\.\\d+)?'), lambda t: lower(t))"


def grams(x: str) -> str:
    return f"list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"


_DOC = f"""doc AS MATERIALIZED (SELECT doc_id AS article_id, lang, source, {_TOK.format('substr(split_part(text, chr(10), 1), 1, 80)')} AS tt, {_TOK.format('text')} AS bt,
    list_concat({_TOK.format('substr(split_part(text, chr(10), 1), 1, 80)')}, {_TOK.format('text')}) AS ct FROM documents),
  gram AS MATERIALIZED (SELECT article_id, unnest({grams('ct')}) AS term FROM doc),
  vocab AS MATERIALIZED (SELECT term, count(*) AS count, count(DISTINCT article_id) AS df FROM gram GROUP BY term HAVING count(DISTINCT article_id) <= 0.9 * (SELECT count(*) FROM documents)
    ORDER BY count(*) DESC, term LIMIT 5000),
  weighted AS MATERIALIZED (SELECT article_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT article_id, unnest({grams('tt')}) AS term FROM doc
    UNION ALL SELECT article_id, unnest({grams('bt')}) FROM doc) x WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2),
  tfidf AS MATERIALIZED (SELECT article_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY article_id)) AS score FROM (
    SELECT article_id, term, (1 + ln(weight)) * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) OVER (PARTITION BY term) AS DOUBLE)) + 1) AS x FROM weighted) y)"""


def corpus(t):
    d = docs(t)
    n = t.documents.count()
    terms = features.vocabulary(d, n, CFG).persist()  # at most max_features rows, used by every later pass
    return d, n, terms


def scores(t):
    d, n, terms = corpus(t)
    return d, features.tfidf(features.weighted_counts(d, terms, CFG), n)


@query("F1_vocabulary", f"WITH {_DOC} SELECT term, count, df FROM vocab")
def _(t):
    return corpus(t)[2]


@query("F1_ngram_counts", f"WITH {_DOC} SELECT article_id, term, count(*) AS count FROM gram WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2")
def _(t):
    d, _n, terms = corpus(t)
    return features.term_counts(d, terms)


@query("F2_weighted_counts", f"WITH {_DOC} SELECT article_id, term, weight FROM weighted")
def _(t):
    d, _n, terms = corpus(t)
    return features.weighted_counts(d, terms)


@query("F3_tfidf", f"WITH {_DOC} SELECT article_id, term, round(score, 6) AS score FROM tfidf")
def _(t):
    return scores(t)[1].withColumn("score", F.round("score", 6))


@query("F4_corpus_guard", """SELECT source, count(*) AS documents, CASE WHEN count(*) = 1 THEN 'SINGLE_DOCUMENT_FALLBACK' WHEN count(*) < 5 THEN 'SMALL_CORPUS' END AS warning,
    CASE WHEN count(*) < 5 THEN 1e0 ELSE 0.9e0 END AS effective_max_df FROM documents GROUP BY source""")
def _(t):
    n = F.col("documents")
    return t.documents.groupBy("source").agg(F.count("*").alias("documents")).select(
        "source", "documents", F.when(n == 1, "SINGLE_DOCUMENT_FALLBACK").when(n < CFG.minimum_normal_documents, "SMALL_CORPUS").alias("warning"),
        F.when(n < CFG.minimum_normal_documents, 1.0).otherwise(CFG.max_df).alias("effective_max_df"))


# every document has an entity and long texts, so the lists are full without graph-rank filling
_KEYWORD = """merged AS (SELECT article_id, term, max(own) AS own, max(src) AS src, max(ent) AS ent FROM (
      SELECT article_id, term, score AS own, 0 AS src, 0 AS ent FROM tfidf WHERE NOT regexp_matches(term, '^\\d+(\\.\\d+)?$')
      UNION ALL SELECT article_id, 'place ' || lang, NULL, 1, 1 FROM doc UNION ALL SELECT article_id, '#' || lang || '#', NULL, 2, 0 FROM doc WHERE article_id % 3 = 0) x GROUP BY 1, 2),
  anchored AS (SELECT *, coalesce(max(own) OVER (PARTITION BY article_id), 1e0) AS a FROM merged),
  cand AS (SELECT article_id, term, CASE src WHEN 2 THEN greatest(coalesce(own, 0), CASE ent WHEN 1 THEN a * 0.95e0 ELSE 0 END, a * 0.9e0) ELSE greatest(coalesce(own, 0), CASE ent WHEN 1 THEN a * 0.95e0 ELSE 0 END) END AS s,
    CASE src WHEN 2 THEN 'topic' WHEN 1 THEN 'entity' ELSE 'tfidf' END AS source, CASE WHEN src = 2 THEN 'hashtag' WHEN src = 1 THEN 'location' WHEN contains(term, ' ') THEN 'phrase' ELSE 'word' END AS type FROM anchored),
  kept AS (SELECT * FROM cand c WHERE type <> 'word' OR NOT EXISTS (SELECT 1 FROM cand p WHERE p.article_id = c.article_id AND p.type = 'phrase' AND contains(p.term, c.term) AND p.s >= c.s)),
  top AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, term) AS rank FROM kept)"""


# words filled in by graph rank have no SQL form: all rows are checked by rule on a small table in the tests
@query("F5_article_keywords", None)
def _(t):
    d, s = scores(t)
    return features.article_keywords(s, d)


@query("F6_graph_rank_words", None)
def _(t):
    d = docs(t)
    return d.select("article_id", F.explode(features.textrank(F.concat("title_tokens", "body_tokens"))).alias("word"))


@query("F7_event_keywords", f"""WITH {_DOC}, w AS (SELECT article_id, article_id % 25 AS event_id, source AS platform, lang, CASE WHEN article_id % 4 = 0 THEN 0.8e0 ELSE 1e0 END AS w FROM doc),
  rows AS (SELECT event_id, t.article_id, platform, term, score * w AS s, 0 AS stage, 'tfidf' AS source, CASE WHEN contains(term, ' ') THEN 'phrase' ELSE 'word' END AS type FROM tfidf t JOIN w ON w.article_id = t.article_id WHERE NOT regexp_matches(term, '^\\d+(\\.\\d+)?$')
    UNION ALL SELECT event_id, article_id, platform, 'place ' || lang, 0.25e0 * w, 1, 'entity', 'location' FROM w
    UNION ALL SELECT event_id, article_id, platform, '#' || lang || '#', 0.2e0 * w, 1, 'topic', 'hashtag' FROM w WHERE article_id % 3 = 0),
  g AS (SELECT event_id, term, round(sum(s), 9) AS raw, arg_max(source, stage) AS source, arg_max(type, stage) AS type, count(DISTINCT article_id) AS document_count, count(DISTINCT platform) AS platform_count FROM rows GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY raw DESC, document_count DESC, platform_count DESC, term) AS rank, max(raw) OVER (PARTITION BY event_id) AS m FROM g WHERE document_count >= 2 OR type <> 'word')
  SELECT event_id, CAST(rank AS INT) AS rank, term, round(raw / m, 6) AS score, source, type, document_count, round(document_count / CAST((SELECT count(*) FROM w WHERE w.event_id = k.event_id) AS DOUBLE), 6) AS document_ratio, platform_count
  FROM k WHERE rank <= 20""")
def _(t):
    d, s = scores(t)
    return features.event_keywords(s, d, d.select("event_id", "article_id"))


_LISTED = """SELECT event_id AS article_id, CAST(i AS INT) AS rank, CASE WHEN i = 1 AND user_id % 3 = 0 THEN '查询' WHEN i = 2 THEN concat('词', CAST(event_id % 9 AS STRING)) WHEN i = 5 THEN 'latin' ELSE concat('话题', CAST((event_id * i) % 13 AS STRING)) END AS term,
    CAST(CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 WHEN 4 THEN 0.125 ELSE 0.0625 END AS DOUBLE) AS score, CASE WHEN i = 1 AND user_id % 3 = 0 THEN 'query' ELSE 'llm' END AS source, CASE event_id % 3 WHEN 0 THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN i % 2 = 0 THEN 'event' ELSE 'concept' END AS type, event_id % 2 AS run_id, user_id
    FROM {events}"""


def _listed(t):
    five = t.events.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return t.spark.sql(_LISTED, events=five)


_LISTED_SQL = "kw AS (" + _LISTED.replace("{events}", "(SELECT *, unnest(range(1, 6)) AS i FROM events) e").replace("STRING", "VARCHAR").replace("1.0 / (2", "1e0 / (2") + ")"


@query("F8_served_event_keywords", f"""WITH {_LISTED_SQL},
  size AS (SELECT user_id AS event_id, count(*) AS n FROM events GROUP BY 1),
  q AS (SELECT user_id AS event_id, term FROM kw WHERE source = 'query' GROUP BY 1, 2 HAVING count(*) >= 0.5 * (SELECT n FROM size WHERE size.event_id = user_id)),
  first AS (SELECT user_id AS event_id, article_id, term, min(rank) AS rank, arg_min(score, rank) AS score, arg_min(sentiment, rank) AS sentiment, arg_min(type, rank) AS type FROM kw GROUP BY 1, 2, 3),
  own AS (SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.event_id = f.event_id AND q.term = f.term) AND length(term) > 1 AND regexp_matches(term, '[\\x{{4e00}}-\\x{{9fff}}]')
    QUALIFY row_number() OVER (PARTITION BY event_id, article_id ORDER BY rank, term) <= 3),
  cs AS (SELECT event_id, term, sentiment AS v, count(*) AS c FROM own GROUP BY 1, 2, 3), ct AS (SELECT event_id, term, type AS v, count(*) AS c FROM own GROUP BY 1, 2, 3),
  st AS (SELECT event_id, term, count(*) AS n, avg(score) AS a FROM own GROUP BY 1, 2),
  rk AS (SELECT st.*, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, a DESC, term) AS rn FROM st),
  cut AS (SELECT * FROM rk WHERE rn <= 30 - coalesce((SELECT count(*) FROM q WHERE q.event_id = rk.event_id), 0)),
  tot AS (SELECT event_id, count(*) AS t FROM cut GROUP BY 1)
  SELECT c.event_id, c.term, round(1 - (rn - 1) / CAST(t AS DOUBLE) * 0.85e0, 4) AS weight, (SELECT v FROM cs WHERE cs.event_id = c.event_id AND cs.term = c.term ORDER BY c DESC, v LIMIT 1) AS sentiment,
    (SELECT v FROM ct WHERE ct.event_id = c.event_id AND ct.term = c.term ORDER BY c DESC, v LIMIT 1) AS type, 'event' AS source FROM cut c JOIN tot ON tot.event_id = c.event_id
  UNION ALL SELECT event_id, term, 0.6e0, (SELECT s FROM (SELECT sentiment AS s, count(*) AS c FROM first f WHERE f.event_id = q.event_id AND f.term = q.term GROUP BY 1 ORDER BY c DESC, s LIMIT 1) z),
    'concept', 'query' FROM q""".replace("ORDER BY c DESC, v", "ORDER BY cs_c DESC, v").replace("cs_c DESC, v LIMIT 1) AS sentiment", "cs.c DESC, v LIMIT 1) AS sentiment").replace("cs_c DESC, v LIMIT 1) AS type", "ct.c DESC, v LIMIT 1) AS type"))
def _(t):
    k = _listed(t)
    return features.served_event_keywords(k.drop("user_id", "run_id"), k.selectExpr("user_id AS event_id", "article_id").distinct())


@query("F9_article_top_keywords", f"""WITH {_LISTED_SQL} SELECT article_id, rank, term, round(score, 6) AS score FROM kw""")
def _(t):
    return features.article_top_keywords(_listed(t)).withColumn("score", F.round("score", 6))


@query("F10_keyword_answers", """SELECT event_id AS article_id, CAST(i AS INT) AS rank, CASE i WHEN 1 THEN event_type WHEN 2 THEN 'second' ELSE 'third' END AS term, CASE i WHEN 1 THEN 1e0 WHEN 2 THEN 0.5e0 ELSE 0.1235e0 END AS score,
    CASE i WHEN 1 THEN 'person' ELSE 'concept' END AS type, CASE i WHEN 3 THEN 'negative' ELSE 'neutral' END AS sentiment, 'llm' AS source FROM events, (SELECT unnest([1, 2, 3]) AS i) x WHERE event_id % 4 <> 0
    UNION ALL SELECT event_id, 1, 'own', 1e0, 'word', 'neutral', 'tfidf' FROM events WHERE event_id % 4 = 0""")
def _(t):
    answer = F.concat(
        F.lit('```json {"'), F.col("event_id").cast("string"), F.lit('": [{"term": "'), F.col("event_type"), F.lit('", "score": 3, "entity_type": "Person"}, "noise", {"term": " "}, {"term": "bad", "score": "x"}'),
        F.when(F.col("event_id") % 4 != 0, F.lit(', {"term": "second", "type": "thing"}, {"term": "third", "score": 0.12345, "sentiment": "NEGATIVE"}')).otherwise(F.lit("")), F.lit('], "-5": [{"term": "stranger"}], "zz": []} ```'))
    requested = t.events.select(F.col("event_id").alias("article_id"))
    parsed = features.parse_keyword_answers(t.events.select(answer.alias("content")), requested)
    own = requested.selectExpr("article_id", "1 AS rank", "'own' AS term", "1.0D AS score", "'word' AS type", "'tfidf' AS source")
    return features.merge_keywords(parsed, own)


@query("F11_keyword_requests", f"""WITH {_DOC}, r AS (SELECT article_id, length(trim(substr(d2.title, 1) || ' ' || array_to_string(bt, ' '))) AS n, 0 AS range FROM doc JOIN (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents) d2 ON d2.doc_id = article_id)
  SELECT batch, count(*) AS documents, sum(least(800, n))::BIGINT AS characters FROM (SELECT *, (row_number() OVER (ORDER BY article_id) - 1) // 5 AS batch FROM r WHERE n >= 20) x GROUP BY 1""")
def _(t):
    out = features.keyword_requests(docs(t))
    return out.select("batch", F.size("documents").cast("long").alias("documents"),
                      F.aggregate("documents", F.lit(0).cast("long"), lambda a, d: a + F.length(d["text"])).alias("characters"))


@query("F12_frequency_topic", f"""WITH {_DOC}, c AS (SELECT term, count(*) AS n FROM (SELECT unnest(ct) AS term FROM doc) x GROUP BY 1 ORDER BY n DESC, term LIMIT 20)
    SELECT 0 AS topic_index, CAST(row_number() OVER (ORDER BY n DESC, term) AS INT) AS rank, term, round(n / CAST((SELECT max(n) FROM c) AS DOUBLE), 6) AS weight FROM c""")
def _(t):
    return topics.frequency_topic(docs(t))


@query("F14_lda_topics", None)
def _(t):
    d, n, terms = corpus(t)
    found = topics.discover(d, [r.term for r in terms.select("term").orderBy("term").collect()], n, TopicConfig())
    return found["topics"]


@query("F16_topic_assignment", """WITH p AS (SELECT event_id AS article_id, list_transform([user_id % 7 + 1, event_id % 11 + 1, event_id % 3 + 1, 1], lambda x: CAST(x AS DOUBLE)) AS v FROM events),
    q AS (SELECT article_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM p)
    SELECT article_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS topic_index, round(list_max(v), 8) AS probability, len(list_filter(v, lambda x: x >= 0.05)) AS listed,
      CASE WHEN list_max(v) < 0.45 THEN 'LOW_TOPIC_CONFIDENCE' END AS warning FROM q""")
def _(t):
    raw = F.array(F.col("user_id") % 7 + 1.0, F.col("event_id") % 11 + 1.0, F.col("event_id") % 3 + 1.0, F.lit(1.0))
    rows = t.events.select(F.col("event_id").alias("article_id"), raw.alias("v")).withColumn("s", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    rows = rows.select("article_id", F.transform("v", lambda x: x / F.col("s")).alias("p"))
    return topics.assignments(rows, column="p").select("article_id", "topic_index", "probability", F.size("probabilities").cast("long").alias("listed"), "warning")


@query("F17_topic_names", """SELECT user_id AS topic_index, CASE WHEN user_id % 3 = 0 THEN '社会事件' ELSE '其他' END AS category, CASE WHEN user_id % 3 = 0 THEN 'name ' || CAST(user_id AS VARCHAR) ELSE 'a·b c·d' END AS topic_name,
    CASE WHEN user_id % 3 = 0 THEN 0.9e0 ELSE 0e0 END AS confidence, CASE WHEN user_id % 3 = 0 THEN 'lda_llm' ELSE 'lda_keyword_fallback' END AS method FROM (SELECT DISTINCT user_id FROM events) x""")
def _(t):
    users = t.events.select("user_id").distinct()
    body = F.concat(F.lit('{"category":"'), F.when(F.col("user_id") % 3 == 1, "体育").otherwise("社会事件"), F.lit('","topic_name":" name  '), F.col("user_id").cast("string"),
                    F.lit('","confidence":'), F.when(F.col("user_id") % 3 == 2, "7").otherwise("0.9"), F.lit("}"))
    answers = users.select(F.col("user_id").alias("topic_index"), body.alias("content"))
    lists = users.select(F.col("user_id").alias("topic_index"), F.array(*[F.lit(x) for x in ("a", "b  c", "a", " ", "d")]).alias("keywords"))
    return topics.name_topics(lists, answers)


@query("F18_representative_titles", """SELECT topic_index, CAST(rank AS INT) AS rank, article_id, title FROM (SELECT user_id % 9 AS topic_index, event_id AS article_id, event_type AS title,
    row_number() OVER (PARTITION BY user_id % 9 ORDER BY value DESC, event_id) AS rank FROM events) x WHERE rank <= 5""")
def _(t):
    assigned = t.events.selectExpr("user_id % 9 AS topic_index", "event_id AS article_id", "value AS probability")
    return topics.representative_titles(assigned, t.events.selectExpr("event_id AS article_id", "event_type AS title"))


@query("F19_unit_vectors", """SELECT vec_id AS article_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm,
    round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings""")
def _(t):
    rows = t.vectors.select("article_id", F.round(features.norm(F.col("vector")), 5).alias("norm"), features.normalized(F.col("vector")).alias("u"))
    return rows.select("article_id", "norm", F.round(F.col("u")[0], 6).alias("first"))


@query("F20_missing_embeddings", """SELECT doc_id AS article_id, 64 AS dimension, length(substr(regexp_replace(substr(split_part(text, chr(10), 1), 1, 80) || chr(10) || text, '^\\s+|\\s+$', '', 'g'), 1, 2000)) AS size FROM documents WHERE doc_id % 2 = 1""")
def _(t):
    d = docs(t).select("article_id", "title", "clean_content", F.lit("m1").alias("model"))
    stored = t.documents.where("doc_id % 2 = 0").selectExpr("doc_id AS article_id", "'m1' AS model")
    todo = features.missing_embeddings(d, stored, ["article_id", "model"]).withColumn("size", F.length("embedding_text"))
    return features.encode(todo, features.hashing_encoder(64), 64).select("article_id", F.size("vector").alias("dimension"), "size")


@query("F21_centroids", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
    m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT CAST(label AS VARCHAR) AS topic_category, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x, n AS member_count FROM m""")
def _(t):
    c = features.centroids(t.vectors, ["topic_category"])
    return c.select("topic_category", F.posexplode("centroid").alias("pos", "x"), "member_count").withColumn("x", F.round("x", 6)).select("topic_category", F.col("pos").cast("long").alias("pos"), "x", "member_count")
