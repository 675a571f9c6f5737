"""Propagation and risk queries over conversations and documents."""

from pyspark.sql import functions as F

from murmur.operators import propagation as g
from murmur.operators import risk
from murmur.functions import text as tx
from murmur.plans.registry import query, with_views


def articles(t):
    """Documents as reports of 8 events (125 each at sf0.01), some undated; a third name an author, some the id of an
    earlier article or of an undated one, which lies behind the published 40."""
    c = F.col("article_id")
    a = t.article.withColumn("event_id", c % 8).withColumn("publish_time", F.when(c % 11 != 5, F.col("publish_time")))
    text = F.when(c % 6 == 1, F.concat(F.lit("//@author "), (c - 25).cast("string"), F.lit(" : "), "clean_content")).otherwise(F.col("clean_content"))
    payload = F.when(c % 10 == 7, F.concat(F.lit('{"parent_id": '), (c - 48).cast("string"), F.lit("}"))).when(
        c % 10 == 8, F.concat(F.lit('{"retweeted_status": {"mid": "'), (c + 8 * F.pmod(7 * (5 - c), F.lit(11))).cast("string"), F.lit('"}}'))).otherwise(F.lit("{}"))
    return a.withColumns({
        "clean_content": text, "raw_content": F.lit(""), "raw_json": payload, "author": F.when(c % 17 != 0, F.concat(F.lit("author"), c.cast("string"))),
        "author_type": F.when(c % 41 == 0, "official"), "author_followers": F.when(c % 29 == 0, 600_000).otherwise(10), "source_article_id": F.lit(None).cast("string"),
        "observed_at": F.lit(None).cast("timestamp"), "views_count": F.lit(None).cast("long"), "keywords": F.array(F.concat(F.lit("K"), c % 4)),
        "entities": F.create_map().cast("map<string,array<string>>")})


_ART = """art AS MATERIALIZED (SELECT doc_id AS id, doc_id % 8 AS event_id, source AS platform, substr(split_part(text, chr(10), 1), 1, 80) AS title,
    CASE WHEN doc_id % 6 = 1 THEN '//@author ' || CAST(doc_id - 25 AS VARCHAR) || ' : ' || text ELSE text END AS body, CASE WHEN doc_id % 17 <> 0 THEN 'author' || CAST(doc_id AS VARCHAR) END AS author,
    CASE WHEN doc_id % 10 = 7 THEN doc_id - 48 WHEN doc_id % 10 = 8 THEN doc_id + 8 * (((7 * (5 - doc_id)) % 11 + 11) % 11) END AS pid, CASE WHEN doc_id % 11 <> 5 THEN doc_id * 3600 END AS t, doc_id % 4 AS k, doc_id % 97 + doc_id % 31 + doc_id % 211 AS inter FROM documents),
  ev AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(lower(title || ' ' || substr(body, 1, 300)), '[a-z0-9_]{2,}')) AS tok, CASE WHEN id % 6 = 1 THEN 'author' END AS nm, row_number() OVER (PARTITION BY event_id ORDER BY t NULLS LAST, id) AS ord FROM art),
  pair AS MATERIALIZED (SELECT c.event_id, c.id AS c, p.id AS p, p.ord AS pord, p.t AS pt, p.platform <> c.platform AS crossp, p.author IS NOT NULL AND c.nm IS NOT NULL AND contains(p.author, 'author') AS src,
      len(list_intersect(p.tok, c.tok)) / CAST(greatest(1, len(p.tok) + len(c.tok) - len(list_intersect(p.tok, c.tok))) AS DOUBLE) AS sem, CASE WHEN c.t IS NULL OR p.t IS NULL THEN 0e0 ELSE greatest(0e0, 1 - (c.t - p.t) / 3600e0 / 168) END AS tm, CASE WHEN p.k = c.k THEN 1e0 ELSE 0e0 END AS kw
    FROM ev c JOIN ev p ON p.event_id = c.event_id AND p.ord < c.ord {limit}),
  sc AS (SELECT *, round(0.7e0 * sem + 0.15e0 * tm + CASE WHEN src THEN 0.03e0 ELSE 0 END + 0.1e0 * kw + CASE WHEN crossp THEN 0.02e0 ELSE 0 END, 6) AS f FROM pair),
  named AS (SELECT c.event_id, c.id AS c, p.id AS p, p.t IS NULL OR c.t IS NULL OR p.t <= c.t AS fits FROM ev c JOIN ev p ON p.event_id = c.event_id AND p.id = c.pid AND p.id <> c.id {limit}),
  byid AS (SELECT event_id, c, p FROM named WHERE fits),
  byauth AS (SELECT event_id, c, arg_max(p, pord) AS p FROM pair WHERE src AND c NOT IN (SELECT c FROM named) GROUP BY 1, 2),
  expl AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.c, b.c) AS c, coalesce(a.p, b.p) AS p FROM byid a FULL JOIN byauth b ON a.c = b.c),
  inf AS (SELECT event_id, c, p, f, crossp FROM sc WHERE round(sem, 6) >= 0.2 AND (src OR kw > 0) AND f >= 0.38 AND c NOT IN (SELECT c FROM expl) QUALIFY row_number() OVER (PARTITION BY c ORDER BY f DESC, pt DESC NULLS LAST, pord) = 1),
  edge AS (SELECT event_id, p AS source_id, c AS target_id, 'explicit' AS evidence_type, 'repost_or_quote' AS relation_type, 1e0 AS confidence FROM expl
    UNION ALL SELECT event_id, p, c, 'inferred', CASE WHEN crossp THEN 'cross_platform_followup' ELSE 'content_followup' END, round(f, 3) FROM inf)"""
HEAD = _ART.replace("{limit}", "AND c.ord <= 40")
ALL = _ART.replace("{limit}", "")


def _graph(t):
    a = articles(t)
    heads = g.first_articles(a).persist()
    return a, heads, g.edges(heads, a)


@query("G1_explicit_parent_ids", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || ',m' || CAST(event_id AS VARCHAR) ELSE '' END AS ids FROM events""")
def _(t):
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"retweeted_status":{"id":0,"mid":"m'), F.col("event_id").cast("string"), F.lit('"},"root_id":'), F.col("user_id").cast("string"), F.lit("}"))).otherwise(F.lit('{"quoted_status":null}'))
    return t.events.select("event_id", F.array_join(g.explicit_parent_ids(body), ",").alias("ids"))


@query("G2_explicit_parent_authors", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u' || CAST(user_id AS VARCHAR) || ',人民网' WHEN 1 THEN 'zed' ELSE '' END AS names FROM events""")
def _(t):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('转自：人民网，text //@u', user_id, ': x') WHEN 1 THEN 'a 来源 @zed' ELSE 'none' END")
    return t.events.select("event_id", F.array_join(g.explicit_parent_authors(text), ",").alias("names"))


@query("G3_author_match", """SELECT event_id, event_id % 4 < 2 AS matches FROM events""")
def _(t):
    a = F.expr("CASE event_id % 4 WHEN 0 THEN '@Alpha News' WHEN 1 THEN 'alpha' WHEN 2 THEN 'a' ELSE 'beta' END")
    return t.events.select("event_id", g.author_matches(g.normalize_author(a), g.normalize_author(F.lit("AlphaNews!"))).alias("matches"))


_EDGE = "event_id, source_id, target_id, evidence_type, relation_type, confidence"


@query("G4_explicit_edges", f"WITH {HEAD} SELECT {_EDGE} FROM edge WHERE evidence_type = 'explicit' AND source_id IN (SELECT id FROM ev WHERE ord <= 40)")
def _(t):
    return _graph(t)[2].where("evidence_type = 'explicit' and published").select(*_EDGE.split(", "))


@query("G5_inferred_scores", f"WITH {HEAD} SELECT event_id, c AS child_id, p AS parent_id, round(sem, 6) AS semantic, f AS final_score FROM sc WHERE round(sem, 6) >= 0.2 AND (src OR kw > 0) AND f >= 0.38")
def _(t):
    ev = g.evidence_columns(g.first_articles(articles(t))).select("event_id", "article_id", "ord", "platform", "_us", "_author", "_tokens", "_terms", "_names")
    side = lambda s: ev.select("event_id", *[F.col(c).alias(f"{s}_{c}") for c in ev.columns if c != "event_id"])
    pairs = side("c").join(side("p"), "event_id").where("p_ord < c_ord")
    return g.score_pairs(pairs).where("eligible").select("event_id", F.col("c_article_id").alias("child_id"), F.col("p_article_id").alias("parent_id"), "semantic", "final_score")


@query("G6_best_parents", f"WITH {HEAD} SELECT {_EDGE} FROM edge WHERE source_id IN (SELECT id FROM ev WHERE ord <= 40)")
def _(t):
    return _graph(t)[2].where("published").select(*_EDGE.split(", "))


_NODE = """node AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM edge x WHERE x.target_id = e.id) AS root, CASE WHEN id % 41 = 0 THEN 'official_response' WHEN id % 29 = 0 THEN 'influencer_amplification'
      WHEN NOT EXISTS (SELECT 1 FROM edge x WHERE x.target_id = e.id) THEN 'origin_candidate' WHEN id = (SELECT id FROM ev z WHERE z.event_id = e.event_id ORDER BY inter DESC, t NULLS LAST, id LIMIT 1) THEN 'peak_content' ELSE 'ordinary' END AS kind FROM ev e WHERE ord <= 40)"""


@query("G7_nodes", f"WITH {HEAD}, {_NODE} SELECT event_id, id AS article_id, CAST(ord AS INT) AS ord, inter AS interaction_count, round(18 + least(24e0, pow(inter, 0.25e0)), 6) AS symbol_size, root AS is_root FROM node")
def _(t):
    a, heads, found = _graph(t)
    return g.nodes(a, heads, found).select("event_id", "article_id", "ord", "interaction_count", F.round("symbol_size", 6).alias("symbol_size"), "is_root")


@query("G8_node_types", f"WITH {HEAD}, {_NODE} SELECT event_id, id AS article_id, kind AS node_type FROM node")
def _(t):
    a, heads, found = _graph(t)
    return g.nodes(a, heads, found).select("event_id", "article_id", "node_type")


@query("G9_phases", f"WITH {HEAD}, {_NODE} SELECT event_id, CAST(ord AS INT) AS ord, kind AS phase_type, id AS representative_node_id FROM node WHERE kind <> 'ordinary'")
def _(t):
    a, heads, found = _graph(t)
    return g.phases(g.nodes(a, heads, found)).select("event_id", "ord", "phase_type", "representative_node_id")


_ORIGINS = f"WITH {ALL} SELECT event_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edge x WHERE x.target_id = ev.id)) AS origin_candidate_count FROM ev GROUP BY 1"


@query("G10_origin_counts", _ORIGINS)
def _(t):
    return g.origin_counts(articles(t))


@query("G10_graph_summary", f"""WITH {HEAD}, {_NODE}, c AS (SELECT event_id, count(*) FILTER (WHERE evidence_type = 'explicit') AS x, count(*) FILTER (WHERE evidence_type = 'inferred') AS i FROM edge
      WHERE source_id IN (SELECT id FROM ev WHERE ord <= 40) GROUP BY 1)
    SELECT n.event_id, count(*) AS node_count, max(coalesce(x, 0)) AS explicit_edge_count, max(coalesce(i, 0)) AS inferred_edge_count, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms,
      CASE WHEN max(coalesce(x, 0) + coalesce(i, 0)) > 0 THEN 'sufficient' ELSE 'insufficient' END AS coverage_status, max(o.origin_candidate_count) AS origin_candidate_count
    FROM node n LEFT JOIN c ON c.event_id = n.event_id LEFT JOIN ({_ORIGINS}) o ON o.event_id = n.event_id GROUP BY 1""")
def _(t):
    a, heads, found = _graph(t)
    out = g.graph_summary(g.nodes(a, heads, found), found, g.origin_counts(a))
    return out.select("event_id", "node_count", "explicit_edge_count", "inferred_edge_count", F.array_join("platforms", ",").alias("platforms"), "coverage_status", "origin_candidate_count")


@query("G11_lineage", "SELECT conv_id AS event_id, conv_id * 1000 + turn AS article_id, conv_id * 1000 AS root_id, turn AS depth FROM conversations")
def _(t):
    rows = t.conversations.selectExpr("conv_id AS event_id", "conv_id * 1000 + turn AS article_id", "turn")
    found = rows.where("turn > 0").selectExpr("event_id", "article_id AS target_id", "article_id - 1 AS source_id")
    return g.lineage(found, rows).select("event_id", "article_id", "root_id", F.col("depth").cast("long").alias("depth"))


# ---- risk

def risk_articles(t):
    """Documents with some copies across platforms, sensational titles, links and advertising."""
    c = F.col("article_id")
    base = "重磅暴雨预警发布多地紧急转移群众安置工作有序展开救援队伍赶赴现场"
    body = F.when(c % 9 == 0, F.concat(F.lit(base), F.when(c % 2 == 0, "请大家注意").otherwise(""), F.lit(" http://x.example.com"))).when(c % 9 == 1, F.concat("clean_content", F.lit(" 立即购买"))).otherwise(F.col("clean_content"))
    return t.article.withColumns({
        "clean_content": body, "title": F.when(c % 9 == 0, "重磅：暴雨预警").otherwise(F.col("title")), "platform": F.concat(F.lit("p"), c % 4),
        "content_hash": F.when(c % 8 == 0, F.concat(F.lit("h"), c % 200)), "duplicate_of_id": F.when(c % 100 == 76, c - 25), "sentiment_score": (c % 21 - 10) / 10,
        "keywords": F.when(c % 9 == 0, F.array(F.lit("暴雨"))).otherwise(F.array(F.concat(F.lit("k"), c))), "entities": F.create_map().cast("map<string,array<string>>")})


_BASE = "重磅暴雨预警发布多地紧急转移群众安置工作有序展开救援队伍赶赴现场"
RISK = f"""ra AS MATERIALIZED (SELECT doc_id AS id, doc_id % 25 AS event_id, 'p' || CAST(doc_id % 4 AS VARCHAR) AS platform, CASE WHEN doc_id % 9 = 0 THEN '重磅：暴雨预警' ELSE substr(split_part(text, chr(10), 1), 1, 80) END AS title,
    CASE WHEN doc_id % 9 = 0 THEN '{_BASE}' || CASE WHEN doc_id % 2 = 0 THEN '请大家注意' ELSE '' END || ' http://x.example.com' WHEN doc_id % 9 = 1 THEN text || ' 立即购买' ELSE text END AS body,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 50 = 3 THEN '新华社' WHEN doc_id % 50 = 4 THEN '匿名' ELSE 'author' END AS author, doc_id % 97 + doc_id % 31 + doc_id % 211 AS inter,
    CASE WHEN doc_id % 8 = 0 THEN 'h' || CAST(doc_id % 200 AS VARCHAR) END AS hash, CASE WHEN doc_id % 100 = 76 THEN doc_id - 25 ELSE doc_id END AS root, CASE WHEN doc_id % 9 = 0 THEN '暴雨' ELSE 'k' || CAST(doc_id AS VARCHAR) END AS kw FROM documents),
  gr AS (SELECT *, CASE WHEN length(han) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(han)), lambda i: substr(han, i, 2))) END AS grams FROM (SELECT *, regexp_replace(title || substr(body, 1, 300), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS han FROM ra) z),
  link AS (SELECT a.event_id, a.id, b.platform AS p, b.id AS other FROM ra a JOIN ra b ON a.event_id = b.event_id AND a.root = b.root WHERE (SELECT count(DISTINCT platform) FROM ra c WHERE c.event_id = a.event_id AND c.root = a.root) > 1
    UNION SELECT a.event_id, a.id, b.platform, b.id FROM ra a JOIN ra b ON a.event_id = b.event_id AND a.hash = b.hash WHERE (SELECT count(DISTINCT platform) FROM ra c WHERE c.event_id = a.event_id AND c.hash = a.hash) > 1
    UNION SELECT a.event_id, a.id, b.platform, b.id FROM gr a JOIN gr b ON a.event_id = b.event_id AND a.platform <> b.platform AND a.kw = b.kw AND len(a.grams) > 0 AND len(b.grams) > 0
      AND len(list_intersect(a.grams, b.grams)) / CAST(len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams)) AS DOUBLE) >= 0.6
    UNION SELECT event_id, id, platform, id FROM ra),
  corr AS MATERIALIZED (SELECT id, string_agg(DISTINCT p, ',' ORDER BY p) AS ps, count(DISTINCT p) AS np FROM link GROUP BY 1),
  ctx AS (SELECT event_id, avg(inter) AS av, bool_or(author = '新华社') AS off FROM ra GROUP BY 1),
  tok AS (SELECT id, list_distinct(list_concat(regexp_extract_all(lower(title), '[a-z0-9_]{{2,}}'), CASE WHEN id % 9 = 0 THEN ['重磅', '暴雨', '雨预', '预警'] ELSE [] END)) AS a,
    list_distinct(list_concat(regexp_extract_all(lower(substr(trim(body), 1, 800)), '[a-z0-9_]{{2,}}'), CASE WHEN id % 9 = 0 THEN ['重磅', '磅暴', '暴雨', '雨预', '预警'] ELSE [] END)) AS b, {{eff}} FROM ra),
  cons AS (SELECT id, CASE WHEN te >= 4 AND be >= 8 AND len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) END AS cs FROM tok),
  feat AS (SELECT r.id, r.event_id, CASE WHEN author IS NULL OR author = '匿名' THEN 1e0 ELSE 0 END AS f1, CASE WHEN np <= 1 THEN 1e0 ELSE 0 END AS f2, coalesce(round(1 - cs, 6), 0) AS f3,
      round(CASE WHEN av > 0 THEN greatest(0e0, least(1e0, (inter / av - 1) / 2)) ELSE 0 END, 6) AS f4, CASE WHEN r.id % 9 = 0 THEN 2 / 3e0 ELSE 0 END AS f5, CASE WHEN r.id % 9 = 1 THEN 1e0 WHEN r.id % 9 = 0 THEN 0.4e0 ELSE 0 END AS f6, cs, off, np
    FROM ra r JOIN ctx ON ctx.event_id = r.event_id JOIN corr ON corr.id = r.id JOIN cons ON cons.id = r.id),
  assessed AS (SELECT *, (0.2e0 * f1 + 0.2e0 * f2 + 0.15e0 * f3 + 0.15e0 * f4 + 0.15e0 * f5 + 0.15e0 * f6) * 100 AS s FROM feat)"""
_EFF = "length(regexp_replace(trim(title), '[^\\x{4e00}-\\x{9fff}A-Za-z0-9]', '', 'g')) AS te, length(regexp_replace(substr(trim(body), 1, 800), '[^\\x{4e00}-\\x{9fff}A-Za-z0-9]', '', 'g')) AS be"
RISK = RISK.replace("{eff}", _EFF)


@query("R1_official_media", """SELECT event_id, event_id % 4 IN (0, 1) AS official FROM events""")
def _(t):
    name = F.expr("CASE event_id % 4 WHEN 0 THEN ' 新华社 ' WHEN 1 THEN '某某晚报社' WHEN 2 THEN '路人' END")
    return t.events.select("event_id", risk.official_media(name).alias("official"))


@query("R2_title_consistency", f"WITH {RISK} SELECT id AS article_id, round(cs, 6) AS score FROM cons")
def _(t):
    return risk_articles(t).select("article_id", F.round(risk.title_consistency(F.col("title"), F.col("clean_content")), 6).alias("score"))


@query("R3_corroboration", f"""WITH {RISK}, backed AS (SELECT id, list_sort(list(DISTINCT other)) AS others FROM link WHERE other <> id GROUP BY id)
    SELECT id AS article_id, ps AS platforms, CAST(coalesce(len(others), 0) AS BIGINT) AS evidence_count, coalesce(array_to_string(others[1:20], ','), '') AS evidence_ids FROM corr LEFT JOIN backed USING (id)""")
def _(t):
    return risk.corroboration(risk_articles(t)).select(
        "article_id", F.array_join("corroborating_platforms", ",").alias("platforms"), "evidence_count", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("R4_event_context", f"WITH {RISK} SELECT event_id, round(av, 6) AS avg_interactions, off AS has_official_media FROM ctx")
def _(t):
    return risk.event_context(risk_articles(t)).select("event_id", F.round("avg_interactions", 6).alias("avg_interactions"), "has_official_media")


@query("R5_interaction_anomaly", f"WITH {RISK} SELECT r.id AS article_id, f4 AS interaction_anomaly, r.id < 25 AND inter > av * 2 AS fast_spread FROM feat f JOIN ra r ON r.id = f.id JOIN ctx ON ctx.event_id = r.event_id")
def _(t):
    return risk.assess(risk_articles(t)).select("article_id", "interaction_anomaly", "fast_spread")


@query("R6_suspicious_score", f"WITH {RISK} SELECT id AS article_id, round(f1 + f2 + f3 + f4 + f5 + f6, 6) AS features, s >= 40 AS is_suspicious, np <= 1 AS alone, round(s, 1) AS score FROM assessed")
def _(t):
    a = risk.assess(risk_articles(t))
    total = sum((F.col(f) for f in risk.WEIGHTS), F.lit(0.0))
    return a.select("article_id", F.round(total, 6).alias("features"), "is_suspicious", (F.col("cross_platform_corroboration") == 1).alias("alone"), "score")


@query("P6_risk_gray_zone", f"WITH {RISK} SELECT id AS article_id FROM assessed WHERE round(s, 1) BETWEEN 30 AND 70")
def _(t):
    return risk.gray_zone(risk.assess(risk_articles(t))).select("article_id")


@query("R7_review_merge", """SELECT event_id AS article_id, CASE WHEN event_id % 3 = 0 THEN '[规则] base | [LLM] looks odd' ELSE 'base' END AS reason, CASE WHEN event_id % 3 = 0 THEN 'mixed' ELSE 'rule' END AS method,
    CASE WHEN event_id % 3 = 0 THEN 1e0 END AS review_confidence FROM events""")
def _(t):
    assessed = t.events.selectExpr("event_id AS article_id", "'base' AS reason", "'rule' AS method")
    body = F.expr("CASE event_id % 3 WHEN 0 THEN '```json {\"risk_level\":\"low\",\"reason\":\" looks odd \",\"confidence\":4} ```' WHEN 1 THEN '{\"reason\":\"\"}' ELSE 'no json' END")
    return risk.merge_reviews(assessed, t.events.select(F.col("event_id").alias("article_id"), body.alias("content"))).select("article_id", "reason", "method", "review_confidence")


@query("R8_event_risk", f"WITH {RISK} SELECT event_id, count(*) FILTER (WHERE s >= 40) AS suspicious_count, count(*) AS total_count, CASE WHEN avg(round(s, 1)) >= 70 THEN '高风险' WHEN avg(round(s, 1)) >= 40 THEN '中风险' ELSE '低风险' END AS level, CAST(round(CAST(avg(round(s, 1)) AS DECIMAL(18, 9)), 1) AS DOUBLE) AS score FROM assessed GROUP BY 1")
def _(t):
    return risk.event_risk(risk.assess(risk_articles(t))).select("event_id", "suspicious_count", "total_count", "level", "score")


@query("R9_risk_radar", f"""WITH {RISK}, b AS (SELECT event_id, count(*) AS n, avg(inter) AS av, count(DISTINCT platform) AS p, (max(id) - min(id)) / 24e0 AS d FROM ra GROUP BY 1),
    r AS (SELECT event_id, CAST(round(CAST(avg(round(s, 1)) AS DECIMAL(18, 9)), 1) AS DOUBLE) AS score, count(*) FILTER (WHERE s >= 40) * 100e0 / count(*) AS share FROM assessed GROUP BY 1)
    SELECT event_id, metric, CAST(floor(greatest(0, least(100, v)) + 0.5e0) AS INT) AS value FROM (SELECT event_id, '传播活跃度' AS metric, n / d / (n / d + 10) * 100 AS v FROM b
      UNION ALL SELECT event_id, '平台覆盖', p / 8e0 * 100 FROM b UNION ALL SELECT event_id, '互动强度', ln(1 + av) / ln(10001e0) * 100 FROM b UNION ALL SELECT event_id, '负面占比', (event_id % 7) / 7e0 * 100 FROM b
      UNION ALL SELECT event_id, '可疑风险', score FROM r UNION ALL SELECT event_id, '可疑报道率', share FROM r) x""")
def _(t):
    a = risk_articles(t)
    negative = a.select("event_id").distinct().withColumn("negative_ratio", F.col("event_id") % 7 / 7)
    return risk.radar(a, risk.event_risk(risk.assess(a)), negative)
