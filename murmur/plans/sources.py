"""Source scans over payloads derived from the event rows, and checks over pages and documents."""

from pyspark.sql import functions as F

from murmur.config import AggregationConfig
from murmur.functions import text as tx
from murmur.operators import ingest, runs
from murmur.plans.registry import query, with_views
from murmur.plans.text import PAGE_SQL, _docs, eff, unescape, url_sql
from murmur.sources import payloads, readers


def landed(t, template: str):
    """One payload per event row: `%(name)s` parts are SQL expressions spliced into JSON text."""
    import re
    parts = re.split(r"%\((.*?)\)s", template)
    columns = [F.lit(p) if i % 2 == 0 else F.expr(p).cast("string") for i, p in enumerate(parts)]
    return t.events.select(F.col("event_id"), F.concat(*columns).alias("payload"))


def doc_columns(df, *names):
    return df.select("event_id", *names)


@query("S1_raw_document_scan", """SELECT page_id, 'news' AS source_type, 'html' AS content_type, 'pending' AS clean_status, 'success' AS fetch_status, 'unknown' AS language, length(html) AS size FROM pages""")
def _(t):
    rows = readers.with_contract(t.pages.select("page_id", F.lit("web").alias("platform"), F.col("url").alias("source_url"), F.lit("html").alias("content_type"), F.col("html").alias("raw_content")))
    return rows.select("page_id", "source_type", "content_type", "clean_status", "fetch_status", "language", F.length("raw_content").alias("size"))


_IMPORT = """{"platform":%(CASE WHEN event_id % 11 = 0 THEN '5' ELSE '" weibo "' END)s,"url":"%(CASE WHEN event_id % 7 = 0 THEN 'ftp' ELSE 'https' END)s://x.com/%(event_id)s","title":"%(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'T' END)s","raw_content":"c","publish_time":"%(CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE '2024-01-02 03:04:05' END)s","like_count":"1.5万"}"""


@query("S2_import_validation", """SELECT event_id AS "index", CASE WHEN event_id % 11 = 0 AND event_id % 5 = 0 THEN '缺少或无效字段: platform, title' WHEN event_id % 11 = 0 THEN '缺少或无效字段: platform'
    WHEN event_id % 5 = 0 THEN '缺少或无效字段: title' WHEN event_id % 7 = 0 THEN 'url 协议不受支持' WHEN event_id % 13 = 0 THEN '发布时间格式无效' END AS message,
    CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 13 = 0 THEN NULL ELSE 15000 END AS likes_count FROM events""")
def _(t):
    accepted, rejects = readers.validate_import(landed(t, _IMPORT).select(F.col("event_id").alias("index"), F.col("payload").alias("item")))
    return rejects.select("index", "message", F.lit(None).cast("long").alias("likes_count")).unionByName(
        accepted.select("index", F.lit(None).cast("string").alias("message"), "likes_count"))


@query("S3a_weibo_hot", """SELECT event_id, pos AS position, 'weibo_hot' AS platform, CASE pos WHEN 0 THEN event_type ELSE 'word ' || CAST(user_id AS VARCHAR) END AS title,
    CASE pos WHEN 0 THEN '#' || event_type || '#' ELSE 'word ' || CAST(user_id AS VARCHAR) END AS source_article_id, 'hotlist' AS source_type,
    'https://s.weibo.com/weibo?q=' || CASE pos WHEN 0 THEN event_type ELSE 'word%20' || CAST(user_id AS VARCHAR) END AS source_url FROM events, (SELECT 0 AS pos UNION ALL SELECT 1) p""")
def _(t):
    docs = payloads.weibo_hot(landed(t, '{"ok":1,"data":{"realtime":[{"note":"%(event_type)s","word":"w","word_scheme":"#%(event_type)s#"},{"note":"","word":"word %(user_id)s"}]}}'))
    return docs.select("event_id", "position", "platform", "title", "source_article_id", "source_type", "source_url")


@query("S3b_weibo_search", """SELECT event_id, i AS position, CASE WHEN event_id * 10 + i = 0 THEN '' ELSE CAST(event_id * 10 + i AS VARCHAR) END AS source_article_id, 'https://weibo.com/' || CAST(user_id AS VARCHAR) || '/' || CASE WHEN event_id * 10 + i = 0 THEN '' ELSE CAST(event_id * 10 + i AS VARCHAR) END AS source_url,
    'hi & ' || event_type AS title, CAST(event_id % 97 AS VARCHAR) AS likes_count FROM events, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE event_id % 2 = 1 OR i < 1""")
def _(t):
    post = lambda i: '{"id":%(event_id * 10 + ' + str(i) + ')s,"text_raw":"<b>hi</b> &amp; %(event_type)s","user":{"id":%(user_id)s,"screen_name":"u"},"attitudes_count":%(event_id % 97)s}'
    flat = landed(t, '{"data":{"statuses":[' + post(0) + ']}}').where("event_id % 2 = 0")
    cards = landed(t, '{"data":{"data":{"cards":[{"mblog":' + post(0) + '},{"card_group":[{"mblog":' + post(1) + '},{"x":1},{"mblog":' + post(2) + '}]}]}}}').where("event_id % 2 = 1")
    return payloads.weibo_search(flat.unionByName(cards)).select("event_id", "position", "source_article_id", "source_url", "title", "likes_count")


@query("S3c_xiaohongshu_search", """SELECT event_id, 'n' || CAST(event_id AS VARCHAR) AS source_article_id, CASE WHEN event_id % 3 = 0 THEN '小红书笔记' ELSE 'note ' || event_type END AS title,
    'https://www.xiaohongshu.com/explore/n' || CAST(event_id AS VARCHAR) AS source_url, CAST(event_id % 97 AS VARCHAR) AS likes_count, 'u' || CAST(user_id AS VARCHAR) AS author_id FROM events""")
def _(t):
    docs = payloads.xiaohongshu_search(landed(t, '{"data":{"items":[{"note_card":{"note_id":"n%(event_id)s","display_title":"%(CASE WHEN event_id % 3 = 0 THEN \'\' ELSE \'note \' || event_type END)s","user":{"nickname":"a","user_id":"u%(user_id)s"},"interact_info":{"liked_count":"%(event_id % 97)s"}}},{"note_card":{"display_title":""}}]}}'))
    return docs.select("event_id", "source_article_id", "title", "source_url", "likes_count", "author_id")


@query("S3d_douyin_search", """SELECT event_id, CASE WHEN event_id = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS source_article_id, 'clip ' || event_type AS title, strftime(to_timestamp(1704067200 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS publish_time,
    CAST(event_id % 97 AS VARCHAR) AS likes_count, CAST(event_id % 31 AS VARCHAR) AS views_count FROM events""")
def _(t):
    docs = payloads.douyin_search(landed(t, '{"data":{"data":[{"aweme_info":{"aweme_id":"%(event_id)s","desc":"clip <i>%(event_type)s</i>","create_time":%(1704067200 + event_id)s,"author":{"uid":1},"statistics":{"digg_count":%(event_id % 97)s,"play_count":%(event_id % 31)s}}}]}}'))
    return docs.select("event_id", "source_article_id", "title", "publish_time", "likes_count", "views_count")


@query("S3e_zhihu", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'zhihu' ELSE 'zhihu_hot' END AS platform, 'https://z/' || CAST(event_id AS VARCHAR) AS source_url,
    CASE WHEN event_id % 2 = 0 THEN 'c' || CAST(event_id AS VARCHAR) ELSE 'https://z/' || CAST(event_id AS VARCHAR) END AS source_article_id, event_type AS title, CAST(event_id % 7 AS VARCHAR) AS likes_count FROM events""")
def _(t):
    upper = landed(t, '{"Code":0,"Data":{"Items":[{"ContentID":"c%(event_id)s","Url":"https://z/%(event_id)s","Title":"%(event_type)s","VoteUpCount":%(event_id % 7)s}]}}').where("event_id % 2 = 0")
    lower = landed(t, '{"data":{"data":[{"link":"https://z/%(event_id)s","question_title":"%(event_type)s","vote_up_count":%(event_id % 7)s}]}}').where("event_id % 2 = 1")
    return payloads.zhihu(upper).unionByName(payloads.zhihu(lower, hot=True)).select("event_id", "platform", "source_url", "source_article_id", "title", "likes_count")


@query("S3f_bilibili", """SELECT event_id, 'BV' || CAST(event_id AS VARCHAR) AS source_article_id, 'v ' || event_type AS title, CAST(event_id % 5 AS VARCHAR) AS likes_count, CAST(event_id % 6 AS VARCHAR) AS comments_count FROM events""")
def _(t):
    docs = payloads.bilibili(landed(t, '{"code":0,"data":{"result":[{"bvid":"BV%(event_id)s","title":"v &lt;em&gt;%(event_type)s&lt;/em&gt;","pubdate":1704067200,"favorites":%(event_id % 5)s,"review":%(event_id % 6)s},{"title":"no id"}]}}'))
    return docs.select("event_id", "source_article_id", "title", "likes_count", "comments_count")


@query("S3g_baidu", """SELECT event_id, 'baidu' AS platform, 'https://b/' || CAST(event_id AS VARCHAR) AS source_url, 'anchor' AS title, 'news' AS source_type FROM events
    UNION ALL SELECT event_id, 'baidu_hot', 'https://www.baidu.com/s?wd=' || event_type, event_type, 'hotlist' FROM events""")
def _(t):
    found = payloads.baidu_search(landed(t, '{"references":[{"url":"https://b/%(event_id)s","web_anchor":"anchor","content":"x"},{"title":"no url"}]}'))
    hot = payloads.baidu_hot(landed(t, '{"data":[{"word":"%(event_type)s","desc":"d"}]}'))
    return found.unionByName(hot).select("event_id", "platform", "source_url", "title", "source_type")


@query("S3h_feed_entries", """SELECT event_id, i AS position, CASE i WHEN 0 THEN 'https://r/' || CAST(event_id AS VARCHAR) ELSE 'https://a/' || CAST(event_id AS VARCHAR) END AS source_url,
    CASE i WHEN 0 THEN 'g' || CAST(event_id AS VARCHAR) ELSE 'https://a/' || CAST(event_id AS VARCHAR) END AS source_article_id, CASE i WHEN 0 THEN event_type ELSE 'atom & ' || event_type END AS title,
    CASE i WHEN 0 THEN 'text' ELSE 'html' END AS content_type FROM events, (SELECT 0 AS i UNION ALL SELECT 1) p""")
def _(t):
    feeds = landed(t, '<feed xmlns="http://www.w3.org/2005/Atom"><item><title>%(event_type)s</title><link>https://r/%(event_id)s</link><guid>g%(event_id)s</guid><description>d</description></item>'
                      '<a:entry><a:title type="html">atom &amp; %(event_type)s</a:title><a:link href="https://a/%(event_id)s"/><a:summary>&lt;p&gt;x&lt;/p&gt;</a:summary></a:entry><item><title>no link</title></item></feed>')
    return payloads.feed_entries(feeds.withColumn("feed_url", F.lit("f"))).select("event_id", "position", "source_url", "source_article_id", "title", "content_type")


_LANDED = """SELECT CASE event_type WHEN 'view' THEN 'weibo' WHEN 'click' THEN 'zhihu' WHEN 'error' THEN 'bilibili' ELSE event_type END AS platform, event_id, event_id AS position,
    concat('https://c.example.com/', CAST(event_id % 37 AS STRING)) AS source_url, CAST(event_id % 53 AS STRING) AS source_article_id FROM {events}"""


@query("S4_batch_collect", """WITH RECURSIVE l AS (""" + _LANDED.replace("{events}", "events").replace("STRING", "VARCHAR") + """),
  head AS (SELECT *, CASE platform WHEN 'weibo' THEN 0 WHEN 'zhihu' THEN 1 ELSE 2 END * 1000000 + rn AS ord FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY position) AS rn FROM l
     WHERE platform IN ('weibo', 'zhihu', 'bilibili')) x WHERE rn <= 27),
  seq AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM head),
  walk AS (SELECT n, event_id, true AS keep, [source_url] AS urls, [platform || ':' || source_article_id] AS ids FROM seq WHERE n = 1
    UNION ALL SELECT s.n, s.event_id, NOT (list_contains(w.urls, s.source_url) OR list_contains(w.ids, s.platform || ':' || s.source_article_id)),
      CASE WHEN list_contains(w.urls, s.source_url) OR list_contains(w.ids, s.platform || ':' || s.source_article_id) THEN w.urls ELSE list_append(w.urls, s.source_url) END,
      CASE WHEN list_contains(w.urls, s.source_url) OR list_contains(w.ids, s.platform || ':' || s.source_article_id) THEN w.ids ELSE list_append(w.ids, s.platform || ':' || s.source_article_id) END
    FROM walk w JOIN seq s ON s.n = w.n + 1)
  SELECT event_id, CAST(row_number() OVER (ORDER BY n) AS INT) AS batch_rank FROM walk WHERE keep ORDER BY n LIMIT 80""")
def _(t):
    return readers.collect_batch(t.spark.sql(_LANDED, events=t.events), ["weibo", "zhihu", "bilibili"], 80).select("event_id", "batch_rank")


@query("S5_batch_issues", """SELECT p.platform, coalesce(n, 0) AS documents, CASE WHEN p.platform = 'douyin' THEN 'CRAWLER_NOT_CONFIGURED' WHEN n IS NULL THEN 'CRAWL_EMPTY_RESPONSE' END AS code
    FROM (SELECT unnest(['view', 'click', 'weibo', 'douyin']) AS platform) p LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c ON c.event_type = p.platform""")
def _(t):
    return readers.batch_issues(t.events.withColumnRenamed("event_type", "platform"), ["view", "click", "weibo", "douyin"], ["view", "click", "weibo"])


@query("S6a_api_error", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CRAWL_API_500' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'CRAWL_API_denied' END AS code FROM events""")
def _(t):
    body = landed(t, '{%(CASE event_id % 5 WHEN 0 THEN \'"code":500\' WHEN 1 THEN \'"code":"OK"\' WHEN 2 THEN \'"Code":0\' WHEN 3 THEN \'"Code":"denied"\' ELSE \'"x":1\' END)s}')
    return body.select("event_id", readers.api_error(F.col("payload")).alias("code"))


@query("S6b_blocked_page", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'CRAWL_CAPTCHA' WHEN page_id % 6 = 1 AND length(v) + 12 < 300 THEN 'CRAWL_CAPTCHA' WHEN page_id % 6 = 2 AND length(v) + 14 < 500 THEN 'CRAWL_BLOCKED_PAGE' END AS code
    FROM (SELECT page_id, substr(regexp_replace(lower(url), '[<>]', ' ', 'g') || repeat('x', CAST(page_id * 7 % 600 AS INT)), 1) AS v FROM pages) x""")
def _(t):
    body = F.concat("url", F.repeat(F.lit("x"), (F.col("page_id") * 7 % 600).cast("int")),
                    F.expr("CASE page_id % 6 WHEN 0 THEN ' 请完成安全验证' WHEN 1 THEN ' need CAPTCHA' WHEN 2 THEN ' 403 Forbidden' ELSE '' END"))
    return t.pages.select("page_id", tx.blocked_code(body).alias("code"))


@query("S7a_fetch_result", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'network_error' WHEN 1 THEN 'blocked_or_rate_limited' WHEN 2 THEN 'server_error' WHEN 3 THEN 'http_error' WHEN 4 THEN 'parse_error'
      ELSE CASE WHEN contains(lower(html), 'robot') THEN 'login_or_verification_required' WHEN length(html) < 120 THEN 'too_little_text' ELSE 'public_content_accessible' END END AS result FROM pages""")
def _(t):
    status = F.expr("CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END")
    error = F.expr("CASE WHEN page_id % 7 = 4 THEN 'bad markup' END")
    return t.pages.select("page_id", readers.fetch_result(status, F.col("html"), error, "robot", "暂无相关结果").alias("result"))


@query("S7b_error_class", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'AUTH_ERROR' WHEN 1 THEN 'QUOTA_ERROR' WHEN 2 THEN 'PLATFORM_BLOCKED' WHEN 3 THEN 'NETWORK_ERROR' WHEN 4 THEN 'REMOTE_CHANGED' ELSE 'CODE_ERROR' END AS kind FROM events""")
def _(t):
    code = F.expr("CASE event_id % 6 WHEN 1 THEN 'quota' WHEN 2 THEN 'CRAWL_CAPTCHA' WHEN 3 THEN 'CRAWL_TIMEOUT' ELSE '' END")
    text = F.expr("CASE event_id % 6 WHEN 0 THEN 'HTTP 403' WHEN 4 THEN 'got 404' ELSE 'timeout' END")
    return t.events.select("event_id", readers.error_class(code, text).alias("kind"))


@query("S7c_document_contract", """SELECT page_id, concat_ws(',', CASE WHEN page_id % 3 = 0 THEN 'title_missing' END, CASE WHEN page_id % 4 = 0 THEN 'raw_json_missing' END) AS errors FROM pages""")
def _(t):
    rows = t.pages.selectExpr("page_id", "'web' AS platform", "CASE WHEN page_id % 3 = 0 THEN ' ' ELSE 't' END AS title", "'news' AS source_type", "url AS source_url",
                              "CASE WHEN page_id % 4 = 0 THEN '{}' ELSE '{\"a\":1}' END AS raw_json")
    return rows.select("page_id", F.array_join(readers.contract_errors(), ",").alias("errors"))


@query("S7d_byte_decoding", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(readers.decode_bytes(F.encode("text", "UTF-8"))).alias("digest"))


_UP = """WITH old AS (SELECT page_id AS article_id, 'p' AS platform, 's' || CAST(page_id % 40 AS VARCHAR) AS sid, sha256(url || CAST(page_id AS VARCHAR)) AS url_hash, 'h' || CAST(page_id % 3 AS VARCHAR) AS raw_hash FROM pages WHERE page_id % 5 = 0 AND page_id < 200),
  new AS (SELECT page_id + 1000 AS doc_id, 's' || CAST(page_id AS VARCHAR) AS sid, sha256(url || CAST(page_id - page_id % 2 AS VARCHAR)) AS url_hash, 'h' || CAST(page_id % 4 AS VARCHAR) AS raw_hash, page_id FROM pages),
  m AS (SELECT n.*, (SELECT min(article_id) FROM old o WHERE o.url_hash = n.url_hash OR o.sid = n.sid) AS matched FROM new n),
  g AS (SELECT coalesce('a' || CAST(matched AS VARCHAR), 'u' || url_hash) AS key, max(matched) AS matched, min(doc_id) AS first, arg_max(raw_hash, doc_id) AS raw_hash FROM m GROUP BY 1)
  SELECT o.article_id, CASE WHEN g.key IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(g.raw_hash, o.raw_hash) AS raw_hash, CASE WHEN g.raw_hash <> o.raw_hash THEN 2 ELSE 1 END AS content_version FROM old o LEFT JOIN g ON g.matched = o.article_id
  UNION ALL SELECT first, 'created', raw_hash, 1 FROM g WHERE matched IS NULL"""


@query("S8a_article_upsert", _UP)
def _(t):
    old = t.pages.where("page_id % 5 = 0 AND page_id < 200").selectExpr(
        "page_id AS article_id", "'p' AS platform", "concat('s', page_id % 40) AS source_article_id", "sha2(concat(url, page_id), 256) AS url_hash", "concat('h', page_id % 3) AS raw_hash", "1 AS content_version", "'t' AS title")
    new = t.pages.selectExpr(
        "page_id + 1000 AS doc_id", "'p' AS platform", "concat('s', page_id) AS source_article_id", "sha2(concat(url, page_id - page_id % 2), 256) AS url_hash", "concat('h', page_id % 4) AS raw_hash", "'n' AS title", "page_id AS crawled_at")
    return runs.upsert_articles(old, new).select("article_id", "action", "raw_hash", "content_version")


_OBS = """SELECT event_id AS observation_id, user_id AS article_id, CAST(ts AS TIMESTAMP) AS crawled_at, concat('h', CAST(floor(event_id / 900) AS STRING)) AS content_hash, 200 AS http_status,
    CASE WHEN event_id % 90 = 0 THEN 'failed' ELSE 'success' END AS fetch_status, CAST(NULL AS STRING) AS fetch_error, CAST(floor(event_id / 700) AS BIGINT) AS comments_count, 0 AS reposts_count, 0 AS likes_count, 0 AS views_count FROM {events}"""


@query("S8b_snapshot_throttle", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY crawled_at, observation_id) AS n FROM (""" + _OBS.replace("{events}", "events").replace("STRING", "VARCHAR") + """) q),
  w AS (SELECT article_id, n, observation_id, true AS keep, crawled_at AS lt, content_hash AS lc, fetch_status AS lf, comments_count AS lm, true AS changed FROM o WHERE n = 1
    UNION ALL SELECT o.article_id, o.n, o.observation_id, k, CASE WHEN k THEN o.crawled_at ELSE lt END, CASE WHEN k THEN o.content_hash ELSE lc END, CASE WHEN k THEN o.fetch_status ELSE lf END, CASE WHEN k THEN o.comments_count ELSE lm END, o.content_hash <> lc
    FROM (SELECT o.*, w.lt, w.lc, w.lf, w.lm, o.content_hash <> w.lc OR o.fetch_status <> w.lf OR (o.comments_count <> w.lm AND epoch_us(o.crawled_at) - epoch_us(w.lt) >= 3600000000) AS k
      FROM w JOIN o ON o.article_id = w.article_id AND o.n = w.n + 1) o)
  SELECT observation_id, article_id, changed AS content_changed FROM w WHERE keep""")
def _(t):
    return runs.snapshot_rows(t.spark.sql(_OBS, events=t.events)).select("observation_id", "article_id", "content_changed")


@query("S8c_processing_log", f"""{PAGE_SQL} SELECT page_id, step, CASE WHEN method IS NOT NULL OR step < 3 THEN s ELSE 'persist' END AS stage,
      CASE WHEN step = 2 AND method IS NULL THEN 'failed' WHEN s = 'normalize' AND page_id % 4 <> 0 THEN 'degraded' WHEN s = 'extract' AND method = 'fallback' THEN 'degraded'
        WHEN s = 'segment' AND method IS NOT NULL THEN 'degraded' ELSE 'success' END AS status
    FROM extracted, (SELECT unnest(['crawl', 'normalize', 'extract', 'clean', 'quality', 'segment', 'persist']) AS s, CAST(unnest(range(0, 7)) AS INT) AS step) x WHERE method IS NOT NULL OR step < 4""")
def _(t):
    return runs.processing_log(ingest.preprocess(_docs(t)), "page_id").select("page_id", "step", "stage", "status")


@query("S10_paged_read", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100 OFFSET 200")
def _(t):
    return readers.page(t.events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 3, 500)


@query("N22_query_fingerprint", """SELECT event_id, sha256('{"keyword":"kw ' || CAST(user_id AS VARCHAR) || '","mode":"search","platforms":["' || CASE WHEN event_type < 'weibo' THEN event_type || '","weibo' ELSE 'weibo","' || event_type END || '"]}') AS fingerprint FROM events""")
def _(t):
    return t.events.select("event_id", runs.query_fingerprint(F.lit(" Search "), F.expr("concat(' KW  ', user_id, ' ')"), F.array(F.lit("Weibo"), F.col("event_type"), F.lit("weibo"))).alias("fingerprint"))


def _tree_sql(levels: int = 6) -> str:
    entry = lambda key, value: f"sha256(string_agg(lpad(CAST({key} AS VARCHAR), 20, '0') || ':' || {value}, chr(10) ORDER BY lpad(CAST({key} AS VARCHAR), 20, '0') || ':' || {value}))"
    sql = f"SELECT user_id % 5 AS run, event_id >> 12 AS node, {entry('event_id', "('article:' || CAST(event_id AS VARCHAR) || ':v1')")} AS h FROM events GROUP BY 1, 2"
    for _ in range(levels - 1):
        sql = f"SELECT run, node >> 12 AS up, {entry('node', 'h')} AS hh FROM ({sql}) x GROUP BY 1, 2"
        sql = f"SELECT run, up AS node, hh AS h FROM ({sql}) y"
    return f"SELECT run AS run_id, h AS dataset_hash FROM ({sql}) z"


@query("N22_dataset_hash", _tree_sql())
def _(t):
    rows = t.events.selectExpr("user_id % 5 AS run_id", "event_id AS article_id", "concat('article:', event_id, ':v1') AS identity")
    return runs.dataset_hash(rows)


@query("P5_dataset_changed", "SELECT event_id AS article_id FROM events WHERE event_id % 10 = 0 OR event_id % 17 = 0")
def _(t):
    frozen = t.events.selectExpr("event_id AS article_id", "concat('article:', event_id, ':v1') AS identity")
    current = t.events.where("event_id % 17 <> 0").selectExpr("event_id AS article_id", "concat('article:', event_id, CASE WHEN event_id % 10 = 0 THEN ':v2' ELSE ':v1' END) AS identity")
    return runs.changed_identities(frozen, current).select("article_id")


_RUNS = """SELECT event_id AS run_id, concat('f', CAST(user_id AS STRING)) AS query_fingerprint, 'search_shared' AS scope, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status,
    'c' AS config_hash, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model, CAST(ts AS TIMESTAMP) AS completed_at, CAST(ts AS TIMESTAMP) + INTERVAL 24 HOUR AS cache_expires_at, event_id % 60 AS attempt, user_id FROM {events}"""


@query("E24_search_cache", "WITH r AS (" + _RUNS.replace("{events}", "events").replace("STRING", "VARCHAR") + """)
    SELECT query_fingerprint, run_id, TIMESTAMP '2024-01-30 12:00:00' >= cache_expires_at AS stale FROM r WHERE status = 'success' AND model = 'v1'
    QUALIFY row_number() OVER (PARTITION BY query_fingerprint ORDER BY completed_at DESC, run_id DESC) = 1""")
def _(t):
    rows = t.spark.sql(_RUNS, events=t.events).withColumn("versions", F.create_map(F.lit("bge_model_version"), F.col("model")))
    return runs.search_cache(rows, {"bge_model_version": "v1"}, "c", F.expr("TIMESTAMP '2024-01-30 12:00:00'")).select("query_fingerprint", "run_id", "stale")


@query("E25_run_attempts", "WITH r AS (" + _RUNS.replace("{events}", "events").replace("STRING", "VARCHAR") + """),
    l AS (SELECT user_id, max(attempt) AS a, arg_max(status, attempt) AS s FROM (SELECT *, attempt * 100000 + run_id AS k FROM r) z GROUP BY user_id),
    q AS (SELECT DISTINCT user_id + 5 AS user_id FROM events)
    SELECT q.user_id, coalesce(s <> 'failed', false) AS reused, CASE WHEN s <> 'failed' THEN a ELSE coalesce(a, 0) + 1 END AS attempt FROM q LEFT JOIN
      (SELECT user_id, attempt AS a, status AS s FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY attempt DESC, run_id DESC) = 1) l ON q.user_id = l.user_id""")
def _(t):
    rows = t.spark.sql(_RUNS, events=t.events)
    # attempts are unique per key in a run table; keep the newest row of each attempt
    rows = rows.groupBy("user_id", "attempt").agg(F.max_by(F.struct("run_id", "status"), "run_id").alias("x")).select("user_id", "attempt", "x.*")
    return runs.next_attempt(t.events.selectExpr("user_id + 5 AS user_id").distinct(), rows, ["user_id"]).select("user_id", "reused", "attempt")


@query("E26_best_cluster", """SELECT run_id, cluster_id FROM (SELECT user_id % 20 AS run_id, event_id AS cluster_id, CAST(floor(value / 20) AS INT) AS member_count, event_id % 11 AS confidence FROM events) x
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY member_count DESC, confidence DESC, cluster_id) = 1""")
def _(t):
    rows = t.events.selectExpr("user_id % 20 AS run_id", "event_id AS cluster_id", "CAST(floor(value / 20) AS INT) AS member_count", "event_id % 11 AS confidence")
    return runs.best_cluster(rows).select("run_id", "cluster_id")
