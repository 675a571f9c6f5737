"""Text, URL, number and time queries over pages, documents and events."""

import hashlib

from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import ingest, reports
from murmur.plans.registry import query, with_views

EFF = "[^\\x{4e00}-\\x{9fff}A-Za-z0-9]"


def eff(x: str) -> str:
    return f"length(regexp_replace({x}, '{EFF}', '', 'g'))"


def unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def strip_html(x: str) -> str:
    x = gsub(x, "<!--[\\s\\S]*?-->", "' '")
    for tag in ("script", "style", "noscript"):
        x = gsub(x, f"(?i)<{tag}[^>]*>[\\s\\S]*?</{tag}>", "' '")
    x = gsub(x, "(?i)</(?:p|div|article|section|li|h[1-6]|br)>", "chr(10)")
    return gsub(x, "<[^>]+>", "' '")


def visible(x: str, tags: tuple[str, ...]) -> str:
    x = gsub(x, "<!--[\\s\\S]*?-->", "''")
    for tag in tags:
        x = gsub(x, f"(?i)<{tag}\\b[^>]*>[\\s\\S]*?</{tag}\\s*>", "chr(10)")
    x = unescape(gsub(x, "<[^>]+>", "chr(10)"))
    return lines(x)


def lines(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: "
            f"trim(regexp_replace(l, '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(13))), lambda l: l <> ''), chr(10))")


# extraction and cleaning of the pages, as common tables
PAGE_SQL = f"""WITH block AS (
  SELECT page_id, url, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS raw_title,
    {visible("nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), '')", ('script', 'style', 'template'))} AS chosen,
    {visible('html', ('script', 'style', 'noscript', 'svg', 'form'))} AS seen FROM pages),
flat AS (SELECT *, trim(regexp_replace(chosen, '\\s+', ' ', 'g')) AS fc, trim(regexp_replace(seen, '\\s+', ' ', 'g')) AS fs FROM block),
ok AS (SELECT *, fc <> '' AND {eff('fc')} >= 100 AND {eff('fc')} / CAST(greatest(1, length(fc)) AS DOUBLE) >= 0.35 AS vc,
    fs <> '' AND {eff('fs')} >= 100 AND {eff('fs')} / CAST(greatest(1, length(fs)) AS DOUBLE) >= 0.35 AS vs FROM flat),
extracted AS (SELECT *, CASE WHEN coalesce(vc, false) THEN 'bs4' WHEN vs THEN 'fallback' END AS method,
    CASE WHEN coalesce(vc, false) THEN chosen WHEN vs THEN seen END AS extracted FROM ok),
cleaned AS (SELECT *, {lines(unescape(strip_html("coalesce(extracted, '')")))} AS clean_content,
    length(coalesce(extracted, '')) AS original_length FROM extracted)"""


def _docs(t):
    """Pages as raw documents."""
    return t.pages.select(
        F.lit("News").alias("platform"), F.col("url").alias("source_url"), F.col("page_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_article_id"),
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("raw_content"),
        F.lit("html").alias("content_type"), F.lit(None).cast("string").alias("source_type"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit(" author "), F.col("page_id").cast("string"))).alias("author"),
        F.lit(None).cast("string").alias("author_id"), F.lit(None).cast("string").alias("author_type"),
        F.lit(None).cast("string").alias("language"),
        F.when(F.col("page_id") % 4 != 0, F.lit("2024-01-02 08:00:00")).alias("publish_time"),
        F.lit("success").alias("fetch_status"), F.lit(None).cast("string").alias("fetch_error"),
        F.lit("1.2万").alias("author_followers"),
        *[F.lit(None).cast("string").alias(m) for m in ("likes_count", "comments_count", "reposts_count", "views_count")],
    )


@query("N1_plain_text", f"""SELECT page_id, nullif(trim(regexp_replace({unescape("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') AS title FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.plain(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))


_URL = """lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END
  || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"""


def url_sql(u: str) -> str:
    q = (f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT "
         "regexp_matches(p, '^(from|source|spm|ref|refer|utm_[^=]*)(=|$)')), '&')")
    return _URL.replace("{u}", u).replace("{q}", q)


@query("N2_url_canonical", f"SELECT page_id, {url_sql('url')} AS url FROM pages")
def _(t):
    return t.pages.select("page_id", tx.normalize_url(F.col("url")).alias("url"))


@query("N3_url_hash", f"SELECT page_id, sha256({url_sql('url')}) AS url_hash FROM pages")
def _(t):
    return t.pages.select("page_id", tx.url_hash(tx.normalize_url(F.col("url")), F.lit("news"), F.col("page_id").cast("string")).alias("url_hash"))


_METRIC = """concat(CASE WHEN event_id % 10 = 0 THEN '-' ELSE '' END, CAST(event_id % 1000 AS STRING), CASE WHEN event_id % 2 = 0 THEN '.5' ELSE '' END,
    CASE event_id % 6 WHEN 0 THEN '万' WHEN 1 THEN 'K' WHEN 2 THEN 'w' WHEN 3 THEN '亿' WHEN 4 THEN 'm' ELSE '' END)"""


@query("N4_metric_parser", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(trunc((event_id % 1000 + CASE WHEN event_id % 2 = 0 THEN 0.5e0 ELSE 0 END)
    * CASE event_id % 6 WHEN 0 THEN 10000 WHEN 1 THEN 1000 WHEN 2 THEN 10000 WHEN 3 THEN 100000000 WHEN 4 THEN 1000000 ELSE 1 END) AS BIGINT) END AS metric FROM events""")
def _(t):
    return t.events.select("event_id", tx.parse_metric(F.expr(_METRIC)).alias("metric"))


@query("N5_time_parser", """SELECT event_id, strftime(CASE WHEN event_id % 7 IN (0, 3, 4, 5) THEN to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC'
      WHEN event_id % 7 = 6 THEN NULL ELSE date_trunc('second', ts) - INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc,
    CASE WHEN event_id % 7 IN (1, 2) THEN 'timezone_assumed' WHEN event_id % 7 = 6 THEN 'NORMALIZE_TIME_PARSE_FAILED' END AS warning FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    fmt = lambda pattern: F.date_format(ts, pattern)
    kinds = (
        (0, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), (1, fmt("yyyy-MM-dd HH:mm:ss")), (2, fmt("yyyy/M/d H:mm:ss")),
        (3, F.concat(F.date_format(ts + F.expr("INTERVAL 8 HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))),
        (4, F.unix_seconds(ts).cast("string")), (5, F.concat(fmt("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))), (6, F.lit("yesterday noon")),
    )
    raw = F.coalesce(*[F.when(F.col("event_id") % 7 == i, c) for i, c in kinds])
    parsed = t.events.select("event_id", tx.time_struct(raw).alias("t"))
    return parsed.select("event_id", F.date_format("t.utc", "yyyy-MM-dd HH:mm:ss").alias("utc"), F.col("t.warning").alias("warning"))


@query("N6_platform_alias", """SELECT event_type, CASE event_type WHEN 'view' THEN 'bilibili' WHEN 'click' THEN 'weibo_hot' WHEN 'error' THEN 'xiaohongshu' ELSE event_type END AS platform, count(*) AS n
    FROM events GROUP BY 1, 2""")
def _(t):
    alias = F.expr("CASE event_type WHEN 'view' THEN 'B站' WHEN 'click' THEN '微博热搜' WHEN 'error' THEN '小红书' ELSE upper(event_type) END")
    return t.events.select("event_type", tx.platform_code(alias).alias("platform")).groupBy("event_type", "platform").agg(F.count("*").alias("n"))


@query("N7_normalize_document", f"""SELECT page_id, 'news' AS platform, {url_sql('url')} AS url, 'html' AS content_type, 12000 AS author_followers,
    CASE WHEN page_id % 3 <> 0 THEN 'author ' || CAST(page_id AS VARCHAR) END AS author,
    CASE WHEN page_id % 4 <> 0 THEN '2024-01-02 00:00:00' END AS publish_time, CASE WHEN page_id % 4 <> 0 THEN 'timezone_assumed' ELSE '' END AS warnings FROM pages""")
def _(t):
    return ingest.normalize(_docs(t)).select(
        "page_id", "platform", "url", "content_type", "author_followers", "author",
        F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("publish_time"), F.array_join("warnings", ",").alias("warnings"))


@query("N8_strip_html", f"SELECT page_id, md5({strip_html('html')}) AS digest FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("digest"))


def _found(x, pattern):
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({x}, '{pattern}'))), ' | ')"


@query("N9_clean_document", f"""WITH base AS (SELECT doc_id, text, {unescape(strip_html('text'))} AS b FROM documents)
    SELECT doc_id, md5({lines('b')}) AS digest, length({lines('b')}) AS clean_length, greatest(0, length(text) - length({lines('b')})) AS removed_length,
      {_found('b', '@[A-Za-z0-9_\\-\\x{4e00}-\\x{9fff}]+')} AS mentions, {_found('b', '#[^#\\n]{1,50}#')} AS topics FROM base""")
def _(t):
    rows = ingest.clean(t.documents, "text")
    joined = lambda c: F.array_join(F.array_sort(c), " | ").alias(c)
    return rows.select("doc_id", F.md5("clean_content").alias("digest"), F.length("clean_content").alias("clean_length"),
                       "removed_length", joined("mentions"), joined("topics"))


@query("N10_content_extraction", f"{PAGE_SQL} SELECT page_id, method AS extraction_method, md5(extracted) AS digest FROM extracted")
def _(t):
    return ingest.extract(ingest.normalize(_docs(t))).select("page_id", "extraction_method", F.md5("extracted_text").alias("digest"))


@query("N11_text_validity", f"""SELECT doc_id, lang, f <> '' AND {eff('f')} >= 100 AND {eff('f')} / CAST(greatest(1, length(f)) AS DOUBLE) >= 0.35 AS valid
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents) x""")
def _(t):
    rows = t.documents.withColumn("kind", F.lit("news"))
    return ingest.with_validity(rows, "text", "kind", "valid").select("doc_id", "lang", "valid")


_QUALITY = f"""
toks AS (SELECT page_id, unnest(regexp_extract_all(lower(clean_content), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9]+')) AS tok FROM cleaned),
rep AS (SELECT page_id, CASE WHEN sum(c) < 4 THEN 0.5e0 ELSE 1 - max(c) / CAST(sum(c) AS DOUBLE) END AS rep
  FROM (SELECT page_id, tok, count(*) AS c FROM toks GROUP BY 1, 2) x GROUP BY 1),
parts AS (SELECT c.page_id, method, {eff('clean_content')} AS e, length(clean_content) AS n, coalesce(rep, 0.5e0) AS rep,
    greatest(0e0, least(1e0, 1 - greatest(0, original_length - length(clean_content)) / CAST(greatest(1, original_length) AS DOUBLE))) AS noise,
    (CASE WHEN raw_title <> '' THEN 1 ELSE 0 END + CASE WHEN c.page_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN c.page_id % 4 <> 0 THEN 1 ELSE 0 END) / 3e0 AS complete,
    CASE method WHEN 'bs4' THEN 0.75e0 WHEN 'fallback' THEN 0.4e0 ELSE 0.5e0 END AS conf
  FROM cleaned c LEFT JOIN rep r ON c.page_id = r.page_id),
quality AS (SELECT *, round(0.2e0 * least(1e0, e / 200e0) + 0.2e0 * least(1e0, e / CAST(greatest(1, n) AS DOUBLE)) + 0.2e0 * noise + 0.15e0 * rep
    + 0.15e0 * complete + 0.1e0 * conf, 4) AS score FROM parts)"""


@query("N12_quality_score", f"""{PAGE_SQL}, {_QUALITY} SELECT page_id, round(score, 3) AS quality_score,
    CASE WHEN score >= 0.75 THEN 'good' WHEN score >= 0.5 THEN 'usable' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END AS quality_level,
    concat_ws(',', CASE WHEN e < 80 THEN 'too_short' END, CASE WHEN noise < 0.5 THEN 'high_noise' END, CASE WHEN rep < 0.5 THEN 'high_repetition' END,
      CASE WHEN page_id % 4 = 0 THEN 'missing_publish_time' END, CASE WHEN page_id % 3 = 0 THEN 'missing_author' END,
      CASE WHEN method = 'fallback' THEN 'extraction_degraded' END) AS flags FROM quality""")
def _(t):
    rows = ingest.judge(ingest.clean(ingest.extract(ingest.normalize(_docs(t)))))
    return rows.select("page_id", F.round("quality_score", 3).alias("quality_score"), "quality_level", F.array_join("quality_flags", ",").alias("flags"))


_AD = """concat(event_type, CASE WHEN event_id % 3 = 0 THEN ' 加微信' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN ' 限时优惠' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN ' 稳赚' ELSE '' END)"""


@query("N13_advertisement_score", """SELECT event_id, least(1e0, h * 0.4e0) AS advertisement_score, h >= 1 AS is_advertisement, CASE WHEN h >= 1 THEN 0.5e0 ELSE 1e0 END AS spam_weight
    FROM (SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS h FROM events) x""")
def _(t):
    rows = t.events.select("event_id", F.expr(_AD).alias("clean_content"), F.lit("social").alias("source_type"), F.lit("plain_text").alias("extraction_method"),
                           F.lit(False).alias("extraction_degraded"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("x").alias("publish_time"),
                           F.lit(10).alias("original_length"), F.lit(0).alias("removed_length"))
    return ingest.judge(rows).select("event_id", "advertisement_score", "is_advertisement", "spam_weight")


@query("N14_tokens", """SELECT doc_id, len(toks) AS n, md5(array_to_string(toks, ' ')) AS digest
    FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z]+|\\d+(?:\\.\\d+)?'), lambda t: lower(t)) AS toks FROM documents) x""")
def _(t):
    seg = tx.segment_struct(F.col("text"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    return t.documents.select("doc_id", seg.alias("s")).select(
        "doc_id", F.size("s.tokens").cast("long").alias("n"), F.md5(F.array_join("s.tfidf_tokens", " ")).alias("digest"))


@query("N15_hot_title_key", """SELECT event_id, concat('topic ', CAST(user_id AS VARCHAR), ' x') AS title, concat('topic', CAST(user_id AS VARCHAR), 'x') AS key FROM events""")
def _(t):
    raw = F.expr("concat('【Topic】 '," " user_id, ' x#', CASE WHEN event_id % 2 = 0 THEN ' 热度 12.5万' ELSE ' - 300人气' END)")
    title = tx.normalize_hot_title(raw)
    return t.events.select("event_id", F.lower(title).alias("title"), tx.hot_key(title).alias("key"))


@query("N16_hot_seed_title", "SELECT event_id, concat('a', event_type, ' ', CAST(user_id AS VARCHAR)) AS title FROM events")
def _(t):
    return t.events.select("event_id", tx.normalize_seed_title(F.expr("concat('＃＃ ａ', event_type, '　 ', user_id, ' ##')")).alias("title"))


@query("N17_term_rules", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '暴雨预警' WHEN 1 THEN event_type || ' x' WHEN 2 THEN '#' || event_type || '#' WHEN 3 THEN '12.5' ELSE '来源' END AS term,
    event_id % 5 < 3 AS valid, CASE event_id % 5 WHEN 0 THEN 'phrase' WHEN 1 THEN 'phrase' WHEN 2 THEN 'hashtag' ELSE 'word' END AS kind FROM events""")
def _(t):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN ' 暴雨  预警' WHEN 1 THEN upper(event_type) || '　X' WHEN 2 THEN '#' || event_type || '#' WHEN 3 THEN '12.5' ELSE '来源' END")
    term = tx.normalize_term(raw)
    return t.events.select("event_id", tx.display_term(term).alias("term"), tx.valid_term(term).alias("valid"), tx.term_type(term).alias("kind"))


@query("N18_secret_redaction", """SELECT event_id, concat('k=', json_extract_string(props, '$.k'), ' Bearer [REDACTED] end') AS note, 2 AS kept FROM events""")
def _(t):
    payload = F.create_map(F.lit("note"), F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit(" bearer abc.DEF-1 end")),
                           F.lit("Access_Token"), F.lit("x"), F.lit("cookie2"), F.lit("y"), F.lit("kind"), F.col("event_type"))
    return t.events.select("event_id", tx.redact_map(payload).alias("m")).select("event_id", F.col("m")["note"].alias("note"), F.size("m").alias("kept"))


@query("N19_api_values", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '微博搜索' WHEN 1 THEN 'B站' END AS platform, CASE WHEN event_id % 2 = 0 THEN '高潮期' ELSE '潜伏期' END AS stage,
    CASE event_id % 3 WHEN 0 THEN '正面' WHEN 1 THEN '中立' ELSE '负面' END AS label, least(100e0, value) AS heat, strftime(ts, '%-m/%-d') AS day FROM events""")
def _(t):
    return t.events.select(
        "event_id", reports.platform_name(F.expr("CASE event_id % 3 WHEN 0 THEN 'Weibo' WHEN 1 THEN 'bilibili' ELSE 'other' END")).alias("platform"),
        reports.shown_stage(F.expr("CASE WHEN event_id % 2 = 0 THEN '高潮期' ELSE 'x' END")).alias("stage"),
        reports.shown_label(F.expr("CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN '中性' ELSE '负面' END")).alias("label"),
        reports.clamp_heat(F.col("value")).alias("heat"), reports.short_date(F.col("ts")).alias("day"))


@query("N21_content_identity", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN printf('snapshot:%d:v%d', event_id, event_id % 4) ELSE printf('article:%d:v%d', user_id, event_id % 4) END AS identity FROM events""")
def _(t):
    snap = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    return t.events.select("event_id", tx.content_identity(snap, F.col("user_id"), F.col("event_id") % 4).alias("identity"))


@query("N24_bigram_sets", """SELECT doc_id, len(b) AS title_bigrams, len(w) AS words, md5(array_to_string(b, '')) AS digest FROM (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN length(t) < 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END)) AS b,
      list_distinct(regexp_extract_all(lower(substr(text, 1, 300)), '[a-z0-9_]{2,}')) AS w
    FROM (SELECT doc_id, text, regexp_replace(lower(substr(split_part(text, chr(10), 1), 1, 80)), '\\s+', '', 'g') AS t FROM documents) x) y""")
def _(t):
    title = F.substring(F.split("text", "\n")[0], 1, 80)
    rows = t.documents.select("doc_id", F.array_sort(tx.title_features(title)).alias("b"), tx.evidence_tokens(F.substring("text", 1, 300)).alias("w"))
    return rows.select("doc_id", F.size("b").cast("long").alias("title_bigrams"), F.size("w").cast("long").alias("words"), F.md5(F.array_join("b", "")).alias("digest"))


@query("N23_preprocess_pages", f"""{PAGE_SQL}, {_QUALITY}, dom AS (SELECT *, CASE WHEN method IS NULL THEN 'EXTRACT_ALL_METHODS_FAILED' END AS err FROM cleaned)
    SELECT d.page_id, CASE WHEN err IS NULL THEN 'success' ELSE 'failed' END AS clean_status, err AS clean_error,
      CASE WHEN err IS NULL THEN 6 ELSE 3 END AS stages,
      CASE WHEN err IS NULL THEN sha256(trim(regexp_replace(d.clean_content, '\\s+', ' ', 'g'))) END AS content_hash,
      CASE WHEN err IS NULL THEN round(q.score, 3) END AS quality_score
    FROM dom d JOIN quality q ON d.page_id = q.page_id""")
def _(t):
    return ingest.preprocess(_docs(t)).select(
        "page_id", "clean_status", "clean_error", F.size("logs").alias("stages"), "content_hash", F.round("quality_score", 3).alias("quality_score"))


@query("P1_analysis_status", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'skipped_invalid' WHEN doc_id % 7 = 0 THEN 'skipped_duplicate' WHEN doc_id % 5 = 0 THEN 'skipped_advertisement'
      WHEN quality = 0 THEN 'skipped_empty_tokens' ELSE 'pending' END AS analysis_status FROM labels""")
def _(t):
    rows = t.labels.select("doc_id", F.lit("success").alias("clean_status"), (1 - F.col("toxic")).alias("nlp_weight"),
                           F.when(F.col("doc_id") % 7 == 0, F.lit(1)).alias("duplicate_of_id"), F.lit(False).alias("is_duplicate"),
                           (F.col("doc_id") % 5 == 0).alias("is_advertisement"),
                           F.when(F.col("quality") == 1, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tfidf_tokens"))
    return ingest.analysis_status(rows).select("doc_id", "analysis_status")
