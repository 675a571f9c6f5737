"""Raw post to article: normalise, extract, clean, judge, fingerprint, segment, each stage one projection.

Every stage adds columns and a (stage, status, error) log entry; a failed stage stops the later ones for
that row, and the row stays in the output. Nothing here shuffles: duplicates are linked afterwards by
`murmur.operators.dedup` over the whole table."""

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmur.functions import text as tx
from murmur.operators.dedup import content_hash, simhash, simhash_hex
from murmur.session import fence

# Fixed values: (minimum, ideal) effective lengths and method confidences.
LENGTH_RULES = {
    "news": (80, 200), "social": (10, 30), "hotlist": (5, 10), "comment": (5, 15), "rss": (40, 120), "sample": (5, 30),
}
EXTRACT_MINIMUM = {"social": 20, "hotlist": 5, "rss": 40, "sample": 5}
METHOD_CONFIDENCE = {"trafilatura": 1.0, "plain_text": 0.95, "readability": 0.9, "bs4": 0.75, "fallback": 0.4}
ADVERTISEMENT = {
    "contact": "(?i)加(?:微信|vx)|私信|联系电话|扫码",
    "purchase": "(?i)购买|下单|优惠|代理|招商|返现|限时",
    "guarantee": "(?i)包治|稳赚|百分百|绝对有效",
}
CLASS_SELECTORS = ((("class", "article-content")), (("class", "content")), (("id", "content")))
WEIBO_CLASS = "detail_wbtext_4CRf9"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def normalize(docs: DataFrame) -> DataFrame:
    """Typed, canonical fields of raw documents; `norm_error` marks rows without identity or content."""
    short = ("platform", "source_article_id", "title", "author", "author_id")
    rows = docs.withColumns({c: tx.unescape_nfkc(F.col(c)) for c in short})
    rows = rows.withColumns({c: tx.blank_to_null(tx.collapse(tx.strip_invisible(F.col(c)))) for c in short})
    rows = rows.withColumns({
        "platform": tx.platform_code(F.col("platform")), "url": tx.normalize_url(F.col("source_url")),
        "raw_content": F.coalesce("raw_content", F.lit("")), "title": F.coalesce("title", F.lit("")),
        "author_type": F.coalesce(F.nullif("author_type", F.lit("")), F.lit("unknown")),
        "source_type": F.coalesce(F.nullif("source_type", F.lit("")), F.lit("news")),
        "language": F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")),
        "_time": tx.time_struct(F.col("publish_time")),
        **{m: tx.parse_metric(F.col(m)) for m in
           ("author_followers", "likes_count", "comments_count", "reposts_count", "views_count")},
    })
    rows = rows.withColumns({
        "url_hash": tx.url_hash(F.col("url"), F.col("platform"), F.col("source_article_id")),
        "content_type": F.when(F.col("content_type").isin("html", "text", "json"), F.col("content_type"))
        .when(F.col("raw_content").rlike("<[^>]+>"), "html").otherwise("text"),
        "publish_time": F.col("_time.utc"),
        "norm_error": F.when(
            (F.col("platform") == "") | (F.col("url").isNull() & F.col("source_article_id").isNull())
            | ((F.col("raw_content") == "") & (F.col("title") == "")), "NORMALIZE_MISSING_REQUIRED_FIELD"),
        "warnings": F.array_compact(F.array("_time.warning", F.when(F.col("url").isNull(), "NORMALIZE_INVALID_URL"))),
    })
    return rows.drop("_time")


class _Selector(HTMLParser):
    """Collects the text inside the first element that matches each wanted (attribute, token)."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.open, self.texts, self.mute = wanted, 0, {}, {}, 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.depth += 1
        if tag in ("script", "style", "template"):
            self.mute += 1
        values = dict(attrs)
        for key in self.wanted:
            if key not in self.texts and key[1] in (values.get(key[0]) or "").split():
                self.texts[key], self.open[key] = [], self.depth

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag in ("script", "style", "template") and self.mute:
            self.mute -= 1
        self.open = {k: d for k, d in self.open.items() if d < self.depth}
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if not self.mute:
            for key in self.open:
                self.texts[key].append(data)


@F.pandas_udf(T.StringType())
def selected_text(pages: pd.Series, platforms: pd.Series) -> pd.Series:
    """Text of the first content container by class or id; only rows without <article>/<main> carry a page."""

    def one(page, platform):
        if not page:
            return None
        wanted = ([("class", WEIBO_CLASS)] if platform == "weibo" else []) + list(CLASS_SELECTORS)
        if not any(re.search(rf"""{a}\s*=\s*["'][^"']*\b{re.escape(v)}\b""", page) for a, v in wanted):
            return None
        parser = _Selector(wanted)
        parser.feed(page)
        for key in wanted:
            if key in parser.texts:
                lines = "\n".join(parser.texts[key]).splitlines()
                return "\n".join(x.strip() for x in lines if x.strip())
        return None

    return pd.Series([one(p, q) for p, q in zip(pages, platforms)], dtype=object)


def _bare(markup: Column, drop: str) -> Column:
    """Markup without comments and the dropped elements; every tag ends a text piece."""
    body = F.regexp_replace(markup, "<!--[\\s\\S]*?-->", "")
    body = F.regexp_replace(body, f"(?i)<({drop})\\b[^>]*>[\\s\\S]*?</\\1\\s*>", "\n")
    return F.regexp_replace(body, "<[^>]+>", "\n")


def _lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n|\r"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def with_validity(rows: DataFrame, text: str, source_type: str, out: str) -> DataFrame:
    """Flag texts that are long enough for their source type, mostly real characters, and no blocked page."""
    flat, effective = f"_{out}_flat", f"_{out}_eff"
    minimum = F.coalesce(tx.literal_map(EXTRACT_MINIMUM)[F.col(source_type)], F.lit(100))
    rows = rows.withColumn(flat, tx.collapse(F.coalesce(text, F.lit(""))))
    rows = rows.withColumns({effective: tx.effective_length(F.col(flat)), f"_{out}_code": tx.blocked_code(F.col(flat))})
    verdict = (
        (F.col(flat) != "") & F.col(f"_{out}_code").isNull() & (F.col(effective) >= minimum)
        & (F.col(effective) / F.greatest(F.lit(1), F.length(flat)) >= 0.35)
    )
    return rows.withColumn(out, verdict).drop(flat, effective, f"_{out}_code")


def extract(rows: DataFrame) -> DataFrame:
    """Main content of each page: plain text, then content containers, then all visible text (degraded).

    Each step is a column of its own, so no text is worked through twice."""
    raw, platform = F.col("raw_content"), F.col("platform")
    plain = F.col("content_type").isin("text", "json") & ~raw.rlike("<[^>]+>")
    block = F.coalesce(
        F.nullif(F.regexp_extract(raw, "(?is)<article\\b[^>]*>(.*?)</article\\s*>", 1), F.lit("")),
        F.nullif(F.regexp_extract(raw, "(?is)<main\\b[^>]*>(.*?)</main\\s*>", 1), F.lit("")),
    )
    weibo = (platform == "weibo") & raw.contains(WEIBO_CLASS)
    rows = fence(rows)
    rows = rows.withColumns({"_plain": plain, "_block": F.when(~weibo, block)})
    rows = rows.withColumn("_picked", selected_text(F.when(~F.col("_plain") & F.col("_block").isNull(), raw), platform))
    rows = rows.withColumns({
        "_chosen_raw": _bare(F.col("_block"), "script|style|template"),
        "_visible_raw": F.when(F.col("_plain"), raw).otherwise(_bare(raw, "script|style|noscript|svg|form")),
    })
    rows = rows.withColumns({
        "_chosen_text": tx.unescape_only(F.col("_chosen_raw")),
        "_visible_text": F.when(F.col("_plain"), F.col("_visible_raw")).otherwise(tx.unescape_only(F.col("_visible_raw"))),
    })
    rows = rows.withColumns({
        "_chosen": F.coalesce(_lines(F.col("_chosen_text")), F.col("_picked")),
        "_visible": F.when(F.col("_plain"), F.regexp_replace(raw, "(?U)^\\s+|\\s+$", "")).otherwise(_lines(F.col("_visible_text"))),
    }).drop("_block", "_picked", "_chosen_raw", "_visible_raw", "_chosen_text", "_visible_text")
    rows = with_validity(with_validity(rows, "_chosen", "source_type", "_chosen_ok"), "_visible", "source_type", "_visible_ok")
    method = (
        F.when(F.col("_plain"), F.when(F.col("_visible_ok"), "plain_text"))
        .when(F.col("_chosen_ok"), "bs4").when(F.col("_visible_ok"), "fallback")
    )
    rows = rows.withColumn("extraction_method", method)
    return rows.withColumns({
        "extracted_text": F.when(F.col("extraction_method") == "bs4", F.col("_chosen")).when(F.col("extraction_method").isNotNull(), F.col("_visible")),
        "extraction_degraded": F.coalesce(F.col("extraction_method") == "fallback", F.lit(False)),
        "extract_error": F.when(F.col("extraction_method").isNull(), "EXTRACT_ALL_METHODS_FAILED"),
    }).drop("_plain", "_chosen", "_visible", "_chosen_ok", "_visible_ok")


def clean(rows: DataFrame, source: str = "extracted_text") -> DataFrame:
    """Cleaned body, ordered distinct mentions/topics/links/emotions, removed boilerplate lines, lengths."""
    rows = fence(rows).withColumn("_1", tx.strip_html(F.coalesce(source, F.lit(""))))
    rows = rows.withColumn("_2", tx.unescape_nfkc(F.col("_1")))
    rows = rows.withColumn("_text", tx.strip_invisible(F.regexp_replace("_2", "\r\n|\r", "\n")))
    rows = rows.withColumns({
        "_lines": tx.trimmed_lines(F.col("_text")), "original_length": F.length(F.coalesce(source, F.lit(""))),
        "mentions": tx.found_in(F.col("_text"), tx.MENTION_PATTERN), "topics": tx.found_in(F.col("_text"), tx.TOPIC_PATTERN),
        "urls": tx.found_in(F.col("_text"), tx.URL_PATTERN), "emotions": tx.found_in(F.col("_text"), tx.EMOTION_PATTERN),
    })
    rows = rows.withColumns({"clean_content": tx.kept_text(F.col("_lines")), "removed_lines": tx.removed_lines(F.col("_lines"))})
    return rows.withColumns({
        "removed_length": F.greatest(F.lit(0), F.col("original_length") - F.length("clean_content")),
        "clean_error": F.when(F.col("clean_content") == "", "CLEAN_EMPTY_AFTER_CLEANING"),
    }).drop("_1", "_2", "_text", "_lines")


def dominant_share(tokens: Column) -> Column:
    """Share of the commonest token of a sorted token array, as the longest run of equal entries."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, token):
        run = F.when(token == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(token.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.try_divide(F.aggregate(tokens, start, step)["best"].cast("double"), F.size(tokens))


def judge(rows: DataFrame) -> DataFrame:
    """Quality score with level, weight and flags, and the advertisement verdict."""
    text = F.coalesce("clean_content", F.lit(""))
    rule = lambda i: F.coalesce(
        tx.literal_map({k: v[i] for k, v in LENGTH_RULES.items()})[F.col("source_type")], F.lit(LENGTH_RULES["news"][i]))
    confidence = F.coalesce(tx.literal_map(METHOD_CONFIDENCE)[F.coalesce("extraction_method", F.lit(""))], F.lit(0.5))
    degraded = F.coalesce("extraction_degraded", F.lit(False))
    known = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in ADVERTISEMENT.items()]))
    rows = rows.withColumn("_tok", F.array_sort(F.regexp_extract_all(F.lower(text), F.lit("[\\u4e00-\\u9fff]|[A-Za-z0-9]+"), F.lit(0))))
    rows = rows.withColumn("_top", dominant_share(F.col("_tok")))
    rows = rows.withColumns({
        "_eff": tx.effective_length(text), "_rep": F.when(F.size("_tok") < 4, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("_top"))),
        "_noise": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("removed_length") / F.greatest(F.lit(1), F.col("original_length")))),
        "advertisement_reasons": hits,
    })
    rows = rows.withColumn("quality_score", F.round(
        0.20 * F.least(F.lit(1.0), F.col("_eff") / rule(1))
        + 0.20 * F.least(F.lit(1.0), F.col("_eff") / F.greatest(F.lit(1), F.length(text)))
        + 0.20 * F.col("_noise") + 0.15 * F.col("_rep")
        + 0.15 * (known("title") + known("author") + known("publish_time")) / 3
        + 0.10 * F.when(degraded, F.least(confidence, F.lit(0.4))).otherwise(confidence), 4))
    q = F.col("quality_score")
    pick = lambda a, b, c, d: F.when(q >= 0.75, a).when(q >= 0.50, b).when(q >= 0.30, c).otherwise(d)
    flags = F.array_compact(F.array(
        F.when(F.col("_eff") < rule(0), "too_short"), F.when(F.col("_noise") < 0.5, "high_noise"),
        F.when(F.col("_rep") < 0.5, "high_repetition"), F.when(known("publish_time") == 0, "missing_publish_time"),
        F.when(known("author") == 0, "missing_author"), F.when(degraded, "extraction_degraded")))
    ad = F.least(F.lit(1.0), F.size("advertisement_reasons") * 0.4)
    return rows.withColumns({
        "quality_level": pick("good", "usable", "low", "very_low"), "nlp_weight": pick(1.0, 0.8, 0.5, 0.2),
        "quality_flags": flags, "advertisement_score": ad, "is_advertisement": ad >= 0.4,
        "spam_weight": F.when(ad >= 0.4, 0.5).otherwise(1.0),
    }).drop("_eff", "_rep", "_noise", "_tok", "_top")


def fingerprint(rows: DataFrame) -> DataFrame:
    rows = fence(rows)
    return rows.withColumns({
        "content_hash": content_hash(F.col("clean_content")), "simhash": simhash_hex(simhash(F.col("clean_content"))),
    })


def segment(rows: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    # cleaned text is already folded, so segmentation adds no further Python step
    rows = rows.withColumn("_s", tx.segment_struct(F.col("clean_content"), F.col("topics"), F.col("mentions"), stopwords))
    return rows.withColumns({c: F.col(f"_s.{c}") for c in ("tokens", "tfidf_tokens", "sentiment_tokens")}).drop("_s")


def preprocess(docs: DataFrame) -> DataFrame:
    """The whole per-document job; `clean_status`, `clean_error` and `logs` tell how far each row came."""
    crawl = F.when(F.coalesce("fetch_status", F.lit("success")) == "failed", F.coalesce("fetch_error", F.lit("CRAWL_FAILED"))).otherwise(
        tx.blocked_code(F.col("raw_content")))
    rows = segment(fingerprint(judge(clean(extract(normalize(docs.withColumn("crawl_error", crawl)))))))
    failed_at = (
        F.when(F.col("crawl_error").isNotNull(), 0).when(F.col("norm_error").isNotNull(), 1)
        .when(F.col("extract_error").isNotNull(), 2).when(F.col("clean_error").isNotNull(), 3).otherwise(9)
    )
    rows = rows.withColumn("_failed", failed_at)
    stages = (("crawl", "crawl_error"), ("normalize", "norm_error"), ("extract", "extract_error"), ("clean", "clean_error"),
              ("quality", None), ("segment", None))
    degraded = {
        "normalize": F.size("warnings") > 0, "extract": F.col("extraction_degraded"), "segment": F.lit(True),
    }
    logs = F.array_compact(F.array(*[
        F.when(F.col("_failed") >= i, F.struct(
            F.lit(stage).alias("stage"),
            F.when(F.col("_failed") == i, "failed").when(degraded.get(stage, F.lit(False)), "degraded").otherwise("success").alias("status"),
            (F.when(F.col("_failed") == i, F.col(error)) if error else F.lit(None).cast("string")).alias("error_code"),
        )) for i, (stage, error) in enumerate(stages)
    ]))
    rows = rows.withColumns({
        "logs": logs, "clean_status": F.when(F.col("_failed") == 9, "success").otherwise("failed"),
        "clean_error": F.coalesce("crawl_error", "norm_error", "extract_error", "clean_error"),
        "warnings": F.when(F.col("_failed") == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(
            "warnings", F.when((F.col("_failed") > 2) & F.col("extraction_degraded"), F.array(F.lit("EXTRACT_FALLBACK_USED"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("_failed") == 9, F.array(F.lit("SEGMENT_JIEBA_ERROR"))).otherwise(F.array().cast("array<string>"))))),
    })
    done = F.col("_failed") == 9
    later = ("clean_content", "quality_score", "quality_level", "nlp_weight", "quality_flags", "advertisement_score",
             "is_advertisement", "spam_weight", "content_hash", "simhash", "tokens", "tfidf_tokens", "sentiment_tokens",
             "mentions", "topics", "urls", "emotions", "removed_lines")
    return rows.withColumns({c: F.when(done, F.col(c)) for c in later}).drop(
        "_failed", "crawl_error", "norm_error", "extract_error", "extracted_text")


def analysis_status(rows: DataFrame) -> DataFrame:
    """Why an article is kept out of the analysis, and whether it speaks for its group."""
    tokens = F.coalesce(F.size("tfidf_tokens"), F.lit(0))
    weight = F.coalesce(F.col("nlp_weight").cast("double"), F.lit(0.0))
    status = (
        F.when((F.col("clean_status") != "success") | (weight <= 0), "skipped_invalid")
        .when(F.col("duplicate_of_id").isNotNull() | F.coalesce("is_duplicate", F.lit(False)), "skipped_duplicate")
        .when(F.coalesce("is_advertisement", F.lit(False)), "skipped_advertisement")
        .when(tokens <= 0, "skipped_empty_tokens").otherwise("pending")
    )
    return rows.withColumn("analysis_status", status).withColumn("is_representative", F.col("analysis_status") == "pending")
