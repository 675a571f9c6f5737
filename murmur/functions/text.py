"""Text, URL, number and time expressions. Everything but Unicode compatibility folding stays in the JVM."""

import html
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from murmur.config import PLATFORM_ALIASES, TRACKING_PARAMETERS

# Character classes and patterns the results depend on.
EFFECTIVE = "[\\u4e00-\\u9fffA-Za-z0-9]"
HAN = "[\\u4e00-\\u9fff]"
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\ufeff]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
SPACE = "(?U)\\s+"
NOISE_LINE = (
    "(?iu)^(?:打开\\s*APP\\s*阅读全文|上一篇(?:[:：].*)?|下一篇(?:[:：].*)?|相关阅读(?:[:：].*)?"
    "|责任编辑(?:[:：].*)?|版权声明(?:[:：].*)?|返回首页)$"
)
URL_PATTERN = "(?i)https?://[^\\s<>]+"
MENTION_PATTERN = "@[A-Za-z0-9_\\-\\u4e00-\\u9fff]+"
TOPIC_PATTERN = "#[^#\\n]{1,50}#"
EMOTION_PATTERN = "\\[[^\\]\\n]{1,12}\\]|[\\x{1F300}-\\x{1FAFF}\\u2600-\\u27BF]"
HEAT_SUFFIX = (
    "(?i)(?:\\s*[-|·]?\\s*)(?:热度|热搜指数|搜索指数)?\\s*\\d+(?:\\.\\d+)?(?:万|亿)?\\s*"
    "(?:热度|热搜指数|人气)?\\s*$"
)
STOPWORDS = ("的", "了", "是", "在", "和", "与", "及", "一个", "我们", "他们", "这个", "那个")
SENTIMENT_TERMS = ("不", "没", "没有", "非常", "很", "太", "过于", "极其", "更加")
TEMPLATE_TERMS = ("点击", "查看", "责任编辑", "来源", "记者", "本文", "相关")
CAPTCHA_CHALLENGE = "请完成安全验证|输入验证码|完成验证码|拖动滑块|验证后继续|captcha challenge"
CAPTCHA_WORD = "验证码|安全验证|captcha"
LOGIN_WORD = "sina visitor system|登录后查看|请先登录"
BLOCKED_WORD = "访问异常|访问受限|403 forbidden"


# Characters that Unicode compatibility folding leaves alone wherever they stand. Text made of
# these only skips the Python step; the list may be short, it must not be wrong.
STABLE = (
    "\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e"
    "\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u3001-\\u301c\\u3041-\\u3096\\u30a1-\\u30fe\\u4e00-\\u9fff"
)
_ENTITIES = {"lt": "<", "gt": ">", "quot": "\"", "apos": "'", "#39": "'", "copy": "©", "middot": "·", "amp": "&"}


@F.pandas_udf(T.StringType())
def _py_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _py_unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _py_unescape_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", html.unescape(v)), na_action="ignore")


def _common_entities(text: Column) -> Column:
    for name, char in _ENTITIES.items():  # the ampersand comes last so that it cannot form a new entity
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


_KNOWN = "&(?:" + "|".join(_ENTITIES) + ");"


def nfkc(text: Column) -> Column:
    """Compatibility folding, the one text step without a built-in; only rows that may change visit Python."""
    return F.coalesce(_py_nfkc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


def unescape_only(text: Column) -> Column:
    """HTML entities; rows with none but the commonest ones stay in the JVM."""
    rare = F.regexp_replace(text, _KNOWN, "").rlike("&[#A-Za-z]")
    return F.coalesce(_py_unescape(F.when(rare, text)), _common_entities(text))


def unescape_nfkc(text: Column) -> Column:
    """Both steps at once; the common entities stand for characters that folding leaves alone."""
    rare = F.regexp_replace(text, _KNOWN, "").rlike(f"&[#A-Za-z]|[^{STABLE}]")
    return F.coalesce(_py_unescape_nfkc(F.when(rare, text)), _common_entities(text))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), CONTROL, "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def plain(text: Column) -> Column:
    """Single-line plain text, null when blank."""
    return blank_to_null(collapse(strip_invisible(unescape_nfkc(text))))


def fixed_point(value: Column, digits: int) -> Column:
    """A number with so many digits after the point, rounded from its exact binary value; ties go to the even digit.

    The product with a power of ten is rounded to a double; its error is found by splitting the number into two halves of
    26 bits, and decides where the product looks like a tie. Holds for magnitudes below 10^12."""
    scale = 10.0 ** digits
    x = F.abs(value.cast("double"))
    product, floor = x * scale, F.floor(x * scale)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    over = product - floor - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (floor % 2 == 1))))
    whole = (floor + up.cast("long")).cast("long")
    unit = F.lit(10 ** digits).cast("long")
    minus = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(minus, F.floor(whole / unit).cast("string"), F.lit("."), F.lpad((whole % unit).cast("string"), digits, "0"))


def effective_length(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(EFFECTIVE))


def strip_html(text: Column) -> Column:
    text = F.regexp_replace(text, "<!--[\\s\\S]*?-->", " ")
    text = F.regexp_replace(text, "(?i)<(script|style|noscript)[^>]*>[\\s\\S]*?</\\1>", " ")
    text = F.regexp_replace(text, "(?i)</(?:p|div|article|section|li|h[1-6]|br)>", "\n")
    return F.regexp_replace(text, "<[^>]+>", " ")


def trimmed_lines(text: Column, blanks: str = "(?U)[ \\t\\u3000]+") -> Column:
    """Non-empty lines with inner blanks collapsed."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.regexp_replace(F.regexp_replace(line, blanks, " "), "(?U)^\\s+|\\s+$", ""),
    )
    return F.filter(lines, lambda line: line != "")


def found_in(text: Column, pattern: str) -> Column:
    """Ordered distinct matches."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def kept_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(NOISE_LINE)), "\n")


def removed_lines(lines: Column) -> Column:
    return F.filter(lines, lambda line: line.rlike(NOISE_LINE))


def blocked_code(text: Column) -> Column:
    """Code of a captcha, login or blocked page; null for ordinary content."""
    visible = collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[<>]", " "))
    size = F.length(visible)
    return (
        F.when(visible.rlike(CAPTCHA_CHALLENGE) | ((size < 300) & visible.rlike(CAPTCHA_WORD)), "CRAWL_CAPTCHA")
        .when((size < 500) & visible.rlike(LOGIN_WORD), "CRAWL_LOGIN_REQUIRED")
        .when((size < 500) & visible.rlike(BLOCKED_WORD), "CRAWL_BLOCKED_PAGE")
    )


def normalize_url(value: Column) -> Column:
    """Canonical http(s) address: lower-case host, no default port, tracking parameter or fragment."""
    v = F.trim(F.coalesce(value, F.lit("")))
    scheme = F.lower(F.regexp_extract(v, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    location = F.regexp_extract(v, "^[^:/?#]+://([^/?#]*)", 1)
    location = F.regexp_replace(location, "^.*@", "")
    host = F.lower(F.regexp_extract(location, "^([^:]*)", 1))
    port = F.regexp_extract(location, ":(\\d+)$", 1).try_cast("int")
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    shown_port = F.when(port.isNull() | (port == 0) | default, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    path = F.regexp_extract(v, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(v, "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_is_tracking(p))
    query = F.array_join(F.transform(kept, _reencoded), "&")
    address = F.concat(
        scheme, F.lit("://"), host, shown_port,
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return (
        F.when(v == "", F.lit(None).cast("string"))
        .when(scheme.isin("sample", "rss"), F.regexp_extract(v, "^([^#]*)", 1))
        .when(scheme.isin("http", "https") & (host != ""), address)
    )


def _decoded(part: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _is_tracking(pair: Column) -> Column:
    key = F.lower(_decoded(F.regexp_extract(pair, "^([^=]*)", 1)))
    return F.coalesce(key.isin(*TRACKING_PARAMETERS) | key.startswith("utm_"), F.lit(False))


def _reencoded(pair: Column) -> Column:
    def encode(part: Column) -> Column:
        quoted = F.url_encode(_decoded(part))
        return F.replace(F.replace(quoted, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    return F.concat(
        encode(F.regexp_extract(pair, "^([^=]*)", 1)), F.lit("="),
        encode(F.regexp_extract(pair, "^[^=]*=?(.*)$", 1)),
    )


def url_hash(url: Column, platform: Column, source_id: Column) -> Column:
    return F.sha2(F.coalesce(url, F.concat(platform, F.lit(":"), source_id)), 256)


def parse_metric(value: Column) -> Column:
    """Counter text such as `1.2万`, `2.5k`, `1,024` as a long; negatives become 0, unreadable null."""
    text = F.replace(F.lower(F.trim(value.cast("string"))), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(text, "-?\\d+(?:\\.\\d+)?", 0), F.lit("")).cast("double")
    factor = (
        F.when(text.contains("亿"), 1e8).when(text.contains("万") | text.endswith("w"), 1e4)
        .when(text.endswith("k"), 1e3).when(text.endswith("m"), 1e6).otherwise(1.0)
    )
    truth = F.when(text == "true", 1).when(text == "false", 0)
    # greatest() skips nulls, so an unreadable text must be kept apart from zero
    return F.coalesce(truth.cast("long"), F.when((number * factor).try_cast("long").isNotNull(), F.greatest(F.lit(0).cast("long"), (number * factor).try_cast("long"))))


_TIME_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]", "yyyy年M月d日[ H:mm[:ss]]", "yyyy.M.d[ H:mm[:ss]]",
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "MMM d HH:mm:ss Z yyyy", "d MMM yyyy HH:mm:ss",
)
_ZONED = "(?i)(?:Z|GMT|UTC|[+-]\\d{2}:?\\d{2})$|[+-]\\d{4} \\d{4}$"


def time_struct(value: Column) -> Column:
    """(utc, warning) of an epoch, ISO, RFC 822 or common Chinese time; naive times are Shanghai time."""
    text = F.regexp_replace(F.trim(value.cast("string")), "^[A-Za-z]{3,9},? (?=\\d|[A-Z])", "")
    epoch = F.when(text.rlike("^\\d{9,11}(\\.\\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    iso = F.when(text.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}"), text.try_cast("timestamp"))
    known = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in _TIME_FORMATS]
    parsed = F.coalesce(iso, *known)
    zoned = text.rlike(_ZONED) & ~text.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$")
    utc = F.coalesce(epoch, F.when(zoned, parsed).otherwise(F.to_utc_timestamp(parsed, "Asia/Shanghai")))
    warning = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(utc.isNull(), "NORMALIZE_TIME_PARSE_FAILED")
        .when(epoch.isNull() & ~zoned, "timezone_assumed")
    )
    return F.struct(utc.alias("utc"), warning.alias("warning"))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def platform_code(value: Column) -> Column:
    lowered = F.lower(F.coalesce(value, F.lit("")))
    return F.coalesce(literal_map(PLATFORM_ALIASES)[lowered], lowered)


def normalize_hot_title(title: Column) -> Column:
    text = F.translate(nfkc(F.coalesce(title, F.lit(""))), "【】[]《》#", "       ")
    text = F.regexp_replace(text, HEAT_SUFFIX, "")
    return F.btrim(collapse(text), F.lit(" \t\r\n-—_|·:：,，。!！?？;；'\""))


def hot_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, "(?U)[\\W_]+", ""))


def normalize_seed_title(title: Column) -> Column:
    text = F.regexp_replace(collapse(nfkc(F.coalesce(title, F.lit("")))), "^[#＃]+|[#＃]+$", "")
    return collapse(text)


def normalize_term(term: Column) -> Column:
    return collapse(F.lower(nfkc(F.coalesce(term, F.lit("")))))


def display_term(term: Column) -> Column:
    """Phrases whose pieces are all Han are shown without blanks."""
    return F.when(term.rlike("^[\\u4e00-\\u9fff]+(?: [\\u4e00-\\u9fff]+)+$"), F.replace(term, F.lit(" "), F.lit(""))).otherwise(term)


def valid_term(term: Column) -> Column:
    shown = display_term(term)
    return (
        (shown != "") & ~shown.isin(*TEMPLATE_TERMS)
        & ~shown.rlike("^\\d+(?:\\.\\d+)?$") & ~shown.rlike("^[\\u4e00-\\u9fff]$")
    )


def term_type(term: Column, entities: Column | None = None) -> Column:
    shown = display_term(term)
    kind = (
        F.when(shown.startswith("#") & shown.endswith("#"), "hashtag")
        .when(term.contains(" "), "phrase").otherwise("word")
    )
    return kind if entities is None else F.coalesce(entities[shown], kind)


def tokens(text: Column) -> Column:
    """Single Han characters, latin words and numbers of folded text, lower case, in order."""
    pattern = "[\\u4e00-\\u9fff]|[A-Za-z]+|\\d+(?:\\.\\d+)?"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def segment_struct(text: Column, topics: Column, mentions: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Three token lists: all, without stop words, and without stop words but keeping sentiment terms."""
    base = tokens(text)
    extra = F.array_distinct(F.concat(topics, mentions))  # tags and mentions carry # or @, which tokens never do
    everything = F.concat(base, extra)
    dropped = sorted({*STOPWORDS, *stopwords})
    kept = F.filter(everything, lambda t: ~t.isin(*dropped))
    for_sentiment = F.filter(everything, lambda t: ~t.isin(*dropped) | t.isin(*SENTIMENT_TERMS))
    return F.struct(everything.alias("tokens"), kept.alias("tfidf_tokens"), for_sentiment.alias("sentiment_tokens"))


def bigrams(text: Column) -> Column:
    """Overlapping two-character windows of a string, found by one pass of a look-ahead.

    Each match takes one character, so none begins inside a character beyond the basic plane."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))."), F.lit(1))


def title_features(title: Column) -> Column:
    """Distinct character bigrams of a blank-free lower-case title; one character stands for itself."""
    flat = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), SPACE, "")
    return (
        F.when(flat == "", F.array().cast("array<string>"))
        .when(F.length(flat) < 2, F.array(flat))
        .otherwise(F.array_distinct(bigrams(flat)))
    )


def evidence_tokens(text: Column) -> Column:
    """Bigrams over all Han characters joined, together with latin words of two characters or more."""
    text = F.coalesce(text, F.lit(""))
    han = F.regexp_replace(text, "[^\\u4e00-\\u9fff]", "")
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(bigrams(han), words))


def segment_tokens(text: Column) -> Column:
    """Like `evidence_tokens`, but Han bigrams never cross a gap between Han runs."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, bigrams))))


def han_bigrams(text: Column) -> Column:
    return F.array_distinct(bigrams(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\u4e00-\\u9fff]", "")))


def jaccard(left: Column, right: Column, both_empty: float | None, one_empty: float | None) -> Column:
    """Set overlap; the value for empty sides differs between the users of this measure."""
    shared = F.size(F.array_intersect(left, right))
    score = shared / (F.size(left) + F.size(right) - shared)
    none = (F.size(left) == 0) & (F.size(right) == 0)
    some = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(none, F.lit(both_empty)).when(some, F.lit(one_empty)).otherwise(score).cast("double")


def redact(value: Column, limit: int = 2000) -> Column:
    """Bearer secrets replaced, then cut to the stored length."""
    return F.substring(F.regexp_replace(value, "(?i)Bearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"), 1, limit)


def redact_map(values: Column) -> Column:
    """Drop secret-bearing keys of a string map and redact the values."""
    safe = F.map_filter(
        values, lambda k, v: ~k.rlike("(?i)authorization|api[-_]?key|access[-_]?token|secret|cookie")
    )
    return F.transform_values(safe, lambda k, v: redact(v))


def content_identity(snapshot_id: Column, article_id: Column, version: Column) -> Column:
    return F.when(snapshot_id.isNotNull(), F.format_string("snapshot:%d:v%d", snapshot_id, version)).otherwise(
        F.format_string("article:%d:v%d", article_id, version)
    )
