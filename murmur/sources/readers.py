"""Readers with explicit schemas, import validation, batch collection, issue tables and paged reads."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from murmur.functions import text as tx
from murmur.functions.ranking import top_overall, top_per_group
from murmur.operators.dedup import two_key_dedup

_S, _L = T.StringType(), T.LongType()
RAW_DOCUMENT = T.StructType([
    *[T.StructField(n, _S) for n in (
        "platform", "source_url", "title", "raw_content", "source_type", "source_article_id", "content_type",
        "author", "author_id", "author_type", "publish_time", "language", "clean_status", "fetch_status", "fetch_error")],
    *[T.StructField(n, _S) for n in ("author_followers", "likes_count", "comments_count", "reposts_count", "views_count")],
    T.StructField("author_verified", T.BooleanType()), T.StructField("http_status", T.IntegerType()),
    T.StructField("raw_json", _S),
])
_DEFAULTS = {"source_type": "news", "content_type": "text", "language": "unknown", "clean_status": "pending",
             "fetch_status": "success", "raw_json": "{}"}
REQUIRED = ("platform", "url", "title", "raw_content", "publish_time")


def with_contract(rows: DataFrame) -> DataFrame:
    """Any subset of the raw-document fields, completed with the contract's defaults and typed."""
    have = set(rows.columns)
    columns = []
    for field in RAW_DOCUMENT:
        value = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in _DEFAULTS:
            value = F.coalesce(value.cast(_S), F.lit(_DEFAULTS[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    extra = [c for c in rows.columns if c not in RAW_DOCUMENT.names]
    return rows.select(*extra, *columns)


CORRUPT = "_corrupt"


def read_raw_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed documents as JSON lines or Parquet, never with an inferred schema.

    A JSON line that is no object of the contract's types comes back as a failed document: its text is `raw_json`, the
    fields that could be read are kept."""
    if fmt != "json":
        return with_contract(spark.read.schema(RAW_DOCUMENT).parquet(path))
    schema = T.StructType([*RAW_DOCUMENT.fields, T.StructField(CORRUPT, _S)])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    broken = F.col(CORRUPT).isNotNull()
    return with_contract(rows.withColumns({
        "fetch_status": F.when(broken, "failed").otherwise(F.col("fetch_status")), "fetch_error": F.when(broken, "INVALID_JSON").otherwise(F.col("fetch_error")),
        "raw_json": F.when(broken, F.col(CORRUPT)).otherwise(F.col("raw_json"))}).drop(CORRUPT))


def read_import_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of posts per file, one row per post as text with its position in the import."""
    body = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    return body.select(F.posexplode(items).alias("index", "item"))


def validate_import(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows `(index, item)` of JSON text to (accepted documents, rejects with reasons).

    A required field must be a non-blank JSON string; the address scheme and the time must be readable."""
    get = lambda name: F.get_json_object("item", f"$.{name}")
    variant = F.try_parse_json("item")
    is_text = lambda name: F.coalesce(
        F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")) == "STRING", F.lit(False))
    rows = items.withColumns({
        "is_object": F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False)),
        "missing": F.array_compact(F.array(*[
            F.when(~is_text(n) | (F.trim(F.coalesce(get(n), F.lit(""))) == ""), n) for n in REQUIRED])),
        "_scheme": F.regexp_extract(F.trim(get("url")), "^([A-Za-z][A-Za-z0-9+.-]*):", 1),
        "_time": tx.time_struct(get("publish_time")),
    })
    field = F.when(~F.lower("_scheme").isin("http", "https", "sample", "rss"), "url").when(F.col("_time.utc").isNull(), "publish_time")
    message = (
        F.when(~F.col("is_object"), "每条数据必须是对象")
        .when(F.size("missing") > 0, F.concat(F.lit("缺少或无效字段: "), F.array_join("missing", ", ")))
        .when(field == "url", "url 协议不受支持").when(field == "publish_time", "发布时间格式无效")
    )
    rows = rows.withColumns({"field": F.when(F.col("is_object") & (F.size("missing") == 0), field), "message": message})
    rejects = rows.where("message is not null").select(
        "index", F.when(F.col("is_object"), F.col("missing")).alias("missing"), "field", "message")
    metric = lambda name: tx.parse_metric(F.coalesce(get(f"{name}s_count"), get(f"{name}_count")))
    accepted = rows.where("message is null").select(
        "index", F.trim(get("platform")).alias("platform"), F.trim(get("url")).alias("source_url"),
        get("source_article_id").alias("source_article_id"), F.coalesce(get("source_type"), F.lit("sample")).alias("source_type"),
        F.trim(get("title")).alias("title"), get("raw_content").alias("raw_content"), get("content_type").alias("content_type"),
        get("publish_time").alias("publish_time"), get("author").alias("author"), get("author_id").alias("author_id"),
        tx.parse_metric(get("author_followers")).alias("author_followers"), get("author_type").alias("author_type"),
        *[metric(n).alias(f"{n}s_count") for n in ("like", "comment", "repost", "view")],
        F.coalesce(get("clean_status"), F.lit("pending")).alias("clean_status"), F.col("item").alias("raw_json"),
    )
    return accepted, rejects


def allocation(target: int | None, platforms: int, maximum: int = 200, default: int = 50, per_platform: int = 50) -> tuple[int, int]:
    """(documents wanted, documents taken from each platform)."""
    wanted = min(maximum, max(1, int(target or default)))
    return wanted, min(per_platform, max(1, -(-wanted // max(1, platforms))))


def choose_platforms(known: list[str], chosen: list[str] | None, mode: str) -> list[str]:
    if chosen:
        return chosen
    if mode == "hot":
        return [p for p in known if p.endswith("_hot")]
    return [p for p in known if p not in ("sample", "rss") and not p.endswith("_hot")]


def collect_batch(landed: DataFrame, platforms: list[str], target: int | None = None) -> DataFrame:
    """Documents of one collection: a share per platform in order, no address or source id twice, `target` in all.

    `landed(platform, position, source_url, source_article_id, ...)`. The share bounds what is de-duplicated."""
    wanted, share = allocation(target, len(platforms))
    index = tx.literal_map({p: i for i, p in enumerate(platforms)})[F.col("platform")]
    pool = landed.where(F.col("platform").isin(*platforms))
    head = top_per_group(pool, ["platform"], [F.asc("position")], share, "_rn")
    head = head.withColumn("ord", index.cast("long") * 1_000_000 + F.col("_rn")).drop("_rn")
    return top_overall(two_key_dedup(head, "ord"), [F.asc("ord")], wanted, "batch_rank").drop("ord")


def batch_issues(batch: DataFrame, platforms: list[str], configured: list[str], failures: DataFrame | None = None) -> DataFrame:
    """Count per requested platform with the code of what went wrong, if anything."""
    spark = batch.sparkSession
    wanted = spark.createDataFrame([(p, p in configured) for p in platforms], "platform string, configured boolean")
    counts = batch.groupBy("platform").agg(F.count("*").alias("documents"))
    joined = wanted.join(counts, "platform", "left")
    failed = F.lit(None).cast("string")
    if failures is not None:
        joined = joined.join(failures.select("platform", F.col("code").alias("_code")), "platform", "left")
        failed = F.col("_code")
    code = (
        F.when(~F.col("configured"), "CRAWLER_NOT_CONFIGURED").when(failed.isNotNull(), failed)
        .when(F.col("documents").isNull(), "CRAWL_EMPTY_RESPONSE")
    )
    return joined.select("platform", F.coalesce("documents", F.lit(0)).alias("documents"), code.alias("code"))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20, maximum: int = 100) -> DataFrame:
    """One ordered page; number and size are clamped."""
    number, size = max(1, int(number)), max(1, min(maximum, int(size)))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sample_documents(spark: SparkSession, keywords: list[str]) -> DataFrame:
    """One deterministic document per keyword."""
    rows = [(k or "舆情",) for k in keywords]
    kw = F.col("keyword")
    return with_contract(spark.createDataFrame(rows, "keyword string").select(
        F.lit("sample").alias("platform"), F.concat(F.lit("sample://"), kw, F.lit("/1")).alias("source_url"),
        F.concat(kw, F.lit("-1")).alias("source_article_id"), F.concat(kw, F.lit(" 样例报道")).alias("title"),
        F.repeat(F.concat(kw, F.lit(" 相关样例正文，用于爬虫、清洗和任务接口联调。")), F.lit(8)).alias("raw_content"),
        F.lit("sample").alias("source_type"), F.lit("text").alias("content_type"),
        F.lit("2026-07-10T08:00:00+08:00").alias("publish_time"), F.lit("系统样例").alias("author"),
        F.to_json(F.struct(F.lit("sample").alias("source"), kw.alias("keyword"))).alias("raw_json"),
    ))


# ---- checks over fetched material

def fetch_result(status: Column, text: Column, error: Column, block_hints: str, empty_hints: str) -> Column:
    """Class of a fetch by status code, error and text; the two hint patterns are lists of site phrases."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(status.isNull(), "network_error").when(status.isin(401, 403, 429), "blocked_or_rate_limited")
        .when(status >= 500, "server_error").when(status >= 400, "http_error")
        .when(F.coalesce(error, F.lit("")) != "", "parse_error")
        .when(F.lower(text).rlike(block_hints), "login_or_verification_required").when(text.rlike(empty_hints), "no_search_results")
        .when(F.length(text) < 120, "too_little_text").otherwise("public_content_accessible")
    )


def error_class(code: Column, message: Column) -> Column:
    """Class of a failure: words are looked for in the upper-case code, bare numbers also in the message."""
    both = F.concat_ws(" ", F.upper(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(message, F.lit(""))))
    has = lambda pattern: both.rlike(pattern)
    return (
        F.when(has("401|403|AUTH|UNAUTHORIZED|INVALID KEY"), "AUTH_ERROR")
        .when(has("429|QUOTA|BALANCE|RATE LIMIT|LIMIT EXCEEDED"), "QUOTA_ERROR")
        .when(has("CAPTCHA|LOGIN_REQUIRED|BLOCKED|SECURITY VERIFICATION"), "PLATFORM_BLOCKED")
        .when(has("TIMEOUT|DNS|SSL|CONNECTION|NETWORK"), "NETWORK_ERROR")
        .when(has("404|NOT FOUND|RESPONSE|JSON|SCHEMA"), "REMOTE_CHANGED").otherwise("CODE_ERROR")
    )


def contract_errors() -> Column:
    """Missing required fields of a raw document row."""
    blank = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))) == ""
    return F.array_compact(F.array(
        *[F.when(blank(n), f"{n}_missing") for n in ("platform", "title", "source_type", "source_url")],
        F.when(F.coalesce(F.trim("raw_json"), F.lit("")).isin("", "{}", "null"), "raw_json_missing"),
    ))


def decode_bytes(content: Column) -> Column:
    """UTF-8 text, else GB18030, else UTF-8 with replacement characters."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_decode_gb(content))


@F.pandas_udf(T.StringType())
def _decode_gb(values):
    def one(data):
        if data is None:
            return None
        for charset in ("utf-8", "gb18030"):
            try:
                return bytes(data).decode(charset)
            except UnicodeDecodeError:
                continue
        return bytes(data).decode("utf-8", errors="replace")

    return values.map(one)


def api_error(payload: Column) -> Column:
    """`CRAWL_API_<code>` when an answer envelope reports a failure."""
    code = F.coalesce(F.get_json_object(payload, "$.code"), F.get_json_object(payload, "$.Code"))
    return F.when(code.isNotNull() & ~F.lower(code).isin("0", "200", "ok", "success"), F.concat(F.lit("CRAWL_API_"), code))
