"""Landed platform answers `(payload)` exploded into raw documents, one scan per platform shape."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from murmur.functions.text import unescape_only
from murmur.session import fence
from murmur.sources.readers import api_error, with_contract


def _get(item: Column, path: str) -> Column:
    return F.get_json_object(item, f"$.{path}")


def _first(item: Column, *paths: str) -> Column:
    """First value that is neither absent nor empty."""
    return F.coalesce(*[F.nullif(_get(item, p), F.lit("")) for p in paths])


def _identifier(item: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.nullif(_get(item, p), F.lit("")), F.lit("0")) for p in paths], F.lit(""))


def _array(payload: Column, path: str) -> Column:
    """JSON array at a path as texts of its object entries, null when it is not an array."""
    raw = _get(payload, path)
    return F.when(raw.startswith("["), F.filter(F.from_json(raw, "array<string>"), lambda x: x.startswith("{")))


def _plain_markup(text: Column, entities_first: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    drop = lambda c: F.regexp_replace(c, "<[^>]+>", "")
    body = drop(unescape_only(text)) if entities_first else unescape_only(drop(text))
    return F.regexp_replace(body, "(?U)^\\s+|\\s+$", "")


def _epoch_or_text(value: Column) -> Column:
    epoch = value.rlike("^\\d+(\\.\\d+)?$")
    return F.when(epoch, F.date_format(F.timestamp_seconds(value.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss+00:00")).otherwise(value)


def split_errors(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable answers, refused answers with their code)."""
    marked = payloads.withColumn("code", api_error(F.col("payload")))
    return marked.where("code is null").drop("code"), marked.where("code is not null")


def _items(payloads: DataFrame, items: Column, limit: int | None) -> DataFrame:
    keep = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*keep, F.posexplode(items).alias("position", "item"))
    return rows if limit is None else rows.where(F.col("position") < limit)


def _documents(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    base = rows.select(*keep, "position", F.col("item").alias("raw_json"), *[c.alias(n) for n, c in columns.items()])
    return with_contract(base)


def weibo_hot(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    keep, i = [c for c in payloads.columns if c != "payload"], F.col("item")
    title = F.coalesce(_first(i, "note", "word"), F.lit(""))
    return _documents(
        _items(payloads, _array(F.col("payload"), "data.realtime"), limit), keep,
        platform=F.lit("weibo_hot"), title=title,
        source_url=F.concat(F.lit("https://s.weibo.com/weibo?q="), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))),
        source_article_id=F.coalesce(_first(i, "word_scheme"), title),
        raw_content=F.coalesce(_first(i, "onboard_time_text"), title), source_type=F.lit("hotlist"),
    )


def weibo_search(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Posts from any of three answer shapes; cards are opened to the posts they hold."""
    p, i = F.col("payload"), F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    cards = F.coalesce(_array(p, "data.data.statuses"), _array(p, "data.statuses"), _array(p, "data.data.cards"))

    def opened(card: Column) -> Column:
        single, group = _get(card, "mblog"), _get(card, "card_group")
        members = F.array_compact(F.transform(
            F.from_json(group, "array<string>"), lambda e: F.when(_get(e, "mblog").startswith("{"), _get(e, "mblog"))))
        return F.when(single.startswith("{"), F.array(single)).when(group.startswith("["), members).otherwise(F.array(card))

    post_id = _identifier(i, "id", "mid")
    body = _first(i, "text_raw", "text")
    return _documents(
        _items(payloads, F.flatten(F.transform(cards, opened)), limit), keep,
        platform=F.lit("weibo"),
        source_url=F.coalesce(_first(i, "url"), F.concat(F.lit("https://weibo.com/"), F.coalesce(_get(i, "user.id"), F.lit("u")), F.lit("/"), post_id)),
        source_article_id=post_id, title=_plain_markup(F.coalesce(body, F.lit("微博内容"))), raw_content=_plain_markup(body),
        source_type=F.lit("social"), author=_get(i, "user.screen_name"), author_id=_get(i, "user.id"),
        author_followers=_get(i, "user.followers_count"), author_verified=_get(i, "user.verified").try_cast("boolean"),
        publish_time=_get(i, "created_at"), likes_count=_get(i, "attitudes_count"),
        comments_count=_get(i, "comments_count"), reposts_count=_get(i, "reposts_count"),
    )


def xiaohongshu_search(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    p, i = F.col("payload"), F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    found = F.coalesce(_array(p, "data.data.items"), _array(p, "data.items"), _array(p, "data.data.notes"))
    card = F.coalesce(F.nullif(_get(i, "note_card"), F.lit("{}")), i)
    # a value that later ones are read from is computed behind a fence, else each of them repeats it
    rows = fence(_items(payloads, found, limit).select("*", card.alias("_card")))
    card = F.col("_card")
    rows = fence(rows.select(
        "*", F.coalesce(F.nullif(_get(card, "user"), F.lit("{}")), _get(i, "user")).alias("_user"),
        F.coalesce(F.nullif(_identifier(i, "id"), F.lit("")), _identifier(card, "note_id", "id")).alias("_id"),
        _first(card, "display_title", "title").alias("_name"), _first(card, "desc").alias("_desc")))
    rows = fence(rows.select("*", _plain_markup(F.col("_name")).alias("_title")))
    rows = fence(rows.select("*", F.coalesce("_desc", "_title").alias("_body")))
    rows = fence(rows.select("*", _plain_markup(F.col("_body")).alias("_content")))
    user, note_id = F.col("_user"), F.col("_id")
    docs = _documents(
        rows, keep, platform=F.lit("xiaohongshu"),
        source_url=F.coalesce(_first(i, "url"), F.concat(F.lit("https://www.xiaohongshu.com/explore/"), note_id)),
        source_article_id=note_id, title=F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.lit("小红书笔记")), raw_content=F.col("_content"),
        source_type=F.lit("social"), author=_get(user, "nickname"), author_id=_get(user, "user_id"),
        likes_count=F.coalesce(_first(card, "interact_info.liked_count"), _get(card, "liked_count")),
        comments_count=F.coalesce(_first(card, "interact_info.comment_count"), _get(card, "comment_count")),
    )
    return docs.where((F.col("source_article_id") != "") | (F.col("raw_content") != ""))


def douyin_search(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    p, i = F.col("payload"), F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    found = F.coalesce(_array(p, "data.data"), _array(p, "data.data.data"), _array(p, "data.aweme_list"))
    clip = F.coalesce(F.nullif(_get(i, "aweme_info"), F.lit("{}")), i)
    clip_id = _identifier(clip, "aweme_id", "id")
    return _documents(
        _items(payloads, found, limit), keep, platform=F.lit("douyin"),
        source_url=F.coalesce(_first(clip, "share_url"), F.concat(F.lit("https://www.douyin.com/video/"), clip_id)),
        source_article_id=clip_id, title=_plain_markup(F.coalesce(_first(clip, "desc"), F.lit("抖音内容"))),
        raw_content=_plain_markup(_first(clip, "desc")), source_type=F.lit("social"), author=_get(clip, "author.nickname"),
        author_id=_get(clip, "author.uid"), author_followers=_get(clip, "author.follower_count"),
        publish_time=_epoch_or_text(_get(clip, "create_time")), likes_count=_get(clip, "statistics.digg_count"),
        comments_count=_get(clip, "statistics.comment_count"), reposts_count=_get(clip, "statistics.share_count"),
        views_count=_get(clip, "statistics.play_count"),
    )


def zhihu(payloads: DataFrame, hot: bool = False, limit: int | None = None) -> DataFrame:
    """Search or hot list; keys come in lower or upper camel case."""
    p, i = F.col("payload"), F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    found = F.coalesce(_array(p, "Data.Items"), _array(p, "data.data"), _array(p, "data"))
    url = F.coalesce(_first(i, "url", "Url", "link"), F.lit(""))
    return _documents(
        _items(payloads, found, limit), keep, platform=F.lit("zhihu_hot" if hot else "zhihu"), source_url=url,
        source_article_id=F.coalesce(F.nullif(_identifier(i, "id", "content_id", "ContentID"), F.lit("")), url),
        title=F.coalesce(_first(i, "title", "Title", "question_title"), F.lit("")),
        raw_content=F.coalesce(_first(i, "summary", "Summary", "excerpt", "content", "ContentText"), F.lit("")),
        source_type=F.lit("hotlist" if hot else "social"), author=_first(i, "author_name", "AuthorName", "author.name"),
        publish_time=_first(i, "edit_time", "EditTime", "updated_time", "created_time"),
        likes_count=F.coalesce(_get(i, "vote_up_count"), _get(i, "VoteUpCount")),
        comments_count=F.coalesce(_get(i, "comment_count"), _get(i, "CommentCount")),
    )


def bilibili(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    i = F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    video = _identifier(i, "bvid", "aid")
    docs = _documents(
        _items(payloads, _array(F.col("payload"), "data.result"), limit), keep, platform=F.lit("bilibili"),
        source_url=F.concat(F.lit("https://www.bilibili.com/video/"), video), source_article_id=video,
        title=_plain_markup(_get(i, "title"), True), raw_content=_plain_markup(_get(i, "description"), True), source_type=F.lit("social"),
        author=_get(i, "author"), author_id=_get(i, "mid"), publish_time=_epoch_or_text(_get(i, "pubdate")),
        likes_count=_get(i, "favorites"), comments_count=_get(i, "review"), views_count=_get(i, "play"),
    )
    return docs.where("source_article_id <> ''")


def baidu_search(payloads: DataFrame, keyword: str = "", limit: int | None = None) -> DataFrame:
    i = F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    docs = _documents(
        _items(payloads, _array(F.col("payload"), "references"), limit), keep, platform=F.lit("baidu"),
        source_url=_first(i, "url"), source_article_id=F.coalesce(F.nullif(_identifier(i, "id"), F.lit("")), _first(i, "url")),
        title=F.coalesce(_first(i, "title", "web_anchor"), F.lit(keyword)),
        raw_content=F.coalesce(_first(i, "content", "snippet"), F.lit("")), source_type=F.lit("news"),
        author=_first(i, "website", "web_anchor"), publish_time=_get(i, "date"),
    )
    return docs.where("source_url is not null")


def baidu_hot(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    i = F.col("item")
    keep = [c for c in payloads.columns if c != "payload"]
    title = F.coalesce(_first(i, "word", "query"), F.lit(""))
    return _documents(
        _items(payloads, _array(F.col("payload"), "data"), limit), keep, platform=F.lit("baidu_hot"), title=title,
        source_url=F.coalesce(_first(i, "url"), F.concat(F.lit("https://www.baidu.com/s?wd="), title)),
        source_article_id=F.coalesce(_first(i, "query"), title), raw_content=F.coalesce(_first(i, "desc"), title),
        source_type=F.lit("hotlist"),
    )


_FEED_FIELDS = ("title", "content", "description", "summary", "guid", "id", "pubDate", "published", "updated")
# text pieces of every element with the name, so that repeated and mixed elements give their first piece
_FEED_ENTRY = "link array<struct<_VALUE:array<string>,_href:string>>, " + ", ".join(f"{n} array<struct<_VALUE:array<string>>>" for n in _FEED_FIELDS)


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Feed documents `(feed_url, payload)` of RSS items or Atom entries; entries without a link are dropped.

    The XML text is cut at its entry elements and each entry is read by the built-in XML parser."""
    entry = "(?s)<(?:\\w+:)?(item|entry)(?:\\s[^>]*)?>.*?</(?:\\w+:)?\\1\\s*>"
    # field names are told apart without namespace prefixes
    bare = F.regexp_replace(F.regexp_replace("payload", "<(/?)\\w+:(\\w)", "<$1$2"), "\\sxmlns(:\\w+)?=\"[^\"]*\"", "")
    rows = feeds.select(*[c for c in feeds.columns if c != "payload"], F.posexplode(F.regexp_extract_all(bare, F.lit(entry), F.lit(0))).alias("position", "item"))
    # one parse for all fields; the fence keeps the filter on the link from parsing a second time
    keep = [c for c in feeds.columns if c != "payload"]
    rows = fence(rows.select(*keep, "position", F.from_xml("item", F.lit(_FEED_ENTRY), {"mode": "FAILFAST"}).alias("_x"))).select(*keep, "position", "_x.*")
    texts = lambda n: F.flatten(F.filter(F.transform(n, lambda x: x["_VALUE"]), lambda v: v.isNotNull()))
    clean = {n: F.nullif(F.trim(F.get(texts(n), F.lit(0))), F.lit("")) for n in _FEED_FIELDS}
    link = F.coalesce(
        F.nullif(F.trim(F.get(texts("link"), F.lit(0))), F.lit("")),
        F.get(F.filter(F.transform("link", lambda x: x["_href"]), lambda h: h.isNotNull()), F.lit(0)))
    content = F.coalesce(clean["content"], clean["description"], clean["summary"], F.lit(""))
    own_id = F.coalesce(clean["guid"], clean["id"])
    docs = rows.select(
        *keep, "position", F.lit("rss").alias("platform"), link.alias("source_url"), F.coalesce(own_id, link).alias("source_article_id"),
        F.coalesce(clean["title"], F.lit("")).alias("title"), content.alias("raw_content"), F.lit("rss").alias("source_type"),
        F.coalesce(clean["pubDate"], clean["published"], clean["updated"]).alias("publish_time"),
        F.when(content.contains("<"), "html").otherwise("text").alias("content_type"),
        F.to_json(F.struct("feed_url", own_id.alias("id"))).alias("raw_json"),
    )
    return with_contract(docs).where("source_url is not null")


_TEXT = "struct<_VALUE:string>"
_FEED_ROW = (
    "title string, link array<struct<_VALUE:string,_href:string>>, content string, encoded string, description string, summary string, "
    f"guid {_TEXT}, id string, pubDate string, published string, updated string, _broken string")


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of feed files: every RSS `item` and Atom `entry` is a row of the XML source, so a file of any size is split.

    Text that is no well-formed XML is kept as a failed document in `raw_json`, from the broken entry on; entries without a link are dropped."""
    def rows(tag: str) -> DataFrame:
        source = spark.read.format("xml").schema(_FEED_ROW).option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE")
        read = source.option("columnNameOfCorruptRecord", "_broken").load(path).withColumn("feed_url", F.input_file_name())
        # broken text turns up under every row tag: it belongs to the tag it holds
        return read.where(F.col("_broken").isNull() | F.col("_broken").rlike(f"<(\\w+:)?{tag}[\\s>]"))

    found = rows("item").unionByName(rows("entry"))
    clean = {n: F.nullif(F.trim(F.col(n)), F.lit("")) for n in ("title", "content", "encoded", "description", "summary", "id", "pubDate", "published", "updated")}
    guid = F.nullif(F.trim(F.col("guid._VALUE")), F.lit(""))
    links = F.filter(F.transform("link", lambda x: F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), F.nullif(F.trim(x["_href"]), F.lit("")))), lambda x: x.isNotNull())
    link, own_id = F.get(links, F.lit(0)), F.coalesce(guid, clean["id"])
    content = F.coalesce(clean["content"], clean["encoded"], clean["description"], clean["summary"], F.lit(""))
    broken = F.col("_broken").isNotNull()
    docs = found.select(
        "feed_url", F.lit("rss").alias("platform"), link.alias("source_url"), F.coalesce(own_id, link).alias("source_article_id"), F.coalesce(clean["title"], F.lit("")).alias("title"),
        content.alias("raw_content"), F.lit("rss").alias("source_type"), F.coalesce(clean["pubDate"], clean["published"], clean["updated"]).alias("publish_time"),
        F.when(content.contains("<"), "html").otherwise("text").alias("content_type"), F.when(broken, "failed").alias("fetch_status"), F.when(broken, "INVALID_XML").alias("fetch_error"),
        F.when(broken, F.col("_broken")).otherwise(F.to_json(F.struct("feed_url", own_id.alias("id")))).alias("raw_json"))
    return with_contract(docs.withColumn("fetch_status", F.coalesce("fetch_status", F.lit("success")))).where("source_url is not null or fetch_status = 'failed'")
