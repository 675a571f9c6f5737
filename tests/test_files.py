"""Readers on files with good and broken records."""

import json

from murmur.sources import payloads, readers

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed</title>
<item><title> First </title><link>http://a.example/1</link><guid isPermaLink="false">g1</guid><description>&lt;p&gt;body&lt;/p&gt;</description><pubDate>Wed, 01 Jul 2026 08:00:00 GMT</pubDate></item>
<item><title>Second</title><link>http://a.example/2</link><content:encoded>whole</content:encoded><description>short</description></item>
<item><title>No link</title><description>x</description></item>
<item><title>Broken</title><link>http://a.example/4</link><description>a <b unclosed</description></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title>Third</title><link rel="alternate" href="http://b.example/3"/><id>urn:3</id><summary>sum</summary><updated>2026-07-01T00:00:00Z</updated></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, encoding="utf-8")
    (tmp_path / "b.xml").write_text(ATOM, encoding="utf-8")
    got = {r.source_article_id: r for r in payloads.read_feed_files(spark, str(tmp_path)).collect() if r.fetch_status == "success"}
    assert set(got) == {"g1", "http://a.example/2", "urn:3"}
    assert (got["g1"].title, got["g1"].source_url, got["g1"].raw_content, got["g1"].content_type) == ("First", "http://a.example/1", "<p>body</p>", "html")
    assert got["http://a.example/2"].raw_content == "whole" and got["http://a.example/2"].content_type == "text"
    assert (got["urn:3"].source_url, got["urn:3"].publish_time, got["urn:3"].raw_content) == ("http://b.example/3", "2026-07-01T00:00:00Z", "sum")
    assert got["urn:3"].platform == "rss" and json.loads(got["urn:3"].raw_json)["id"] == "urn:3"
    failed = [r for r in payloads.read_feed_files(spark, str(tmp_path / "a.xml")).collect() if r.fetch_status == "failed"]
    assert len(failed) == 1 and failed[0].fetch_error == "INVALID_XML" and "unclosed" in failed[0].raw_json


def test_json_lines(spark, tmp_path):
    lines = ['{"platform": "weibo", "title": "t", "http_status": 200, "extra": 1}', "not json", '{"platform": "zhihu", "http_status": "x"}', ""]
    (tmp_path / "docs.json").write_text("\n".join(lines), encoding="utf-8")
    got = readers.read_raw_documents(spark, str(tmp_path / "docs.json"), "json").collect()
    good = [r for r in got if r.fetch_status == "success"]
    assert [(r.platform, r.title, r.http_status, r.language, r.raw_json) for r in good] == [("weibo", "t", 200, "unknown", "{}")]
    assert {r.raw_json for r in got if r.fetch_status == "failed"} == {"not json", lines[2]}


def test_parquet_documents(spark, tmp_path):
    rows = spark.createDataFrame([("weibo", "t", 5)], "platform string, title string, http_status int")
    readers.with_contract(rows).write.parquet(str(tmp_path / "docs"))
    got = readers.read_raw_documents(spark, str(tmp_path / "docs")).first()
    assert (got.platform, got.http_status, got.clean_status, got.author) == ("weibo", 5, "pending", None)


def test_import_files(spark, tmp_path):
    post = {"platform": "weibo", "url": "http://x.example/1", "title": "t", "raw_content": "c", "publish_time": "2026-07-01 08:00"}
    (tmp_path / "one.json").write_text(json.dumps([post, {"platform": "weibo"}, 7, post | {"url": "ftp://x"}]), encoding="utf-8")
    accepted, rejects = readers.validate_import(readers.read_import_json(spark, str(tmp_path / "one.json")))
    assert [(r["index"], r.source_url) for r in accepted.collect()] == [(0, "http://x.example/1")]
    bad = {r["index"]: (r.missing, r.field) for r in rejects.collect()}
    assert bad == {1: (["url", "title", "raw_content", "publish_time"], None), 2: (None, None), 3: ([], "url")}


def test_feed_entries_parse_each_entry_once(spark):
    from pyspark.sql import functions as F

    from murmur.sources import payloads

    feed = ("<feed xmlns=\"x\"><item><title>a <b>x</b> c</title><title>second</title><link>https://r</link><guid isPermaLink=\"false\">g1</guid></item>"
            "<a:entry xmlns:a=\"y\"><a:title type=\"html\">atom &amp; v</a:title><a:link href=\"h1\"/><a:link href=\"h2\"/><a:summary><![CDATA[<p>x</p>]]></a:summary></a:entry>"
            "<item><title>no link</title></item><item><author><title>deep</title></author><title>top</title><link> https://z </link><link href=\"k\"/><pubDate>now</pubDate></item></feed>")
    df = payloads.feed_entries(spark.createDataFrame([("f", feed)], "feed_url string, payload string"))
    got = [tuple(r) for r in df.orderBy("position").select("position", "title", "source_url", "source_article_id", "raw_content", "content_type").collect()]
    assert got == [(0, "a", "https://r", "g1", "", "text"), (1, "atom & v", "h1", "h1", "<p>x</p>", "html"), (3, "top", "https://z", "https://z", "", "text")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and "xpath" not in plan


def test_note_answers_clean_each_text_once(spark):
    from murmur.sources import payloads

    answer = ('{"data":{"items":[{"id":"a","note_card":{"display_title":"x &amp;lt; <b>y</b>","user":{"nickname":"n","user_id":"u"}}},'
              '{"note_card":{"note_id":"b","desc":"d &copy;"}},{"note_card":{"display_title":""}}]}}')
    df = payloads.xiaohongshu_search(spark.createDataFrame([("f", answer)], "feed string, payload string"))
    got = [tuple(r) for r in df.orderBy("position").select("position", "source_article_id", "title", "raw_content", "author_id").collect()]
    assert got == [(0, "a", "x &lt; y", "x < y", "u"), (1, "b", "小红书笔记", "d ©", None)]
    # the card is taken out of its item once (152 times before, once for every use)
    shown = df.select("position", "source_article_id", "title", "raw_content", "author_id")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("note_card") == 1
