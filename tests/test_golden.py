"""Hand-checked rows for rules that the given tables reach only in part."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from murmur.config import AggregationConfig
from murmur.functions import text as tx
from murmur.operators import clustering, dedup, events, features, heat, hooks, ingest, lifecycle, propagation, risk, sentiment, topics
from murmur.sources import readers

DAY = dt.date(2026, 7, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [
    ("HTTPS://EXAMPLE.COM/a?utm_source=x&keep=1#part", "https://example.com/a?keep=1"), ("http://h:80", "http://h/"), ("ftp://h/x", None),
    ("sample://k/1#f", "sample://k/1"), ("https://u:p@h:8443/p?a=&b=x y&from=z", "https://h:8443/p?a=&b=x+y"), ("", None),
])
def test_url(spark, raw, want):
    assert one(spark, tx.normalize_url(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("1.2万", 12000), ("2.5k", 2500), ("1,024", 1024), ("-3", 0), ("3亿", 300_000_000), ("1.5w", 15000), ("many", None), ("", None)])
def test_metric(spark, raw, want):
    assert one(spark, tx.parse_metric(F.lit(raw))) == want


def test_unknown_metric_stays_unknown(spark):
    assert one(spark, tx.parse_metric(F.lit(None).cast("string"))) is None


def test_plain_text_and_stable_characters(spark):
    assert one(spark, tx.plain(F.lit("  ＡＢ&nbsp;c&#33;​\n d ﬁ "))) == "AB c! d fi"
    import re

    stable = re.compile(f"[{tx.STABLE}]".encode().decode("unicode_escape"))
    composing = {unicodedata.normalize("NFD", chr(c))[1:2] for c in range(0x3000)} - {""}
    for code in range(0x10000):
        char = chr(code)
        if stable.fullmatch(char):
            assert unicodedata.normalize("NFKC", char) == char and unicodedata.combining(char) == 0 and char not in composing


def test_duplicate_pairs(spark):
    long_a, long_b = "城市暴雨预警发布最新进展通报", "城市暴雨预警发布最新进展通报"
    body = "今天城市发布暴雨红色预警多部门启动应急响应" * 5
    rows = [("copy", long_a, long_b, body, body + "。"), ("short", "暴雨", "暴雨", body, body + "！晴"), ("other", long_a, "电影票房再创新高观众反响热烈评价", body, "票房" * 40)]
    df = spark.createDataFrame(rows, "name string, title_a string, title_b string, a string, b string").select(
        "name", "title_a", "title_b", dedup.content_hash(F.col("a")).alias("hash_a"), dedup.content_hash(F.col("b")).alias("hash_b"),
        dedup.simhash(F.col("a")).alias("sim_a"), dedup.simhash(F.col("b")).alias("sim_b"))
    got = {r.name: r for r in dedup.pair_verdict(df).collect()}
    assert got["copy"].is_duplicate and got["copy"].method == "simhash"
    assert not got["short"].is_duplicate and got["short"].dedup_pending
    assert not got["other"].is_duplicate


def test_near_copies_are_all_found(spark):
    """Blocking against brute force over all pairs of a small, hot set of titles and bodies."""
    rng = random.Random(7)
    base = "breaking storm warning issued for the coastal district tonight"
    rows = []
    for i in range(120):
        title = list(base)
        for _ in range(rng.randint(0, 4)):
            title[rng.randrange(len(title))] = rng.choice("abcdefgh ")
        rows.append((i, "".join(title), base * 3 + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))))
    prints = dedup.fingerprinted(spark.createDataFrame(rows, "article_id long, title string, clean_content string")).persist()
    data = prints.select("article_id", "content_hash", "sim", "features", "title_length").collect()

    def same(a, b):
        if a.content_hash == b.content_hash:
            return True
        x, y = set(a.features), set(b.features)
        near = bin((a.sim ^ b.sim) & (2**64 - 1)).count("1") <= 3
        return min(a.title_length, b.title_length) >= 10 and near and len(x & y) / len(x | y) >= 0.85

    parent = {r.article_id: r.article_id for r in data}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in data:
        for b in data:
            if a.article_id < b.article_id and same(a, b):
                x, y = find(a.article_id), find(b.article_id)
                parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in parent if sum(find(j) == find(i) for j in parent) > 1}
    got = {r.node: r.component for r in dedup.connected_components(dedup.duplicate_edges(prints)).collect()}
    assert got == want


def test_cycle_is_reported(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4)]
    got = {r.article_id: (r.root_id, r.in_cycle) for r in dedup.resolve_chains(spark.createDataFrame(rows, "article_id long, duplicate_of_id long")).collect()}
    assert got[3] == (1, False) and got[1] == (1, False)
    assert all(got[i][1] for i in (4, 5, 6, 7))


@pytest.mark.parametrize("counts,previous,stage,reactivated", [
    ([3, 4, 5, 3, 5], None, "潜伏期", False), ([5, 15, 30, 50, 80, 120], None, "成长期", False), ([80, 100, 120, 115, 118, 116, 114], None, "高潮期", False),
    ([120, 115, 110, 105, 100, 50, 40], None, "消退期", False), ([120, 90, 50, 20, 30, 50, 80], "消退期", "成长期", True), ([7], None, "潜伏期", False),
])
def test_lifecycle(spark, counts, previous, stage, reactivated):
    daily = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), c) for i, c in enumerate(counts)], "event_id long, day date, count long")
    before = spark.createDataFrame([(1, previous)], "event_id long, previous_stage string")
    row = lifecycle.lifecycle_stage(daily, before).first()
    assert (row.stage, row.reactivated) == (stage, reactivated)


def test_single_event_scores_fifty(spark):
    now = dt.datetime(2026, 7, 10)
    rows = [(1, i, p, now - dt.timedelta(hours=i), None, True, i, None, 5, None, 1.0, 1.0) for i, p in ((1, "a"), (2, "b"), (3, "a"))]
    articles = spark.createDataFrame(rows, "event_id long, article_id long, platform string, publish_time timestamp, observed_at timestamp, is_representative boolean, "
                                     "comments_count long, reposts_count long, likes_count long, views_count long, duplicate_weight double, spam_weight double")
    ranks = spark.createDataFrame([], "event_id long, hot_rank int")
    row = heat.event_heat(articles, ranks, F.lit(now)).first()
    assert (row.report_score, row.growth_score, row.platform_score, row.spread_heat) == (50.0, 50.0, 50.0, 50.0)
    fresh = round(100 * 2 ** (-1 / 24), 6)
    assert row.core_heat == pytest.approx(round((150 + fresh) / 4, 6), abs=1e-6)
    assert row.final_heat == pytest.approx(0.7 * row.core_heat + 15, abs=1e-6) and row.eligible_as_hot and row.hot_rank == 1


def test_weight_is_bounded(spark):
    row = spark.createDataFrame([(1, 1, "positive", 0.5, "a", DAY, None, True, 5.0, 2.0, 1.0, 9.0), (1, 2, "negative", -0.5, "a", DAY, None, False, 1.0, 1.0, 0.3, 0.0)],
        "event_id long, article_id long, label string, score double, platform string, publish_time date, observed_time date, is_representative boolean, nlp_weight double, spam_weight double, duplicate_weight double, heat_contribution double")
    got = {r.article_id: r.final_weight for r in sentiment.article_weights(row).collect()}
    assert got == {1: 1.5, 2: pytest.approx(0.3)}
    total = sentiment.event_summary(row).first()
    assert total.positive_ratio == pytest.approx(1.5 / 1.8) and total.dominant_label == "positive"


def test_probability_without_value_has_no_label_by_accident(spark):
    df = spark.createDataFrame([(0.6, "自然灾害"), (0.4, "其他"), (0.5, None)], "probability double, topic_category string")
    assert [r.label for r in sentiment.from_probability(df).collect()] == ["positive", "negative", "neutral"]


def test_missing_corroboration_alone(spark):
    rows = [(1, 1, "weibo", "城市交通通知发布", "城市交通通知发布内容说明正文", "某作者", None, None, 0.0, None, [], {}, 1, 1, 1)]
    schema = ("event_id long, article_id long, platform string, title string, clean_content string, author string, duplicate_of_id long, content_hash string, sentiment_score double, "
              "publish_time timestamp, keywords array<string>, entities map<string,array<string>>, comments_count long, reposts_count long, likes_count long")
    row = risk.assess(spark.createDataFrame(rows, schema)).first()
    assert row.score == 20.0 and not row.is_suspicious and row.reason == "缺少跨平台佐证"


def _posts(spark, rows):
    t0 = dt.datetime(2026, 7, 1)
    full = [(1, i, a, p, title, body, "", t0 + dt.timedelta(hours=h), None, sid, raw, ["k"], {}, "unknown", 0, 1, 0, 0, 0) for i, a, p, title, body, h, sid, raw in rows]
    return spark.createDataFrame(full, "event_id long, article_id long, author string, platform string, title string, clean_content string, raw_content string, publish_time timestamp, "
        "observed_at timestamp, source_article_id string, raw_json string, keywords array<string>, entities map<string,array<string>>, author_type string, author_followers long, likes_count long, comments_count long, reposts_count long, views_count long")


def test_propagation_edges(spark):
    same = "城市暴雨预警发布多部门启动应急响应转移群众"
    posts = _posts(spark, [
        (1, "甲媒体", "weibo", "暴雨预警", same, 0, "s1", "{}"), (2, "乙", "zhihu", "跟进", "无关的一段话", 1, "s2", '{"parent_id": "s1"}'),
        (3, "丙", "weibo", "转", "//@甲媒体 转一下", 2, "s3", "{}"), (4, "丁", "baidu", "暴雨预警", same + "中", 3, "s4", "{}"), (5, "戊", "rss", "别的话题", "完全不同的文字内容", 4, "s5", "{}")])
    heads = propagation.first_articles(posts)
    got = {r.target_id: r for r in propagation.edges(heads).collect()}
    assert {k: (v.source_id, v.evidence_type) for k, v in got.items()} == {2: (1, "explicit"), 3: (1, "explicit"), 4: (1, "inferred")}
    assert got[4].relation_type == "cross_platform_followup"
    assert propagation.origin_counts(posts, tile=2).first().origin_candidate_count == 2  # tiles of two rows: cut on purpose


def test_clustering_attach_ambiguous_conflict(spark):
    t0 = dt.datetime(2026, 7, 1)
    def doc(run, i, vec, ent=None, kw=()):
        return (run, i, t0 + dt.timedelta(hours=i), "t", list(kw), ent or {}, vec, None)
    rows = [doc(1, 1, [1.0, 0.0]), doc(1, 2, [0.99, 0.1]), doc(1, 3, [0.0, 1.0]), doc(2, 1, [1.0, 0.0], {"location": ["北京"]}), doc(2, 2, [1.0, 0.0], {"location": ["上海"]}), doc(3, 1, None)]
    schema = "run_id long, article_id long, effective_time timestamp, topic_category string, keywords array<string>, entities map<string,array<string>>, bge_vector array<double>, tfidf_vector array<double>"
    docs = spark.createDataFrame(rows, schema)
    got = {(r.run_id, r.article_id): (r.cluster_index, r.action) for r in clustering.cluster_runs(docs).collect()}
    assert got[(1, 1)] == (0, "create") and got[(1, 2)] == (0, "attach") and got[(1, 3)] == (1, "create")
    assert got[(2, 1)][0] != got[(2, 2)][0]
    assert got[(3, 1)] == (None, "deferred")
    shuffled = clustering.cluster_runs(docs.orderBy(F.desc("article_id")).repartition(3))
    assert {(r.run_id, r.article_id): (r.cluster_index, r.action) for r in shuffled.collect()} == got
    assert len(got) == len(rows)


def test_a_run_of_any_size_comes_back_whole(spark):
    docs = spark.range(1000).selectExpr(
        "7L AS run_id", "id AS article_id", "timestamp_seconds(id * 60) AS effective_time", "'t' AS topic_category", "array('k') AS keywords",
        "map('topic', array('t')) AS entities", "array(cos(id % 3), sin(id % 3)) AS bge_vector", "CAST(NULL AS ARRAY<DOUBLE>) AS tfidf_vector")
    got = clustering.cluster_runs(docs).collect()
    assert len(got) == 1000 and {r.action for r in got} <= {"attach", "create", "moved"} and len({r.cluster_index for r in got}) == 1 + max(r.cluster_index for r in got)


def test_extraction_paths(spark):
    text = "正文内容" * 40
    rows = [("a", f"<html><body><div class='x content'>{text}<script>var a=1</script></div><p>其他</p></body></html>"), ("b", f"<html><main><p>{text}</p></main></html>"),
            ("c", f"<html><body><p>{text}</p></body></html>"), ("d", "<html><body>short</body></html>"), ("e", text)]
    docs = readers.with_contract(spark.createDataFrame(rows, "source_article_id string, raw_content string").withColumns(
        {"platform": F.lit("web"), "title": F.lit("t"), "content_type": F.when(F.col("source_article_id") == "e", "text").otherwise("html")}))
    got = {r.source_article_id: r for r in ingest.preprocess(docs).collect()}
    assert {k: v.extraction_method for k, v in got.items()} == {"a": "bs4", "b": "bs4", "c": "fallback", "d": None, "e": "plain_text"}
    assert got["a"].clean_content == text and got["d"].clean_status == "failed" and [s.stage for s in got["d"].logs] == ["crawl", "normalize", "extract"]


def test_sample_documents_and_allocation(spark):
    assert readers.sample_documents(spark, ["暴雨"]).first().source_url == "sample://暴雨/1"
    assert readers.allocation(500, 3) == (200, 50) and readers.allocation(10, 3) == (10, 4)
    assert readers.choose_platforms(["weibo", "weibo_hot", "rss"], None, "hot") == ["weibo_hot"]


def test_topic_numbers_and_choice():
    assert [topics.candidate_counts(n) for n in (4, 9, 29, 50)] == [[], [2], [2, 3, 4], [3, 4, 5, 6, 7, 8]]
    c = lambda k, p, ok: {"topic_count": k, "perplexity": p, "passed_quality": ok}
    assert topics.select_candidate([c(2, 101.0, True), c(3, 100.0, True), c(4, 50.0, False)])[0]["topic_count"] == 2
    assert topics.select_candidate([c(2, 150.0, False), c(3, 100.0, False)]) == (c(3, 100.0, False), ["TOPIC_QUALITY_DEGRADED"])


def test_zero_vector_and_mixed_sizes(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0]), ("b", [1.0])], "k string, vector array<double>")
    assert df.select(features.normalized(F.col("vector")).alias("u")).first().u is None
    assert {r.k: r.centroid for r in features.centroids(df, ["k"]).collect()}["b"] is None


def test_percentile_handles_one_huge_tie(spark):
    from murmur.functions.ranking import with_percentile

    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = with_percentile(df, "v").where("id in (5, 2999)").select("id", "score").collect()
    assert {r.id: r.score for r in got} == {5: round(999.5 / 2999 * 100, 6), 2999: 100.0}


def test_pair_scorer_replaces_token_overlap(spark):
    same = hooks.pair_scorer(lambda a, b: 2.0 if a == b else -1.0)
    df = spark.createDataFrame([("x", "x"), ("x", "y")], "a string, b string").select(same("a", "b").alias("s"))
    assert [r.s for r in df.collect()] == [1.0, 0.0]


def test_only_whole_json_numbers_are_list_ranks(spark):
    rows = [(1, '{"rank": "新"}'), (2, '{"rank": "3", "realpos": 4}'), (3, '{"rank": 0, "realpos": 5}'), (4, '{"rank": 7}'), (5, '{"rank": null, "realpos": 2}'), (6, "no json"), (7, None)]
    listed = spark.createDataFrame(rows, "event_id long, raw_json string").withColumn("source_type", F.lit("hotlist"))
    seeds = spark.createDataFrame([], "event_id long, source_rank int")
    assert {r.event_id: r.hot_rank for r in heat.hotlist_ranks(seeds, listed).collect()} == {3: 5, 4: 7, 5: 2}


def test_huge_metric_is_unknown(spark):
    assert one(spark, tx.parse_metric(F.lit("99999999999999999999亿"))) is None


def test_new_rows_with_one_source_id_are_one_article(spark):
    from murmur.operators import runs

    old = spark.createDataFrame([], "article_id long, platform string, source_article_id string, url_hash string, raw_hash string, content_version int, title string")
    new = spark.createDataFrame([(1, "p", "s1", "u1", "h", "t", 1), (2, "p", "s1", "u2", "h", "t", 2), (3, "p", None, "u2", "h", "t", 3), (4, "q", "s1", "u4", "h", "t", 4)],
        "doc_id long, platform string, source_article_id string, url_hash string, raw_hash string, title string, crawled_at long")
    assert sorted((r.article_id, r.action) for r in runs.upsert_articles(old, new).collect()) == [(1, "created"), (4, "created")]


def test_sparse_ids_fill_batches(spark):
    docs = spark.range(10).selectExpr("id * 1000000007 AS article_id", "'a title of twenty letters or more' AS title", "array('x') AS body_tokens")
    assert sorted(len(r.documents) for r in features.keyword_requests(docs).collect()) == [5, 5]


def test_embedding_text_is_cut_as_a_whole(spark):
    docs = spark.createDataFrame([(1, " ti", "b" * 3000), (2, None, " x ")], "article_id long, title string, clean_content string")
    stored = spark.createDataFrame([], "article_id long")
    got = {r.article_id: r.embedding_text for r in features.missing_embeddings(docs, stored, ["article_id"]).collect()}
    assert got == {1: "ti\n" + "b" * 1997, 2: "x"}


def test_one_digest_per_run_for_any_id(spark):
    from murmur.operators import runs

    rows = spark.createDataFrame([(1, -5, "a"), (1, 1 << 61, "b"), (1, 7, "c"), (2, 7, "c")], "run_id long, article_id long, identity string")
    assert sorted(r.run_id for r in runs.dataset_hash(rows).collect()) == [1, 2]


def test_id_parents_anywhere_in_the_event(spark):
    """A parent behind the first 40 makes its child no origin; a late one is refused and ends the search."""
    body = lambda i: f"独立内容{i}号" * 3
    rows = [(i, f"作者{i:03d}", "weibo", f"t{i}", body(i), i, f"s{i}", "{}") for i in range(1, 46)]
    rows[4] = (5, "作者005", "weibo", "t5", body(5), 5, "s5", '{"parent_id": "s99"}')
    rows[5] = (6, "作者006", "weibo", "t6", "//@作者001 " + body(6), 6, "s6", '{"parent_id": "s44"}')
    posts = _posts(spark, rows)
    late = _posts(spark, [(99, "无", "weibo", "t", "别的", 0, "s99", "{}")]).withColumn("publish_time", F.lit(None).cast("timestamp"))
    posts = posts.unionByName(late)
    heads = propagation.first_articles(posts)
    found = propagation.edges(heads, posts)
    assert {(r.source_id, r.target_id, r.published) for r in found.where("evidence_type = 'explicit'").collect()} == {(99, 5, False)}
    roots = {r.article_id: r.is_root for r in propagation.nodes(posts, heads, found).collect()}
    assert len(roots) == 40 and not roots[5]  # article 6 names a later one and may not fall back on the author
    inside = found.where("target_id <> 5").count()
    assert propagation.origin_counts(posts, tile=8).first().origin_candidate_count <= 45 - inside


def test_fixed_point_rounds_the_exact_binary_value(spark):
    values = [(x, d) for d in (1, 3) for x in (0.0665, 0.0375, -0.0004, -0.0, 0.0, 0.5, 0.25, 0.0625, -0.0625, 12.35, 43.85, 99.95, 100.0, -1.0, 0.9995, 41.800000000000004)]
    rnd = random.Random(5)
    values += [(rnd.randint(-2000, 2000) / 2000, 3) for _ in range(300)] + [(rnd.randint(0, 2000) / 20, 1) for _ in range(300)]
    for digits in (1, 3):
        part = [(x,) for x, d in values if d == digits]
        got = spark.createDataFrame(part, "x double").select("x", tx.fixed_point(F.col("x"), digits).alias("t")).collect()
        assert [(r.x, r.t) for r in got if r.t != f"{r.x:.{digits}f}"] == []


def test_event_risk_mean_at_a_tie_does_not_depend_on_row_order(spark):
    scores = [31.4, 32.9, 31.8, 30.1]  # as doubles their mean is 31.549999999999997
    rows = [(e, s, False, ["x"]) for e, order in enumerate((scores, scores[::-1], sorted(scores))) for s in order]
    df = spark.createDataFrame(rows, "event_id long, score double, is_suspicious boolean, reasons array<string>").coalesce(1)
    assert {r.score for r in risk.event_risk(df).collect()} == {31.6}
