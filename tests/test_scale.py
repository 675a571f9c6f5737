"""Shapes of plans that decide how a query grows, and the results that must stay."""

from pyspark.sql import functions as F

from murmur.functions import ranking
from murmur.operators import features, heat, sentiment


def joins(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.split("\n") if "Join" in line]


def test_inherited_results_take_one_shuffle_join(spark):
    targets = spark.createDataFrame(
        [(1, True, None), (2, False, 1), (3, False, None), (4, False, 9), (5, True, None), (6, None, 1), (7, False, 1)],
        "article_id long, is_representative boolean, duplicate_of_id long")
    results = spark.createDataFrame([(1, "positive", 0.5, "llm"), (6, "negative", 0.1, "llm"), (7, "neutral", 0.2, "llm")], "article_id long, label string, score double, method string")
    out = sentiment.with_inherited(targets, results)
    missing = "INHERITANCE_SOURCE_MISSING"
    assert sorted((r.article_id, r.label, r.score, r.method, r.warning) for r in out.collect()) == [
        (1, "positive", 0.5, "llm", None), (2, "positive", 0.5, "inherited", None), (3, None, None, None, missing), (4, None, None, None, missing),
        (5, None, None, None, None), (6, "negative", 0.1, None, None), (7, "positive", 0.5, "inherited", None)]
    assert len(joins(out)) == 1 and "SortMergeJoin" in joins(out)[0]


def test_fences_are_cut_as_their_pattern_did(spark):
    def by_pattern(content):
        text = F.regexp_replace(F.coalesce(content, F.lit("")), "(?U)^\\s+|\\s+$", "")
        return F.when(text.rlike("(?is)^```(?:json)?\\s*.*?\\s*```$"), F.regexp_extract(text, "(?is)^```(?:json)?\\s*(.*?)\\s*```$", 1)).otherwise(text)

    texts = [None, "", " {} ", "```json {} ```", "```JSON\n{\n}\n```\n", "```{}```", "```js```", "``````", "`````", "```json```", "```json", "\u3000```\xa0x\xa0```\x85", "a```{}```", "```\n```json x``` ```"]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(sentiment.strip_fence(F.col("c")).alias("a"), by_pattern(F.col("c")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_answers_are_parsed_once(spark):
    answers = spark.createDataFrame([('```json {"1": [{"term": "a", "score": 3}, {"term": "b"}, {"term": "c", "entity_type": "Person"}], "2": [{"term": "d"}, "{bad"], "7": [{"term": "e"}]} ```',)], "content string")
    requested = spark.createDataFrame([(1,), (2,), (3,)], "article_id long")
    own = requested.selectExpr("article_id", "1 AS rank", "'own' AS term", "1.0D AS score", "'word' AS type", "'tfidf' AS source")
    out = features.merge_keywords(features.parse_keyword_answers(answers, requested), own)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 1, "a", 1.0, "concept", "neutral", "llm"), (1, 2, "b", 0.5, "concept", "neutral", "llm"), (1, 3, "c", 0.5, "person", "neutral", "llm"),
        (2, 1, "own", 1.0, "word", "neutral", "tfidf"), (3, 1, "own", 1.0, "word", "neutral", "tfidf")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") == 1 and "get_json_object" not in plan, plan


def test_small_and_large_groups_rank_alike(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CASE WHEN id % 5 = 0 THEN 'a' WHEN id % 501 = 1 THEN NULL ELSE 'b' END AS g", "CAST(id * 7 % 613 AS DOUBLE) AS v", "id % 3 AS w")
    found = {}
    for limit in (0, 1000, 10_000):
        monkeypatch.setattr(ranking, "SMALL_GROUP", limit)
        found[limit] = sorted(tuple(r) for r in ranking.rank_table(df.where("g is not null"), "v", ["g"], "w").select("g", "_value", "_cnt", "_n", "_start", "w").collect())
    assert found[0] == found[1000] == found[10_000] and len(found[0]) > 1000


def test_scores_of_an_event_do_not_travel_back_to_articles(spark):
    rows = [(e, a if a else 1, p, "2024-01-30 00:00:00", a % 4 != 0, None if a % 3 == 0 else a * e, a % 2, None, a % 5 if e > 1 else None, 0.5, 1.0)
            for e in (1, 2) for a in range(12) for p in "xy"]
    names = "event_id long, article_id long, platform string, t string, is_representative boolean, comments_count long, reposts_count long, likes_count long, views_count long, duplicate_weight double, spam_weight double"
    articles = spark.createDataFrame(rows, names).selectExpr("*", "CAST(t AS TIMESTAMP) AS publish_time", "CAST(NULL AS TIMESTAMP) AS observed_at")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    signal = heat.engagement_percentiles(articles, ["event_id"]).groupBy("event_id", "article_id").agg(F.avg("score").alias("s"))
    weight = heat.freshness(F.lit(24.0), 24) / 100 * 0.5
    want = {r.event_id: r.o for r in articles.join(signal, ["event_id", "article_id"]).groupBy("event_id").agg(F.round(F.sum(F.col("s") * weight), 6).alias("o")).collect()}
    out = heat.spread_raw(articles, spark.createDataFrame([], "event_id long, hot_rank int"), at, population=["event_id"])
    assert {r.event_id: round(r.spread_raw, 6) for r in out.collect()} == want and len(want) == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join Inner" in line and "article_id" in line], plan


def test_scores_do_not_count_n_grams_again(spark):
    docs = spark.createDataFrame([(1, ["a"], ["b", "a"]), (2, ["b"], ["c"])], "article_id long, title_tokens array<string>, body_tokens array<string>")
    out = features.tfidf(features.weighted_counts(docs, features.vocabulary(docs, 2)), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "InMemoryTableScan" not in plan, plan
    assert out.count() == 5  # bigrams across the seam of title and body have no weight
