"""Candidates against all pairs, and clusters of small runs with known outcomes."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from murmur.config import AggregationConfig
from murmur.operators import clustering, events
from murmur.operators.features import norm, normalized

T0 = dt.datetime(2026, 7, 11, 12)
SCHEMA = ("run_id long, article_id long, effective_time timestamp, topic_category string, keywords array<string>, entities map<string,array<string>>, "
          "bge_vector array<double>, tfidf_vector array<double>")
ONLY_TFIDF = dict(create_threshold=0.40, bge_weight=0.0, tfidf_weight=1.0, entity_weight=0.0, time_weight=0.0)


def doc(i, hours, vector, location="重庆", keywords=("暴雨", "救援"), run=1, topic="自然灾害"):
    when = None if hours is None else T0 + dt.timedelta(hours=hours)
    return (run, i, when, topic, None if keywords is None else list(keywords), {"location": [location]} if location else {}, vector, vector)


def clustered(spark, rows, **cfg):
    got = clustering.cluster_runs(spark.createDataFrame(rows, SCHEMA), AggregationConfig(**cfg)).collect()
    assert len(got) == len(rows)
    return {(r.run_id, r.article_id): r for r in got}


def groups(got, run):
    found = {}
    for (of, i), r in got.items():
        if of == run and r.cluster_index is not None:
            found.setdefault(r.cluster_index, []).append(i)
    return [sorted(found[k]) for k in sorted(found)]


@pytest.mark.parametrize("turned", [1, -1])
def test_ambiguous_and_moving_documents(spark, turned):
    """Runs 1 and 2: a document between the thresholds is heard again when all clusters stand. Run 3: it founds and says so.
    Run 4: an attached document moves for a clear improvement, run 5: not for a small one. Input order does not matter."""
    x, y, d = [1.0, 0.0], [0.0, 1.0], [0.6, 0.8]
    rows = [doc(1, 0, x, ""), doc(2, 1, d, ""), doc(3, 2, y, "")]
    rows += [doc(1, 0, x, "", run=2), doc(2, 1, d, "", run=2), doc(3, 2, d, "", run=2)]
    rows += [doc(1, 0, x, "", run=3), doc(2, 1, d, "", run=3)]
    rows += [doc(1, 0, x, run=4), doc(2, 1, [0.8, 0.6], "", run=4), doc(3, 2, [0.8, 0.6], "广东", run=4)]
    rows += [doc(1, 0, x, run=5), doc(2, 1, [0.95, (1 - 0.95**2) ** 0.5], "", run=5), doc(3, 2, [0.95, (1 - 0.95**2) ** 0.5], "广东", run=5)]
    got = clustered(spark, rows[::turned], attach_threshold=0.79, move_margin=0.10, **ONLY_TFIDF)
    assert groups(got, 1) == [[1], [2, 3]] and [(got[1, i].first_action, got[1, i].action) for i in (1, 2, 3)] == [("create", "create"), ("ambiguous", "attach"), ("create", "create")]
    assert groups(got, 2) == [[1], [2, 3]]
    assert groups(got, 3) == [[1], [2]] and got[3, 2].reasons == ["AMBIGUOUS_AFTER_REFINEMENT"] and got[3, 2].first_action == "ambiguous"
    assert groups(got, 4) == [[1], [2, 3]] and (got[4, 2].first_action, got[4, 2].action) == ("attach", "moved")
    assert got[4, 2].similarity >= 1.0 and got[4, 2].reasons == ["MOVE_MARGIN_MET"]
    assert groups(got, 5) == [[1, 2], [3]] and got[5, 2].action == "attach"


@pytest.mark.parametrize("longest", [256, 3])
def test_runs_with_known_clusters(spark, monkeypatch, longest):
    """Run 1: the same event attaches. Run 2: places stay apart. Run 3: the founder knows no place; the cluster is bound by
    the earliest member that does, and those who leave stay together. Run 4: no evidence. Run 5: equal documents meet
    wherever they stand, with all others of the run between them under the same keyword."""
    monkeypatch.setattr(clustering, "LONG_LIST", longest)
    x, rng = [1.0, 0.0], random.Random(1)
    rows = [doc(2, 1, [0.99, 0.01]), doc(1, 0, x), doc(1, 0, x, run=2), doc(2, 1, x, "广东", run=2)]
    rows += [doc(1, 0, x, "", run=3), doc(2, 1, x, "重庆", run=3), *[doc(i, i, x, "广东", run=3) for i in (3, 4, 5)]]
    rows += [doc(1, 0, None, "", None, run=4), doc(2, None, None, "", ("", " "), run=4), doc(3, 0, None, "", ("k",), run=4)]
    vectors = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(60)]
    vectors[59], vectors[55] = vectors[0], vectors[40]
    rows += [doc(i, i, v, "", ("k",), run=5) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    got = clustered(spark, rows)
    assert {i: (got[1, i].cluster_index, got[1, i].action) for i in (1, 2)} == {1: (0, "create"), 2: (0, "attach")}
    assert [got[2, i].action for i in (1, 2)] == ["create", "create"] and "LOCATION_CONFLICT" in got[2, 2].reasons
    assert groups(got, 3) == [[1, 2], [3, 4, 5]]
    assert [(got[4, i].cluster_index, got[4, i].action) for i in (1, 2, 3)] == [(None, "deferred")] * 2 + [(0, "create")] and got[4, 1].reasons == ["INSUFFICIENT_EVIDENCE"]
    assert got[5, 59].cluster_index == got[5, 0].cluster_index == 0 and got[5, 55].cluster_index == got[5, 40].cluster_index


def all_pairs(docs, clusters, limit):
    out = {}
    for run, article, topic, words in docs:
        own = {w.strip().lower() for w in words or [] if w.strip()}
        scored = []
        for their_run, index, their_topic, their_words in clusters:
            if their_run == run:
                theirs = {w.strip().lower() for w in their_words or [] if w.strip()}
                overlap = len(own & theirs) / len(own | theirs) if own and theirs else 0.0
                scored.append((-(float(bool(topic) and topic == their_topic) + overlap), index))
        out[run, article] = [(i, round(-s, 9)) for s, i in sorted(scored)[:limit]]
    return out


@pytest.mark.parametrize("longest", [256, 5, 0])
def test_candidates_equal_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(clustering, "LONG_LIST", longest)
    rng = random.Random(longest)
    words = lambda: rng.choice([None, [], [" "], rng.sample([f"w{i}" for i in range(40)] + ["hot", "HOT ", "warm"] * 6, rng.randint(1, 7))])
    topic = lambda: rng.choice([None, "", "a", "a", "b"])
    docs = [(run, i, topic(), words()) for run in (1, 2) for i in range(60)] + [(3, 1, "a", ["x"])]
    clusters = [(run, i, topic(), words()) for run in (1, 2) for i in range(90 if run == 1 else 7)] + [(4, 0, "a", ["x"])]
    got = clustering.rank_candidates(
        spark.createDataFrame(docs, "run_id long, article_id long, topic_category string, keywords array<string>"),
        spark.createDataFrame(clusters, "run_id long, cluster_index long, topic_category string, keywords array<string>"), AggregationConfig(candidate_limit=6))
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault((r.run_id, r.article_id), []).append((r.cluster_index, round(r.candidate_score, 9)))
    assert found == {k: v for k, v in all_pairs(docs, clusters, 6).items() if v}


def test_long_lists_make_no_product(spark, monkeypatch):
    """2,000 documents and as many clusters of one run under one keyword: candidates stay in proportion to the documents."""
    monkeypatch.setattr(clustering, "LONG_LIST", 50)
    rows = spark.range(2000).selectExpr("1L AS run_id", "id AS article_id", "id AS cluster_index", "'t' AS topic_category", "array('hot', concat('own', id)) AS keywords")
    got = clustering.rank_candidates(rows, rows)
    assert got.count() == 40_000
    best = {r.article_id: r.cluster_index for r in got.where("rank = 1").collect()}
    assert all(k == v for k, v in best.items())
    assert got.where(F.col("rank") == 2).select("cluster_index").distinct().count() == 2


def folds(df):
    """How often the plan of `df` adds up an array: every dot product, norm and mean is one."""
    return len(re.findall(r"\baggregate\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_a_signal_is_computed_once_per_pair(spark, monkeypatch):
    """A formula put in place of a column is computed once per use, and a norm inside a function of components once per
    component: pairs hold two cosines and a mean, documents two norms, centres no more than a cosine and two norms a vector."""
    assert folds(spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(normalized(F.col("v")).alias("unit"))) == 1
    rows = [doc(i, i, [1.0, i / 10], "重庆" if i % 2 else "广东") for i in range(6)]
    live, _ = clustering._with_evidence(spark.createDataFrame(rows, SCHEMA), AggregationConfig())
    written, cut = [], clustering.cut_lineage
    monkeypatch.setattr(clustering, "cut_lineage", lambda df: (written.append(folds(df)), cut(df))[1])
    clustering._document_pairs(live, AggregationConfig())
    assert sum(written) <= 5
    placed = live.select("run_id", "at", F.lit(0).cast("long").alias("cluster"))
    assert folds(clustering._against(live, placed, placed.withColumn("inside", F.lit(True)), AggregationConfig())) <= 8


def test_entity_signals_of_folded_maps(spark):
    rng = random.Random(3)
    words = lambda: rng.choice([None, [], [" "], [None, "a"], *[rng.sample(["a", "A ", "b", " B", "c", "D", ""], rng.randint(1, 5)) for _ in range(6)]])
    entities = lambda: rng.choice([None, {}, *[{k: words() for k in rng.sample(["location", "case", "organization", "topic", "mention"], rng.randint(1, 5))} for _ in range(8)]])
    kind = "map<string,array<string>>"
    pairs = spark.createDataFrame([(i, entities(), entities()) for i in range(400)], f"id long, a {kind}, b {kind}")
    known = pairs.withColumns({"ka": events.known_entities(F.col("a")), "kb": events.known_entities(F.col("b"))})
    got = events.with_entity_signals(known, "ka", "kb").select(
        "entity", "clash", events.entity_similarity(F.col("a"), F.col("b")).alias("e"), events.conflicts(F.col("a"), F.col("b")).alias("c")).collect()
    assert len(got) == 400 and all(r.entity == r.e and r.clash == r.c for r in got)
    assert {len(r.c) for r in got} > {0, 1} and any(r.e for r in got)


def test_cosine_with_known_norms(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([1.0], None), (None, None)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(
        events.cosine(a, b).alias("plain"), events.cosine(a, b, norm(a) * norm(b)).alias("known")).collect()
    assert [r.plain for r in got] == [pytest.approx(0.8), 0.0] + [None] * 6 and all(r.plain == r.known for r in got)
