"""Two-key dedup against a walk in row order, and a long alternating chain in few rounds."""

import random

import pytest

from murmur.operators import dedup

SCHEMA = "at long, platform string, source_url string, source_article_id string"


def walked(rows):
    urls, ids, kept = set(), set(), []
    for at, platform, url, own in sorted(rows):
        u, s = (url or "").strip().lower(), (platform, own) if own else None
        if u not in urls and s not in ids:
            kept.append(at)
            urls.add(u)
            if s:
                ids.add(s)
    return kept


@pytest.mark.parametrize("urls,ids", [(12, 9), (60, 4), (3, 80)])
def test_rows_equal_a_walk_in_order(spark, urls, ids):
    rng = random.Random(urls)
    rows = [(i, rng.choice("ab"), rng.choice([None, " ", f"U{rng.randrange(urls)} ", f"u{rng.randrange(urls)}"]), rng.choice([None, "", str(rng.randrange(ids))])) for i in range(400)]
    rng.shuffle(rows)
    got = dedup.two_key_dedup(spark.createDataFrame(rows, SCHEMA), "at")
    assert got.columns == ["at", "platform", "source_url", "source_article_id"]
    assert sorted(r["at"] for r in got.collect()) == walked(rows)
    assert dedup.two_key_dedup(spark.createDataFrame([], SCHEMA), "at").collect() == []


def test_a_long_alternating_chain_takes_few_rounds(spark, monkeypatch):
    """Every row shares its address with the row before and its source id with the row behind: every second one stays."""
    n, cuts = 20_000, []
    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    rows = spark.range(n).selectExpr("id AS at", "'p' AS platform", "concat('u', floor(id / 2)) AS source_url", "concat('s', floor((id + 1) / 2)) AS source_article_id")
    got = dedup.two_key_dedup(rows, "at")
    assert got.count() == n // 2 and got.where("at % 2 = 1").isEmpty()
    assert len(cuts) < 40


def test_title_keys_miss_no_pair_and_do_not_meet_on_empty_parts(spark):
    from itertools import combinations
    import random

    from pyspark.sql import functions as F

    from murmur.operators import dedup

    rnd, words = random.Random(3), [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    sets = [set(rnd.sample(words, rnd.randint(8, 79))) for _ in range(400)]
    for s in sets[:200]:  # near copies at and around the threshold
        copy = set(s) - set(rnd.sample(sorted(s), rnd.randint(0, max(1, len(s) // 12))))
        sets.append(copy | set(rnd.sample(words, rnd.randint(0, max(1, len(s) // 14)))))
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(sets), 2) if len(a & b) / len(a | b) >= dedup.TITLE_OVERLAP}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "title_key long, features array<string>")
    got = {(r.a, r.b) for r in dedup.similar_titles(df).collect()}
    assert got == want and len(want) > 60
    met = dedup._part_keys(df).groupBy("_sig").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert met <= 4  # an empty part used to bring a share of all sets together
