"""Stored visits against a walk over every post, and one post with very many visits."""

import datetime as dt
import random

import pytest

from murmur.operators import runs

SCHEMA = ("observation_id long, article_id long, crawled_at timestamp, content_hash string, http_status int, fetch_status string, fetch_error string, "
          "comments_count long, reposts_count long, likes_count long, views_count long")
T0 = dt.datetime(2026, 7, 1)


def walked(rows, throttle=3600):
    out, last = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        state, metrics = row[3:7], row[7:]
        old = last.get(row[1])
        if old is None or old[1] != state or (old[2] != metrics and (row[2] - old[0]).total_seconds() >= throttle):
            out[row[0]] = old is None or old[1][0] != row[3] or row[3] is None
            last[row[1]] = (row[2], state, metrics)
    return out


def stored(spark, rows):
    got = runs.snapshot_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    out = {r.observation_id: r.content_changed for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed,step", [(1, 400), (2, 3000), (3, 20000)])
def test_stored_rows_equal_a_walk(spark, seed, step):
    rng, rows = random.Random(seed), []
    for article in range(6):
        at = 0
        for _ in range(60):
            at += rng.choice([0, 1, rng.randrange(step), 3600, 900])
            quiet = article % 2
            rows.append((len(rows), article, T0 + dt.timedelta(seconds=at), "a" if quiet and rng.random() < 0.95 else rng.choice("ab"), rng.choice([200, 200, 200, 200, None, 500]) if not quiet else 200,
                         "ok", None, rng.randrange(3), None, 1 if rng.random() < 0.9 else 2, None))
    rng.shuffle(rows)
    assert stored(spark, rows) == walked(rows)


def test_one_post_with_many_visits(spark):
    """A visit a minute for 30,000 minutes without a change of state: one stored row an hour, whatever the number of visits."""
    rows = spark.range(30_000).selectExpr(
        "id AS observation_id", "7L AS article_id", "timestamp_seconds(1782864000 + id * 60) AS crawled_at", "'h' AS content_hash", "200 AS http_status", "'ok' AS fetch_status",
        "CAST(NULL AS STRING) AS fetch_error", "id AS comments_count", "0L AS reposts_count", "0L AS likes_count", "0L AS views_count")
    got = runs.snapshot_rows(rows)
    assert sorted(r.observation_id for r in got.select("observation_id").collect()) == list(range(0, 30_000, 60))
    assert runs.snapshot_rows(rows.limit(0)).collect() == []
