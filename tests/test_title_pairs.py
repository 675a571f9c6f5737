"""Near-copy search moves neither false title pairs nor the variants of one title."""

import random

from pyspark.sql import functions as F

from murmur.operators import dedup


def frame(spark, titles, sims):
    rows = [(i, f"body {i}", sim, title) for i, (title, sim) in enumerate(zip(titles, sims))]
    df = spark.createDataFrame(rows, "article_id long, content_hash string, sim long, title string")
    df = df.withColumn("features", F.array_sort(dedup.title_features(F.col("title")))).withColumn("title_length", F.length("title"))
    return df.withColumn("title_key", F.md5(F.array_join("features", "\u0001")))


def bigrams(title):
    flat = "".join(title.lower().split())
    return {flat[i : i + 2] for i in range(len(flat) - 1)}


def data():
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(6)]
    titles, sims = [], []
    for i in range(90):
        title = list(base[i % 6])
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            title[rng.randrange(60)] = rng.choice("xyzw")
        titles.append("".join(title))
        sims.append(rng.choice((0, 0x0F0F0F0F0F, 1 << 40)) ^ sum(1 << rng.randrange(63) for _ in range(rng.choice((0, 1, 2)))))
    return titles, sims


def test_edges_and_reviews_equal_brute_force(spark):
    titles, sims = data()
    sets = [bigrams(t) for t in titles]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85
    near = lambda a, b: (sims[a] ^ sims[b]).bit_count() <= 3
    prints = frame(spark, titles, sims)
    # equal variants are stars around their first row
    first = {}
    want = set()
    for i, (title, sim) in enumerate(zip(titles, sims)):
        key = (frozenset(sets[i]), sim)
        if key in first:
            want.add((i, first[key]))
        first.setdefault(key, i)
    heads = sorted(first.values())
    want |= {(b, a) for a in heads for b in heads if a < b and alike(a, b) and near(a, b)}
    assert {(r.src, r.dst) for r in dedup.duplicate_edges(prints).collect()} == want
    pending = {b for b in range(90) if any(alike(a, b) or near(a, b) for a in range(b))}
    assert {r.article_id for r in dedup.pending_reviews(prints).collect()} == pending


def test_only_distinct_titles_are_cut_into_parts(spark, monkeypatch):
    seen, real = [], dedup._part_keys
    monkeypatch.setattr(dedup, "_part_keys", lambda titles: seen.append(titles.count()) or real(titles))
    got = dedup.duplicate_edges(frame(spark, ["a title that many articles have"] * 60, [1 << i for i in range(60)])).count()
    assert got == 60 * 59 // 2 and seen == [1]


def test_false_title_pairs_are_left_out_inside_the_join(spark, capsys):
    titles = frame(spark, data()[0], data()[1]).groupBy("title_key").agg(F.first("features").alias("features"))
    capsys.readouterr()
    dedup.similar_titles(titles).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    assert "bit_count" in plan and plan.index("Aggregate") < plan.index("bit_count")
