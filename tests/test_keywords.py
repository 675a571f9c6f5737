"""All keyword rows of the smallest tables: scored terms against SQL, filling words against a plain graph rank."""

from collections import defaultdict

from compare import canonical, connect
from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import features
from murmur.plans import features as plan
from murmur.plans.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"
SCORED = f"""WITH {plan._DOC}, {plan._KEYWORD} SELECT article_id, CAST(rank AS INT) AS rank, term, round(s / max(s) OVER (PARTITION BY article_id), 6) AS score, source, type
    FROM top WHERE rank <= 10"""


def graph_rank(words):
    names = sorted({w for w in words if len(w) >= 2})
    links = defaultdict(lambda: defaultdict(int))
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 5]:
            if a != b and len(a) >= 2 and len(b) >= 2:
                links[a][b] += 1
                links[b][a] += 1
    rank = {w: 1.0 / len(set(words)) for w in names}
    for _ in range(10):
        rank = {w: 0.15 + 0.85 * sum(rank[v] * n / sum(links[v].values()) for v, n in links[w].items()) if links[w] else 0.0 for w in names}
    return [w for w in sorted(names, key=lambda w: (-round(rank[w], 9), w)) if rank[w] > 0][:20]


def test_all_keyword_rows(spark):
    rows = QUERIES["F5_article_keywords"](spark, FOLDER).collect()
    scored = sorted(tuple(map(canonical, r)) for r in rows if r.source != "textrank")
    assert scored == sorted(tuple(map(canonical, r)) for r in connect(FOLDER).sql(SCORED).fetchall())
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        lists[r.article_id].append(r)
    tokens = {r.article_id: r.w for r in plan.docs(Tables(spark, FOLDER)).select("article_id", F.concat("title_tokens", "body_tokens").alias("w")).collect()}
    assert lists.keys() <= tokens.keys()
    for article, words in tokens.items():
        own = lists[article]
        have = [r.term for r in own if r.source != "textrank"]
        room = 10 - len(have)
        fill = [w for w in graph_rank(words) if w not in have and w not in tx.TEMPLATE_TERMS and not w.replace(".", "", 1).isdigit()][: max(0, room)]
        assert [r.term for r in own] == have + fill


def test_served_keywords_pass_nothing_through_the_driver(spark):
    from murmur.plans import catalog

    plan = catalog.QUERIES["F8_served_event_keywords"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" in plan


def test_gram_counts_do_not_depend_on_the_runs_they_are_counted_in(monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    from murmur.operators import features

    rnd = random.Random(9)
    rows = [(i, [rnd.choice("abc") for _ in range(rnd.randint(0, 4))], [rnd.choice("abcd") for _ in range(rnd.choice((0, 1, 3, 60)))]) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"article_id": [r[0] for r in rows], "title_tokens": pa.array([r[1] for r in rows], pa.list_(pa.string())),
                                        "body_tokens": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    grams = lambda x: Counter(x) + Counter(f"{a} {b}" for a, b in zip(x, x[1:]))
    want = {(i, term): (grams(a)[term], grams(b)[term], n) for i, a, b in rows for term, n in grams(a + b).items()}
    cut = features._slices
    for tokens in (1, 40, 10_000):
        monkeypatch.setattr(features, "_slices", lambda b, t=tokens: cut(b, t))
        got = [r for part in features._count_batches([batch]) for r in part.to_pylist()]
        assert len(got) == len(want) and {(r["article_id"], r["term"]): (r["title_n"], r["body_n"], r["joint_n"]) for r in got} == want
        known = [r for part in features._count_batches([batch], ["a", "b c", "zz"]) for r in part.to_pylist()]
        assert {(r["article_id"], r["term"]) for r in known} == {k for k in want if k[1] in ("a", "b c")}
        totals = Counter()
        for part in features._total_batches([batch]):
            for r in part.to_pylist():
                totals[r["term"]] += complex(r["count"], r["df"])
        assert totals == {t: complex(sum(v[2] for k, v in want.items() if k[1] == t), sum(k[1] == t for k in want)) for t in {k[1] for k in want}}
    assert max(b.num_rows for b in cut(batch, 40)) < 50


def test_text_rules_are_not_moved_to_the_scores(spark, capsys):
    scores = spark.createDataFrame([(1, "word", 0.5), (2, "word", 0.7), (2, " two  words ", 0.1), (3, "1", 0.2)], "article_id long, term string, score double")
    got = features._lexical(scores)
    assert sorted((r.article_id, r.term, r.score) for r in got.collect()) == [(1, "word", 0.5), (2, "two words", 0.1), (2, "word", 0.7)]
    capsys.readouterr()
    got.explain("extended")
    plan = capsys.readouterr().out.lower()
    assert "regexp" not in plan and "rlike" not in plan
