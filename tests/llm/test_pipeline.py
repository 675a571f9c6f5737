"""The pipeline against brute force, stage by stage, and its registration."""

from pyspark.sql import functions as F

import corpus_pipeline
from llm import helpers as h
from murmur.llm import language
from murmur.llm.queries import tokenizer_text
from murmur.llm.shared import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    profiles = language.learn(docs)
    now = {r.doc_id: r for r in docs.collect()}
    assert len(now) == docs.count()
    states = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-stage")
        states.append({r.doc_id: r for r in docs.collect()})
        assert len(states[-1]) == docs.count()
    judged = {i: profiles.judge(r.text) for i, r in now.items()}
    assert set(states[0]) == {i for i, (lang, score) in judged.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    rows = [(i, r.text) for i, r in sorted(states[0].items())]
    assert set(states[1]) == {i for (i, t), (c, _) in zip(rows, h.jaccard_classes(rows)) if c == i or not h.words(t)}
    rows = [(i, r.text) for i, r in sorted(states[1].items())]
    cut = h.later_windows(rows, 20)
    want = {i: t if not cut[i, t][1] else cut[i, t][2] for i, t in rows if not cut[i, t][1] or cut[i, t][2]}
    assert {i: r.text for i, r in states[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in states[2].values())
    assert set(states[3]) == {i for i, t in want.items() if not h.hits(t, items)[1]}
    lib = Tokenizer.from_str(tokenizer_text())
    for i, r in states[4].items():
        assert r.ids == lib.encode(r.text, add_special_tokens=False).ids
    assert set(states[4]) == set(states[3]) and len(states[3]) > 100
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(next(iter(s.values())).__fields__) == names for s in states[:4])


def test_stages_take_awkward_rows(spark):
    rows = [(i, t, None, None, None) for i, t in h.corpus(n=12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taught = docs.withColumn("lang", F.when(F.col("doc_id") < 30, "xx"))
    for frame in (taught, docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, FOLDER), "test-stage")
        assert frame.columns == [*docs.columns, "ids", "decoded"]
