"""Each corpus operator against brute force, a round trip, or held-out accuracy, on small awkward tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm import helpers as h
from murmur.llm import anchored, bloom_lm, bpe, decontaminate, jaccard, language, phrases, sharding, suffix_repeats, url_filter, winnow
from murmur.llm.queries import URL_RULES, tokenizer_text

DOCS = h.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return h.frame(spark, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return h.frame(spark, [])


# --- 1 URL filter

URLS = [
    "http://Sub.Example.ORG/es/x?q=1", "https://example.org/en/1234", "https://example.org/en/2", "http://notexample.org/es/", "x://a.com/de/1",
    "x://com/de/", "x://fr.com/fr", "x://fr.com/fr/", "x://example.org", "//example.org/es/", "nothing", "", None, "x://#/de/", "a://b.org/?://c.com/de/",
    "a://..org/x", "a://example.org:80/es/", "http://example.org/es/\nx", "http://example.org/es/",
]


def by_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(h.LOW), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in URL_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path) and (host or path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [url_filter.BROADCAST_RULES, 0])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS + URLS[:2])], "page_id int, url string, rule string")
    got = url_filter.judge(rows, URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert [tuple(r)[2:] for r in sorted(got.collect())] == [by_rule(u) for u in URLS + URLS[:2]]
    assert url_filter.judge(rows.limit(0), URL_RULES).collect() == []


def test_deeper_host_wins_over_longer_path():
    trie = url_filter.RuleTrie([url_filter.Rule("b.c/", "allow"), url_filter.Rule("c/very/long/path", "block"), url_filter.Rule("b.c/", "block")])
    assert trie.find("a.b.c", "/very/long/path").verdict == "block" and trie.find("a.b.c", "/very/long/path").host == "b.c"
    assert trie.find("x.c", "/very/long/pathway").path == "/very/long/path"


# --- 2 BPE

def test_bpe_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    definition, rng = tokenizer_text(), random.Random(3)
    lib = Tokenizer.from_str(definition)
    pools = ["abcdeiorst", "AÉßñΣσİ ", "中文かな😀", "'s't 've", "01²", "\x1c\x85\u00a0\u0301 \n", "Ᲊ<|endoftext|>", "!?-—"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>" * 2 + "a<|startoftext|>b", "th" * 2000, "the " * 3000, "", None, "", "ΑΣ ΑΣΑ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3).withColumn("ids", F.lit("clash"))
    got = bpe.decode_documents(bpe.encode_documents(rows, definition), definition).collect()
    assert len(got) == len(texts)
    for row in got:
        want = lib.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want, row.text
        assert row.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(rows.limit(0), definition).collect() == []


# --- 3 language

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.learn(docs.where(language.remainder(F.col("doc_id"), 4) != 2))
    held = language.identify(docs.where(language.remainder(F.col("doc_id"), 4) == 2), learned, score="n_chars").collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.n_chars <= 1 for r in held)


def test_language_edges(spark, docs, none):
    learned = language.RankProfiles({"b": language.ranked(*language.gram_counts("aa ab")), "a": language.ranked(*language.gram_counts("aa ab"))})
    rows = spark.createDataFrame([(1, "aa ab"), (2, None), (3, "12 --"), (4, ""), (4, "")], "doc_id int, text string")
    assert [(r.doc_id, r.lang_pred, r.score) for r in sorted(language.identify(rows, learned).collect())] == [
        (1, "a", 1.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (4, "und", 0.0)
    ]
    nothing = language.learn(none.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_long_text_is_counted_like_its_grams(monkeypatch):
    text = "aber das ist ein langer text " * 40
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_PIECE", 37)
    for a, b in zip(whole, language.gram_counts(text)):
        assert (a == b).all()


# --- 4 suffix-array dedup

@pytest.mark.parametrize("anchors,variants", [(4_000_000, 4096), (0, 4096), (4_000_000, 0)])
def test_repeated_bytes(docs, monkeypatch, anchors, variants):
    monkeypatch.setattr(anchored, "BROADCAST_ANCHORS", anchors)
    monkeypatch.setattr(anchored, "MOST_VARIANTS", variants)
    want = Counter((d[0], n, tuple(spans), kept) for d, (n, spans, kept) in zip(DOCS, h.repeated_bytes(DOCS, 200)))
    got = suffix_repeats.remove_repeats(docs.withColumn("kept", F.lit(1))).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s["from"], s["to"]) for s in r.removed), bytes(r.kept)) for r in got) == want


def test_repeat_groups_are_maximal_and_complete(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    long, short = noise(260), noise(230)
    rows = [(1, "x" + long + noise(50)), (2, noise(70) + "y" + long + "q"), (3, short + noise(9)), (4, noise(99) + short), (5, short), (6, noise(400))]
    found = {}
    for r in suffix_repeats.repeat_groups(h.frame(spark, rows)).collect():
        found.setdefault((r.group, r.length), set()).add((r.node, r["at"]))
    texts = {hashlib.sha256(t.encode()).hexdigest()[:32]: t for _, t in rows}
    for (_, length), places in found.items():
        assert len({texts[n][at : at + length] for n, at in places}) == 1 and length >= 200
    starts = {frozenset((texts[n].startswith("x"), at) for n, at in p) for p in found.values() if len(p) == 2}
    assert frozenset({(True, 1), (False, 71)}) in starts  # the one place where the long repeat begins, seen from both texts
    assert {frozenset(at for _, at in p) for p in found.values() if len(p) == 3} == {frozenset({0, 99})}
    assert len(found) == 2  # shifted copies of a longer repeat are no groups


def test_interval_tree():
    assert sorted(suffix_repeats.interval_tree([3, 5, 5, 2, 7])) == sorted([(1, 3, 5), (0, 3, 3), (4, 5, 7), (0, 5, 2)])
    assert list(suffix_repeats.interval_tree([])) == []


# --- 5 Jaccard join

@pytest.mark.parametrize("sent,block", [(500_000, 256), (0, 2)])
def test_jaccard_classes_and_links(docs, monkeypatch, sent, block):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    want = Counter((d[0], d[1], *x) for d, x in zip(DOCS, h.jaccard_classes(DOCS)))
    got = jaccard.near_duplicates(docs)
    keys = {jaccard_key(t): t for _, t in DOCS if t is not None} | {jaccard_key(""): None}
    found = Counter((r.doc_id, keys[r.node], r.class_id, r.n_links) for r in got.collect())
    assert Counter({(a, b or None, c, d): n for (a, b, c, d), n in want.items()}) == Counter({(a, b or None, c, d): n for (a, b, c, d), n in found.items()})
    kept = jaccard.keep_one(docs).collect()
    classes = {c for (_, c0), (c, _) in zip(DOCS, h.jaccard_classes(DOCS)) if h.words(c0)}
    assert sorted(r.doc_id for r in kept if h.words(r.text)) == sorted(c for c in classes)
    assert sum(not h.words(r.text) for r in kept) == sum(not h.words(t) for _, t in DOCS)


def jaccard_key(text):
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def test_matched_depth_shortens_until_the_recall():
    assert jaccard.matched_depth(0.8) == 5 and jaccard.matched_depth(0.99) == 8 and jaccard.matched_depth(0.1, recall=0.999) == 1
    assert 1 - (1 - 0.8**5) ** jaccard.TREES >= jaccard.RECALL


# --- 6 substring dedup

@pytest.mark.parametrize("anchors,variants", [(4_000_000, 4096), (0, 4096), (4_000_000, 0)])
def test_later_windows_go(docs, monkeypatch, anchors, variants):
    monkeypatch.setattr(anchored, "BROADCAST_ANCHORS", anchors)
    monkeypatch.setattr(anchored, "MOST_VARIANTS", variants)
    want = h.later_windows(DOCS, 20)
    got = phrases.remove_later_copies(docs.withColumn("kept", F.lit(1))).withColumn("lost", phrases.removed_units("removed")).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.n_words, r.lost, r.kept) == want[r.doc_id, r.text], r.doc_id


def test_clean_texts_leaves_clean_rows(docs):
    want = h.later_windows(DOCS, 20)
    got = Counter((r.doc_id, r.text) for r in phrases.clean_texts(docs).collect())
    assert got == Counter((i, t if not want[i, t][1] else want[i, t][2]) for i, t in DOCS if not want[i, t][1] or want[i, t][2])


# --- 7 sharding

def test_shards_are_exact_and_complete(spark, docs):
    got = sharding.shuffle_into_shards(docs.withColumn("slot", F.lit("own")), 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(DOCS)
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle_into_shards(docs.limit(0), 4).collect() == []


def test_ranges_of_a_shard_join_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    rows = spark.range(1000, numPartitions=7).withColumn("x", F.lit(None).cast("string"))
    got = sharding.shuffle_into_shards(rows, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(334 if s == 0 else 333)]
    assert len({r.id for r in got}) == 1000 and [r.id for r in got[:20]] != list(range(20))
    # a uniform shuffle leaves no trace of the place: ids of a shard spread like all ids
    assert abs(np.mean([r.id for r in got if r.shard == 1]) - 499.5) < 60


def test_communication_matrix():
    counts = sharding.communication_matrix([5, 0, 17, 100, 1], 7, seed=1)
    assert counts.sum(axis=1).tolist() == [5, 0, 17, 100, 1] and counts.sum(axis=0).tolist() == [18, 18, 18, 18, 17, 17, 17]
    draws = [sharding._hypergeometric(np.random.default_rng(s), 1_500_000_000, 500_000_000, 40) for s in range(300)]
    assert abs(np.mean(draws) - 30) < 0.6 and max(draws) <= 40
    mean = np.mean([sharding.communication_matrix([30, 70], 2, seed=s)[0, 0] for s in range(400)])
    assert abs(mean - 15) < 0.5


# --- 8 fingerprints

def spark_hash(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def winnowed(text):
    import re

    tokens = re.findall(r"\S{1,16}", text or "", re.ASCII)
    runs, n = [spark_hash(t) for t in tokens], 1
    while n < winnow.GRAM and len(tokens) >= winnow.GRAM:
        runs, n = [spark_hash(a, b) for a, b in zip(runs, runs[n:])], 2 * n
    if 0 < len(tokens) < winnow.GRAM:
        runs = [spark_hash(" ".join(tokens))]
    top = [(r % (1 << 64)) >> 33 for r in runs]
    picks = []
    for i in range(max(1, len(runs) - winnow.WINDOW + 1)) if runs else ():
        window = range(i, min(i + winnow.WINDOW, len(runs)))
        at = max(window, key=lambda j: (-top[j], j))
        if at not in picks:
            picks.append(at)
    return [(runs[p], p) for p in picks]


def test_fingerprints_and_next_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 8)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(7).alias("extra"))
    got = winnow.with_next(rows, "doc_id", "text").collect()
    assert len(got) == len(DOCS) and got[0].extra == 7
    for r in got:
        assert [tuple(p) for p in r._print] == winnowed(r.text)
        assert [tuple(p) for p in r._next_print] == winnowed(r._next)
    ordered = sorted(got, key=lambda r: h.order(r.doc_id))
    unique = [r for r in ordered if sum(x.doc_id == r.doc_id for x in got) == 1]
    at = {id(r): i for i, r in enumerate(ordered)}
    for r in unique:
        follower = ordered[(at[id(r)] + 1) % len(ordered)]
        if follower in unique:
            assert r._next == follower.text
    assert winnow.with_next(rows.limit(0), "doc_id", "text").collect() == []
    single = winnow.with_next(rows.where("doc_id = 704"), "doc_id", "text").first()
    assert single._next == single.text


def test_edited_text_and_likeness(spark):
    one = spark.createDataFrame([("abcdé", "xyz"), ("", "x"), ("ab", "")], "a string, b string")
    assert [r[0] for r in one.select(winnow.edited(F.col("a"), F.col("b"))).collect()] == ["abcxy", "", "a"]
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(text, text), (text, text[:500] + " z" * 100), (text, ""), ("", "")], "a string, b string")
    near = [r[0] for r in rows.select(winnow.likeness(winnow.fingerprint(F.col("a")), winnow.fingerprint(F.col("b")))).collect()]
    assert near[0] == 1.0 and 0.2 < near[1] < 0.9 and near[2] == 0.0 and near[3] == 1.0


# --- 9 decontamination

@pytest.mark.parametrize("most", [300_000, -1])
def test_hits_of_benchmark_windows(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    monkeypatch.setattr(decontaminate, "BROADCAST_STARTS", most)
    own = sorted(w for _, t in DOCS for w in h.words(t))
    items = [(1, " ".join(h.words(DOCS[3][1])[2:30])), (12, own[5]), (2, "No such words at all"), (3, None), (4, ""), (5, "b"), (7, "a"), (7, "a")]
    items += [(10 + i, t) for i, (_, t) in enumerate(DOCS[5:12])] + [(5, (DOCS[20][1] or "x y").upper().replace(" ", "--"))]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("n_words", F.lit(1))
    got = decontaminate.decontaminate(docs.withColumn("hits", F.lit("own")), bench).collect()
    assert Counter((r.doc_id, r.n_words, tuple(r.hits), tuple(r["items"])) for r in got) == Counter(
        (i, n, tuple(p), tuple(f)) for i, (n, p, f) in ((i, h.hits(t, items)) for i, t in DOCS)
    )
    clean = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.hits for r in clean)
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == []


def test_proximity_match(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"x {phrase} y"), (2, phrase.replace("delta", "delta oh")), (3, phrase.replace("delta ", ""))]
    bench = spark.createDataFrame([(1, phrase)], "item_id int, text string")
    found = lambda slop: {r.doc_id for r in decontaminate.decontaminate(h.frame(spark, rows), bench, slop=slop).collect() if r.hits}
    assert found(0) == {1} and found(2) == {1, 2}


# --- 10 LM scoring

@pytest.mark.parametrize("most,frequent", [(384 << 20, 500_000), (-1, 5)])
def test_scores(docs, monkeypatch, most, frequent):
    monkeypatch.setattr(bloom_lm, "MOST_FILTER_BYTES", most)
    monkeypatch.setattr(bloom_lm, "FREQUENT", frequent)
    training = [t for i, t in DOCS if i is not None and i % 2 == 0]
    tokens = lambda t: [w.translate(h.LOW) for w in h.words(t)] + ["\n"]
    counts = Counter(w for t in training for w in tokens(t))
    pairs = Counter(p for t in training for p in zip(["", *tokens(t)], tokens(t)))
    heads = Counter(w for t in training for w in ["", *tokens(t)])
    n, width = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    level = lambda c: int(math.log2(c)) + 1 if c else 0
    middle = lambda c: 1.5 * 2 ** (level(c) - 1) - 0.5 if c else 0.0

    def model(t):
        total = 0.0
        for a, b in zip(["", *tokens(t)], tokens(t)):
            weight = bloom_lm.WEIGHT if heads[a] else 0.0
            follows = min(1.0, middle(pairs[a, b]) / middle(heads[a])) if heads[a] else 0.0
            total += math.log10(weight * follows + (1 - weight) * (middle(counts[b]) + 1) / width)
        return total

    got = bloom_lm.score(docs.withColumn("score", F.lit("x")).drop("score"), docs.where("doc_id % 2 = 0"), ["doc_id"]).collect()
    known = {}
    for i, t in DOCS:
        known.setdefault(i, []).append((len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / width) for w in tokens(t)), model(t)))
    assert len(got) == len(DOCS)
    for r in got:
        assert r.train_tokens == n
        assert any(
            (r.n_tokens, r.n_known) == w[:2] and abs(r.base_score - w[2]) < 1e-6 * max(1, abs(w[2]))
            and (abs(r.score - w[3]) < 1e-6 * max(1, abs(w[3])) if most < 0 else abs(r.score - w[3]) < 0.05 * abs(w[3]) + 0.5) for w in known[r.doc_id]
        ), r


def test_scores_do_not_depend_on_the_filter_limit(docs, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BLOCK_GRAMS", 50)
    def scores(most):
        monkeypatch.setattr(bloom_lm, "MOST_FILTER_BYTES", most)
        few = docs.where("doc_id in (12, 48)")  # far more grams ask than were learned, so blocks are met in parts
        return sorted((r.doc_id or -1, r.n_tokens, round(r.score, 9)) for r in bloom_lm.score(docs, few, ["doc_id"]).collect())
    broadcast, shuffled, exact = scores(384 << 20), scores(0), scores(-1)
    assert shuffled == broadcast
    assert exact != broadcast  # false positives are there to be kept


def test_training_rows_by_condition_or_apart(docs, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BLOCK_GRAMS", 50)
    monkeypatch.setattr(bloom_lm, "CHUNK_BYTES", 5_000)
    def scores(training, most):
        monkeypatch.setattr(bloom_lm, "MOST_FILTER_BYTES", most)
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9)) for r in bloom_lm.score(docs, training, ["doc_id"]).collect())
    broadcast = scores(docs.where("doc_id % 2 = 0"), 384 << 20)
    assert broadcast == scores(F.expr("doc_id % 2 = 0"), 0) == scores(docs.where("doc_id % 2 = 0"), 0) == scores(F.expr("doc_id % 2 = 0"), 384 << 20)


def test_a_gram_is_asked_once_for_all_texts_of_a_chunk(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(i, True, text) for i in range(300)], "doc_id long, _learns boolean, _text string").coalesce(1)
    chunks = bloom_lm._chunks(rows)
    assert chunks.count() == 1
    got = bloom_lm._answers(chunks, None, 3).collect()
    assert sum(len(r.levels) for r in got) == 201 + 202  # pairs; words, the end and the start
    assert all(set(r.levels) <= {9, 10} for r in got)  # 300 counts each, a false positive apart


def test_scores_without_training(docs, none):
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in bloom_lm.score(docs, none, ["doc_id"]).collect()} == {(0.0, 0.0, 0, 0)}
    assert bloom_lm.score(none, docs, ["doc_id"]).collect() == []


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    grams, counts = rng.integers(0, 1 << 63, 20_000, np.uint64), rng.integers(1, 300, 20_000)
    block = bloom_lm._block(grams, 3)
    f = bloom_lm.LogFrequencyFilter([bloom_lm.build_block(grams[block == b], counts[block == b]) for b in range(3)])
    assert (f.level(grams) >= bloom_lm._levels(counts)).all()
    assert (f.level(grams) > bloom_lm._levels(counts)).mean() < 0.03
    assert (f.level(rng.integers(0, 1 << 63, 20_000, np.uint64)) > 0).mean() < 0.03
    assert bloom_lm.LogFrequencyFilter([b""]).level(grams[:5]).tolist() == [0] * 5
