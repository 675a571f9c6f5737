"""Text features in long form: n-gram counts, TF-IDF, article and event keywords, model answers, vectors.

Documents: `(article_id, title_tokens, body_tokens)` plus `entities map<term,type>`, `topics`, `platform`,
`nlp_weight` where keywords need them. The vocabulary never exceeds `max_features` terms, which is what
makes it safe to send to every task."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from murmur.config import FeatureConfig
from murmur.functions import text as tx
from murmur.functions.ranking import top_per_group
from murmur.session import cut_lineage, fence


def ngrams(tokens: Column) -> Column:
    """Unigrams followed by the bigrams of neighbouring tokens."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(tokens, F.array_compact(pairs))


#: Tokens whose n-grams are counted at a time; a longer document is counted by itself.
_TOKENS = 200_000


def _slices(batch: pa.RecordBatch, tokens: int = _TOKENS):
    """The rows of a batch in runs of few tokens: n-grams take many times the memory of their tokens."""
    size = sum(pc.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("title_tokens", "body_tokens"))
    run = np.cumsum(size) // tokens
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(run)) + 1):
        if len(rows):
            yield batch.take(pa.array(rows))


def _row_grams(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all unigrams and bigrams of coded tokens; a bigram is a pair of codes, not yet a text."""
    same = row[1:] == row[:-1]
    return np.concatenate([row, row[1:][same]]), np.concatenate([code, n + code[:-1][same] * n + code[1:][same]])


def _counted(batch: pa.RecordBatch, known: pa.Array | None):
    """(names, row, code, title_n, body_n, joint_n) of the n-grams of a batch.

    Tokens are coded once, n-grams counted as integers; only distinct ones are written out as text."""
    title, body = batch.column("title_tokens"), batch.column("body_tokens")
    coded = pa.concat_arrays([title.flatten(), body.flatten()]).cast(pa.string()).dictionary_encode()
    words, n = coded.dictionary, max(1, len(coded.dictionary))
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row_t, row_b = (pc.list_parent_indices(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (title, body))
    code_t, code_b = tokens[:len(row_t)], tokens[len(row_t):]
    # the bigram across the seam: last token of a title, first one of its body
    last, first = np.flatnonzero(np.diff(row_t, append=-1)), np.flatnonzero(np.diff(row_b, prepend=-1))
    seam, i, j = np.intersect1d(row_t[last], row_b[first], assume_unique=True, return_indices=True)
    parts = [(*_row_grams(row_t, code_t, n), (1, 0)), (*_row_grams(row_b, code_b, n), (0, 1)), (seam, n + code_t[last[i]] * n + code_b[first[j]], (0, 0))]
    row, key = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    of_title, of_body = (np.concatenate([np.full(len(r), f[k]) for r, _key, f in parts]) for k in (0, 1))
    width = n + n * n
    pairs, at, joint = np.unique(row * width + key, return_inverse=True, return_counts=True)
    title_n, body_n = (np.bincount(at, weights=flag, minlength=len(pairs)).astype(np.int64) for flag in (of_title, of_body))
    row, (grams, code) = pairs // width, np.unique(pairs % width, return_inverse=True)
    two = grams[grams >= n] - n
    names = pa.concat_arrays([words.take(pa.array(grams[grams < n])), pc.binary_join_element_wise(words.take(pa.array(two // n)), words.take(pa.array(two % n)), " ")])
    if known is None:
        whole = names.dictionary_encode()  # a token that holds a blank may be some bigram's text
        names, place = whole.dictionary, whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        names, place = known, pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    code, joint = place[code], joint.astype(np.int64)
    if known is not None:
        met = code >= 0
        row, code, title_n, body_n, joint = row[met], code[met], title_n[met], body_n[met], joint[met]
    used = place[place >= 0]
    if len(np.unique(used)) < len(used):
        wide = max(1, len(names))
        pairs, at = np.unique(row * wide + code, return_inverse=True)
        row, code = pairs // wide, pairs % wide
        title_n, body_n, joint = (np.bincount(at, weights=c, minlength=len(pairs)).astype(np.int64) for c in (title_n, body_n, joint))
    return names, row, code, title_n, body_n, joint


def _count_batches(batches, vocabulary: list[str] | None = None):
    known = None if vocabulary is None else pa.array(vocabulary, pa.string())
    for batch in batches:
        for part in _slices(batch):
            names, row, code, title_n, body_n, joint_n = _counted(part, known)
            out = pa.table({"article_id": part.column("article_id").take(pa.array(row)), "term": names.take(pa.array(code)),
                            "title_n": title_n, "body_n": body_n, "joint_n": joint_n})
            yield from out.to_batches(max_chunksize=65536)


def _total_batches(batches):
    for batch in batches:
        for part in _slices(batch):
            names, _row, code, _title_n, _body_n, joint_n = _counted(part, None)
            n = len(names)
            out = pa.table({"term": names, "count": np.bincount(code, weights=joint_n, minlength=n).astype(np.int64), "df": np.bincount(code, minlength=n).astype(np.int64)})
            yield from out.to_batches(max_chunksize=65536)


def _token_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("article_id").cast("long").alias("article_id"), "title_tokens", "body_tokens")


def gram_counts(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per document and n-gram `(article_id, term, title_n, body_n, joint_n)`.

    Counted inside each Arrow batch by whole columns, so a repeated word costs one row, not one per
    occurrence. `joint_n` reads title and body as one sequence, with the bigram across their seam. With `terms`,
    a vocabulary of at most `max_features` rows, all other n-grams are dropped inside the batch."""
    kept = None if terms is None else [r.term for r in terms.select("term").collect()]
    return _token_rows(docs).mapInArrow(lambda batches: _count_batches(batches, kept), "article_id long, term string, title_n long, body_n long, joint_n long")


def gram_totals(docs: DataFrame) -> DataFrame:
    """`(term, count, df)` of every n-gram; documents read together leave one row per term."""
    part = _token_rows(docs).mapInArrow(_total_batches, "term string, count long, df long")
    return part.groupBy("term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def corpus_warnings(documents: int, cfg: FeatureConfig = FeatureConfig()) -> tuple[list[str], float]:
    """Warnings of a small corpus and the document-frequency ceiling in force."""
    if documents == 0:
        raise ValueError("no document to analyse")
    if documents == 1:
        return ["SINGLE_DOCUMENT_FALLBACK"], 1.0
    if documents < cfg.minimum_normal_documents:
        return ["SMALL_CORPUS"], 1.0
    return [], cfg.max_df


def vocabulary(docs: DataFrame, documents: int, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Terms kept for the corpus with document frequency and count, most frequent first, ties by term."""
    counts = gram_totals(docs)
    _warnings, max_df = corpus_warnings(documents, cfg)
    kept = counts.where((F.col("df") >= cfg.min_df) & (F.col("df") <= max_df * documents))
    return kept.orderBy(F.desc("count"), F.asc("term")).limit(cfg.max_features)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(article_id, term, count) over title and body read as one sequence; one input row per article."""
    return gram_counts(docs, terms).select("article_id", "term", F.col("joint_n").alias("count"))


def weighted_counts(docs: DataFrame, terms: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """(article_id, term, weight): title and body counted apart, each with its weight; no shuffle."""
    weight = F.col("title_n") * float(cfg.title_weight) + F.col("body_n") * float(cfg.body_weight)
    return gram_counts(docs, terms).select("article_id", "term", weight.alias("weight")).where("weight > 0")


def tfidf(weighted: DataFrame, documents: int) -> DataFrame:
    """Sublinear term weight times smoothed inverse document frequency, unit length per document."""
    # read for the document frequencies, the scores and their terms: written once, for readers that start together
    # do not wait for each other on a persisted table and count all n-grams again
    weighted = cut_lineage(weighted.where("weight > 0"))
    df = weighted.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log((1.0 + documents) / (1.0 + F.col("_df"))) + 1.0
    raw = weighted.join(F.broadcast(df), "term").withColumn("_x", (1.0 + F.log("weight")) * idf)
    # a document holds at most one row per vocabulary term, which bounds the window
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy("article_id")))
    return raw.select("article_id", "term", (F.col("_x") / length).alias("score"))


# ---- article keywords

def _graph_rank(words) -> list[str]:
    """Words of one document by graph rank over a five-token window, best first."""
    if words is None or len(words) == 0:
        return []
    names, at = np.unique(np.asarray(words, dtype=object).astype(str), return_inverse=True)
    n = len(names)
    keep = np.array([len(name) >= 2 for name in names])
    src, dst = np.concatenate([np.stack([at[:-g], at[g:]]) for g in range(1, 5) if len(at) > g] or [np.zeros((2, 0), int)], axis=1)
    used = keep[src] & keep[dst] & (src != dst)
    src, dst = np.concatenate([src[used], dst[used]]), np.concatenate([dst[used], src[used]])
    if len(src) == 0:
        return []
    out = np.bincount(src, minlength=n).astype(float)
    rank = np.where(keep, 1.0 / n, 0.0)
    for _ in range(10):
        flow = np.bincount(dst, weights=rank[src] / out[src], minlength=n)
        rank = np.where(keep & (out > 0), 0.15 + 0.85 * flow, 0.0)
    rank = np.round(rank, 9)
    return [str(names[i]) for i in np.lexsort((names, -rank))[:20] if rank[i] > 0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def textrank(tokens: pd.Series) -> pd.Series:
    return tokens.map(_graph_rank)


_TEMPLATE_TERMS = frozenset(tx.TEMPLATE_TERMS)
_KEYWORD = T.StructType([T.StructField("neg", T.DoubleType()), T.StructField("term", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("source", T.StringType()), T.StructField("type", T.StringType())])


@F.pandas_udf(T.ArrayType(_KEYWORD))
def _graph_fill(tokens: pd.Series, have: pd.Series, score: pd.Series) -> pd.Series:
    """Graph-ranked words a short list lacks, at half the anchor score; rows without tokens are left alone."""
    out = []
    for words, shown, half in zip(tokens, have, score):
        seen = set() if shown is None else set(shown)
        new = [w for w in _graph_rank(words) if w not in seen and w not in _TEMPLATE_TERMS and not w.replace(".", "", 1).isdigit()]
        out.append([{"neg": -half, "term": w, "score": half, "source": "textrank", "type": "word"} for w in new])
    return pd.Series(out, dtype=object)


def article_keywords(
    scores: DataFrame, docs: DataFrame, query_terms: list[str] = (), cfg: FeatureConfig = FeatureConfig(),
) -> DataFrame:
    """Ranked keywords `(article_id, rank, term, score, source, type)` of every document.

    Candidates are TF-IDF terms, query terms at .6, entities at >= .95 and hash tags at >= .9 of the best
    TF-IDF score. A word inside a phrase that scores as high is dropped; short lists are filled by graph rank."""
    limit = cfg.article_keyword_limit
    queries = sorted({" ".join(q.casefold().split()) for q in query_terms if q.strip()})
    shown_queries = sorted({q.replace(" ", "") if all("一" <= c <= "鿿" or c == " " for c in q) else q for q in queries})
    base = _lexical(scores)
    if shown_queries:
        base = base.where(~F.col("shown").isin(*shown_queries))
    ids = docs.select("article_id", "entities", "topics")
    outside = (lambda c: ~tx.display_term(c).isin(*shown_queries)) if shown_queries else (lambda c: F.lit(True))
    entity = ids.select("article_id", F.explode("entities").alias("t", "kind")).select(
        "article_id", tx.normalize_term(F.col("t")).alias("term"), "kind").where(tx.valid_term(F.col("term")) & outside(F.col("term")))
    topic = ids.select("article_id", F.explode("topics").alias("t")).select(
        "article_id", tx.normalize_term(F.col("t")).alias("term")).where(tx.valid_term(F.col("term")) & outside(F.col("term")))
    none, flag = F.lit(None).cast("string"), lambda b: F.lit(b)
    rows = base.select("article_id", "term", "score", none.alias("kind"), flag(0).alias("src"))  # terms are ready-made here
    rows = rows.unionByName(entity.select("article_id", "term", F.lit(None).cast("double").alias("score"), "kind", flag(1).alias("src")))
    rows = rows.unionByName(topic.select("article_id", "term", F.lit(None).cast("double").alias("score"), none.alias("kind"), flag(2).alias("src")))
    if queries:
        asked = ids.select("article_id", F.explode(F.array(*[F.lit(q) for q in queries])).alias("term"))
        rows = rows.unionByName(asked.where(tx.valid_term(F.col("term"))).select(
            "article_id", "term", F.lit(None).cast("double").alias("score"), none.alias("kind"), flag(3).alias("src")))
    # dealt by article once: the merge, the windows and the lists below keep that
    merged = rows.repartition("article_id").groupBy("article_id", "term").agg(
        F.max("score").alias("own"), F.max("kind").alias("kind"), F.max("src").alias("src"),
        F.max((F.col("src") == 1).cast("int")).alias("is_entity"))
    # scores are plain columns; a document's rows are bounded by the vocabulary, which bounds the window
    of_doc = W.partitionBy("article_id")
    anchor = F.coalesce(F.max("own").over(of_doc), F.lit(1.0))
    rows = merged.withColumns({"anchor": anchor, "_n": F.count("*").over(of_doc)})
    lifted = F.greatest(F.coalesce("own", F.lit(0.0)), F.when(F.col("is_entity") == 1, F.col("anchor") * 0.95).otherwise(0.0))
    src = F.col("src")
    rows = rows.withColumn("score", F.when(src == 3, F.col("anchor") * 0.6).when(src == 2, F.greatest(lifted, F.col("anchor") * 0.9)).otherwise(lifted))

    def typed(part: DataFrame) -> DataFrame:
        """Rows as shown, with origin and type; these text rules are kept for rows that may get into a list."""
        return part.join(docs.select("article_id", "entities"), "article_id").select(
            "article_id", "term", "anchor", "_n", "score",
            F.when(src == 3, "query").when(src == 2, "topic").when(src == 1, "entity").otherwise("tfidf").alias("source"),
            F.when(src == 2, "hashtag").when(src == 1, F.col("kind")).otherwise(tx.term_type(F.col("term"), F.col("entities"))).alias("type"),
            tx.display_term(F.col("term")).alias("shown"))

    def judged(part: DataFrame) -> DataFrame:
        """Ordered candidate list per document without the words that a phrase of at least their score contains."""
        entry = F.struct((-F.col("score")).alias("neg"), "term", "score", "source", "type", "shown")
        lists = fence(part.groupBy("article_id").agg(
            F.array_sort(F.collect_list(entry)).alias("r"), F.first("anchor").alias("anchor"), F.first("_n").alias("_n"),
            F.collect_list(F.when(F.col("type") == "phrase", F.struct(F.col("shown").alias("d"), F.col("score").alias("s")))).alias("_phrases")))
        covered = lambda x: F.exists("_phrases", lambda p: (p["s"] >= x["score"]) & p["d"].contains(x["shown"]))
        return lists.select("article_id", "anchor", "_n", F.filter("r", lambda x: (x["type"] != "word") | ~covered(x)).alias("r"))

    # a phrase that covers a word ranks no lower, so the front of a list (ties included) can be judged by itself;
    # documents left with too few words are judged as a whole
    head = max(64, limit * 4)
    front = rows.withColumn("_rank", F.rank().over(of_doc.orderBy(F.desc("score")))).where(F.col("_rank") <= head)
    front = cut_lineage(judged(typed(front)))
    short_front = (F.size("r") < limit) & (F.col("_n") > head)
    again = judged(typed(rows.join(front.where(short_front).select("article_id"), "article_id", "left_semi")))
    ranked = front.where(~short_front).unionByName(again)
    ranked = docs.select("article_id").join(ranked, "article_id", "left").select(
        "article_id", F.coalesce("anchor", F.lit(1.0)).alias("anchor"),
        F.coalesce(F.slice("r", 1, limit), F.array().cast("array<struct<neg:double,term:string,score:double,source:string,type:string,shown:string>>")).alias("r"))
    ranked = ranked.persist()  # at most `limit` entries per document, read for the lists and for the ones to fill
    # only documents with a short list send their words to the Python step
    todo = fence(docs.select("article_id", F.concat("title_tokens", "body_tokens").alias("_words")).join(
        ranked.where(F.size("r") < limit).select("article_id", (F.col("anchor") * 0.5).alias("_half"), F.transform("r", lambda x: x["shown"]).alias("_have")), "article_id"))
    filled = fence(todo.select("article_id", _graph_fill("_words", "_have", "_half").alias("_fill"))).select("article_id", F.posexplode("_fill").alias("_p", "k"))
    own = ranked.select("article_id", F.posexplode("r").alias("_i", "k")).select("article_id", "_i", "k.neg", "k.term", "k.score", "k.source", "k.type")
    # filling words follow in graph order
    extra = filled.select("article_id", (F.col("_p") + limit).alias("_i"), "k.neg", "k.term", "k.score", "k.source", "k.type")
    every = own.unionByName(extra)
    order = of_doc.orderBy("_i")
    listed = every.withColumns({"rank": F.row_number().over(order), "_max": F.max("score").over(of_doc)}).where(F.col("rank") <= limit)
    return listed.select(
        "article_id", "rank", tx.display_term(F.col("term")).alias("term"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max")))), 6).alias("score"), "source", "type")


def _lexical(scores: DataFrame) -> DataFrame:
    """Scores with normalised, shown and typed terms, invalid ones left out.

    The text rules run once per vocabulary term, at most `max_features` of them, not once per document and term. A filter on
    them would be moved below the distinct() and, by the equal keys of the join, to all scores: a fence stops the first, a
    written table the second."""
    terms = fence(scores.select("term").distinct()).withColumn("_t", tx.normalize_term(F.col("term")))
    terms = terms.where(tx.valid_term(F.col("_t"))).select("term", "_t", tx.display_term(F.col("_t")).alias("shown"), tx.term_type(F.col("_t")).alias("lex_type"))
    terms = cut_lineage(terms)
    return scores.join(F.broadcast(terms), "term").select("article_id", F.col("_t").alias("term"), "score", "shown", "lex_type")


def event_keywords(scores: DataFrame, docs: DataFrame, members: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Top keywords of each event with score, coverage and origin, from `members(event_id, article_id)`."""
    weight = F.greatest(F.lit(0.0), F.col("nlp_weight").cast("double"))
    base = members.join(docs.select("article_id", "platform", "entities", "topics", weight.alias("w")), "article_id")
    norm = lambda c: tx.normalize_term(F.col(c))
    plain = _lexical(scores).join(base, "article_id").select(
        "event_id", "article_id", "platform", F.col("shown").alias("term"), (F.col("score") * F.col("w")).alias("s"),
        F.struct(F.lit(0).alias("stage"), "article_id", F.lit(0).alias("o")).alias("at"), F.lit("tfidf").alias("source"),
        F.coalesce(F.col("entities")[F.col("shown")], F.col("lex_type")).alias("type"))
    ent = base.select("event_id", "article_id", "platform", "w", F.explode("entities").alias("raw", "kind")).withColumn("t", norm("raw")).where(tx.valid_term(F.col("t"))).select(
        "event_id", "article_id", "platform", tx.display_term(F.col("t")).alias("term"), (F.lit(0.25) * F.col("w")).alias("s"),
        F.struct(F.lit(1).alias("stage"), "article_id", F.lit(1).alias("o")).alias("at"), F.lit("entity").alias("source"), F.col("kind").alias("type"))
    top = base.select("event_id", "article_id", "platform", "w", F.explode("topics").alias("raw")).withColumn("t", norm("raw")).where(tx.valid_term(F.col("t"))).select(
        "event_id", "article_id", "platform", tx.display_term(F.col("t")).alias("term"), (F.lit(0.2) * F.col("w")).alias("s"),
        F.struct(F.lit(1).alias("stage"), "article_id", F.lit(2).alias("o")).alias("at"), F.lit("topic").alias("source"), F.lit("hashtag").alias("type"))
    rows = plain.unionByName(ent).unionByName(top)
    # distinct documents and platforms are reduced per (event, term, document) first, so no event is gathered
    per_doc = rows.groupBy("event_id", "term", "platform", "article_id").agg(F.sum("s").alias("s"), F.max(F.struct("at", "source", "type")).alias("last"))
    per_platform = per_doc.groupBy("event_id", "term", "platform").agg(F.sum("s").alias("s"), F.max("last").alias("last"), F.count("*").alias("docs"))
    agg = per_platform.groupBy("event_id", "term").agg(
        F.sum("s").alias("raw"), F.max("last").alias("last"), F.sum("docs").alias("document_count"), F.count("*").alias("platform_count"))
    kept = agg.where((F.col("document_count") >= 2) | (F.col("last.type") != "word")).withColumn("raw", F.round("raw", 9))
    best = kept.groupBy("event_id").agg(F.max("raw").alias("_max"))
    size = members.groupBy("event_id").agg(F.count("*").alias("_n"))
    order = [F.desc("raw"), F.desc("document_count"), F.desc("platform_count"), F.asc("term")]
    head = top_per_group(kept, ["event_id"], order, cfg.event_keyword_limit)
    return head.join(best, "event_id").join(size, "event_id").select(
        "event_id", "rank", "term", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / F.col("_max"))), 6).alias("score"),
        F.col("last.source").alias("source"), F.col("last.type").alias("type"), "document_count",
        F.round(F.col("document_count") / F.col("_n"), 6).alias("document_ratio"), "platform_count")


def served_event_keywords(keywords: DataFrame, members: DataFrame, limit: int = 30) -> DataFrame:
    """Keywords shown for an event, from per-article lists `(article_id, rank, term, score, source, sentiment, type)`.

    Query terms are those asked for in half the articles; of the rest each article adds its first three Han terms.
    Equal counts of a mood or type fall to the smaller name."""
    # everything here grows with articles or events, while the planner sees small compressed files: nothing goes through the driver
    big = lambda df: df.hint("merge")
    rows = keywords.join(big(members), "article_id").withColumn("term", F.trim("term"))
    size = members.groupBy("event_id").agg(F.count("*").alias("_n"))
    first = cut_lineage(rows.groupBy("event_id", "article_id", "term").agg(
        F.min_by(F.struct("rank", "score", "sentiment", "type"), "rank").alias("k"), F.count_if(F.col("source") == "query").alias("_c")).select("event_id", "article_id", "term", "_c", "k.*"))
    asked = first.where("_c > 0").groupBy("event_id", "term").agg(F.sum("_c").alias("_c")).join(big(size), "event_id").where("_c >= _n * 0.5").select("event_id", "term", F.lit(True).alias("_q"))
    tagged = cut_lineage(first.drop("_c").join(big(asked), ["event_id", "term"], "left"))
    own = tagged.where(F.col("_q").isNull() & (F.length("term") > 1) & F.col("term").rlike(tx.HAN))
    own = top_per_group(own, ["event_id", "article_id"], [F.asc("rank"), F.asc("term")], 3, "_rn")
    stats = lambda df: df.groupBy("event_id", "term").agg(
        F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.mode("sentiment", True).alias("sentiment"), F.mode("type", True).alias("type"))
    asked_stats = stats(tagged.where("_q"))
    queries = asked_stats.groupBy("event_id").agg(F.count("*").alias("_nq"))
    ranked = top_per_group(stats(own), ["event_id"], [F.desc("n"), F.desc("avg_score"), F.asc("term")], limit, "_rn").join(big(queries), "event_id", "left")
    ranked = cut_lineage(ranked.where(F.col("_rn") <= limit - F.coalesce("_nq", F.lit(0))))
    total = ranked.groupBy("event_id").agg(F.count("*").alias("_total"))
    shown = ranked.join(big(total), "event_id").select(
        "event_id", "term", F.round(1.0 - (F.col("_rn") - 1) / F.col("_total") * 0.85, 4).alias("weight"), "sentiment", "type", F.lit("event").alias("source"))
    numbered = top_per_group(asked_stats, ["event_id"], [F.asc("term")], limit * 100, "_rn")
    query_rows = numbered.select(
        "event_id", "term", F.round(F.greatest(F.lit(0.2), 0.6 - (F.col("_rn") - 1) * 0.05), 4).alias("weight"), "sentiment", "type", F.lit("query").alias("source"))
    return shown.unionByName(query_rows)


def article_top_keywords(keywords: DataFrame, count: int = 5) -> DataFrame:
    """First five terms of the earliest run that gave an article at least three keywords."""
    usable = keywords.groupBy("article_id", "run_id").agg(F.count("*").alias("n")).where("n >= 3")
    first = usable.groupBy("article_id").agg(F.min("run_id").alias("run_id"))
    rows = keywords.join(first, ["article_id", "run_id"]).where((F.col("rank") <= count) & (F.coalesce("term", F.lit("")) != ""))
    return rows.select("article_id", "rank", F.trim("term").alias("term"), F.coalesce("score", F.lit(0.0)).alias("score"))


# ---- model answers for keywords

def keyword_requests(docs: DataFrame, size: int = 5, span: int = 5000) -> DataFrame:
    """Texts of at least 20 characters, cut to 800, in batches of five by ascending id (only the last can be smaller).

    Rows are numbered inside ranges of ids and shifted by the rows of the ranges before, which are summed in two levels."""
    text = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("body_tokens", " ")))
    rows = docs.select("article_id", text.alias("text")).where(F.length("text") >= 20).withColumn("range", F.floor(F.col("article_id") / span))
    ranges = rows.groupBy("range").agg(F.count("*").alias("_n")).withColumn("_part", F.floor(F.col("range") / span))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    parts = ranges.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before(W.orderBy("_part"))), F.lit(0)).alias("_far"))
    near = ranges.withColumn("_near", F.coalesce(F.sum("_n").over(before(W.partitionBy("_part").orderBy("range"))), F.lit(0)))
    shift = near.join(parts, "_part").select("range", (F.col("_near") + F.col("_far")).alias("_shift"))
    number = F.row_number().over(W.partitionBy("range").orderBy("article_id")) + F.col("_shift")
    return rows.join(shift, "range").withColumn("batch", F.floor((number - 1) / size)).groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("article_id", F.substring("text", 1, 800).alias("text")))).alias("documents"))


def parse_keyword_answers(answers: DataFrame, requested: DataFrame, per_document: int = 8) -> DataFrame:
    """Landed answers `(content)` as `(article_id, rank, term, score, type, sentiment)`; only requested ids, valid items."""
    from murmur.operators.sentiment import strip_fence

    # behind fences: a filter on a list or a field would otherwise parse the answer once more for itself
    lists = fence(answers.select(F.from_json(strip_fence(F.col("content")), "map<string,string>").alias("lists")))
    by_id = lists.select(F.explode("lists").alias("id", "items")).select(F.col("id").try_cast("bigint").alias("article_id"), "items").where("article_id is not null")
    by_id = by_id.join(requested.select("article_id").distinct(), "article_id", "left_semi")
    by_id = fence(by_id.select("article_id", F.from_json("items", "array<string>").alias("items")))
    raw = by_id.select("article_id", F.posexplode("items").alias("i", "x")).where(F.col("x").startswith("{"))
    # one parse per item gives all its fields
    names = ("term", "score", "sentiment", "entity_type", "type")
    raw = raw.select("article_id", "i", F.json_tuple("x", *names).alias(*[f"_{n}" for n in names]))
    rows = raw.select(
        "article_id", "i", F.substring(F.trim(F.coalesce("_term", F.lit(""))), 1, 20).alias("term"),
        F.coalesce("_score", F.lit("0.5")).try_cast("double").alias("score"),
        F.lower(F.trim(F.coalesce("_sentiment", F.lit("neutral")))).alias("sentiment"),
        F.lower(F.trim(F.coalesce("_entity_type", "_type", F.lit("concept")))).alias("type"),
    ).where((F.col("term") != "") & F.col("score").isNotNull())
    rows = top_per_group(rows, ["article_id"], [F.asc("i")], per_document)
    return rows.select(
        "article_id", "rank", "term", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 4).alias("score"),
        F.when(F.col("type").isin("location", "organization", "person", "event", "concept"), F.col("type")).otherwise("concept").alias("type"),
        F.when(F.col("sentiment").isin("positive", "negative", "neutral"), F.col("sentiment")).otherwise("neutral").alias("sentiment"))


def merge_keywords(answered: DataFrame, computed: DataFrame) -> DataFrame:
    """Model keywords where an article has at least three of them, computed keywords otherwise."""
    # both meet in one pass, so the answers are parsed once; the lists of an article are short on either side
    columns = ["article_id", "rank", "term", "score", "type", "sentiment", "source"]
    both = answered.select(*columns[:-1], F.lit("llm").alias("source"), F.lit(True).alias("_llm")).unionByName(
        computed.select(*columns[:5], F.lit("neutral").alias("sentiment"), "source", F.lit(False).alias("_llm")))
    enough = F.count_if("_llm").over(W.partitionBy("article_id")) >= 3
    return both.withColumn("_enough", enough).where(F.col("_llm") == F.col("_enough")).select(*columns)


# ---- vectors

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector; null for a zero vector, which the caller reports."""
    # the norm is an argument: written inside the inner function it would be computed anew for every component
    unit = lambda size: F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))
    return F.get(F.transform(F.array(norm(v)), unit), F.lit(0))


def centroids(rows: DataFrame, by: list[str], vector: str = "vector", unit: bool = True) -> DataFrame:
    """Mean vector per group, null when the lengths of a group differ. Sums are kept per task, never gathered."""
    sized = rows.where(F.col(vector).isNotNull()).withColumn("_d", F.size(vector))
    mean = Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    parts = sized.groupBy(*by, "_d").agg(vector_to_array(mean).alias("_mean"), F.count("*").alias("_n"))
    whole = parts.groupBy(*by).agg(F.count("*").alias("_sizes"), F.first("_mean").alias("_mean"), F.sum("_n").alias("member_count"))
    center = F.when(F.col("_sizes") == 1, normalized(F.col("_mean")) if unit else F.col("_mean"))
    return whole.select(*by, center.alias("centroid"), "member_count")


def missing_embeddings(docs: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Documents without a stored vector for their content and model versions, with the text to encode: title and body
    on two lines, stripped, then cut at 2,000 characters."""
    both = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("clean_content", F.lit("")))
    text = F.substring(F.regexp_replace(both, "^\\s+|\\s+$", ""), 1, 2000)
    return docs.withColumn("embedding_text", text).join(stored.select(*key), key, "left_anti")


def encode(docs: DataFrame, encoder, dimension: int, text: str = "embedding_text") -> DataFrame:
    """Add `vector` by a batch encoder `(list[str]) -> array`; made once per task by `encoder()`.

    Rows stream through in Arrow batches; the default hashing encoder needs no model file."""
    keep = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*keep, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = encoder()
        for batch in batches:
            vectors = np.asarray(model(batch[text].fillna("").tolist()), dtype=float).reshape(len(batch), dimension)
            yield batch.drop(columns=[text]).assign(vector=[v.tolist() for v in vectors])

    return docs.mapInPandas(run, schema)


def hashing_encoder(dimension: int = 64):
    """Default encoder factory: signed hashed character bigrams, unit length."""
    import zlib

    def factory():
        def run(texts):
            out = np.zeros((len(texts), dimension))
            for i, text in enumerate(texts):
                for a, b in zip(text, text[1:]):
                    h = zlib.crc32((a + b).encode())
                    out[i, h % dimension] += 1.0 if h >> 31 else -1.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size == 0, 1.0, size)

        return run

    return factory
