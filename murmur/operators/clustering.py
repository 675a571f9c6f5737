"""Clusters of the documents of a run: candidates from an inverted index, then centres that grow in parallel rounds.

A run may hold any share of all documents and a cluster any share of a run. Documents and clusters meet through lists
(run, keyword); a keyword whose list is longer than `LONG_LIST` is met by heads instead (see `rank_candidates`). Values of
a cluster are counted as rows, never gathered; vectors are joined for the best candidates only."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from murmur.config import AggregationConfig
from murmur.functions.ranking import top_per_group
from murmur.operators.dedup import resolve_chains
from murmur.operators.events import CONFLICTS, cosine, folded, known_entities, match_score, match_warnings, time_compatibility, with_entity_signals
from murmur.operators.features import centroids, dot, norm, normalized
from murmur.session import cut_lineage

#: A keyword with more clusters than this in one run is long.
LONG_LIST = 256
_CODES = [code for _, code in CONFLICTS]
_TEXTS = "array<string>"
_SIGNALS = ("bge", "tfidf", "entity", "time")
_VERDICT = "struct<score:double,clash:array<string>,bge:double,tfidf:double,entity:double,time:double>"


def _topic(df: DataFrame) -> Column:
    return F.when(F.coalesce(df["topic_category"], F.lit("")) != "", df["topic_category"])


# ---- candidates

def rank_candidates(docs: DataFrame, clusters: DataFrame, cfg: AggregationConfig = AggregationConfig()) -> DataFrame:
    """Best clusters of its run for every document: same topic counts 1, keyword overlap up to 1, ties by index.

    Exact, as if all clusters of the run were scored, without a product of documents and clusters:
    * a cluster that shares a keyword with a short list is found in that list; overlaps are summed per pair;
    * one that shares long keywords only scores by topic, its long keywords and its size alone, so of all clusters with
      the same three only the first ones by index can be among the best;
    * one that shares the topic or nothing scores 1 or 0: the first ones of the topic and of the run."""
    words = clusters.select("run_id", "cluster_index", F.explode(folded(F.col("keywords"))).alias("word"))
    heads = clusters.select("run_id", "cluster_index", _topic(clusters).alias("topic"))
    asked = docs.select("run_id", "article_id", _topic(docs).alias("topic"), folded(F.col("keywords")).alias("words"))
    found = _ranked(asked, heads, words, max(1, cfg.candidate_limit))
    return found.select("run_id", "article_id", "cluster_index", "candidate_score", "rank")


def _ranked(asked: DataFrame, clusters: DataFrame, words: DataFrame, limit: int, before: str | None = None) -> DataFrame:
    """`asked(run_id, article_id, topic, words)` against `clusters(run_id, cluster_index, topic)` with their keywords as rows.

    With `before`, only clusters of a smaller index than that column of `asked` count; as ties go to the smaller index, the
    first ones of a kind remain the right ones."""
    key = ["run_id", "cluster_index"]
    lists = words.groupBy("run_id", "word").agg((F.count("*") > LONG_LIST).alias("long"))
    filed = words.join(lists, ["run_id", "word"])
    long_words = F.array_sort(F.collect_list(F.when(F.col("long"), F.col("word"))))
    kept = clusters.join(filed.groupBy(*key).agg(F.count("*").alias("size"), long_words.alias("longs")), key, "left").select(
        *key, F.col("topic").alias("their_topic"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("longs", F.array().cast(_TEXTS)).alias("longs"))
    any_long = not lists.where("long").isEmpty()
    at = F.col(before) if before else F.lit(None).cast("long")
    asked = asked.select("run_id", "article_id", at.alias("at"), "topic", F.size("words").alias("own_size"), "words")
    if any_long:
        kept = cut_lineage(kept)
        own = asked.select("run_id", "article_id", F.explode("words").alias("word")).join(lists.where("long"), ["run_id", "word"]).groupBy(
            "run_id", "article_id").agg(F.collect_list("word").alias("own_longs"))
        asked = cut_lineage(asked.join(own, ["run_id", "article_id"], "left").withColumn("own_longs", F.coalesce("own_longs", F.array().cast(_TEXTS))))
    else:
        asked = asked.withColumn("own_longs", F.array().cast(_TEXTS))
    facts = ["at", "topic", "own_size", "own_longs"]
    one = asked.select("run_id", "article_id", *facts)
    earlier = F.col("at").isNull() | (F.col("cluster_index") < F.col("at"))
    shared = F.array_intersect("own_longs", "longs")
    alike = {"same_topic": F.coalesce(F.col("topic") == F.col("their_topic"), F.lit(False)), "both_sizes": F.col("own_size") + F.col("size"),
             "common_longs": F.size(shared) if any_long else F.lit(0)}
    short = filed.where("not long").select("run_id", "word", "cluster_index").join(kept, key)
    parts = [
        asked.select("run_id", "article_id", *facts, F.explode(F.array_except("words", "own_longs")).alias("word")).join(short, ["run_id", "word"]).select(
            "run_id", "article_id", *facts, "cluster_index", "their_topic", "size", "longs", F.lit(1).alias("hit")),
    ]
    columns = parts[0].columns[:-1]
    by_run = top_per_group(kept, ["run_id"], [F.col("cluster_index")], limit).drop("rank")
    parts.append(one.join(by_run, "run_id").select(*columns, F.lit(0).alias("hit")))
    by_topic = top_per_group(kept.where("their_topic is not null"), ["run_id", "their_topic"], [F.col("cluster_index")], limit).drop("rank").withColumn("topic", F.col("their_topic"))
    parts.append(one.join(by_topic, ["run_id", "topic"]).select(*columns, F.lit(0).alias("hit")))
    if any_long:
        kinds = top_per_group(kept.where(F.size("longs") > 0), ["run_id", "their_topic", "longs", "size"], [F.col("cluster_index")], limit).drop("rank")
        met = one.select("*", F.explode("own_longs").alias("word")).join(kinds.select("*", F.explode("longs").alias("word")), ["run_id", "word"]).where(
            (F.array_min(shared) == F.col("word")) & earlier).withColumns(alike)
        parts.append(top_per_group(met.withColumn("bound", _overlap_score(F.col("common_longs"))), ["run_id", "article_id"], [F.desc("bound"), F.col("cluster_index")], limit).select(
            *columns, F.lit(0).alias("hit")))
    key = ["run_id", "article_id", "cluster_index"]
    # the facts of a pair are narrow keys: kept as values they would make the aggregation sort all hits. One shuffle by
    # document serves the sums and the ranks
    pairs = reduce(DataFrame.unionByName, parts).where(earlier).withColumns(alike).select(*key, *alike, "hit").repartition("run_id", "article_id")
    scored = pairs.groupBy(*key, *alike).agg(F.sum("hit").alias("hits")).withColumn("candidate_score", _overlap_score(F.col("hits") + F.col("common_longs")))
    return top_per_group(scored, ["run_id", "article_id"], [F.desc("candidate_score"), F.asc("cluster_index")], limit).select(
        "run_id", "article_id", "cluster_index", "candidate_score", "rank")


def _overlap_score(common: Column) -> Column:
    return F.col("same_topic").cast("double") + F.when(common > 0, common / (F.col("both_sizes") - common)).otherwise(0.0)


# ---- clusters

def cluster_runs(docs: DataFrame, cfg: AggregationConfig = AggregationConfig()) -> DataFrame:
    """Clusters of the documents of each run; every row comes back with `first_action` and its final `action`.

    Documents: `(run_id, article_id, effective_time, topic_category, keywords, entities, bge_vector, tfidf_vector)`, one row
    per run and article. Order of a run: time (unknown last), then id. Without enough evidence a document is `deferred`.

    1. Seeds. A document meets the best earlier ones by topic and keywords (`candidate_limit` of all, wherever they stand)
       and the first one equal to it. The best score decides: free of conflict at the attach threshold it follows, between
       the thresholds it is `ambiguous` and steps aside with all that equal it (others choose anew), else it founds. Documents that
       lead to one founder are a cluster. A member that conflicts with the earliest known place, case or organisation of
       its cluster leaves; those who leave keep together where they followed each other without conflict.
    2. Centres: mean vectors, values, time span and first topic of all members.
    3. Every ambiguous document meets the best clusters and attaches to the centre that scores best, or founds.
    4. With new centres, every attached document compares its own cluster without itself with the best other one and moves
       by the move margin. Clusters are numbered by earliest member.

    All documents of a step decide by the same state, so no result depends on the order in which rows are read, and the
    steps are as many for every run. A cluster's time is its span: a document inside has no gap."""
    live, deferred = _with_evidence(docs, cfg)
    pairs = _document_pairs(live, cfg)
    chosen = _chosen(pairs)
    aside = chosen.where((F.size("said.clash") == 0) & (F.col("said.score") >= cfg.create_threshold) & (F.col("said.score") < cfg.attach_threshold))
    aside = aside.select("run_id", "at")
    equals = pairs.where("twin").join(aside.withColumnRenamed("at", "other"), ["run_id", "other"]).select("run_id", "at")
    gone = cut_lineage(aside.unionByName(equals).distinct())
    rest = live.select("run_id", "at", "entities").join(gone, ["run_id", "at"], "left_anti")
    open_pairs = pairs.join(gone, ["run_id", "at"], "left_anti").join(gone.withColumnRenamed("at", "other"), ["run_id", "other"], "left_anti")
    seeds = _seeded(rest, open_pairs, cfg).withColumn("first_action", F.col("action"))
    # 3: ambiguous documents against centres
    heard = _best_cluster(_against(live, seeds, _cluster_pairs(live, gone, seeds, cfg.candidate_limit), cfg))
    retried = cut_lineage(gone.join(heard, ["run_id", "at"], "left"))
    attached = retried.where(_free("said", cfg)).select(
        "run_id", "at", F.col("cluster").alias("cluster"), F.lit("attach").alias("action"), "said", F.array().cast(_TEXTS).alias("notes"), F.lit("ambiguous").alias("first_action"))
    failed = retried.where(~_free("said", cfg) | F.col("said").isNull()).select("run_id", "at", "said")
    among = pairs.join(failed.select("run_id", "at"), ["run_id", "at"], "left_semi").join(
        failed.select("run_id", F.col("at").alias("other")), ["run_id", "other"], "left_semi")
    fresh = _seeded(live.select("run_id", "at", "entities").join(failed.select("run_id", "at"), ["run_id", "at"], "left_semi"), among, cfg)
    noted = failed.select("run_id", "at", F.col("said").alias("heard"))
    note = F.when((F.col("action") == "create") & (F.size("heard.clash") == 0), F.array(F.lit("AMBIGUOUS_AFTER_REFINEMENT"))).otherwise(F.array().cast(_TEXTS))
    fresh = fresh.join(noted, ["run_id", "at"]).select(
        "run_id", "at", "cluster", "action", F.when(F.col("action") == "create", F.col("heard")).otherwise(F.col("said")).alias("said"),
        F.concat("notes", note).alias("notes"), F.lit("ambiguous").alias("first_action"))
    placed = cut_lineage(seeds.select(*attached.columns).unionByName(attached).unionByName(fresh))
    # 4: one move by margin
    followers = placed.where("action = 'attach'").select("run_id", "at", F.col("cluster").alias("own"))
    met = _cluster_pairs(live, followers, placed, cfg.candidate_limit + 1).join(followers, ["run_id", "at"])
    others = top_per_group(met.where("cluster <> own"), ["run_id", "at"], [F.col("rank")], cfg.candidate_limit, "place").select("run_id", "at", "cluster", F.lit(False).alias("inside"))
    stays = followers.select("run_id", "at", F.col("own").alias("cluster"), F.lit(True).alias("inside"))
    scores = cut_lineage(_against(live, placed, others.unionByName(stays), cfg))
    here = scores.where("inside").select("run_id", "at", F.col("said.score").alias("stay"))
    there = _best_cluster(scores.where("not inside")).select("run_id", "at", F.col("cluster").alias("goes_to"), F.col("said").alias("hears"))
    moves = there.join(here, ["run_id", "at"]).where(
        _free("hears", cfg) & (F.round(F.col("hears.score") - F.col("stay"), 6) >= cfg.move_margin)).drop("stay")
    final = placed.join(moves, ["run_id", "at"], "left")
    moved = F.col("goes_to").isNotNull()
    final = cut_lineage(final.select(
        "run_id", "at", "first_action", F.coalesce("goes_to", "cluster").alias("cluster"), F.when(moved, "moved").otherwise(F.col("action")).alias("action"),
        F.coalesce("hears", "said").alias("said"), F.concat("notes", F.when(moved, F.array(F.lit("MOVE_MARGIN_MET"))).otherwise(F.array().cast(_TEXTS))).alias("notes")))
    earliest = final.groupBy("run_id", "cluster").agg(F.min("at").alias("first"))
    numbers = _numbered(earliest, "first", "cluster_index").select("run_id", "cluster", "cluster_index")
    out = final.join(numbers, ["run_id", "cluster"]).join(live.select("run_id", "at", "article_id"), ["run_id", "at"]).select(
        "run_id", "article_id", F.col("cluster_index").cast("long").alias("cluster_index"), "first_action", "action", F.coalesce("said.score", F.lit(0.0)).alias("similarity"),
        F.array_distinct(F.concat(F.coalesce("said.clash", F.array().cast(_TEXTS)), "notes")).alias("reasons"), *[F.col(f"said.{s}").alias(s) for s in _SIGNALS],
        F.when(F.col("said").isNotNull(), match_warnings(F.col("said.bge"), F.col("said.tfidf"))).otherwise(F.array().cast(_TEXTS)).alias("warnings"))
    return out.unionByName(deferred)


def _with_evidence(docs: DataFrame, cfg: AggregationConfig) -> tuple[DataFrame, DataFrame]:
    """(live documents with their place `at` in the run, rows of the deferred ones)."""
    filled = lambda c: (F.size(F.coalesce(F.col(c), F.array())) > 0).cast("int")
    any_entity = F.exists(F.map_values(F.coalesce("entities", F.create_map().cast("map<string,array<string>>"))), lambda v: F.size(folded(v)) > 0)
    evidence = filled("tfidf_vector") + filled("bge_vector") + (F.size(folded(F.col("keywords"))) > 0).cast("int") + any_entity.cast("int")
    base = docs.withColumns({"order": F.struct(F.col("effective_time").isNull().alias("n"), F.unix_micros("effective_time").alias("t"), F.col("article_id").alias("i")),
                             "live": evidence >= cfg.minimum_evidence_count})
    live = cut_lineage(_numbered(base.where("live").drop("live"), "order", "at").drop("order"))
    none = F.lit(None).cast("double")
    deferred = base.where("not live").select(
        "run_id", "article_id", F.lit(None).cast("long").alias("cluster_index"), F.lit("deferred").alias("first_action"), F.lit("deferred").alias("action"),
        F.lit(0.0).alias("similarity"), F.array(F.lit("INSUFFICIENT_EVIDENCE")).alias("reasons"), *[none.alias(s) for s in _SIGNALS], F.array().cast(_TEXTS).alias("warnings"))
    return live, deferred


def _numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the gapless place (from 0) of each row in its run: places inside sorted ranges, shifted by the ranges before."""
    ranged = rows.repartitionByRange("run_id", order).sortWithinPartitions("run_id", order).withColumn("_seen", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged).withColumn("_range", F.shiftright("_seen", 33))
    before = Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("run_id", "_range").agg(F.count("*").alias("_n"), F.min("_seen").alias("_low")).select(
        "run_id", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    return ranged.join(shifts, ["run_id", "_range"]).withColumn(name, F.col("_seen") + F.col("_shift")).drop("_seen", "_range", "_shift")


def _free(said: str, cfg: AggregationConfig) -> Column:
    return F.coalesce((F.size(f"{said}.clash") == 0) & (F.col(f"{said}.score") >= cfg.attach_threshold), F.lit(False))


def _verdict(cfg: AggregationConfig) -> Column:
    """Score, conflicts and signals, from columns of those names: a formula in their place would be computed once per use."""
    return F.struct(match_score(*[F.col(s) for s in _SIGNALS], cfg).alias("score"), "clash", *_SIGNALS).cast(_VERDICT)


def _document_pairs(live: DataFrame, cfg: AggregationConfig) -> DataFrame:
    """`(run_id, at, other, twin, said)`: each document with its best earlier candidates and the first document equal to it."""
    words = live.select("run_id", F.col("at").alias("cluster_index"), F.explode(folded(F.col("keywords"))).alias("word"))
    heads = live.select("run_id", F.col("at").alias("cluster_index"), _topic(live).alias("topic"))
    asked = live.select("run_id", F.col("at").alias("article_id"), "at", _topic(live).alias("topic"), folded(F.col("keywords")).alias("words"))
    ranked = _ranked(asked, heads, words, max(1, cfg.candidate_limit), "at").select("run_id", F.col("article_id").alias("at"), F.col("cluster_index").alias("other"))
    # equal documents share a hash; the score decides, so a chance collision does no harm
    looks = F.xxhash64("topic_category", F.array_sort(folded(F.col("keywords"))), "bge_vector", "tfidf_vector", F.array_sort(F.map_entries("entities")))
    looks = live.select("run_id", "at", looks.alias("looks"))
    firsts = looks.groupBy("run_id", "looks").agg(F.min("at").alias("other"))
    equal = looks.join(firsts, ["run_id", "looks"]).where("other < at").select("run_id", "at", "other", F.lit(True).alias("twin"))
    met = ranked.withColumn("twin", F.lit(False)).unionByName(equal).groupBy("run_id", "at", "other").agg(F.max("twin").alias("twin"))
    # small rows, much work on each: the planner would judge by their bytes and use few tasks
    tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = [normalized(F.col(f"{name}_vector")).alias(f"{name}_unit") for name in ("bge", "tfidf")]  # once per document, not per pair
    sides = cut_lineage(live.select("run_id", "at", "effective_time", known_entities(F.col("entities")).alias("known"), *units))
    side = lambda s, at: sides.select("run_id", F.col("at").alias(at), *[F.col(c).alias(f"{c}_{s}") for c in ("effective_time", "known", "bge_unit", "tfidf_unit")])
    both = met.join(side("b", "other"), ["run_id", "other"]).repartition(tasks, "run_id", "at").join(side("a", "at"), ["run_id", "at"])
    return cut_lineage(_pair_verdicts(both, cfg))


def _pair_verdicts(both: DataFrame, cfg: AggregationConfig) -> DataFrame:
    """Verdicts of pairs that carry what is known of both documents."""
    heard = with_entity_signals(both, "known_a", "known_b").withColumns({
        "bge": _unit_cosine("bge_unit_a", "bge_unit_b"), "tfidf": _unit_cosine("tfidf_unit_a", "tfidf_unit_b"),
        "time": time_compatibility(F.col("effective_time_a"), F.col("effective_time_b"), cfg.maximum_event_gap_days)})
    return heard.select("run_id", "at", "other", "twin", _verdict(cfg).alias("said"))


def _unit_cosine(a: str, b: str) -> Column:
    """Cosine of two unit vectors, clamped to 0..1; null where one is missing or their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col(a), F.col(b)))))


def _chosen(pairs: DataFrame) -> DataFrame:
    """The best earlier document of each: score, then the earliest."""
    return pairs.groupBy("run_id", "at").agg(F.max_by(F.struct("other", "said"), F.struct(F.col("said.score"), -F.col("other"))).alias("best")).select(
        "run_id", "at", "best.other", "best.said")


def _seeded(rows: DataFrame, pairs: DataFrame, cfg: AggregationConfig) -> DataFrame:
    """`(run_id, at, cluster, action, said, notes)` of documents that follow, found or leave; a cluster is named by its founder's place."""
    told = rows.join(_chosen(pairs), ["run_id", "at"], "left")
    told = cut_lineage(told.withColumn("parent", F.when(_free("said", cfg), F.col("other"))).drop("other"))
    first = _apart(_followed(told))
    stayed, left = first.where(F.size("split") == 0), first.where(F.size("split") > 0)
    empty = F.array().cast(_TEXTS)
    out = stayed.select("run_id", "at", F.col("root").alias("cluster"), F.col("parent").isNotNull().alias("follows"), "said", empty.alias("notes"))
    if left.isEmpty():
        return out.select("run_id", "at", "cluster", F.when(F.col("follows"), "attach").otherwise("create").alias("action"), "said", "notes")
    # who left goes on with a parent that left the same cluster, and is judged once more among those
    also = left.select("run_id", F.col("at").alias("parent"), F.col("root").alias("was"))
    again = left.join(also, ["run_id", "parent"], "left").withColumn("parent", F.when(F.col("was") == F.col("root"), F.col("parent")))
    again = again.withColumn("notes", F.col("split")).drop("was", "root", "split")
    second = _apart(_followed(cut_lineage(again)))
    alone = F.size("split") > 0
    out = out.unionByName(
        second.select("run_id", "at", F.when(alone, F.col("at")).otherwise(F.col("root")).alias("cluster"), (F.col("parent").isNotNull() & ~alone).alias("follows"), "said", F.col("notes")))
    return cut_lineage(out.select("run_id", "at", "cluster", F.when(F.col("follows"), "attach").otherwise("create").alias("action"), "said",
                                  F.when(F.col("follows"), empty).otherwise(F.col("notes")).alias("notes")))


def _followed(rows: DataFrame) -> DataFrame:
    """Adds the founder `root` that a document's parents lead to."""
    node = lambda c: F.concat_ws(":", F.col("run_id"), F.col(c))
    ends = resolve_chains(rows.select(node("at").alias("article_id"), F.when(F.col("parent").isNotNull(), node("parent")).alias("duplicate_of_id")))
    ends = ends.select(F.col("article_id").alias("_node"), F.element_at(F.split("root_id", ":"), -1).cast("long").alias("root"))
    return rows.withColumn("_node", node("at")).join(ends, "_node").drop("_node")


def _apart(rows: DataFrame) -> DataFrame:
    """Adds `split`: the codes in which a member conflicts with the earliest known values of its cluster."""
    known = rows.select("run_id", "root", "at", F.explode(F.array(*[F.struct(F.lit(code).alias("code"), folded(F.col("entities")[key]).alias("own")) for key, code in CONFLICTS])).alias("k")).select(
        "run_id", "root", "at", "k.*").where(F.size("own") > 0)
    anchors = known.groupBy("run_id", "root", "code").agg(F.min_by("own", "at").alias("theirs"))
    against = known.join(anchors, ["run_id", "root", "code"]).where(~F.arrays_overlap("own", "theirs"))
    codes = against.groupBy("run_id", "at").agg(F.collect_set("code").alias("split"))
    ordered = F.filter(F.array(*[F.lit(c) for c in _CODES]), lambda c: F.array_contains(F.coalesce("split", F.array().cast(_TEXTS)), c))
    return cut_lineage(rows.join(codes, ["run_id", "at"], "left").withColumn("split", ordered))


def _cluster_pairs(live: DataFrame, wanted: DataFrame, placed: DataFrame, limit: int) -> DataFrame:
    """`(run_id, at, cluster, rank, inside)`: the best clusters of the wanted documents by topic and keywords."""
    members = placed.select("run_id", "at", "cluster").join(live.select("run_id", "at", _topic(live).alias("topic"), "keywords"), ["run_id", "at"])
    words = members.select("run_id", F.col("cluster").alias("cluster_index"), F.explode(folded(F.col("keywords"))).alias("word")).distinct()
    heads = members.groupBy("run_id", F.col("cluster").alias("cluster_index")).agg(F.min_by("topic", F.when(F.col("topic").isNotNull(), F.col("at"))).alias("topic"))
    asked = live.join(wanted.select("run_id", "at"), ["run_id", "at"], "left_semi").select(
        "run_id", F.col("at").alias("article_id"), _topic(live).alias("topic"), folded(F.col("keywords")).alias("words"))
    return _ranked(asked, heads, words, max(1, limit)).select(
        "run_id", F.col("article_id").alias("at"), F.col("cluster_index").alias("cluster"), "rank", F.lit(False).alias("inside"))


def _best_cluster(scores: DataFrame) -> DataFrame:
    return scores.groupBy("run_id", "at").agg(F.max_by(F.struct("cluster", "said"), F.struct(F.col("said.score"), -F.col("cluster"))).alias("best")).select(
        "run_id", "at", "best.cluster", "best.said")


def _against(live: DataFrame, placed: DataFrame, pairs: DataFrame, cfg: AggregationConfig) -> DataFrame:
    """Scores `(run_id, at, cluster, inside)` pairs of a document and a centre; `inside` leaves the document out of the centre."""
    group, pair = ["run_id", "cluster"], ["run_id", "at", "cluster"]
    own = live.select("run_id", "at", "effective_time", "bge_vector", "tfidf_vector")
    members = placed.select(*pair).join(own, ["run_id", "at"])
    heads = members.select(*group).distinct()
    for name in ("bge", "tfidf"):
        centre = centroids(members, group, f"{name}_vector", False)
        heads = heads.join(centre.select(*group, F.col("centroid").alias(f"{name}_centre"), F.col("member_count").alias(f"{name}_count"), norm(F.col("centroid")).alias(f"{name}_length")), group, "left")
    timed = members.where("effective_time is not null").select(*group, "at", "effective_time")
    for name, order in (("low", F.asc("effective_time")), ("high", F.desc("effective_time"))):
        ends = top_per_group(timed, group, [order, F.asc("at")], 2).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "effective_time", "at"))).alias(name))
        heads = heads.join(ends, group, "left")
    values = _values(live)
    held = placed.select(*pair).join(values, ["run_id", "at"]).groupBy(*group, "kind", "value").agg(F.count("*").alias("members"))
    sizes = held.groupBy(*group, "kind").agg(F.count("*").alias("theirs"))
    lone = F.col("inside") & (F.col("members") == 1)
    asked = pairs.select(*pair, "inside")
    common = asked.join(values, ["run_id", "at"]).join(held, [*group, "kind", "value"], "left").groupBy(*pair, "kind").agg(
        F.count("*").alias("own"), F.count_if(F.col("members").isNotNull() & ~lone).alias("common"), F.count_if(lone).alias("lone"))
    met = common.join(sizes, [*group, "kind"]).withColumn("theirs", F.col("theirs") - F.col("lone")).where("theirs > 0")
    kinds = met.groupBy(*pair).agg(
        F.avg(F.col("common") / (F.col("own") + F.col("theirs") - F.col("common"))).alias("entity"), F.collect_set(F.when(F.col("common") == 0, F.col("kind"))).alias("apart"))
    tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # narrow rows first: of the two vectors of a pair only the centre is shuffled with it
    own = own.select("*", *[norm(F.col(f"{name}_vector")).alias(f"{name}_norm") for name in ("bge", "tfidf")])
    both = asked.join(kinds, pair, "left").join(heads, group).repartition(tasks, "run_id", "at").join(own, ["run_id", "at"])
    return _centre_verdicts(both, cfg)


def _centre_verdicts(both: DataFrame, cfg: AggregationConfig) -> DataFrame:
    """Verdicts of pairs that carry the document and what is known of the centre."""
    end = lambda name: F.get(F.filter(name, lambda e: ~F.col("inside") | (e["at"] != F.col("at"))), F.lit(0))["effective_time"]
    without, signals = {"_low": end("low"), "_high": end("high")}, {}
    for name in ("bge", "tfidf"):
        own, mean, n = F.col(f"{name}_vector"), F.col(f"{name}_centre"), F.col(f"{name}_count")
        # the direction of the sum without the own vector; scaling does not change a cosine
        other = F.when(n > 1, F.transform(F.arrays_zip(mean.alias("m"), own.alias("v")), lambda z: z["m"] * n - z["v"]))
        without[f"_{name}"] = F.when(F.col("inside") & own.isNotNull(), other)
        outside = ~F.col("inside") | own.isNull()
        their = F.when(outside, mean).otherwise(F.col(f"_{name}"))
        length = F.when(outside, F.col(f"{name}_length")).otherwise(norm(F.col(f"_{name}")))
        signals[name] = (their, F.col(f"{name}_norm") * length)
    heard = both.withColumns(without).withColumns({f"_{name}_{c}": v for name, found in signals.items() for c, v in zip(("their", "length"), found)})
    own_time, low, apart = F.col("effective_time"), F.col("_low"), F.coalesce("apart", F.array().cast(_TEXTS))
    heard = heard.withColumns({
        **{name: cosine(F.col(f"{name}_vector"), F.col(f"_{name}_their"), F.col(f"_{name}_length")) for name in signals},
        "time": F.when(low.isNotNull(), time_compatibility(own_time, F.greatest(F.least(own_time, F.col("_high")), low), cfg.maximum_event_gap_days)),
        "clash": F.array_compact(F.array(*[F.when(F.array_contains(apart, key), code) for key, code in CONFLICTS]))})
    return heard.select("run_id", "at", "cluster", "inside", _verdict(cfg).alias("said"))


def _values(live: DataFrame) -> DataFrame:
    """`(run_id, at, kind, value)`: the distinct entity values of each document."""
    kinds = live.select("run_id", "at", F.explode("entities").alias("kind", "raw"))
    return kinds.select("run_id", "at", "kind", F.explode(folded(F.col("raw"))).alias("value"))
