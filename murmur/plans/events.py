"""Event assembly queries over embeddings, events and documents."""

from pyspark.sql import functions as F

from murmur.config import AggregationConfig
from murmur.operators import clustering, events as ev
from murmur.operators import sentiment
from murmur.plans.heat import at
from murmur.plans.registry import query, with_views
from murmur.plans.features import docs

# cosine of two float lists, in double precision
COS = "greatest(0e0, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.n * b.n))"
VEC = """vec AS MATERIALIZED (SELECT vec_id AS id, CAST(label AS VARCHAR) AS topic, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, ['k' || CAST(label % 3 AS VARCHAR), 'm' || CAST(vec_id % 7 AS VARCHAR)] AS kw
  FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e)"""
JAC = "(len(list_intersect(a.kw, b.kw)) / CAST(len(a.kw) + len(b.kw) - len(list_intersect(a.kw, b.kw)) AS DOUBLE))"


def vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("topic_category"),
        F.array(F.concat(F.lit("k"), F.col("label") % 3), F.concat(F.lit("m"), F.col("vec_id") % 7)).alias("keywords"))


def _neighbours(t):
    """Each vector beside its two successors."""
    v = vectors(t)
    left = v.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k")).withColumn("other", F.col("article_id") + F.col("k"))
    right = v.select(F.col("article_id").alias("other"), F.col("vector").alias("vb"), F.col("keywords").alias("kb"), F.col("topic_category").alias("tb"))
    return left.join(right, "other")


_NEXT = "FROM vec a JOIN vec b ON b.id BETWEEN a.id + 1 AND a.id + 2"


@query("E1_cosine_similarity", f"WITH {VEC} SELECT a.id AS article_id, b.id AS other, round({COS}, 6) AS score {_NEXT}")
def _(t):
    return _neighbours(t).select("article_id", "other", F.round(ev.cosine(F.col("vector"), F.col("vb")), 6).alias("score"))


@query("E2_set_similarity", f"WITH {VEC} SELECT a.id AS article_id, b.id AS other, round({JAC}, 6) AS score {_NEXT}")
def _(t):
    return _neighbours(t).select("article_id", "other", F.round(ev.set_similarity(F.col("keywords"), F.col("kb")), 6).alias("score"))


def _maps(t):
    one = lambda c, n: F.array(F.concat(F.lit("P"), F.pmod(F.col(c), F.lit(n)).cast("string")))
    return t.events.select(
        "event_id",
        F.map_from_arrays(F.array(F.lit("location"), F.lit("mention")), F.array(one("event_id", 3), one("user_id", 4))).alias("a"),
        F.map_from_arrays(F.array(F.lit("location"), F.lit("topic")), F.array(F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.lit(" p0 "), F.lit("p1"))), one("user_id", 2))).alias("b"))


@query("E3_entity_similarity", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 2 THEN 0e0 ELSE 0.5e0 END AS score FROM events""")
def _(t):
    return _maps(t).select("event_id", ev.entity_similarity(F.col("a"), F.col("b")).alias("score"))


@query("E4_hard_conflict", """SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 2 THEN 'LOCATION_CONFLICT' ELSE '' END AS codes FROM events""")
def _(t):
    return _maps(t).select("event_id", F.array_join(ev.conflicts(F.col("a"), F.col("b")), ",").alias("codes"))


_SIG = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 101) / 100e0 END AS bge, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 53) / 52e0 END AS tfidf, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.5e0 END AS entity, (event_id % 7) / 6e0 AS time FROM events"


@query("E5_match_score", f"""SELECT event_id, round((coalesce(bge * 0.55e0, 0) + coalesce(tfidf * 0.2e0, 0) + coalesce(entity * 0.15e0, 0) + time * 0.1e0)
    / (CASE WHEN bge IS NULL THEN 0 ELSE 0.55e0 END + CASE WHEN tfidf IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN entity IS NULL THEN 0 ELSE 0.15e0 END + 0.1e0), 6) AS score,
    concat_ws(',', CASE WHEN bge IS NULL THEN 'BGE_UNAVAILABLE' END, CASE WHEN tfidf IS NULL THEN 'TFIDF_UNAVAILABLE' END) AS warnings FROM ({_SIG}) s""")
def _(t):
    c = F.col("event_id")
    bge, tfidf = F.when(c % 4 != 0, (c % 101) / 100), F.when(c % 3 != 0, (c % 53) / 52)
    score = ev.match_score(bge, tfidf, F.when(c % 5 != 0, 0.5), (c % 7) / 6)
    return t.events.select("event_id", score.alias("score"), F.array_join(ev.match_warnings(bge, tfidf), ",").alias("warnings"))


@query("E6_time_compatibility", """SELECT event_id, round(pow(0.5e0, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-31 00:00:00')) / 86400000000e0 / 30), 6) AS score FROM events""")
def _(t):
    return t.events.select("event_id", F.round(ev.time_compatibility(F.col("ts").cast("timestamp"), at()), 6).alias("score"))


_RUN_CLUSTERS = "SELECT DISTINCT id // 50 AS run_id, id % 50 AS cluster_index, topic, kw FROM vec"


@query("E7_candidate_ranking", f"""WITH {VEC}, b AS ({_RUN_CLUSTERS}), s AS (SELECT a.id // 50 AS run_id, a.id AS article_id, b.cluster_index, CASE WHEN a.topic = b.topic THEN 1e0 ELSE 0e0 END + {JAC} AS s
    FROM vec a JOIN b ON b.run_id = a.id // 50)
    SELECT run_id, article_id, cluster_index, round(s, 6) AS candidate_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, cluster_index) AS rank FROM s) x WHERE rank <= 20""")
def _(t):
    v = vectors(t).withColumn("run_id", F.floor(F.col("article_id") / 50))
    return clustering.rank_candidates(v, v.withColumn("cluster_index", F.col("article_id") % 50)).withColumn("candidate_score", F.round("candidate_score", 6))


@query("E8_best_match", """SELECT user_id, cluster_index, score FROM (SELECT user_id, event_id AS cluster_index, floor(value / 10) AS score, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id) AS rn FROM events) x WHERE rn = 1""")
def _(t):
    rows = t.events.selectExpr("user_id", "event_id AS cluster_index", "CAST(floor(value / 10) AS DOUBLE) AS score")
    return ev.best_match(rows, ["user_id"])


def run_documents(t):
    """Vectors as the documents of runs, one run per block of 100 ids; some have a place, some lack a time or any evidence."""
    c = F.col("article_id")
    place = F.when(c % 4 == 0, F.array(F.concat(F.lit("L"), F.floor(c / 4) % 2))).otherwise(F.array().cast("array<string>"))
    bare = c % 41 == 40
    return vectors(t).select(
        F.floor(c / 100).alias("run_id"), "article_id", F.when(c % 13 != 12, F.timestamp_seconds(F.lit(1704067200) + c * 7200)).alias("effective_time"),
        "topic_category", F.when(~bare, F.col("keywords")).alias("keywords"),
        F.when(~bare, F.create_map(F.lit("topic"), F.array("topic_category"), F.lit("location"), place)).alias("entities"),
        F.when(~bare, F.transform("vector", lambda x: x.cast("double"))).alias("bge_vector"), F.lit(None).cast("array<double>").alias("tfidf_vector"))


# the same rule from all pairs of a run: ranks by window, founders by recursion, centres by averages
def _seeded_sql(p: str, rows: str, pairs: str) -> str:
    """`{p}(run, pos, cluster, follows, s, clash, noted)`: documents that follow, found or leave, from pairs with verdicts."""
    def judged(n: int) -> str:
        told, up = f"{p}told{n}", f"{p}up{n}"
        return f"""{up}(run, pos, root) AS (SELECT run, pos, pos FROM {told} WHERE parent IS NULL UNION ALL SELECT t.run, t.pos, u.root FROM {told} t JOIN {up} u ON t.run = u.run AND t.parent = u.pos),
    {p}cut{n} AS MATERIALIZED (SELECT t.*, u.root, coalesce(t.loc <> h.loc, false) AS split FROM {told} t JOIN {up} u USING (run, pos)
      LEFT JOIN (SELECT run, root, arg_min(loc, pos) AS loc FROM {told} JOIN {up} USING (run, pos) WHERE loc IS NOT NULL GROUP BY run, root) h ON h.run = u.run AND h.root = u.root)"""
    return f"""{p}told1 AS MATERIALIZED (SELECT d.run, d.pos, d.loc, b.s, b.clash, CASE WHEN NOT b.clash AND b.s >= 0.55 THEN b.other END AS parent FROM {rows} d LEFT JOIN
      (SELECT * FROM {pairs} QUALIFY row_number() OVER (PARTITION BY run, pos ORDER BY s DESC, other) = 1) b ON b.run = d.run AND b.pos = d.pos),
    {judged(1)},
    {p}told2 AS MATERIALIZED (SELECT c.run, c.pos, c.loc, c.s, c.clash, CASE WHEN w.root = c.root THEN c.parent END AS parent FROM {p}cut1 c LEFT JOIN {p}cut1 w ON w.run = c.run AND w.pos = c.parent AND w.split WHERE c.split),
    {judged(2)},
    {p} AS MATERIALIZED (SELECT run, pos, root AS cluster, parent IS NOT NULL AS follows, s, clash, false AS noted FROM {p}cut1 WHERE NOT split
      UNION ALL SELECT run, pos, CASE WHEN split THEN pos ELSE root END, parent IS NOT NULL AND NOT split, s, clash, parent IS NULL OR split FROM {p}cut2)"""


def _ranked_sql(p: str, wanted: str, placed: str, but: str = "false") -> str:
    """`{p}rank`: the 20 best clusters of the wanted documents, without those that `but` names."""
    return f"""{p}heads AS MATERIALIZED (SELECT run, cluster, arg_min(topic, pos) AS topic, list_distinct(flatten(list(kw))) AS kw FROM {placed} JOIN d USING (run, pos) GROUP BY run, cluster),
    {p}rank AS MATERIALIZED (SELECT a.run, a.pos, b.cluster, false AS inside FROM {wanted} w JOIN d a ON a.run = w.run AND a.pos = w.pos JOIN {p}heads b ON b.run = a.run WHERE NOT ({but})
      QUALIFY row_number() OVER (PARTITION BY a.run, a.pos ORDER BY CASE WHEN a.topic = b.topic THEN 1e0 ELSE 0e0 END + {JAC} DESC, b.cluster) <= 20)"""


def _against_sql(p: str, pairs: str, placed: str) -> str:
    """`{p}(run, pos, cluster, inside, s, clash)`: a document and a centre; `inside` leaves the document out of the centre."""
    return f"""{p}mean AS MATERIALIZED (SELECT run, cluster, list(x ORDER BY k) AS m, max(c) AS c FROM (SELECT run, cluster, k, avg(x) AS x, count(*) AS c
        FROM (SELECT run, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM {placed} JOIN d USING (run, pos)) GROUP BY run, cluster, k) GROUP BY run, cluster),
    {p}facts AS MATERIALIZED (SELECT q.run, q.pos, q.cluster, q.inside, count(DISTINCT o.topic) AS topics, coalesce(bool_or(o.topic = a.topic), false) AS same_topic, count(DISTINCT o.loc) AS locs,
        coalesce(bool_or(o.loc = a.loc), false) AS same_loc, min(o.t) AS low, max(o.t) AS high, count(o.pos) AS others
      FROM {pairs} q JOIN d a USING (run, pos) JOIN {placed} m ON m.run = q.run AND m.cluster = q.cluster LEFT JOIN d o ON o.run = m.run AND o.pos = m.pos AND NOT (q.inside AND m.pos = q.pos) GROUP BY q.run, q.pos, q.cluster, q.inside),
    {p}parts AS (SELECT f.run, f.pos, f.cluster, f.inside, d.loc IS NOT NULL AND locs > 0 AND NOT same_loc AS clash,
        CASE WHEN others > 0 THEN list_transform(range(1, len(v) + 1), lambda i: CASE WHEN inside THEN m[i] * c - v[i] ELSE m[i] END) END AS w, v, n,
        ((CASE WHEN topics > 0 THEN CASE WHEN same_topic THEN 1e0 / topics ELSE 0e0 END ELSE 0e0 END) + CASE WHEN d.loc IS NOT NULL AND locs > 0 AND same_loc THEN 1e0 / locs ELSE 0e0 END)
          / nullif(CASE WHEN topics > 0 THEN 1 ELSE 0 END + CASE WHEN d.loc IS NOT NULL AND locs > 0 THEN 1 ELSE 0 END, 0) AS ent,
        pow(0.5e0, CASE WHEN d.t < low THEN low - d.t WHEN d.t > high THEN d.t - high WHEN d.t IS NOT NULL AND low IS NOT NULL THEN 0 END * 7200e0 / 86400 / 30) AS tim
      FROM {p}facts f JOIN d USING (run, pos) JOIN {p}mean m ON m.run = f.run AND m.cluster = f.cluster),
    {p} AS MATERIALIZED (SELECT run, pos, cluster, inside, clash, coalesce(round((0.55e0 * coalesce(cos, 0) + 0.15e0 * coalesce(ent, 0) + 0.1e0 * coalesce(tim, 0))
        / nullif(CASE WHEN cos IS NULL THEN 0 ELSE 0.55e0 END + CASE WHEN ent IS NULL THEN 0 ELSE 0.15e0 END + CASE WHEN tim IS NULL THEN 0 ELSE 0.1e0 END, 0), 6), 0) AS s
      FROM (SELECT *, greatest(0e0, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])) / (n * sqrt(list_sum(list_transform(w, lambda x: x * x))))) AS cos FROM {p}parts))"""


def _best_sql(p: str, found: str) -> str:
    return f"{p} AS MATERIALIZED (SELECT * FROM {found} QUALIFY row_number() OVER (PARTITION BY run, pos ORDER BY s DESC, cluster) = 1)"


_E9 = f"""WITH RECURSIVE {VEC}, d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t NULLS LAST, id) - 1 AS pos FROM
      (SELECT id // 100 AS run, id, CASE WHEN id % 13 <> 12 THEN id END AS t, topic, kw, v, n, CASE WHEN id % 4 = 0 THEN (id // 4) % 2 END AS loc FROM vec WHERE id % 41 <> 40)),
    twins AS MATERIALIZED (SELECT run, pos, head AS other FROM (SELECT run, pos, min(pos) OVER (PARTITION BY run, topic, list_sort(kw), v, loc) AS head FROM d) WHERE head < pos),
    met AS (SELECT a.run, a.pos, b.pos AS other FROM d a JOIN d b ON a.run = b.run AND b.pos < a.pos
        QUALIFY row_number() OVER (PARTITION BY a.run, a.pos ORDER BY CASE WHEN a.topic = b.topic THEN 1e0 ELSE 0e0 END + {JAC} DESC, b.pos) <= 20
      UNION FROM twins),
    pairs AS MATERIALIZED (SELECT m.*, coalesce(a.loc <> b.loc, false) AS clash,
      round((0.55e0 * {COS} + 0.15e0 * (CASE WHEN a.topic = b.topic THEN 1e0 ELSE 0e0 END + CASE WHEN a.loc = b.loc THEN 1e0 ELSE 0e0 END) / (CASE WHEN a.loc IS NOT NULL AND b.loc IS NOT NULL THEN 2 ELSE 1 END)
        + coalesce(0.1e0 * pow(0.5e0, abs(a.t - b.t) * 7200e0 / 86400 / 30), 0)) / (0.7e0 + CASE WHEN a.t IS NULL OR b.t IS NULL THEN 0e0 ELSE 0.1e0 END), 6) AS s
      FROM met m JOIN d a ON a.run = m.run AND a.pos = m.pos JOIN d b ON b.run = m.run AND b.pos = m.other),
    unsure AS MATERIALIZED (SELECT run, pos FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY run, pos ORDER BY s DESC, other) = 1) WHERE NOT clash AND s >= 0.4 AND s < 0.55),
    aside AS MATERIALIZED (FROM unsure UNION SELECT t.run, t.pos FROM twins t JOIN unsure u ON u.run = t.run AND u.pos = t.other),
    rest AS MATERIALIZED (SELECT * FROM d ANTI JOIN aside USING (run, pos)),
    open_pairs AS MATERIALIZED (SELECT * FROM pairs p WHERE (run, pos) NOT IN (SELECT (run, pos) FROM aside) AND (run, other) NOT IN (SELECT (run, pos) FROM aside)),
    {_seeded_sql('seeds', 'rest', 'open_pairs')},
    {_ranked_sql('retry', 'aside', 'seeds')},
    {_against_sql('heard_all', 'retryrank', 'seeds')},
    {_best_sql('heard', 'heard_all')},
    fits AS (SELECT * FROM heard WHERE NOT clash AND s >= 0.55),
    failed AS MATERIALIZED (SELECT a.run, a.pos, h.s, h.clash FROM aside a LEFT JOIN heard h USING (run, pos) WHERE h.s IS NULL OR h.clash OR h.s < 0.55),
    failed_docs AS MATERIALIZED (SELECT d.* FROM d SEMI JOIN failed USING (run, pos)),
    among AS MATERIALIZED (SELECT * FROM pairs WHERE (run, pos) IN (SELECT (run, pos) FROM failed) AND (run, other) IN (SELECT (run, pos) FROM failed)),
    {_seeded_sql('fresh', 'failed_docs', 'among')},
    placed AS MATERIALIZED (SELECT run, pos, cluster, follows, s, clash, noted, false AS ambiguous, false AS late FROM seeds
      UNION ALL SELECT run, pos, cluster, true, s, clash, false, true, false FROM fits
      UNION ALL SELECT run, pos, cluster, follows, CASE WHEN follows THEN f.s ELSE x.s END, CASE WHEN follows THEN f.clash ELSE x.clash END, noted, true, NOT follows AND NOT coalesce(x.clash, true) FROM fresh f JOIN failed x USING (run, pos)),
    followers AS MATERIALIZED (SELECT run, pos, cluster AS own FROM placed WHERE follows),
    {_ranked_sql('move', 'followers', 'placed', 'b.cluster = w.own')},
    versus AS MATERIALIZED (SELECT * FROM moverank UNION ALL SELECT run, pos, own, true FROM followers),
    {_against_sql('moving', 'versus', 'placed')},
    away AS (SELECT * FROM moving WHERE NOT inside), {_best_sql('there', 'away')},
    moves AS (SELECT t.* FROM there t JOIN moving h ON h.run = t.run AND h.pos = t.pos AND h.inside WHERE NOT t.clash AND t.s >= 0.55 AND round(t.s - h.s, 6) >= 0.1),
    final AS MATERIALIZED (SELECT p.*, m.s AS ms, coalesce(m.cluster, p.cluster) AS c FROM placed p LEFT JOIN moves m USING (run, pos)),
    numbered AS (SELECT run, c, row_number() OVER (PARTITION BY run ORDER BY min(pos)) - 1 AS no FROM final GROUP BY run, c)
    SELECT f.run AS run_id, d.id AS article_id, n.no AS cluster_index, CASE WHEN ambiguous THEN 'ambiguous' WHEN follows THEN 'attach' ELSE 'create' END AS first_action,
      CASE WHEN ms IS NOT NULL THEN 'moved' WHEN follows THEN 'attach' ELSE 'create' END AS action, coalesce(ms, s, 0e0) AS similarity,
      concat_ws(',', CASE WHEN (clash AND ms IS NULL) OR noted THEN 'LOCATION_CONFLICT' END, CASE WHEN late THEN 'AMBIGUOUS_AFTER_REFINEMENT' END, CASE WHEN ms IS NOT NULL THEN 'MOVE_MARGIN_MET' END) AS reasons,
      CASE WHEN s IS NULL AND ms IS NULL THEN '' ELSE 'TFIDF_UNAVAILABLE' END AS warnings
    FROM final f JOIN d ON d.run = f.run AND d.pos = f.pos JOIN numbered n ON n.run = f.run AND n.c = f.c
    UNION ALL SELECT id // 100, id, NULL, 'deferred', 'deferred', 0e0, 'INSUFFICIENT_EVIDENCE', '' FROM vec WHERE id % 41 = 40"""


@query("E9_cluster_runs", _E9)
def _(t):
    return clustering.cluster_runs(run_documents(t)).select(
        "run_id", "article_id", "cluster_index", "first_action", "action", "similarity", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"))


@query("E10_nearest_event", f"""WITH {VEC}, b AS (SELECT * FROM vec WHERE id % 10 = 0), s AS (SELECT a.id AS article_id, b.id AS event_id, round({COS}, 6) AS s FROM vec a CROSS JOIN b WHERE a.id % 10 <> 0),
    m AS (SELECT article_id, event_id, s, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, event_id) AS rn FROM s)
    SELECT article_id, CASE WHEN s >= 0.55 THEN event_id END AS event_id, CASE WHEN s >= 0.55 THEN 'attach' ELSE 'create' END AS action, s AS similarity FROM m WHERE rn = 1""")
def _(t):
    v = vectors(t)
    return ev.nearest_events(v.where("article_id % 10 <> 0"), v.where("article_id % 10 = 0").withColumnRenamed("article_id", "event_id"))


# stored events: all vectors, each with its first two components exchanged
@query("E11_stored_event_match", f"""WITH {VEC}, turned AS MATERIALIZED (SELECT id, kw, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT id, kw, list_concat(v[2:2], v[1:1], v[3:]) AS v FROM vec)), s AS (SELECT a.id AS cluster_id, b.id AS event_id, round((0.55e0 * {COS} + 0.15e0 * {JAC} + 0.1e0) / 0.8e0, 6) AS s FROM vec a CROSS JOIN turned b),
    m AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, event_id) AS rn FROM s)
    SELECT cluster_id, CASE WHEN s >= 0.55 THEN event_id END AS event_id, s AS match_score FROM m WHERE rn = 1""")
def _(t):
    v = vectors(t).withColumn("entities", F.create_map().cast("map<string,array<string>>"))
    turned = v.withColumn("vector", F.concat(F.slice("vector", 2, 1), F.slice("vector", 1, 1), F.slice("vector", 3, 1 << 20)))
    return ev.match_stored_events(v.withColumnRenamed("article_id", "cluster_id"), turned.withColumnRenamed("article_id", "event_id"))


@query("E12_move_margin", """SELECT event_id AS cluster_id, CASE WHEN cur IS NOT NULL AND (cs IS NULL OR (new IS NOT NULL AND new <> cur AND ns - cs < 0.1e0)) THEN cur ELSE new END AS event_id,
    CASE WHEN cur IS NOT NULL AND (cs IS NULL OR (new IS NOT NULL AND new <> cur AND ns - cs < 0.1e0)) THEN 'kept' WHEN new IS NOT NULL THEN 'matched' ELSE 'created' END AS decision
    FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS cur, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 0.6e0 END AS cs, CASE WHEN event_id % 4 <> 0 THEN user_id + event_id % 2 END AS new, 0.6e0 + (event_id % 30) / 100e0 AS ns FROM events) x""")
def _(t):
    c = F.col("event_id")
    rows = t.events.select(
        c.alias("cluster_id"), F.when(c % 3 != 0, F.col("user_id")).alias("current_event_id"), F.when((c % 3 != 0) & (c % 5 != 0), 0.6).alias("current_score"),
        F.when(c % 4 != 0, F.col("user_id") + c % 2).alias("event_id"), (0.6 + (c % 30) / 100).alias("match_score"))
    return ev.resolve_moves(rows).select("cluster_id", "event_id", "decision")


def _memberships(t):
    return t.events.select(F.col("event_id").alias("article_id"), F.col("user_id").alias("event_id"), F.col("ts").cast("timestamp").alias("valid_from"),
                           F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_active"))


@query("E13_membership_history", """SELECT article_id, event_id, action, closed FROM (
    SELECT event_id AS article_id, user_id AS event_id, CASE WHEN event_id % 5 = 0 THEN 'closed' ELSE 'unchanged' END AS action, event_id % 5 = 0 AS closed FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, user_id + 1000, 'moved', false FROM events WHERE event_id % 3 <> 0 AND event_id % 5 = 0
    UNION ALL SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id + 1000 ELSE user_id END, 'attach', false FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0) x""")
def _(t):
    current = _memberships(t).where("article_id % 3 <> 0")
    assigned = t.events.where("event_id % 3 <> 0 OR event_id % 7 <> 0").selectExpr("event_id AS article_id", "CASE WHEN event_id % 5 = 0 THEN user_id + 1000 ELSE user_id END AS event_id")
    return ev.update_memberships(current, assigned, at()).select("article_id", "event_id", "action", F.col("valid_to").isNotNull().alias("closed"))


@query("E14_duplicate_inheritance", """SELECT d.event_id AS article_id, o.user_id AS event_id, 'DUPLICATE_INHERITANCE' AS reason FROM events d JOIN events o ON o.event_id = d.event_id - d.event_id % 4 AND o.event_id % 8 = 0 WHERE d.event_id % 4 <> 0""")
def _(t):
    dup = t.events.where("event_id % 4 <> 0").selectExpr("event_id AS article_id", "event_id - event_id % 4 AS duplicate_of_id")
    assigned = t.events.where("event_id % 4 = 0").selectExpr("event_id AS article_id", "CASE WHEN event_id % 8 = 0 THEN 1 END AS cluster_index", "user_id AS event_id", "0.5D AS similarity")
    return ev.inherit_assignments(dup, assigned).select("article_id", "event_id", "reason")


@query("E15_event_roll_up", with_views("heat_article", """SELECT event_id, strftime(min(coalesce(publish_time, observed_at)), '%Y-%m-%d %H:%M:%S') AS first_publish_time, strftime(max(coalesce(publish_time, observed_at)), '%Y-%m-%d %H:%M:%S') AS last_activity_time,
    count(*) FILTER (WHERE is_representative) AS independent_report_count, count(DISTINCT platform) AS platform_count FROM heat_article GROUP BY 1"""))
def _(t):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ev.roll_up(t.heat_article).select("event_id", stamp("first_publish_time"), stamp("last_activity_time"), "independent_report_count", "platform_count")


@query("E16_event_representation", f"""WITH {VEC} SELECT topic AS event_id, count(*) FILTER (WHERE id % 4 <> 0) AS member_count, (SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM (SELECT topic AS tt, unnest(kw) AS k FROM vec) z WHERE z.tt = topic) AS keywords,
    (SELECT string_agg(DISTINCT '@u' || CAST(id % 6 AS VARCHAR), ',') FROM vec v2 WHERE false) AS none, string_agg(DISTINCT CASE WHEN id % 4 <> 0 THEN '@u' || CAST(id % 6 AS VARCHAR) END, ',' ORDER BY CASE WHEN id % 4 <> 0 THEN '@u' || CAST(id % 6 AS VARCHAR) END) AS mentions,
    (SELECT round(list_sum(list_transform(range(1, len(c) + 1), lambda i: i * c[i])) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) FROM
      (SELECT list(x ORDER BY k) AS c FROM (SELECT k, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS k FROM vec w WHERE w.topic = vec.topic AND w.id % 4 <> 0) GROUP BY k))) AS centre
    FROM vec GROUP BY topic""")
def _(t):
    v = vectors(t)
    members = v.select(F.col("topic_category").alias("event_id"), "article_id", "vector", (F.col("article_id") % 4 != 0).alias("is_representative"),
                       F.array(F.concat(F.lit("@u"), F.col("article_id") % 6)).alias("mentions"), F.array().cast("array<string>").alias("topics"))
    out = ev.event_representations(members, v.select("article_id", F.explode("keywords").alias("term")))
    return out.select("event_id", "member_count", F.array_join("keywords", ",").alias("keywords"), F.lit(None).cast("string").alias("none"), F.array_join(F.col("entities")["mention"], ",").alias("mentions"),
                      F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("centre"))


def _assigned(t):
    return t.events.select(
        (F.col("user_id") % 10).alias("run_id"), (F.col("user_id") % 40).alias("cluster_index"), F.col("event_id").alias("article_id"), F.col("event_type").alias("platform"),
        F.concat_ws(" ", F.col("event_type"), F.repeat(F.lit("word "), (F.col("event_id") % 30).cast("int")), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp")).alias("effective_time"), (F.col("event_id") % 100 / 100).alias("similarity"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'deferred' ELSE 'attach' END").alias("action"),
        F.when(F.col("event_id") % 6 == 0, F.array(F.lit("BGE_UNAVAILABLE"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


@query("E17_cluster_summary", """WITH r AS (SELECT user_id % 10 AS run_id, user_id % 40 AS cluster_index, event_id, event_type, CASE WHEN event_id % 9 <> 0 THEN ts END AS t, event_id % 100 / 100e0 AS s,
      event_type || ' ' || repeat('word ', CAST(event_id % 30 AS INT)) || ' ' || CAST(event_id AS VARCHAR) AS title FROM events),
    g AS (SELECT run_id, cluster_index, arg_min(event_id, (CASE WHEN t IS NULL THEN 1 ELSE 0 END, coalesce(t, TIMESTAMP '2100-01-01'), event_id)) AS representative_article_id, count(*) AS member_count, count(DISTINCT event_type) AS platform_count, max(s) AS confidence,
      arg_max(title, (length(title), -event_id)) AS title FROM r GROUP BY 1, 2)
    SELECT run_id, cluster_index, representative_article_id, member_count, platform_count, confidence,
      CASE WHEN length(title) <= 80 THEN title WHEN 80 - strpos(reverse(substr(title, 1, 80)), ' ') > 40 THEN substr(title, 1, 81 - strpos(reverse(substr(title, 1, 80)), ' ')) ELSE substr(title, 1, 77) || '...' END AS title FROM g""")
def _(t):
    return ev.cluster_summaries(_assigned(t)).select("run_id", "cluster_index", "representative_article_id", "member_count", "platform_count", "confidence", "title")


@query("E18_cluster_title", """SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN strpos(substr(t, 1, 80), ' ') > 0 AND 80 - strpos(reverse(substr(t, 1, 80)), ' ') > 40 THEN substr(t, 1, 81 - strpos(reverse(substr(t, 1, 80)), ' ')) ELSE substr(t, 1, 77) || '...' END AS title
    FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents) x""")
def _(t):
    return t.documents.select("doc_id", ev.cut_title(F.split("text", "\n")[0]).alias("title"))


@query("E19_run_statistics", """SELECT user_id % 10 AS run_id, count(*) AS input_count, count(DISTINCT user_id % 40) AS cluster_count, count(*) FILTER (WHERE event_id % 4 = 0) AS create_count, count(*) FILTER (WHERE event_id % 4 > 1) AS attach_count,
    count(*) FILTER (WHERE event_id % 4 = 1) AS deferred_count, 'BGE_UNAVAILABLE' AS warnings FROM events GROUP BY 1""")
def _(t):
    return ev.run_statistics(_assigned(t)).select("run_id", "input_count", "cluster_count", "create_count", "attach_count", "deferred_count", F.array_join("warnings", ",").alias("warnings"))


@query("E20_publish_clusters", """SELECT user_id % 10 AS run_id, user_id % 40 AS cluster_index, event_id AS article_id FROM events WHERE user_id % 40 >= 5""")
def _(t):
    assigned = _assigned(t)
    clusters = ev.cluster_summaries(assigned)
    done, _members = ev.publish_clusters(clusters.where("cluster_index < 5"), assigned, clusters.select(F.lit(-1).cast("long").alias("event_id")))
    fresh, members = ev.publish_clusters(clusters, assigned, done)
    return fresh.select("run_id", "cluster_index", "event_id").join(members, "event_id").select("run_id", "cluster_index", "article_id")


@query("E21_merge_review", """SELECT event_id AS article_id, user_id AS event_id, user_id % 10 <> 3 AS is_active FROM events UNION ALL SELECT event_id, user_id + 1, true FROM events WHERE user_id % 10 = 3""")
def _(t):
    records = t.events.select("user_id").distinct().selectExpr(
        "user_id AS source_event_id", "user_id + 1 AS target_event_id", "CASE user_id % 10 WHEN 3 THEN 'confirmed' WHEN 4 THEN 'rejected' ELSE 'pending' END AS decision")
    return ev.review_merges(_memberships(t), records, at()).select("article_id", "event_id", "is_active")


@query("E22_related_events", f"""WITH {VEC}, s AS (SELECT a.id AS event_id, b.id AS related_event_id, round((0.65e0 * {COS} + 0.15e0 * {JAC} + 0.05e0 * CASE WHEN a.topic = b.topic THEN 1 ELSE 0 END) / 0.85e0, 6) AS similarity
    FROM vec a CROSS JOIN vec b WHERE a.id <> b.id AND b.id % 11 <> 0)
    SELECT event_id, related_event_id, CAST(rank AS INT) AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY similarity DESC, related_event_id) AS rank FROM s) x WHERE rank <= 5""")
def _(t):
    e = vectors(t).withColumnRenamed("article_id", "event_id").withColumns({
        "entities": F.create_map().cast("map<string,array<string>>"), "first_publish_time": F.lit(None).cast("timestamp")})
    aliases = t.embeddings.where("vec_id % 11 = 0").selectExpr("vec_id AS source_event_id")
    return ev.related_events(e, aliases).select("event_id", "related_event_id", "rank", "similarity")


def _event_rows(t):
    return t.documents.select(
        F.col("doc_id").alias("event_id"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.col("source").alias("topic_name"), F.col("text").alias("summary"),
        F.array(F.col("lang"), F.lit("erat")).alias("keywords"), (F.col("doc_id") % 3 == 0).alias("is_hot"))


@query("P4_event_filter", """SELECT doc_id AS event_id FROM documents WHERE doc_id % 3 = 0 AND (contains(lower(substr(split_part(text, chr(10), 1), 1, 80)), 'erat') OR contains(lower(source), 'erat') OR contains(lower(text), 'erat'))""")
def _(t):
    return ev.filter_events(_event_rows(t), "erat", hot=True).select("event_id")


@query("E23_keyword_search", """SELECT event_id, s AS similarity FROM (SELECT doc_id AS event_id, CASE WHEN contains(lower(substr(split_part(text, chr(10), 1), 1, 80)), 'erat en') THEN 1e0 ELSE 0e0 END + CASE WHEN lang = 'en' THEN 1e0 ELSE 0.5e0 END
    + CASE WHEN contains(lower(text), 'erat en') THEN 0.5e0 ELSE 0e0 END AS s FROM documents) x ORDER BY s DESC, event_id LIMIT 20""")
def _(t):
    return ev.search_events(_event_rows(t), "erat en").select("event_id", "similarity")


@query("E27_relevant_cluster", """WITH s AS (SELECT user_id % 10 AS run_id, event_id AS cluster_id, event_id % 9 AS member_count,
      CASE WHEN event_type = 'view' THEN 10e0 ELSE 0 END + CASE WHEN contains(event_type, 'r') THEN 2e0 ELSE 0 END + least(event_id % 9, 5) - CASE WHEN contains(event_type, 'p') AND NOT contains(event_type, 'n') THEN 6e0 ELSE 0 END AS sc FROM events)
    SELECT run_id, cluster_id, sc AS selection_score FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sc DESC, member_count DESC, cluster_id) = 1 AND sc >= 6""")
def _(t):
    rows = t.events.selectExpr("user_id % 10 AS run_id", "event_id AS cluster_id", "event_id % 9 AS member_count", "event_type AS text")
    return ev.relevant_cluster(rows, "view", ("zz", "yy"), ["film"], ["r"], [(["p"], ["n"], 6.0)]).select("run_id", "cluster_id", "selection_score")


@query("E28_frozen_inputs", """SELECT d.doc_id AS article_id, d.source AS platform, d.doc_id IN (SELECT vec_id FROM embeddings) AS has_vector, CASE WHEN d.doc_id % 2 = 0 THEN d.lang END AS topic_category FROM documents d WHERE d.doc_id % 7 <> 0""")
def _(t):
    d = docs(t)
    run_rows = d.select(F.lit(1).alias("run_id"), "article_id", F.lit("x").alias("content_identity"), F.array().cast("array<string>").alias("keywords"), (F.col("article_id") % 7 != 0).alias("is_representative"))
    articles = d.select("article_id", "title", "platform", F.lit(None).cast("timestamp").alias("publish_time"), F.lit(None).cast("timestamp").alias("observed_at"))
    feats = d.select("article_id", F.array().cast("array<string>").alias("mentions"), "topics")
    topics = t.documents.where("doc_id % 2 = 0").selectExpr("doc_id AS article_id", "lang AS topic_category")
    return ev.frozen_inputs(run_rows, articles, feats, vectors(t), topics).select("article_id", "platform", F.col("bge_vector").isNotNull().alias("has_vector"), "topic_category")


@query("E29_sentiment_targets", """WITH good AS (SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0 AND event_type <> 'signup' AND event_id % 7 <> 0)
    SELECT user_id % 10 AS run_id, CASE WHEN user_id % 2 = 0 THEN 'e' || CAST(user_id % 50 AS VARCHAR) ELSE 'c' || CAST(user_id % 40 AS VARCHAR) END AS target, event_id AS article_id FROM good
    WHERE user_id % 2 = 1 OR true GROUP BY ALL""".replace("WHERE user_id % 2 = 1 OR true ", ""))
def _(t):
    keys = t.events.selectExpr("user_id % 10 AS run_id", "user_id % 40 AS cluster_index", "user_id % 50 AS e", "user_id % 2 AS odd").distinct()
    clusters = keys.selectExpr("run_id", "cluster_index", "CASE WHEN odd = 0 THEN e END AS event_id", "CASE WHEN odd = 0 THEN 'global' ELSE 'search_shared' END AS scope")
    memberships = t.events.where("user_id % 2 = 0").selectExpr("event_id AS article_id", "user_id % 50 AS event_id", "true AS is_active")
    assignments = t.events.where("user_id % 2 = 1").selectExpr("user_id % 10 AS run_id", "user_id % 40 AS cluster_index", "event_id AS article_id")
    articles = t.events.selectExpr("event_id AS article_id", "'success' AS clean_status", "'t' AS title", "'' AS clean_content", "CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS nlp_weight",
                                   "event_id % 7 = 0 AS is_advertisement", "CASE WHEN event_type = 'signup' THEN 'hotlist' ELSE 'news' END AS source_type", "true AS is_representative")
    return ev.sentiment_targets(clusters, memberships, assignments, articles).select("run_id", "target", "article_id")


@query("P2_sentiment_eligibility", """SELECT event_id AS article_id FROM events WHERE event_id % 5 <> 0 AND event_type <> 'signup' AND event_id % 7 <> 0""")
def _(t):
    articles = t.events.selectExpr("event_id AS article_id", "'success' AS clean_status", "'t' AS title", "'' AS clean_content", "CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS nlp_weight",
                                   "event_id % 7 = 0 AS is_advertisement", "CASE WHEN event_type = 'signup' THEN 'hotlist' ELSE 'news' END AS source_type")
    return sentiment.eligible_articles(articles).select("article_id")


@query("P3_time_window", with_views("heat_article", """SELECT article_id FROM heat_article WHERE coalesce(publish_time, observed_at) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"""))
def _(t):
    moment = F.coalesce("publish_time", "observed_at")
    return t.heat_article.where(moment.between(F.expr("TIMESTAMP '2024-01-10'"), F.expr("TIMESTAMP '2024-01-20'"))).select("article_id")
