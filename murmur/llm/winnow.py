"""Document fingerprints by winnowing, in column expressions only.

A text is read as tokens (runs of non-space, cut at 16 code points, so that text without spaces is covered too). Every
run of GRAM tokens has a rolling hash; in every window of WINDOW such hashes the smallest is chosen, the rightmost
between equals, and kept with its place. Guarantee: two texts that share GRAM + WINDOW - 1 tokens share a choice.

Defined cases: a text of fewer than GRAM tokens has one gram, of all its tokens; one of fewer than WINDOW grams has one
window; null or blank text has the empty fingerprint. Two empty fingerprints have likeness 1, one empty 0. No rows give
no rows, repeated rows are fingerprinted each, extra columns are kept by `with_next`."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

GRAM, WINDOW = 4, 16  # GRAM is a power of two: runs are extended by doubling
#: Documents that one range of the reading order holds on average, and the most ranges kept in one small table.
RANGE_ROWS, MOST_RANGES = 2_000, 20_000
_LOW = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, although `use` names it often or inside a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,16}"), F.lit(0))


def _grams(words: Column) -> Column:
    """Hashes of all runs of GRAM tokens: a run of 2n tokens joins the run of n here and the one n places on."""
    def doubled(runs: Column, n: int) -> Column:
        return let(runs, lambda r: F.zip_with(
            F.slice(r, F.lit(1), F.size(r) - n), F.slice(r, F.lit(1 + n), F.size(r) - n), lambda a, b: F.xxhash64(a, b)
        ))

    runs, n = F.transform(words, lambda w: F.xxhash64(w)), 1
    while n < GRAM:
        runs, n = doubled(runs, n), 2 * n
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) < GRAM, short).otherwise(runs)


def _winnowed(hashes: Column) -> Column:
    # hash bits above, distance from the right end below: the least value is the rightmost of the least hashes
    ranked = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31).bitwiseOR((F.lit(_LOW) - i).cast("bigint")))
    least = let(ranked, lambda r: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(r) - (WINDOW - 1), F.lit(1))),
        lambda i: F.array_min(F.slice(r, i, F.lit(WINDOW))),
    )))
    at = F.transform(least, lambda v: (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("int"))
    picked = F.transform(at, lambda i: F.struct(F.get(hashes, i).alias("hash"), i.alias("at")))
    return F.when(F.size(hashes) > 0, picked).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))


def fingerprint(text: Column) -> Column:
    """Chosen `(hash, at)` pairs in text order; `at` is the gram's first token, counted from 0."""
    return let(let(tokens(text), _grams), _winnowed)


def shown(prints: Column) -> Column:
    """A fingerprint as text: `hash:place` pairs, joined by spaces."""
    return F.concat_ws(" ", F.transform(prints, lambda p: F.concat(F.lower(F.hex(p["hash"])), F.lit(":"), p["at"].cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints (Jaccard of the hash sets, places aside)."""
    shared = F.size(F.array_intersect(a["hash"], b["hash"]))
    both = F.size(F.array_union(a["hash"], b["hash"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _ranges(docs: DataFrame, key: str) -> Column | None:
    """A range number that grows with the key: even cuts of its span, and crowded cuts split once more on their own span."""
    low, high, n = docs.agg(F.min(key), F.max(key), F.count("*")).first()
    if low is None or n <= RANGE_ROWS:
        return F.lit(0)
    cuts = min(MOST_RANGES, -(-n // RANGE_ROWS))
    def even(value: Column, low, high, parts) -> Column:
        share = (value.cast("double") - low) / F.greatest(F.lit(1.0), (high.cast("double") if isinstance(high, Column) else F.lit(float(high))) - low)
        return F.when(value.isNull(), F.lit(0)).otherwise(F.least(F.floor(share * parts), parts - 1)).cast("int")
    first = even(F.col(key), F.lit(float(low)), high, F.lit(cuts))
    crowded = docs.groupBy(first.alias("_c")).agg(F.min(key).alias("_l"), F.max(key).alias("_h"), F.count("*").alias("_n")).where(
        F.col("_n") > 4 * RANGE_ROWS
    )
    found = crowded.orderBy(F.desc("_n")).limit(200).collect()  # at most 200 hold over 1/200 of all rows
    number = first.cast("long") * MOST_RANGES
    for c in found:
        if c["_l"] is not None and c["_h"] > c["_l"]:
            parts = max(2, min(-(-c["_n"] // RANGE_ROWS), MOST_RANGES * c["_n"] // n))
            inner = even(F.col(key), F.lit(float(c["_l"])), c["_h"], F.lit(parts))
            number = F.when(first == c["_c"], F.lit(c["_c"]).cast("long") * MOST_RANGES + inner).otherwise(number)
    return number


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds `_print` (fingerprint of the text), and `_next`, `_next_print` of the following row by ascending key.

    After the last row comes the first. Rows meet once, in ranges of the key; a range takes the first row of the one
    behind it from a table with one row per range. Keys may repeat (ties by the text's hash) or be null (first)."""
    number = _ranges(docs.select(key), key)
    spread = docs.withColumn("_range", number.cast("long"))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(F.col(text))]
    heads = spread.groupBy("_range").agg(F.min(key).alias("_head"), F.sum(F.col(key).isNull().cast("int")).alias("_nulls"))
    heads = heads.select("_range", F.when(F.col("_nulls") == 0, F.col("_head")).alias("_head"))
    # one row per range, at most 2 * MOST_RANGES + 400: the ids are sent to all, the texts meet their range by shuffle
    first = spread.select("_range", key, text).join(
        F.broadcast(heads), (spread["_range"] == heads["_range"]) & spread[key].eqNullSafe(heads["_head"]), "left_semi"
    ).groupBy("_range").agg(F.min_by(text, F.struct(key, F.xxhash64(F.col(text)))).alias("_first"))
    line = Window.partitionBy(F.lit(0)).orderBy("_range")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    behind = first.select("_range", F.coalesce(F.lead(F.struct("_first")).over(line), F.first(F.struct("_first")).over(whole)).alias("_behind"))
    behind = behind.select("_range", F.col("_behind._first").alias("_behind"))
    behind = behind.withColumn("_behind_print", fingerprint(F.col("_behind")))
    here = spread.repartition("_range").withColumn("_print", fingerprint(F.col(text)))
    inside = Window.partitionBy("_range").orderBy(*order)
    led = here.withColumn("_lead", F.lead(F.struct(F.col(text).alias("t"), F.col("_print").alias("p"))).over(inside))
    joined = led.join(behind.hint("merge"), "_range", "left")
    last = F.col("_lead").isNull()
    return joined.select(
        *docs.columns, "_print", F.when(last, F.col("_behind")).otherwise(F.col("_lead.t")).alias("_next"),
        F.when(last, F.col("_behind_print")).otherwise(F.col("_lead.p")).alias("_next_print"),
    )
