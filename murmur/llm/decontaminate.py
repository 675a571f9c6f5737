"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

1. The index: postings (term, document key, place) of every corpus token whose term occurs in the benchmark, written once.
2. Benchmark windows of WINDOW words; each is looked up from its two rarest terms (by postings in the index). A window
   with a term that has no posting cannot occur and is dropped before any list is read.
3. The list of the rarest term, shifted by the term's offset in the window, gives possible starts; they are intersected
   with the equally shifted list of the second rarest.
4. The starts left are compared word by word with the document: an exact phrase, or within `slop` for proximity.

Defined cases: null or wordless text has no words and no hit; an item of fewer than WINDOW words, but not none, is one
window; equal windows of several items are looked up once and count for each item; a null item id counts as a hit but is
no item; repeated rows are judged each; an empty benchmark hits nothing; extra columns are kept, a column named like a
result is replaced. Documents are keyed by a hash of id and text: a collision only adds starts that step 4 refuses."""

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from murmur.llm.shared import written

WINDOW = 10
#: Windows (and their terms), and starts to compare, are sent to all executors up to so many (some 100 bytes each);
#: beyond, they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_STARTS = 300_000, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased, then all runs of a-z, 0-9 and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    # the built-in lower() is the quick way and means the same for pure ASCII
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """Distinct windows: `wid`, their words `w`, the same as one `phrase`, and the ids of the items that hold them."""
    cut = items.select(F.col(item).alias("item"), words(F.col(text)).alias("all")).where(F.size("all") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("all") - (length - 1), F.lit(1)))
    one = cut.select("item", "all", F.explode(places).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(length)).alias("w"))
    return one.groupBy("w").agg(F.collect_set(F.col("item").cast("string")).alias("items")).select(
        F.sha2(F.concat_ws(" ", "w"), 256).alias("wid"), "w", F.concat_ws(" ", "w").alias("phrase"), "items"
    )


def index(docs: DataFrame, windows: DataFrame, key: str, text: str) -> DataFrame:
    """Stored postings `(term, key, at)` of all tokens whose term occurs in a window; `at` counts words from 0."""
    terms = windows.select(F.explode("w").alias("term")).distinct()
    terms = written(terms, "bench-terms")
    tokens = docs.select(F.col(key).alias("key"), F.posexplode(words(F.col(text))).alias("at", "term"))
    return written(tokens.join(_small(terms, terms.count()), "term").select("term", "key", "at"), "postings")


def starts(postings: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Possible starts `(key, start, phrase, items)`: offset-adjusted lists of each window's two rarest terms, intersected.

    With `slop` the two lists may disagree by so many places."""
    df = written(postings.groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    parts = windows.select("wid", F.posexplode("w").alias("o", "term")).join(df, "term", "left")
    rare = Window.partitionBy("wid").orderBy(F.col("df"), "term", "o")
    ordered = parts.withColumns({"r": F.row_number().over(rare), "least": F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("wid"))})
    # the places of a term in one window are alternatives of the same list: the second must be another place
    chosen = ordered.where("least > 0 and r <= 2").groupBy("wid").agg(
        F.max(F.when(F.col("r") == 1, F.struct("term", "o"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("term", "o"))).alias("b")
    )
    chosen = written(chosen.select("wid", F.col("a.term").alias("term"), F.col("a.o").alias("o"), F.col("b.term").alias("term2"), F.col("b.o").alias("o2")), "window-terms")
    n = chosen.count()
    first = postings.join(_small(chosen, n), "term").select("wid", "key", (F.col("at") - F.col("o")).alias("start"), "term2", "o2").where("start >= 0")
    seconds = postings.join(_small(chosen.where("term2 is not null").select(F.col("term2").alias("term")).distinct(), n), "term", "left_semi")
    seconds = seconds.select(F.col("term").alias("term2"), "key", F.col("at").alias("at2"))
    if slop:
        # neighbouring cells of slop + 1 places meet; the exact distance is tested after
        cell = slop + 1
        asked = first.where("term2 is not null").withColumn("_cell", F.explode(F.array(*[F.floor((F.col("start") + F.col("o2")) / cell) + d for d in (-1, 0, 1)])))
        met = asked.join(seconds.withColumn("_cell", F.floor(F.col("at2") / cell)), ["term2", "key", "_cell"]).where(F.abs(F.col("at2") - F.col("start") - F.col("o2")) <= slop)
    else:
        met = first.where("term2 is not null").withColumn("at2", F.col("start") + F.col("o2")).join(seconds, ["term2", "key", "at2"], "left_semi")
    alone = first.where("term2 is null")  # windows of one word
    return met.select("wid", "key", "start").unionByName(alone.select("wid", "key", "start")).distinct().join(
        _small(windows, windows.count()), "wid"
    ).select("key", "start", "phrase", "items")


def _holds(all_words: Column, start: Column, phrase: Column, slop: int) -> Column:
    """Whether the words from `start` on are the phrase; with `slop`, whether all its words stand so near."""
    n = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1
    if not slop:
        return F.array_join(F.slice(all_words, start + 1, n), " ") == phrase
    near = F.slice(all_words, F.greatest(start - slop, F.lit(0)) + 1, n + 2 * slop)
    return F.size(F.array_except(F.split(phrase, " "), near)) == 0


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int = 0,
) -> DataFrame:
    """Adds to every document: `n_words`, `hits` (places of hit words, ascending), `items` (ids as text, sorted)."""
    kept = docs.drop(*[c for c in ("n_words", "hits", "items", "_key") if c in docs.columns and c not in (doc_id, text)])
    keyed = kept.withColumn("_key", F.xxhash64(F.col(doc_id), F.col(text)))
    windows = written(benchmark_windows(items, item, item_text), "windows")
    postings = index(keyed, windows, "_key", text)
    # one row per document with starts; a document's starts are bounded by its own length times the windows it holds
    found = written(starts(postings, windows, slop).groupBy("key").agg(F.collect_list(F.struct("start", "phrase", "items")).alias("_starts")), "starts")
    sent = found.agg(F.coalesce(F.sum(F.size("_starts")), F.lit(0))).first()[0] <= BROADCAST_STARTS
    found = found.withColumnRenamed("key", "_key")
    joined = keyed.join(F.broadcast(found) if sent else found, "_key", "left")
    joined = joined.withColumn("_words", words(F.col(text)))
    true = F.filter(F.coalesce("_starts", F.array().cast(found.schema["_starts"].dataType)), lambda s: _holds(F.col("_words"), s["start"], s["phrase"], slop))
    joined = joined.withColumn("_true", true)
    spans = F.transform("_true", lambda s: F.sequence(s["start"], F.least(s["start"] + F.size(F.split(s["phrase"], " ")), F.size("_words")) - 1))
    return joined.select(
        *kept.columns, F.size("_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_true", lambda s: s["items"])))).alias("items"),
    )
