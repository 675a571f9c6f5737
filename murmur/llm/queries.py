"""One registered query per corpus operator: production parameters, whole tables, whole results."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmur.llm import (
    bloom_lm, bpe, decontaminate, jaccard, language, merkle, phrases, secrets, sharding, suffix_repeats, url_filter, vector_codes, winnow,
)
from murmur.llm.queries_sql import MERKLE_SQL, VECTOR_CODES_SQL
from murmur.llm.shared import written
from murmur.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# fixed values: the rules that the query judges by
URL_RULES = [
    url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(tune(spark), folder)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_url_filter", """
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
      judged AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""")
def _(spark, folder):
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def tokenizer_text(path: str | None = None) -> str:
    """JSON text of a tokenizer file, by default the installed word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


@query("op2_bpe_round_trip")
def _(spark, folder):
    definition = tokenizer_text()
    coded = bpe.encode_documents(table(spark, folder, "documents").select("doc_id", "text"), definition).select("doc_id", "ids")
    return bpe.decode_documents(coded, definition).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_language_id")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    profiles = language.learn(docs.where(language.remainder(F.col("doc_id"), 4) != 2))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (language.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_suffix_array_dedup")
def _(spark, folder):
    cut = suffix_repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", phrases.removed_units("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op5_ngram_jaccard_join")
def _(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "class_size", "n_links", "n_doc_links"
    )


@query("op6_substring_dedup")
def _(spark, folder):
    cut = phrases.remove_later_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", phrases.removed_units("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_sharding")
def _(spark, folder):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shuffle_into_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_document_fingerprints")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = winnow.with_next(docs, "doc_id", "text").withColumn("_edited", winnow.edited(F.col("text"), F.col("_next")))
    pairs = pairs.withColumn("_edited_print", winnow.fingerprint(F.col("_edited")))
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        winnow.shown(F.col("_print")).alias("fingerprint"), winnow.shown(F.col("_edited_print")).alias("edited_fingerprint"),
        winnow.likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        winnow.likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )


_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_benchmark_decontamination", f"""
    WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark),
      win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT n FROM win),
      d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
      occ AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
      hit AS (SELECT o.r, o.i, o.n, win.item_id FROM occ o JOIN win ON o.g = win.g AND o.n = win.n),
      per AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
      its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)""")
def _(spark, folder):
    found = decontaminate.decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query("op10_lm_scoring")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", language.remainder(F.col("doc_id"), 7) == 2)
    return bloom_lm.score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@query("op11_merkle_manifest", MERKLE_SQL)
def _(spark, folder):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    drawn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0  # null ids are never drawn
    leaves = table(spark, folder, "documents").select(
        "doc_id", "lang", merkle.leaf_digest(*fields, F.col("text")).alias("leaf"),
        F.when(drawn, merkle.leaf_digest(*fields, lowered)).alias("changed"),
    )
    proved = merkle.manifest(leaves, "lang", "doc_id", "leaf").leaves
    out = proved.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_vector_code_compression", VECTOR_CODES_SQL)
def _(spark, folder):
    coded = vector_codes.compress(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))
    rows = written(coded.rows.select("vec_id", "label", "code", "error"), "vector-codes")
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return vector_codes.summed_by(rows, "label", "error", "label_error").select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(vector_codes.fingerprint(coded.codebooks)).alias("codebooks_sha256"),
    )


@query("op13_secret_scan")
def _(spark, folder):
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in secrets.BASE_RULES]
    return found.select(
        "doc_id", *[number(kind) for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
