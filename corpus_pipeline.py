"""Corpus pipeline: language, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last adds the token ids. Stages read nothing but their input and, for the benchmark, one table of sf_dir."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmur.llm import bpe, decontaminate, jaccard, language, phrases
from murmur.llm.queries import table, tokenizer_text
from murmur.llm.shared import ROW_GROUP_BYTES, written
from murmur.session import tune

#: Texts nearer to no language than this are rejected, as are those without a letter.
LEAST_SCORE = 0.2


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage under settings that keep the batches of its Python workers and the row groups of its writers small,
    whoever calls it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark).conf.set("parquet.block.size", str(ROW_GROUP_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that resemble no learned language."""
    judged = language.identify(docs, language.learn(docs), lang="_lang", score="_score")
    return judged.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


@bounded
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return jaccard.keep_one(docs)


@bounded
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out of the texts; a document of which nothing is left goes."""
    cut = phrases.clean_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


@bounded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(F.size("hits") == 0).select(*docs.columns)


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and the text they decode to."""
    definition = tokenizer_text()
    return bpe.decode_documents(bpe.encode_documents(docs, definition), definition)


STAGES = [
    ("language ID", by_language), ("n-gram Jaccard join", without_near_copies), ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark), ("BPE encoding and decoding", tokens),
]
#: Min-hash candidates, automata and merges have no SQL form; the rows are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored before the next one reads it."""
    docs = table(tune(spark), sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
