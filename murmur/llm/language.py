"""Language identification by rank-order profiles of letter n-grams.

A text is lower-cased and read as words of letters with a blank at either side; its n-grams of one to three characters
are ranked by frequency (ties by code points). A language's profile is the ranking of the n-grams of its training texts.
The distance of a text to a profile sums, over the text's PROFILE most frequent n-grams, how far each is out of place
(PROFILE where the profile lacks it). The nearest language wins; ties go to the smaller name.

Profiles are learned from whole texts of at most about SAMPLE documents per language, chosen by a hash of the text (a
documented bound of the learning sample only; equal texts are chosen together). Predictions read whole texts.

Defined cases: null text and text without a letter are `und` with score 0; without training rows every text is `und`;
rows without a language teach nothing; repeated rows are judged each; no rows give no rows; columns named like the
results are replaced. The score is 1 less the distance over the largest possible one."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: N-grams in a profile, and about how many documents teach a language.
PROFILE, SAMPLE = 400, 4_000
_NOT_WORD = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20
_SHIFT = np.int64(21)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to 3 code points of 21 bits each in one number) and their counts; none without a letter.

    A long text is counted piece by piece; pieces overlap by the n-grams across their border."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(f" {_NOT_WORD.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    grams, counts = [], []
    for start in range(0, len(flat), _PIECE):
        codes = flat[start : start + _PIECE + 2].astype(np.int64)
        own = min(_PIECE, len(flat) - start)
        pairs = codes[:-1] << _SHIFT | codes[1:]
        triples = pairs[:-1] << _SHIFT | codes[2:]
        middle = codes[1:-1] != 32  # a triple across two words says nothing
        single = codes[:own]
        found, n = np.unique(np.concatenate([single[single != 32], pairs[:own], triples[:own][middle[:own]]]), return_counts=True)
        grams.append(found)
        counts.append(n)
    if len(grams) == 1:
        return grams[0], counts[0]
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by the n-gram's code points."""
    return grams[np.argsort(-counts, kind="stable")[:most]]  # the n-grams come in ascending order


class RankProfiles:
    """Profiles of all languages and the out-of-place distance to each."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        # rank of each n-gram by language; PROFILE places away where a language lacks it
        self.ranks = np.full((len(self.names), len(self.vocabulary)), -1, np.int64)
        for row, name in enumerate(self.names):
            self.ranks[row, np.searchsorted(self.vocabulary, profiles[name])] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text))
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        ranks = self.ranks[:, at]
        away = np.abs(ranks - np.arange(len(own)))
        away = np.where((ranks < 0) | (self.vocabulary[at] != own), PROFILE, np.minimum(away, PROFILE))
        distance = away.sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (PROFILE * len(own)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> RankProfiles:
    """Profiles from the rows with a language. Counts are summed per batch before they are exchanged."""
    taught = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sizes = taught.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = taught.join(sizes, "lang").where(draw < F.lit(float(SAMPLE)) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, []).append(gram_counts(value))
            for name, parts in found.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams, "n": n})

    grams = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the PROFILE first of each language, found by halves: a group's list never holds more than its profile
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("lang", *by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, PROFILE).alias("top"))
    parts = first(grams.withColumn("part", part), "part").select("lang", F.inline("top")).withColumn("n", -F.col("n"))
    return RankProfiles({r["lang"]: np.array([g["gram"] for g in r["top"]], np.int64) for r in first(parts).collect()})


def identify(docs: DataFrame, profiles: RankProfiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row."""
    kept = docs.drop(lang, score)
    sent, at = docs.sparkSession.sparkContext.broadcast(profiles), kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value.judge
        for batch in batches:
            found = [judge(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*batch.schema.names, lang, score],
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
