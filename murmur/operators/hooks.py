"""Places where users plug in their own scorers; everything runs in Arrow batches inside tasks."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Default word lists of the built-in mood scorer; pass another scorer for real use.
POSITIVE = ("好", "赞", "喜欢", "支持", "感谢", "优秀", "成功", "good", "great", "love", "excellent")
NEGATIVE = ("差", "糟", "讨厌", "反对", "失望", "危险", "失败", "bad", "poor", "hate", "terrible")


def lexicon_probability(text: Column) -> Column:
    """Share of positive among all mood words, .5 without any. Built-in functions only."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: F.regexp_count(low, F.lit("|".join(words)))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.when(p + n == 0, 0.5).otherwise(p / (p + n))


def text_scorer(function: Callable[[str], float]) -> Callable[[Column], Column]:
    """Any text -> number function as a vectorised column function."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(function).astype(float)

    return run


def pair_scorer(function: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """Same for two texts, e.g. a similarity that replaces the token overlap of title and body."""

    @F.pandas_udf(T.DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, max(0.0, float(function(a or "", b or "")))) for a, b in zip(left, right)])

    return run


def score_with_fallback(rows: DataFrame, text: str, primary: Callable[[], Callable[[str], float]],
                        fallback: Callable[[], Callable[[str], float]], attempts: int = 3) -> DataFrame:
    """Add `(score, method, failures)`: the primary scorer is tried a few times per text, then the fallback once.

    Factories are called once per task. A text that fails both keeps a null score and method `failed`."""
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType()), T.StructField("failures", T.IntegerType())])

    def run(batches):
        first, second = primary(), fallback()

        def one(value):
            for failures in range(attempts):
                try:
                    return float(first(value)), "primary", failures
                except Exception:  # the plugged-in scorer may fail in any way
                    continue
            try:
                return float(second(value)), "fallback", attempts
            except Exception:
                return None, "failed", attempts + 1

        for batch in batches:
            scored = [one(v if isinstance(v, str) else "") for v in batch[text]]
            yield batch.assign(score=[s[0] for s in scored], method=[s[1] for s in scored], failures=pd.Series([s[2] for s in scored], index=batch.index, dtype="int32"))

    return rows.mapInPandas(run, schema)
