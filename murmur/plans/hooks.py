"""Queries through the plug-in places."""

from pyspark.sql import functions as F

from murmur.operators import hooks, sentiment
from murmur.plans.registry import query


def _share_of_e(text: str) -> float:
    return text.count("e") / max(1, len(text))


@query("U1_text_scorer", "SELECT doc_id, round((length(text) - length(replace(text, 'e', ''))) / CAST(greatest(1, length(text)) AS DOUBLE), 6) AS score FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(hooks.text_scorer(_share_of_e)("text"), 6).alias("score"))


_P, _N = (f"len(regexp_extract_all(lower(coalesce(text, '')), '{'|'.join(words)}'))" for words in (hooks.POSITIVE, hooks.NEGATIVE))


@query("U1_lexicon_mood", f"""WITH c AS (SELECT doc_id, {_P} AS p, {_N} AS n FROM documents), m AS (SELECT doc_id, CASE WHEN p + n = 0 THEN 0.5e0 ELSE p / CAST(p + n AS DOUBLE) END AS p FROM c)
    SELECT doc_id, CASE WHEN p >= 0.6 THEN 'positive' WHEN p <= 0.4 THEN 'negative' ELSE 'neutral' END AS label, round(2 * p - 1, 6) AS score, round(least(0.75e0, abs(round(2 * p - 1, 6))), 6) AS confidence FROM m""")
def _(t):
    rows = t.documents.select("doc_id", hooks.lexicon_probability(F.col("text")).alias("probability"), F.lit("其他").alias("topic_category"))
    return sentiment.from_probability(rows).select("doc_id", "label", "score", "confidence")


def _fragile():
    def run(text: str) -> float:
        if len(text) % 3 == 0:
            raise ValueError("refused")
        return float(len(text))

    return run


def _steady():
    return lambda text: -1.0


@query("U3_scoring_fallback", "SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN -1e0 ELSE CAST(length(text) AS DOUBLE) END AS score, CASE WHEN length(text) % 3 = 0 THEN 'fallback' ELSE 'primary' END AS method, CASE WHEN length(text) % 3 = 0 THEN 3 ELSE 0 END AS failures FROM documents")
def _(t):
    return hooks.score_with_fallback(t.documents.select("doc_id", "text"), "text", _fragile, _steady).drop("text")
