"""TF-IDF cosine similarity of each resume and its job, from the two texts of a row.

The two texts are their own corpus: a term in both has the weight 1 + ln(tf), a term
in one of them that times c = ln(3/2) + 1. With S the sum of squares over all terms of
a text and B that over shared ones, its squared norm is c^2 (S - B) + B. Terms are counted
where the row is, in Arrow batches: none is shuffled, and a job's are counted once a worker.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossiergrid.batches import bound_batches
from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import half_even, text_or_empty
from dossiergrid.operators.matching import with_jobs

_STOP = frozenset(lx.STOPWORDS)
C2 = (math.log(1.5) + 1) ** 2


def bag_of_words(text: Column) -> Column:
    """Lower-cased words of letters, without function words and single letters, as one text."""
    words = F.split(F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z]+", " "), " ")
    stop = F.array(*[F.lit(w) for w in lx.STOPWORDS])
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), " ")


#: A match is as long as it can be, so it needs no test of its ends.
WORD = re.compile(r"\w\w+")


def term_weights(text: str) -> tuple[dict[str, float], float]:
    """1 + ln(tf) of the single words of at least two characters and of neighbouring pairs, and the sum of squares."""
    words = WORD.findall(text.lower())
    count = Counter(words)
    count.update(map(" ".join, zip(words, words[1:], strict=False)))
    weights = {t: 1 + math.log(n) for t, n in count.items()}
    return weights, math.fsum(w * w for w in weights.values())


@lru_cache(1024)
def _item_weights(text: str) -> tuple[dict[str, float], dict[tuple[str, str], float], float]:
    """``term_weights`` with words and pairs apart; a pair is a tuple."""
    weights, square = term_weights(text)
    return {t: w for t, w in weights.items() if " " not in t}, {tuple(t.split(" ")): w for t, w in weights.items() if " " in t}, square


def cosine(left: str, right: str) -> float:
    """0..100 for two texts; 0 where they share no term. The right one is a job's, seen again and again."""
    return _cosine_of_words(WORD.findall(left.lower()), right)


def _cosine_of_words(words: list[str], right: str) -> float:
    """``cosine`` of a text of these words. Its terms are counted, and weighed only where shared; sums don't depend on their order."""
    both = [(Counter(words), 0), (Counter(zip(words, words[1:], strict=False)), 1)]
    *items, all_b = _item_weights(right)
    shared = [(1 + math.log(count[t]), items[k][t]) for count, k in both for t in count.keys() & items[k].keys()]
    if not shared:
        return 0.0
    often = Counter(chain.from_iterable(count.values() for count, _ in both))
    squares = ((1 + math.log(n), many) for n, many in often.items())
    all_a = math.fsum(chain.from_iterable(repeat(w * w, many) for w, many in squares))
    one, two = math.fsum(a**2 for a, _ in shared), math.fsum(b**2 for _, b in shared)
    norm = math.sqrt(C2 * (all_a - one) + one) * math.sqrt(C2 * (all_b - two) + two)
    return math.fsum(a * b for a, b in shared) / norm * 100


def _bag(text: str) -> list[str]:
    return [w for w in re.findall(r"[a-z]{2,}", text.lower()) if w not in _STOP]


@lru_cache(1024)
def plain_words(text: str) -> str:
    """What ``bag_of_words`` gives, for one text, which is a job's."""
    return " ".join(_bag(text))


@F.pandas_udf(T.DoubleType())
def _cosines(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([cosine(a or "", b or "") for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _cosines_of_bags(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_cosine_of_words(_bag(a or ""), plain_words(b or "")) for a, b in zip(left, right, strict=True)], dtype="float64")


def pair_similarity(left: Column, right: Column, bags: bool = False) -> Column:
    """0..100 for the two texts of a row (columns of the input), as they are or as bags of words; null counts as empty."""
    return (_cosines_of_bags if bags else _cosines).asNondeterministic()(left, right)


def text_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, digits: int | None = 2) -> DataFrame:
    """(left_key, right_key, similarity) in 0..100 of all ``pairs``, one a left text; texts are in columns ``text``; 0 where one has no words.

    The right texts are jobs: broadcast behind a count of their size, else joined by salted key.
    """
    bound_batches(left.sparkSession)
    known = left.select(left_key, F.col("text").alias("left_text"))
    rows = with_jobs(pairs.select(left_key, F.col(right_key).alias("job_id")).join(known, left_key), right.select(F.col(right_key).alias("job_id"), F.col("text").alias("right_text")))
    value = pair_similarity(F.col("left_text"), F.col("right_text"))
    return rows.select(left_key, F.col("job_id").alias(right_key), (value if digits is None else half_even(value, digits)).alias("similarity"))
