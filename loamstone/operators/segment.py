"""Words of Han text: the likeliest cut of each run of Han characters into words whose probabilities the corpus tells.

A word's probability is its share of all counted words; a single character that is no word has half a count. The cut with
the largest product is found from left to right (for each place the best cut that ends there); of equal ones that with the
fewest words, then that whose last words are longest. The words are the runs of one to LONGEST characters that texts have
LEAST times or more, the MOST most frequent of them, which bounds what every task holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import text as X

LONGEST, LEAST, MOST = 4, 2, 1 << 18


def _runs(rows: DataFrame, text: str, least: int) -> DataFrame:
    return rows.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{X.HAN}{{{least},}}"), F.lit(0))).alias("run"))


def word_counts(rows: DataFrame, text: str = "content", longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> DataFrame:
    """word and c: how often the corpus has each run of up to ``longest`` Han characters."""
    chars = _runs(rows, text, 1).select(F.split("run", "").alias("a"))
    size = F.size("a")

    def of_length(n: int) -> Column:
        words = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice("a", i + 1, n), ""))
        return F.when(size >= n, words).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of_length, range(1, longest + 1))))
    return chars.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("c")).filter(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(most)


def costs(words: DataFrame) -> dict[str, float]:
    """The negative logarithm of each word's share, under '' that of half a count; MOST words at most."""
    rows = words.collect()
    total = sum(r.c for r in rows) or 1
    return {r.word: math.log(total) - math.log(r.c) for r in rows} | {"": math.log(total) - math.log(0.5)}


def best_cut(run: str, cost: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The words of the likeliest cut."""
    unknown = cost[""]
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # cost, words, length of the last word
    for end in range(1, len(run) + 1):
        found = None
        for n in range(min(longest, end), 0, -1):
            c = cost.get(run[end - n : end], unknown if n == 1 else None)
            if c is None:
                continue
            before = best[end - n]
            now = (round(before[0] + c, 9), before[1] + 1, n)
            if found is None or now[:2] < found[:2]:
                found = now
        best.append(found)
    out, end = [], len(run)
    while end:
        n = best[end][2]
        out.append(run[end - n : end])
        end -= n
    return out[::-1]


def segmented(rows: DataFrame, cost: dict[str, float], text: str = "content", out: str = "words", longest: int = LONGEST, least: int = 2, stop: bool = True) -> DataFrame:
    """``rows`` with the words of ``least`` to eight Han characters of each text, in order; without stop words if ``stop``."""
    shared = rows.sparkSession.sparkContext.broadcast(cost)
    han, common = re.compile(f"{X.HAN_PY}+"), frozenset(X.STOP if stop else ())
    schema = rows.select("*", F.array().cast("array<string>").alias(out)).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for part in parts:
            cut = []
            for t in part[text]:
                words = []
                for r in han.findall(t or ""):
                    if r not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[r] = [w for w in best_cut(r, shared.value, longest) if least <= len(w) <= 8 and w not in common]
                    words += known[r]
                cut.append(words)
            yield part.assign(**{out: cut})

    return rows.mapInPandas(run, schema)
