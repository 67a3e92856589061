"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate on the text. On a bounded sample the cascade measures how long a text takes each rule (the sample
many times over, less the time of a job without a rule) and which texts it rejects. Rules are ordered greedily: next comes
the one that rejects most of the texts that the rules before it let pass, per second. A text meets a rule only if the ones
before let it pass. The order changes the time, never the verdict.

Measures (``MEASURES``): words are runs outside ASCII white space; ``n_repeat_words`` counts the words covered by 8-word
windows that occur twice or more in the text. Windows are hashed by doubling (1, 2, 4, 8 words); only texts with an equal
pair of windows sort them.

Defined results: a null text is an empty text, which has zero in every measure and is rejected; equal rows get equal
verdicts; texts of any length are measured whole; an empty table gives an empty table; in ``measured`` new columns replace
columns of the same name, other columns stay.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialize

#: Texts on which costs and selectivities are estimated and their bytes, at most, and how often each is taken to tell a rule's
#: time; verdicts don't depend on it.
SAMPLE_ROWS, SAMPLE_BYTES, REPEATS = 256, 1 << 17, 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _next(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.size(values))


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many of the ``words`` are in an 8-word window that occurs twice or more."""
    enough = F.when(F.size(words) > 8, F.col(words)).otherwise(F.array().cast("array<string>"))  # two windows take nine words
    df = df.withColumn("__h1", F.transform(enough, lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        df = df.withColumn(f"__h{2 * k}", F.zip_with(f"__h{k}", _next(F.col(f"__h{k}"), k), lambda a, b: F.xxhash64(a, b))).drop(f"__h{k}")
    df = df.withColumn("__w", F.slice("__h8", 1, F.greatest(F.size("__h8") - 7, F.lit(0)))).drop("__h8")
    twice = F.size(F.array_distinct("__w")) < F.size("__w")
    df = df.withColumn("__s", F.when(twice, F.array_sort(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("__w")
    df = df.withColumn("__p", F.array_sort(F.transform(F.filter("__s", lambda x, i: F.coalesce(F.get("__s", i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get("__s", i + 1).h == x.h, F.lit(False))), lambda x: x.p))).drop("__s")
    covered = F.aggregate(F.zip_with("__p", _next(F.col("__p"), 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(8)), F.lit(8))), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of ``text``."""
    names = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}
    df = docs.select(*[c for c in docs.columns if c.lower() not in names])
    full = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", _words(full)).withColumn("__lines", _lines(full))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.octet_length(full) - F.octet_length(F.regexp_replace(full, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__lines")
    return with_repeats(df, "__words", "n_repeat_words").drop("__words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for texts to reject (null counts as false)."""

    name: str
    rejects: Column


def default_rules(text: str = "text", measures: bool = False) -> list[Rule]:
    """Rules on the text alone, each cheap enough to stand by itself; with ``measures``, on its measures where they say the same."""
    full = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(full)
    kept = lambda pattern: F.octet_length(F.regexp_replace(full, pattern, ""))
    solid = kept(r"[\x20\x09-\x0D]+")
    words = F.col("n_words") if measures else F.size(_words(full))
    symbols = F.col("n_symbols") if measures else size - kept(SYMBOLS + "+")
    lines, distinct = _lines(full), F.size(F.array_distinct(_lines(full)))
    n_lines, n_dup = (F.col("n_lines"), F.col("n_dup_lines")) if measures else (F.size(lines), F.size(lines) - distinct)
    ends = lambda pattern: F.size(F.regexp_extract_all(full, F.lit(pattern), F.lit(0)))
    return [
        Rule("symbols", symbols * 10 > words * 3),
        Rule("shouting", (size - kept("[A-Z]+")) * 2 > solid),
        Rule("exclamations", ends("!!+") * 10 > words * 3),
        Rule("word_length", (solid > words * 24) | (solid < words * 2)),
        Rule("dup_lines", n_dup * 10 > n_lines * 4),
        Rule("bullets", (n_lines >= 5) & (ends(r"(?m)^[\x20\x09]*[*\u2022\u2023\u25E6-][\x20\x09]") * 10 > n_lines * 9)),
        Rule("ellipses", (n_lines >= 5) & (ends(r"(?m)(?:\.\.\.|\u2026)[\x20\x09]*$") * 10 > n_lines * 3)),
        Rule("no_letters", size - kept(r"\p{L}+") < words),
    ]


@dataclass(frozen=True)
class Estimate:
    """``seconds`` for the sample, and which of its texts the rule rejects."""

    rule: Rule
    seconds: float
    rejected: tuple[bool, ...]


def estimates(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[Estimate]:
    """Cost and rejections of each rule on about ``rows`` texts of SAMPLE_BYTES at most, drawn from all rows with a fixed seed.

    The texts are read once more; the sample alone, twice ``rows`` at most, reaches the driver.
    """
    spark = docs.sparkSession
    share = min(1.0, rows / max(1, docs.count()))
    drawn = docs.select(F.col(text).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).sample(share, 1)
    found = [r[0] for r in drawn.limit(2 * rows).collect()]
    if not found:
        return [Estimate(rule, 1.0, ()) for rule in rules]
    sample = measured(spark.createDataFrame([(t,) for t in found], "text string"))
    told = sample.select(*[F.coalesce(rule.rejects, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]).collect()
    spent = []
    held = materialize(sample, "quality-sample")
    many = held.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    for test in (F.col("text").isNull(), F.col("text").isNull(), *(rule.rejects for rule in rules)):  # the first run warms up
        began = time.perf_counter()
        many.agg(F.count_if(test & (F.col("__again") > 0))).first()
        spent.append(time.perf_counter() - began)
    discard(held)
    return [Estimate(rule, max(spent[i + 2] - spent[1], 1e-3) / REPEATS, tuple(r[i] for r in told)) for i, rule in enumerate(rules)]


def ordered(found: list[Estimate]) -> list[Rule]:
    """Greedily, most rejections per second among the texts that are left first; those that reject none of them, cheapest first."""
    left, out = list(found), []
    passed = [True] * max((len(e.rejected) for e in found), default=0)
    while left:
        best = max(left, key=lambda e: (sum(p and r for p, r in zip(passed, e.rejected, strict=False)) / e.seconds, -e.seconds))
        left.remove(best)
        out.append(best.rule)
        passed = [p and not r for p, r in zip(passed, best.rejected, strict=False)]
    return out


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    rules = ordered(estimates(docs, default_rules(measures=True)))
    df = measured(docs).withColumn("base_failed", base_failed())
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules).isNull()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base nor the cascade rejects; rows the cascade rejects aren't measured."""
    rules = ordered(estimates(docs, default_rules()))
    passed = docs.filter(cascade(rules).isNull())
    marked = with_repeats(passed.withColumn("__words", _words(F.coalesce(F.col("text"), F.lit("")))), "__words", "__repeats")
    n = F.size("__words")
    # the observation keeps the filter above the measures; pushed below them it would repeat their expressions many times over
    marked = marked.observe(f"measured-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return marked.filter((n >= 20) & (100 * F.col("__repeats") <= 30 * n)).select(*docs.columns)
