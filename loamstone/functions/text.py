"""Text functions as column expressions: entities, titles, snippets, lists, rejects."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ENTITIES = 15
#: Common words that are no concepts (fixed values).
STOP = [
    "可以", "没有", "这个", "那个", "什么", "怎么", "因为", "所以", "但是", "如果", "已经", "自己", "他们", "我们", "你们", "现在", "时候", "问题", "方法", "情况", "需要", "进行", "通过", "由于", "对于",
    "一个", "一些", "这样", "那样", "并且", "以及", "或者", "不是", "就是", "还是", "这些", "那些", "然后", "还有", "而且", "只是", "一直", "一定", "非常", "比较",
]
#: What looks like a credential (fixed values).
SECRETS = [r"\bsk-[A-Za-z0-9_-]{16,}\b", r"(?i)\b(?:api[_ -]?key|access[_ -]?token|password|secret)\s*[:=]\s*\S+", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"]
#: Han characters that count, and the form of links (fixed values).
HAN, HAN_PY = r"[\x{4e00}-\x{9fa5}]", "[一-龥]"
LINK = r"\[\[([^\]|]{1,40})(?:\|[^\]]*)?\]\]"


def wikilinks(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def neighbours(chars: Column) -> Column:
    """Each two neighbours of an array of characters together, in time linear in its length."""
    return F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))


def han_tokens(text: Column) -> Column:
    """Greedy runs of two to six Han characters, then each pair of neighbours, without stop words."""
    runs = F.regexp_extract_all(text, F.lit(HAN + "{2,6}"), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(HAN + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(F.transform(whole, lambda r: F.split(r, "")), neighbours))
    return F.array_except(F.concat(runs, pairs), F.lit(STOP))


def identifiers(text: Column) -> Column:
    """Whole words of three or more ASCII letters, digits and underscores that begin with a letter."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9_]{2,}$"))


def entities(text: Column, most: int = MAX_ENTITIES, words: Column | None = None) -> Column:
    """Distinct links, Han tokens (or the ``words`` that a segmentation found) and identifiers, in this order, the first ``most``."""
    t = F.coalesce(text, F.lit(""))
    return F.slice(F.array_distinct(F.concat(wikilinks(t), han_tokens(t) if words is None else words, identifiers(t))), 1, most)


def title(content: Column, size: int = 40) -> Column:
    return F.substring(F.get(F.split(F.trim(content), "\n"), F.lit(0)), 1, size)


def snippet(content: Column, size: int = 90) -> Column:
    return F.substring(content, 1, size)


def has_secret(text: Column) -> Column:
    hit = F.lit(False)
    for p in SECRETS:
        hit = hit | F.coalesce(text.rlike(p), F.lit(False))
    return hit


def listed(text: Column, most: int = 40) -> Column:
    """A list in one string: split at commas, semicolons and bars, trimmed to 120 characters, distinct."""
    parts = F.transform(F.split(text, "[,，、;；|]"), lambda x: F.substring(F.trim(x), 1, 120))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def listed_json(text: Column, most: int = 40) -> Column:
    """``listed`` of a JSON value: a string is split, a list's items aren't; an object stands for its name, value or id."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    item = lambda x: F.when(F.substring(F.trim(x), 1, 1) == "{", F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("name", "value", "id")])).otherwise(x)
    parts = F.transform(F.from_json(bare, "array<string>"), lambda x: F.substring(F.trim(F.coalesce(item(x), F.lit(""))), 1, 120))
    items = F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)
    return F.when(bare == "", F.array().cast("array<string>")).when(F.substring(bare, 1, 1) == "[", F.coalesce(items, F.array().cast("array<string>"))).when(F.substring(bare, 1, 1) == "{", F.array(F.substring(item(bare), 1, 120))).otherwise(listed(bare, most))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "是", "y"), F.lit(False))


def safe_name(name: Column, size: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\n]', "")), 1, size)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_contains(text: Column, query: str) -> Column:
    """SQLite's LIKE '%query%': ASCII case doesn't count, % and _ in the query are wildcards."""
    return ascii_lower(text).like("%" + re.sub("[A-Z]", lambda m: m[0].lower(), query).replace("\\", "\\\\") + "%")


def query_terms(query: str, most: int = 24, segment: Callable[[str], list[str]] | None = None) -> list[str]:
    """Phrases that a full-text query looks for; the whole query without quotes if it has none.

    Of Han text these are the words of ``segment`` with three characters or more and neighbouring words together, or without
    a segmenter the runs of three characters (18 of each run at most).
    """
    out = []
    if segment is not None:
        words = [w for w in map(str.strip, segment(query)) if re.fullmatch(HAN_PY + "{2,8}", w) and w not in STOP]
        out += [w for w in words if len(w) >= 3] + [(a + b)[:12] for a, b in zip(words, words[1:], strict=False)]
    else:
        for run in re.findall(HAN_PY + "{3,}", query):
            out += [run[i : i + 3] for i in range(len(run) - 2)][:18]
    out += re.findall(r"[A-Za-z0-9][A-Za-z0-9_-]{2,}", query)
    return list(dict.fromkeys(out))[:most] or ([query.strip().replace('"', "")] if query.strip() else [])


def segmented(text: str, segment: Callable[[str], list[str]]) -> list[str]:
    """Han words of two to eight characters that a segmenter finds, without stop words."""
    return [w for w in map(str.strip, segment(text)) if re.fullmatch(HAN_PY + "{2,8}", w) and w not in STOP]


def parsed_json(text: Column, schema: str, default: Column) -> Column:
    """The JSON value of a string column, or the default where there is none or it doesn't parse."""
    return F.coalesce(F.from_json(text, schema), default)


def iso_date(text: Column) -> Column:
    """The date that a string begins with, or null unless it begins YYYY-MM-DD."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Shared distinct bigrams of Han characters, ASCII letters and digits, over the root of both numbers."""
    def grams(t: Column) -> Column:
        s = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]+"), F.lit(0)), "")
        return F.when(F.char_length(s) > 1, F.array_distinct(neighbours(F.split(s, "")))).otherwise(F.array().cast("array<string>"))

    x, y = grams(a), grams(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)


def loose_json(text: str | None):
    """The JSON value in a model's answer, with or without a fence or talk around it; None if there is none."""
    t = re.sub(r"^\s*```(?:json)?|```\s*$", "", text or "").strip()
    for attempt in (t, *(m.group(0) for p in (r"\{.*\}", r"\[.*\]") for m in [re.search(p, t, re.S)] if m)):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None
