"""Small documents with the cases every operator must stand: nulls, blanks, long texts, ties, repeated rows, other columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, id long, component_id long, shard int, tok long"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return WORD.findall(s or "")


def corpus(seed=7, extra=()):
    """Documents with exact copies, near copies, shared passages, and the odd cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéioñtrsl") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", "  \t\n", "one", "one two", "One  TWO", "a b c　d", "x" * 9000]
    passage = say(70)
    for _ in range(12):
        texts.append(say(r.randint(5, 120)))
    base = say(150).split()
    for k in range(14):
        own = list(base)
        for _ in range(k // 2):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [texts[10]] * 4 + [say(20) + "\n" + passage + " " + say(30), passage + say(5), "\n".join([say(9)] * 6 + [say(12)])]
    texts += [say(4000), "Go! " * 50, *extra]
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, repeat=True):
    """``rows`` (doc_id, text) as a table with clashing other columns; the last row twice if ``repeat``."""
    full = [(i, t, None if i % 3 else "en", f"s{i % 4}", None if t is None else len(t), 1, None, i, 2, 3, None) for i, t in rows]
    return spark.createDataFrame(full + ([full[-1]] if repeat else []), SCHEMA).repartition(3)
