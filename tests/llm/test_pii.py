import re

from tests.llm.helpers import corpus, frame

from loamstone.llm.pii import ANY, assigned, replaced, surrogate
from pyspark.sql import functions as F

MAIL = "Ann.Lee+x@mail.example.org"
TEXTS = [
    f"Mr. John Smith, {MAIL}, +1 (017) 555-7713; 4539578763621486 and 10.2.3.4. Mr. Smith again: {MAIL.upper()}!!",
    "Frau Anna Müller (123-45-6789): 4539 5787 6362 1486, token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"",
    "Госпожа Анна Иванова и Mrs. Smith; GB29 NWBK 6016 1331 9268 19 and 1EB9C654E721B4F812088970E66A6345CEE33DD6",
    "version 4.0 of 2024-01-02, 12345 and 999.1.1.1, a@b, Here They are 1.2.3.4.5",
    MAIL, "+1 (017) 555-7713" * 1, "10.2.3.4 " * 400,
]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def account(iban):
    c = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def test_replacements(spark):
    rows = corpus(extra=TEXTS)
    docs = frame(spark, rows).withColumn("n_entities", F.lit("clash"))
    out = replaced(docs, "key")
    assert [*docs.columns[:-1], "n_entities"] == out.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, (r.text, r.n_entities))
        assert got[r.doc_id] == (r.text, r.n_entities)
    assert out.count() == docs.count()
    by = {t: got[i][0] for i, t in rows}
    for i, t in rows:
        if t not in TEXTS or t == TEXTS[3]:
            assert got[i] == (t, 0)
    a, b, c = (by[t] for t in TEXTS[:3])
    m = re.fullmatch(r"Mr\. (\S+) (\S+), (\S+@\S+), (\+1 \(\d{3}\) \d{3}-\d{4}); (\d{16}) and (\S+)\. Mr\. (\S+) again: (\S+)!!", a)
    assert m and m[2] == m[7] and m[8] == m[3].upper() and m[3].endswith(".org") and luhn("4539578763621486") == luhn(m[5])
    for gone in ("John", "Smith", MAIL, "555-7713", "4539578763621486", "10.2.3.4"):
        assert gone not in a
    assert " ".join(re.findall("....", m[5])) in b and re.search(r"Frau [A-Z][a-zü]+a [A-Z]\w+ \(\d{3}-\d\d-\d{4}\)", b) and "123-45-6789" not in b
    secret = re.search(r'"([0-9a-f]{40})"', b)[1]
    assert secret.upper() in c and re.match(r"Госпожа [А-Я][а-я]+а [А-Я][а-я]+ и Mrs\. " + m[2] + r"; (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and", c) and account(re.search(r"GB[\w ]{25}", c)[0]) and "NWBK" not in c
    assert by[MAIL] == m[3] and by[TEXTS[5]] == m[4] and by[TEXTS[6]] == (m[6] + " ") * 400
    assert {r.text for r in replaced(docs, "key").collect()} == {t for t, _ in got.values()}
    assert {r.text for r in replaced(docs, "other").collect()} != {t for t, _ in got.values()}
    assert replaced(docs.limit(0), "key").count() == 0


def test_collisions_are_resolved(spark):
    short = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(400)], "kind string, canon string")
    plain = short.withColumn("sur", surrogate(F.lit("k"), F.col("kind"), F.col("canon"), F.lit(0)))
    assert plain.select("sur").distinct().count() < 400
    out = assigned(short, "k").collect()
    assert len({r.sur for r in out}) == 400 and not {r.sur for r in out} & {r.canon for r in out}


def test_names_without_their_title_and_odd_forms(spark):
    texts = [
        "Mr. John Smith called. John Smith said yes; Smith left. Smithers and Johnny stayed, smith too.",
        "ORDER US90 SALE ENDS SOON TODAY, but DE89 3704 0044 0532 0130 00 is real and DE88 3704 0044 0532 0130 00 isn't",
        "key sk-abcDEF123456789012345 and password: hunter2! API key = 'Zq9_x-77' or secret:ok",
        "555 123 4567, fe80:0:0:0:1:2:3:4 and 2001:db8:85a3:0:0:8a2e:370:7334; at 12:30:45",
        None, "", "nothing of that kind",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in replaced(docs, "key").collect()}
    m = re.fullmatch(r"Mr\. (\S+) (\S+) called\. (\S+) (\S+) said yes; (\S+) left\. Smithers and Johnny stayed, smith too\.", got[0][0])
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] and "John " not in got[0][0] and got[0][1] == 1
    m = re.fullmatch(r"ORDER US90 SALE ENDS SOON TODAY, but (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) is real and DE88 3704 0044 0532 0130 00 isn't", got[1][0])
    assert m and account(m[1]) and m[1] != "DE89 3704 0044 0532 0130 00" and got[1][1] == 1
    m = re.fullmatch(r"key sk-([a-z]{3}[A-Z]{3}\d{15}) and password: ([a-z]{6}\d!) API key = '([A-Z][a-z]\d_[a-z]-\d\d)' or secret:ok", got[2][0])
    assert m and m[1] != "abcDEF123456789012345" and m[2] != "hunter2!" and m[3] != "Zq9_x-77" and got[2][1] == 3
    m = re.fullmatch(r"(\d{3} \d{3} \d{4}), ([0-9a-f:]+) and ([0-9a-f:]+); at 12:30:45", got[3][0])
    assert m and m[1] != "555 123 4567" and m[2].count(":") == m[3].count(":") == 7 and got[3][1] == 3
    assert [got[i] for i in (4, 5, 6)] == [(None, 0), ("", 0), ("nothing of that kind", 0)]


def test_equals_brute_force(spark):
    """Every match of the patterns, told by another engine, is replaced by one partner of its kind and form; all else stays."""
    import random

    import regex

    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    make = {
        "email": lambda: "".join(r.choice("abcXY") for _ in range(5)) + f"{r.randint(0, 30)}@host.{r.choice(['com', 'org', 'de'])}", "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(4)} {digits(2)}", "card": lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        "name": lambda: r.choice(["Mr.", "Mrs.", "Herr", "Frau"]) + " " + r.choice(["Ann", "Bob", "Carl"]) + " " + r.choice(["Stone", "Field", "Hill"]), "word": lambda: r.choice(["the", "harbour", "12", "a-b", "x@y", "at 9.30"]),
    }
    texts = [" ; ".join(make[r.choice(list(make))]() for _ in range(r.randint(0, 14))) + r.choice([".", "!", ""]) for _ in range(150)]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_entities) for x in replaced(docs, "key").collect()}
    pattern = regex.compile(ANY)
    partner, back = {}, {}
    for i, t in enumerate(texts):
        spans = [m.span() for m in pattern.finditer(t)]
        assert got[i][1] == len(spans)
        out, at, new = [], 0, got[i][0]
        for a, z in spans:  # cut the new text at the pieces that stay
            gap = t[at:a]
            out.append(gap)
            at = z
        assert new.startswith(out[0] if out else t)
        rest = "".join(regex.escape(g) + "(.+?)" for g in out) + regex.escape(t[at:])
        m = regex.fullmatch(rest, new)
        assert m
        for (a, z), s in zip(spans, m.groups()):
            old = t[a:z]
            shape = lambda x: regex.sub(r"[0-9]", "9", x)
            if regex.fullmatch(r"[\d .+()-]+", old) and old.count(".") != 3:
                assert shape(old) == shape(s)
            assert partner.setdefault(old, s) == s and old != s
            assert back.setdefault(s.split(" ", 1)[1] if old[0] in "MHF" else s, old.split(" ", 1)[1] if old[0] in "MHF" else old) == (old.split(" ", 1)[1] if old[0] in "MHF" else old)
    assert len(partner) > 300


def test_a_crowded_kind_gets_longer(spark):
    full = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(100)], "kind string, canon string")
    out = assigned(full, "k").collect()
    assert len({r.sur for r in out}) == 100 and not {r.sur for r in out} & {r.canon for r in out} and max(len(r.sur) for r in out) > 2


def test_a_text_with_many_names(spark):
    import random
    import time

    r = random.Random(8)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)).capitalize()
    names = sorted({(word(), word()) for _ in range(1500)})
    text = " ".join(f"Mr. {a} {b} came, {a} {b} spoke, {b} left." for a, b in names)
    docs = spark.createDataFrame([(1, text), (2, "Mr. Kim Lee, Ms. Kim Lee; Lee \x01\x01 Kim Lee"), (3, "nobody")], "doc_id long, text string")
    began = time.perf_counter()
    got = {x.doc_id: x for x in replaced(docs, "key").collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_entities == len(names) and not any(b in got[1].text or f"{a} {b}" in got[1].text for a, b in names)
    said = re.findall(r"Mr\. (\S+) (\S+) came, (\S+) (\S+) spoke, (\S+) left\.", got[1].text)
    assert len(said) == len(names) and all((a, b, b) == (c, d, e) for a, b, c, d, e in said)
    assert "Lee" not in got[2].text and "\x01\x01" in got[2].text and got[3].text == "nobody"
