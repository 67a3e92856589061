"""Surrogates for personal data, in DataFrame functions only.

Patterns find entities; each is taken apart into atoms (an e-mail address, the digits of a number, a given name, a family
name). An atom's canonical form (lower case, digits only) gets a keyed surrogate of the same kind: digits for digits with
the Luhn check kept where it held, bank accounts of the same country with letters for letters and right check digits, hex
for hex, keys of the same classes of characters, letters of the same script for names, with an ending of the gender that the
title tells. The surrogate is then poured into the format of each mention (case, separators), so mentions of one entity
stay mentions of one entity in every document. Distinctness is checked over the whole corpus: of atoms with the same
surrogate, or with one that is itself an atom of the corpus, all but the first try again, until none are left; where a
kind's space is crowded, later tries are longer.

Found are e-mail addresses, hex secrets of 32 digits or more, keys that begin ``sk-``, what follows ``password:`` and its
like, IPv4 and whole IPv6 addresses, phone numbers, cards, social security numbers, bank accounts whose check digits are
right, and names after a title. A name found in a text is also replaced where the text has it without the title: given and
family name together, or the family name alone. Not found are names that no title in the text tells, postal addresses, and
short keys without a label.

The patterns go over each text once: what they find is written beside the text, and all the rest comes from there. Texts
without a match are never shuffled. Texts with one are taken by their digest, so copies are handled once, and joins on hot
entities or hot texts are left splittable.

Defined results: null texts stay null; empty texts and texts without entities stay as they are; repeated rows stay repeated
and get equal texts; texts of any length are handled whole; an empty table gives an empty table; all other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialize, skew_join

#: Tries after which digits are added; more tries than MAX_TRIES can't be needed, as each added digit makes ten times the room.
CROWDED, MAX_TRIES = 24, 400

#: Stands between the parts of a text that are searched together; a text that has it is searched part by part.
_BETWEEN = "\x01\ue123\x01"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{Ll}\p{M}'’-]+"
#: Titles that tell gender, by the script and the gender of the name that follows (fixed values).
TITLES = {
    "name_m": ["Mr.", "Mr", "Mister", "Herr", "Herrn", "Monsieur", "M.", "Señor", "Sr.", "Don", "Господин"],
    "name_f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra.", "Doña", "Госпожа"],
}
_quote = lambda s: s.replace(".", r"\.")
_TITLE = {k: "(?:" + "|".join(_quote(t) for t in sorted(v, key=len, reverse=True)) + ")" for k, v in TITLES.items()}
_LABEL = r"(?i:api[_ -]?key|access[_ -]?token|password|secret)\s{0,2}[:=]\s{0,2}[\"']?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried at a place that no letter or digit goes before.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}" + _END,
    "secret": r"(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)" + _END,
    "ipv6": rf"(?<!:){_HEX}(?::{_HEX}){{7}}(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "phone": r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}" + _END + r"|(?<!\()\(\d{3}\) ?\d{3}[ .-]\d{4}" + _END + r"|\d{3}[ .-]\d{3}[ .-]\d{4}" + _END,
    "card": r"(?:\d{4}[ -]){3}\d{4}" + _END + r"|\d{13,19}" + _END,
    "ssn": r"\d{3}-\d{2}-\d{4}" + _END,
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "key": r"sk-[A-Za-z0-9_-]{16,}+|" + _LABEL + r"[^\s\"'<>,;]{4,}+",
    "name_m": _TITLE["name_m"] + rf" {_NAME}(?: {_NAME})?" + _END,
    "name_f": _TITLE["name_f"] + rf" {_NAME}(?: {_NAME})?" + _END,
}
#: What a match begins with, by kind; most places are ruled out by their first character.
_FIRST = {"secret": "[0-9A-Fa-f]", "ipv6": "[0-9A-Fa-f]", "ip": "[0-9]", "phone": "[0-9+(]", "card": "[0-9]", "ssn": "[0-9]", "iban": "[A-Z]", "key": "[sSaApP]", "name_m": "[MHSDГ]", "name_f": "[MFSDГ]"}
#: What every pattern needs somewhere in the text: a digit, an @, long hex, a label, or a word that may be a title before a capital.
HINT = r"[0-9@:=]|[MHSDFГ]\p{L}{0,8}\.? \p{Lu}|sk-|[A-Fa-f]{32}"
ANY = _EDGE + "(?:" + "|".join(f"(?={_FIRST[k]})(?:{p})" if k in _FIRST else f"(?:{p})" for k, p in PATTERNS.items()) + ")"


def kind_of(entity: Column) -> Column:
    """The kind whose pattern the whole entity fits, tried in order."""
    tests = [(k, entity.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda out, kt: F.when(kt[1], F.lit(kt[0])).otherwise(out), reversed(tests), F.lit("card"))


def _hex(key: Column, kind: Column, canon: Column, tries: Column, part: int) -> Column:
    return F.sha2(F.concat_ws("\x1f", key, kind, canon, tries.cast("string"), F.lit(str(part))), 256)


def _number(h: Column, at: Column | int, size: int = 4) -> Column:
    """The number that ``size`` hex digits stand for, from hex digit 4 * at."""
    start = (F.lit(at) if isinstance(at, int) else at) * 4 + 1
    return F.conv(h.substr(start, F.lit(size)), 16, 10).cast("long")


def _drawn(h: Column, n: Column, alphabet: str) -> Column:
    """``n`` characters of ``alphabet`` drawn by the hex string ``h``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(F.lit(alphabet), (_number(h, i) % len(alphabet) + 1).cast("int"), F.lit(1))), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits; a multiple of ten is valid."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.coalesce(F.try_to_number(d, F.lit("9")), F.lit(0)).cast("int")).otherwise((F.coalesce(F.try_to_number(d, F.lit("9")), F.lit(0)).cast("int") * 2) % 9 + F.when(d == "9", 9).otherwise(0)))
    return F.aggregate(turned, F.lit(0), lambda s, x: s + x)


def _shaped(h: Column, canon: Column, hexadecimal: bool = False) -> Column:
    """Characters drawn by the hex string ``h`` of the classes of those of ``canon``: digits, lower and upper case letters; others stay."""
    low = "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    pick = lambda i, alphabet: F.substring(F.lit(alphabet), (_number(h, i % 120) % len(alphabet) + 1).cast("int"), F.lit(1))
    drawn = lambda c, i: F.when(c.rlike("^[0-9a-f]$") if hexadecimal else c.rlike("^[a-z]$"), pick(i, low)).when(c.rlike("^[0-9]$"), pick(i, "0123456789")).when(c.rlike("^[A-Z]$"), pick(i, low.upper())).otherwise(c)
    return F.array_join(F.transform(F.split(canon, ""), drawn), "")


def mod97(account: Column) -> Column:
    """Remainder by 97 of a bank account (no spaces): the first four characters last, letters as numbers from 10."""
    turned = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("^[A-Z]$"), 100).otherwise(10) + value(c)) % 97)


def _account(h: Column, canon: Column) -> Column:
    """An account of the same country and form with right check digits."""
    own = _shaped(h, F.substring(canon, 5, 64))
    check = F.lit(98) - mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), own))
    return F.concat(F.substring(canon, 1, 2), F.lpad(check.cast("string"), 2, "0"), own)


_LATIN, _CYRILLIC, _GREEK = ("bdfgklmnprstv", "aeiou"), ("бвгдклмнпрст", "аеиоу"), ("βγδκλμνπρστ", "αειοω")


def _named(h: Column, canon: Column, tries: Column, kind: Column) -> Column:
    """A name of syllables in the script of ``canon``; given names end as their gender's do."""
    def build(letters: tuple[str, str], endings: dict[str, str]) -> Column:
        n = (F.lit(2) + (tries / 3).cast("int") + (_number(h, 15) % 2).cast("int")).cast("int")
        body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(
            F.substring(F.lit(letters[0]), (_number(h, i * 2) % len(letters[0]) + 1).cast("int"), F.lit(1)), F.substring(F.lit(letters[1]), (_number(h, i * 2 + 1) % len(letters[1]) + 1).cast("int"), F.lit(1)))), "")
        end = F.when(kind == "given_f", endings["f"]).when(kind == "given_m", endings["m"]).otherwise(endings["s"])
        return F.concat(body, end)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), build(_CYRILLIC, {"f": "на", "m": "р", "s": "ков"})).when(canon.rlike(r"\p{IsGreek}"), build(_GREEK, {"f": "να", "m": "ρος", "s": "κης"})).otherwise(build(_LATIN, {"f": "na", "m": "n", "s": "rel"}))


def surrogate(key: Column, kind: Column, canon: Column, tries: Column) -> Column:
    """The canonical surrogate of an atom; another one for each number of tries."""
    h = F.concat(_hex(key, kind, canon, tries, 0), _hex(key, kind, canon, tries, 1), _hex(key, kind, canon, tries, 2), _hex(key, kind, canon, tries, 3), _hex(key, kind, canon, tries, 4), _hex(key, kind, canon, tries, 5), _hex(key, kind, canon, tries, 6), _hex(key, kind, canon, tries, 7))
    size = F.char_length(canon)
    more = F.greatest(F.lit(0), (tries - CROWDED + 7) / 8).cast("int")
    digits = _drawn(h, size + more, "0123456789")
    head = digits.substr(F.lit(1), size + more - 1)
    check = F.pmod(-_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn_sum(canon) % 10 == 0, F.concat(head, check)).otherwise(digits)
    local = F.concat(_drawn(h, F.lit(6), "abcdefghijklmnopqrstuvwxyz"), F.lit("."), _drawn(F.substring(h, 65, 64), F.lit(4), "0123456789"))
    octet = lambda i: (_number(h, i) % 254 + 1).cast("string")
    country = F.regexp_extract(canon, r"^(\+\d{1,3}) ", 1)
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), _drawn(F.substring(h, 129, 64), F.lit(5), "bcdfghjklmnpqrstvwxz"), F.lit(".example."), F.when(canon.rlike(r"\.(com|org|net)$"), F.regexp_extract(canon, r"(\w+)$", 1)).otherwise(F.lit("com"))))
        .when(kind == "secret", F.substring(h, 1, 128).substr(F.lit(1), size))
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "ipv6", _shaped(h, canon, True))
        .when(kind == "key", F.concat(F.when(canon.startswith("sk-"), F.lit("sk-")).otherwise(F.lit("")), _shaped(h, F.when(canon.startswith("sk-"), F.substring(canon, 4, 4096)).otherwise(canon)), F.repeat(F.lit("x"), more)))
        .when(kind == "card", card)
        .when(kind == "iban", _account(h, canon))
        .when(kind.isin("given_m", "given_f", "family"), _named(h, canon, tries, kind))
        .when((kind == "phone") & canon.startswith("+"), F.concat(country, F.lit(" "), _drawn(h, size + more - F.char_length(country) - 1, "0123456789")))
        .otherwise(digits)
    )


def atoms_of(entity: Column) -> Column:
    """The atoms (kind, canon, form) of an entity, in order; ``form`` is the piece of the mention that the atom fills.

    The pieces come last in the mention: what goes before them, a title or a label, stays. What looks like a bank account but
    for its check digits has no atom.
    """
    kind = kind_of(entity)
    value, account = F.regexp_replace(entity, "^" + _LABEL, ""), F.regexp_replace(entity, " ", "")
    one = lambda k, canon: F.array(F.struct(k.alias("kind"), canon.alias("canon"), entity.alias("form")))
    bare = F.regexp_replace(entity, r"\D", "")
    phone = F.when(entity.startswith("+"), F.concat(F.regexp_extract(entity, r"^(\+\d{1,3})", 1), F.lit(" "), F.regexp_replace(F.regexp_replace(entity, r"^\+\d{1,3}", ""), r"\D", ""))).otherwise(bare)
    title = F.regexp_extract(entity, "^(" + "|".join(_TITLE.values()) + ") ", 1)
    given = F.when(kind == "name_m", F.lit("given_m")).otherwise(F.lit("given_f"))
    names = F.split(F.substring(entity, F.char_length(title) + 2, F.char_length(entity)), " ")
    part = lambda k, x: F.struct(k.alias("kind"), F.lower(x).alias("canon"), x.alias("form"))
    named = F.when(F.size(names) > 1, F.array(part(given, F.get(names, F.lit(0))), part(F.lit("family"), F.get(names, F.lit(1))))).otherwise(F.array(part(F.lit("family"), F.get(names, F.lit(0)))))
    return (
        F.when(kind.isin("name_m", "name_f"), named)
        .when(kind.isin("email", "secret", "ipv6"), one(kind, F.lower(entity)))
        .when(kind == "ip", one(kind, entity))
        .when(kind == "key", F.array(F.struct(kind.alias("kind"), value.alias("canon"), value.alias("form"))))
        .when(kind == "iban", F.when(mod97(account) == 1, one(kind, account)).otherwise(F.array().cast("array<struct<kind:string,canon:string,form:string>>")))
        .when(kind == "phone", one(kind, phone))
        .otherwise(one(kind, bare))
    )


def poured(kind: Column, form: Column, sur: Column) -> Column:
    """The canonical surrogate in the format of the mention ``form``."""
    upper = (F.upper(form) == form) & (F.lower(form) != form)
    cased = F.when(upper, F.upper(sur)).otherwise(F.when(kind.isin("given_m", "given_f", "family"), F.initcap(sur)).otherwise(sur))
    flat = F.when(kind == "iban", sur).otherwise(F.regexp_replace(sur, r"\D", ""))
    taken = F.char_length(F.regexp_replace(form, F.when(kind == "iban", F.lit(r"[^A-Z0-9]")).otherwise(F.lit(r"\D")), F.lit("")))
    filled = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(r"^[0-9]$") | ((kind == "iban") & c.rlike("^[A-Z]$")), flat.substr(F.char_length(F.regexp_replace(form.substr(F.lit(1), i + 1), F.when(kind == "iban", F.lit(r"[^A-Z0-9]")).otherwise(F.lit(r"\D")), F.lit(""))), F.lit(1))).otherwise(c)), "")
    added = F.when(F.char_length(flat) > taken, flat.substr(taken + 1, F.char_length(flat) - taken)).otherwise("")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(filled, added)).when(kind == "key", sur).otherwise(cased)


def assigned(atoms: DataFrame, key: str) -> DataFrame:
    """``atoms`` (kind, canon), each once, with surrogates that differ from each other and from every atom of the kind.

    Of colliding atoms the smallest keeps its surrogate and the others try again; a retry can collide only with what is
    there, so each round is two joins on surrogates, over all atoms.
    """
    make = lambda df: df.withColumn("sur", surrogate(F.lit(key), F.col("kind"), F.col("canon"), F.col("tries")))
    table = materialize(make(atoms.select("kind", "canon").distinct().withColumn("tries", F.lit(0))), "pii-atoms")
    group = F.when(F.col("kind").isin("given_m", "given_f", "family"), F.lit("name")).otherwise(F.col("kind"))
    for _ in range(MAX_TRIES):
        first = table.groupBy(group.alias("kind_of"), F.col("sur")).agg(F.min(F.struct("kind", "canon")).alias("first"), F.count("*").alias("n"))
        real = table.select(group.alias("kind_of"), F.col("canon").alias("sur")).distinct().withColumn("real", F.lit(True))
        bad = first.join(real, ["kind_of", "sur"], "left").filter("n > 1 OR real").select("kind_of", "sur", "first", "real")
        bad = materialize(bad, "pii-collisions")
        if bad.isEmpty():
            return table.select("kind", "canon", "sur")
        keyed = table.withColumn("kind_of", group)
        met = skew_join(keyed, bad.select("kind_of", "sur", "first", "real"), ["kind_of", "sur"], "left")
        again = F.col("real").isNotNull() | (F.col("first").isNotNull() & ((F.col("first.kind") != F.col("kind")) | (F.col("first.canon") != F.col("canon"))))
        nxt = met.select("kind", "canon", F.when(again, F.col("tries") + 1).otherwise(F.col("tries")).alias("tries"))
        new = materialize(make(nxt), "pii-atoms")
        discard(table)
        table = new
    raise RuntimeError("surrogates did not become distinct")


def _names(parts: Column) -> Column:
    """What to replace without a title: the whole names, then the family names of a mention, as (form, new)."""
    family, given = F.filter(parts, lambda x: x.kind == "family"), F.filter(parts, lambda x: x.kind.isin("given_m", "given_f"))
    pair = lambda a, b: F.struct(F.concat(a.form, F.lit(" "), b.form).alias("form"), F.concat(a.new, F.lit(" "), b.new).alias("new"))
    whole = F.zip_with(given, F.slice(family, 1, 1), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), pair(a, b)))
    return F.concat(F.filter(whole, lambda x: x.isNotNull()), F.transform(family, lambda x: F.struct(x.form.alias("form"), x.new.alias("new"))))


def _untitled(gaps: Column, text: Column) -> Column:
    """The gaps between a text's entities with what ``__any`` finds replaced by ``__new_of``: all gaps in one pass."""
    found = lambda t: F.regexp_extract_all(t, F.col("__any"), F.lit(0))
    filled = lambda t: F.array_join(F.zip_with(F.split(t, F.col("__any")), found(t), lambda g, m: F.concat(g, F.coalesce(F.element_at("__new_of", m), F.lit("")))), "")
    joined = F.split(filled(F.array_join(gaps, _BETWEEN)), _BETWEEN)
    return F.when(F.col("__any").isNull(), gaps).when(text.contains(_BETWEEN), F.transform(gaps, filled)).otherwise(joined)


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities`` (in place of a column of that name), the mentions found with a title, label or form of their own."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != "n_entities"])
    columns = docs.columns
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = materialize(docs.withColumn("__found", F.when(F.size(found) > 0, found)), "pii-marked")
    clean = marked.filter("__found IS NULL").select(*columns, F.lit(0).cast("long").alias("n_entities"))
    flagged = marked.filter("__found IS NOT NULL").withColumn("__tk", F.sha2(F.col(text), 256))
    mentions = flagged.groupBy("__tk").agg(F.any_value("__found").alias("found"))
    pieces = mentions.select("__tk", F.posexplode("found").alias("at", "entity")).select("__tk", "at", "entity", F.posexplode_outer(atoms_of(F.col("entity"))).alias("k", "atom"))
    pieces = materialize(pieces.select("__tk", "at", "entity", "k", "atom.kind", "atom.canon", "atom.form"), "pii-pieces")
    known = assigned(pieces.filter("kind IS NOT NULL").select("kind", "canon"), key)
    filled = skew_join(pieces, known, ["kind", "canon"], "left").select("__tk", "at", "entity", "k", "form", F.when(F.col("sur").isNotNull(), poured(F.col("kind"), F.col("form"), F.col("sur"))).alias("new"), "kind")
    whole = filled.groupBy("__tk", "at", "entity").agg(F.sort_array(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("k", "form", "new", "kind")))).alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda x: x[c]), " ")
    named = F.concat(F.substring(F.col("entity"), F.lit(1), F.char_length("entity") - F.char_length(joined("form"))), joined("new"))
    told = whole.select("__tk", "at", F.when(F.size("parts") > 0, named).otherwise(F.col("entity")).alias("new"), (F.size("parts") > 0).alias("real"), _names(F.col("parts")).alias("names"))
    lists = told.groupBy("__tk").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x.new).alias("__new"), F.count_if("real").alias("__n"))
    forms = told.select("__tk", F.explode("names").alias("x")).groupBy("__tk", F.col("x.form").alias("form")).agg(F.min("x.new").alias("new"))
    forms = forms.groupBy("__tk").agg(F.sort_array(F.collect_list(F.struct((-F.char_length("form")).alias("less"), "form", "new"))).alias("x"))  # the longest first
    each = lambda c: F.transform("x", lambda y: y[c])
    forms = forms.select("__tk", F.map_from_arrays(each("form"), each("new")).alias("__new_of"), F.concat(F.lit(_EDGE + "(?:"), F.array_join(each("form"), "|"), F.lit(")" + _END)).alias("__any"))
    met = skew_join(flagged, materialize(lists.join(forms, "__tk", "left"), "pii-lists"), ["__tk"])
    gaps = _untitled(F.split(text, ANY), F.col(text))
    fresh = F.array_join(F.zip_with(gaps, "__new", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    done = met.withColumn(text, fresh)
    return clean.unionByName(done.select(*columns, F.col("__n").alias("n_entities")))
