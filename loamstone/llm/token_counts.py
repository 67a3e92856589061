"""The exact number of tokens of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding is the one way to cut a word into tokens such that each two neighbours, encoded alone, stay those two
tokens. So the tokens of a prefix are those of a shorter prefix and one more: the last token of every prefix of a word, and
with it the number of tokens, follows from the ones before. Two tables are kept for a word: tokens in its middle, and tokens
that end it, as a text that is cut inside a word ends that word there. White space parts words for certain (no merge, no
normal form and no match of the pattern goes over it), so a text's counts are those of its words one after the other, and a
word is counted once for all texts of a task that have it.

``with_counts`` stores for each text

* ``prefix_tokens``: element n + 1 is the number of tokens of the first n characters (code points), n from 0;
* ``budget_chars``: element b + 1 is the longest prefix, in characters, of at most b tokens, b from 0 to the whole's number.

Questions about truncation and budgets are then look-ups in these arrays (``tokens_at``, ``chars_within``, ``truncated``,
``window_tokens``); nothing is encoded again.

The tokenizer file is one of the tokenizers library: byte-level BPE of words with an end-of-word mark (its normal form, pattern
and added tokens are taken from the file; added tokens in a text count as the library counts them, and a prefix that ends
inside one is ordinary text).

Defined results: a null text is an empty text: arrays of the one element 0. White space alone has no tokens. Texts and words of
any length are counted whole. Equal and repeated rows give equal results, whatever their ids, null ids too. An empty table
gives an empty table. Other columns stay; new columns replace ones of those names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.bpe import byte_alphabet
from loamstone.llm.common import arrow_map

#: Characters of white space (fixed values: the Unicode property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that a worker remembers (twice: those of late and those before), and the longest of them.
CACHED, LONGEST_CACHED = 250_000, 64
#: Rows whose arrays are sent on together, in characters.
CHUNK_CHARS = 1 << 20
_ENDLESS = 1 << 60
#: Characters that stay apart in every normal form, have one small letter each and belong to one class for every Unicode version:
#: printable ASCII and white space, the letters from U+00C0 to U+017F (but three), some marks. Of small ones, what the pattern matches.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_SIGNS = "!-/:-@[-`{-~\u00a1\u00ab\u00bb\u00bf\u2010-\u2027"
SIMPLE = re.compile(f"[\t-\r 0-9A-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS}{_SIGNS}]*")
MATCHES = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+|[\t-\r ]+")


@lru_cache(maxsize=1)
def _joining() -> re.Pattern:
    """A character and those after it that a normal form may join to it or reorder."""
    after = {chr(int(d.split()[1], 16)) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    marks = {chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))}
    jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    inside = "".join(map(re.escape, sorted(after | marks | jamo)))
    return re.compile(f"(?s).[{inside}]*")


class _Steps(dict):
    """Of each word (or match) the steps of the number of tokens, one for each character, as bytes of int32; made when first asked for.

    Holds those asked for since it was last full, and those from the time before that.
    """

    def __init__(self, counts):
        self.counts, self.before = counts, {}

    def __missing__(self, part: str) -> bytes:
        steps = self.before.get(part)
        if steps is None:
            counts = self.counts(part) if part else []
            steps = array("i", map(sub, counts, [0, *counts])).tobytes()
        if len(part) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.before = dict(self)
                self.clear()
            self[part] = steps
        return steps


class PrefixCounter:
    """Counts of all prefixes for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or not self.mark or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a BPE of words with an end-of-word mark is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens that reach over white space or other spellings can't be counted by words")
        self.normalize, self.pieces_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        white = "".join(c for c in WHITE if not self.pieces_of(self.normalize(c)))
        self.split = re.compile(f"([{re.escape(white)}]+)").split
        self.white = frozenset(white)
        self._tables(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.words, self.simple, self.counts, self.parted = _Steps(self.word), _Steps(self._simple), {}, {}
        self._states = b"", [0], [0], [0], [0]

    def _tables(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        alphabet = byte_alphabet()
        rank = {pair: r for r, pair in enumerate(merges)}
        made = {a + b: (a, b) for a, b in merges}
        born = {a + b: r for (a, b), r in rank.items()}
        if len(made) != len(merges) or any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b) in enumerate(merges)):
            raise ValueError("each merge must make a token of its own from earlier ones")
        self.rank = {(vocab[a], vocab[b]): r for (a, b), r in rank.items()}
        self.halves = {vocab[t]: (vocab[a], vocab[b]) for t, (a, b) in made.items()}
        self.born = {vocab[t]: r for t, r in born.items()}
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            ends = token.endswith(self.mark) and token != self.mark
            letters = token.removesuffix(self.mark) if ends else token
            if all(c in alphabet for c in letters):
                (self.final if ends else self.inner)[bytes(alphabet[c] for c in letters)] = i
        if not all(bytes([b]) in t for b in range(256) for t in (self.inner, self.final)):
            raise ValueError("every byte needs a token, inside of words and at their end")
        self.widest = max(map(len, [*self.inner, *self.final]))
        self.bytes_of = {c: b for c, b in alphabet.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at this edge (0 left, 1 right) of the token while it is merged together, and the rank of the merge that ends it."""
        chain, death = [], _ENDLESS
        while True:
            chain.append((token, death))
            if token not in self.halves:
                return chain[::-1]
            death = self.born[token]
            token = self.halves[token][side]

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay what they are: no merge over their border comes before the ones inside of them."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends:  # of equal pairs the left one is merged first
                return False
            if x_ends == y_ends == _ENDLESS:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def piece(self, data: bytes) -> list[int]:
        """The number of tokens of each prefix (0 bytes on) of one piece of the pattern, where the piece ends there; 0 inside a character.

        The states of the prefix that this piece shares with the one before are taken over: sorted pieces cost least.
        """
        old, last, number, begin, ended = self._states
        k, n = 0, len(data)
        for x, y in zip(old, data):
            if x != y:
                break
            k += 1
        last, number, begin, ended = last[: k + 1], number[: k + 1], begin[: k + 1], ended[: k + 1]
        inner, final, good = self.inner.get, self.final.get, self.parted.get
        at = begin[-1]  # where the last token of the prefix before begins: the likeliest place for the next one
        for end in range(k + 1, n + 1):
            token = inner(data[at:end])
            if token is None or at and not good(last[at] << 20 | token):
                at, token = self._last(data, end, self.inner, last)
            last.append(token)
            number.append(number[at] + 1)
            begin.append(at)
            if end < n and data[end] & 0xC0 == 0x80:
                ended.append(0)
                continue
            token = final(data[at:end])
            start = at
            if token is None or at and not good(last[at] << 20 | token):
                start, _ = self._last(data, end, self.final, last)
            ended.append(number[start] + 1)
        self._states = data, last, number, begin, ended
        return ended

    def _last(self, data: bytes, end: int, table: dict[bytes, int], last: list[int]) -> tuple[int, int]:
        """Where the one token begins that ends here and stays beside the last token of the prefix before it."""
        parted = self.parted
        for start in range(end - 1, max(-1, end - self.widest - 1), -1):
            token = table.get(data[start:end])
            if token is None:
                continue
            if not start:
                return 0, token
            key = last[start] << 20 | token
            if key not in parted:
                if len(parted) >= 4 * CACHED:
                    parted.clear()
                parted[key] = self.stays(last[start], token)
            if parted[key]:
                return start, token
        raise ValueError("these merges don't cut this word in one way")

    def _piece(self, data: bytes) -> list[int]:
        """As ``piece``, at the ends of characters alone."""
        found = self.counts.get(data)
        if found is None:
            ended = self.piece(data)
            found = [c for c in ended[1:] if c]
            if len(data) <= LONGEST_CACHED:
                if len(self.counts) >= CACHED:
                    self.counts.clear()
                self.counts[data] = found
        return found

    def _marked(self, data: bytes) -> list[int]:
        """As ``_piece``, also of a mark and letters that only together are a match of the pattern."""
        own = self._piece(data)
        if data[:1] == b"'" and len(own) == 3 and data[1:].isalpha():
            return [own[0], sum(self._piece(d)[-1] for _, d in self._cut(data[:2].decode())), own[2]]
        return own

    def _cut(self, text: str) -> list[tuple[int, bytes]]:
        """Where the pieces of normalized text start, and their bytes."""
        return [(span[0], bytes(map(self.bytes_of.__getitem__, p))) for p, span in self.pieces_of(text)]

    def _normal(self, text: str) -> list[int]:
        """Counts of all prefixes (from one character on) of normalized text without white space, each as a text of its own."""
        out, before = [], 0
        for start, data in self._cut(text):
            own = self._marked(data)
            out += [before] * (start - len(out)) + [before + c for c in own]
            before += own[-1]
        return out + [before] * (len(text) - len(out))

    def _plain(self, text: str) -> list[int]:
        """Counts of all prefixes of a word without added tokens."""
        if text.isascii():
            return self._normal(text.lower())
        segments = [*text] if unicodedata.is_normalized("NFC", text) else _joining().findall(text)
        forms = [self.normalize(s) for s in segments]
        whole = self.normalize(text)
        if "".join(forms) != whole:
            return [self.total(text[:k]) for k in range(1, len(text) + 1)]
        counts, starts, out, at = [0, *self._normal(whole)], [s for s, _ in self._cut(whole)], [], 0
        for segment, form in zip(segments, forms, strict=True):
            for k in range(1, len(segment)):  # inside of what the normal form joins
                x = self.normalize(segment[:k])
                if whole.startswith(x, at):
                    out.append(counts[at + len(x)])
                    continue
                a = starts[max(0, int(np.searchsorted(starts, max(0, at - 1), side="right")) - 2)] if starts and at else 0  # of the match that goes on, or a mark before it
                out.append(counts[a] + sum(self._piece(d)[-1] for _, d in self._cut(whole[a:at] + x)))
            at += len(form)
            out.append(counts[at])
        return out

    def total(self, text: str) -> int:
        """The number of tokens of a word without added tokens."""
        return sum(self._piece(d)[-1] for _, d in self._cut(self.normalize(text)))

    def _simple(self, part: str) -> list[int]:
        """Counts of all prefixes (from one character on) of one match of the pattern over simple characters, or of white space."""
        if part[0] in self.white:
            return [0] * len(part)
        data = part.encode()
        return self._marked(data) if part[0] == "'" else [c for c in self.piece(data)[1:] if c]

    def word(self, part: str) -> list[int]:
        """Counts of all prefixes (from one character on) of a word, or of white space."""
        if part[0] in self.white:
            return [0] * len(part)
        out, begin = [], 0
        for found in self.added.finditer(part):
            before, a = (out[-1] if out else 0), found.start() - begin
            held = self._plain(part[begin : found.end() - 1])  # what leads to the added token is ordinary text until it is whole
            out += [before + c for c in held] + [before + (held[a - 1] if a else 0) + 1]
            begin = found.end()
        before = out[-1] if out else 0
        return out + [before + c for c in self._plain(part[begin:])] if begin < len(part) else out

    def prefixes(self, text: str) -> np.ndarray:
        """The number of tokens of the first 0, 1, ... characters of a text."""
        if SIMPLE.fullmatch(text) and not self.added.search(text):
            parts = map(self.simple.__getitem__, MATCHES.findall(text.lower()))
        else:
            parts = map(self.words.__getitem__, self.split(text))
        steps = np.frombuffer(b"".join(parts), dtype=np.int32)
        out = np.zeros(len(steps) + 1, dtype=np.int32)
        np.cumsum(steps, out=out[1:])
        return out

    def learn(self, texts: list[str]) -> None:
        """Count the new matches of these texts in their order, so that they share their prefixes' states."""
        new = {p for t in texts if SIMPLE.fullmatch(t) for p in MATCHES.findall(t.lower())} - self.simple.keys()
        for p in sorted(new):
            self.simple[p]


def longest_within(counts: np.ndarray) -> np.ndarray:
    """Of the counts of all prefixes, the longest prefix of at most 0, 1, ... tokens, up to the whole's number."""
    least = np.minimum.accumulate(counts[::-1])[::-1]
    return (np.searchsorted(least, np.arange(counts[-1] + 1), side="right") - 1).astype(np.int32)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows)))


def with_counts(df: DataFrame, path: str, text: str = "text", prefixes: str = "prefix_tokens", budgets: str = "budget_chars") -> DataFrame:
    """``df`` with the number of tokens of every prefix of ``text`` and the longest prefix of every number of tokens."""
    names = {prefixes.lower(), budgets.lower()}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in (prefixes, budgets))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            own = [b.column(i) for i, n in enumerate(b.schema.names) if n.lower() not in names]
            lo, held, size = 0, [], 0
            texts = [t or "" for t in b.column(text).to_pylist()]
            count.learn(texts)
            for i, t in enumerate(texts):
                held.append(count.prefixes(t))
                size += len(held[-1])
                if size >= CHUNK_CHARS or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(held)) for c in own), _lists(held), _lists([longest_within(h) for h in held])], names=[f.name for f in schema.fields])
                    lo, held, size = i + 1, [], 0

    return df.transform(arrow_map, run, schema)


def tokens_at(chars: int | Column, prefixes: str = "prefix_tokens") -> Column:
    """The number of tokens of the first ``chars`` characters; of the whole text where it has no more."""
    n = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(prefixes, (F.least(F.greatest(n, F.lit(0)), F.size(prefixes) - 1) + 1).cast("int")).cast("long")


def tokens_in(prefixes: str = "prefix_tokens") -> Column:
    """The number of tokens of the whole text."""
    return F.element_at(prefixes, -1).cast("long")


def chars_within(tokens: int | Column, budgets: str = "budget_chars") -> Column:
    """The length in characters of the longest prefix of at most ``tokens`` tokens; none if the budget is below 0."""
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.when(n >= 0, F.element_at(budgets, (F.least(n, F.size(budgets) - 1) + 1).cast("int")).cast("long"))


def truncated(tokens: int | Column, text: str = "text", budgets: str = "budget_chars") -> Column:
    """The longest prefix of the text of at most ``tokens`` tokens."""
    return F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), chars_within(tokens, budgets).cast("int"))


def counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within the limit)."""
    held = with_counts(docs.select("doc_id", "text"), path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return held.select("doc_id", size.alias("n_bytes"), tokens_in().alias("n_tokens"), (tokens_in() > limit).alias("over_limit"), chars_within(limit).alias("fit_chars"))
