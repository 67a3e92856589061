"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can't end up inside a token, so the text may be cut
there for certain: between any two characters, in any script, with or without white space. The pre-tokenizer's pattern must
not see the cut either. It takes white space in front of what follows, so no cut is made after white space; it takes an apostrophe
with some letters after it, so none is made at an apostrophe or within those letters. Anywhere else a match that goes over the cut is a run
of one class of characters, and both its parts are runs of that class. The fragments (mostly single words with the space before them)
are encoded independently, each distinct one once per chunk of text, and the ids are concatenated. Fragments are told
apart by a hash and then by their bytes.

Defined results: a null text is an empty text; an empty text has no tokens (both digests are of no bytes); texts of any
length are handled whole, in chunks of half a MB (one text at least); equal rows give equal results; an empty table gives an
empty table; other columns of the input are kept by ``encode`` and ``decode``, whose new columns replace ones of that name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import arrow_map
from loamstone.llm.kernel import SPACE, chunks, distinct, gather_bytes, hash_spans, text_buffer

#: Bytes of texts whose letters, digits and white space every Unicode version and pattern engine tells alike: printable ASCII,
#: ASCII white space, and U+00C0 to U+017F.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
#: The pre-tokenizer's pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments whose ids a task remembers from one chunk to the next.
CACHE_FRAGMENTS = 200_000
#: Bytes of text that are encoded at once (one text at least); the arrays this takes are many times as large.
CHUNK = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies: visible Latin-1 bytes are themselves, others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def flat_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(entries) + 1, dtype=np.int64)
    np.cumsum([len(e) for e in entries], out=off[1:])
    return np.frombuffer(b"".join(entries), dtype=np.uint8), off


def _rank_encoder(table: list[bytes], vocab: dict[str, int], merges: list, alphabet: dict[str, int]):
    """A faster encoder of the same vocabulary for plain fragments, if each merge makes the next id (then ids are the merges' ranks)."""
    try:
        import tiktoken
    except ImportError:
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = [vocab.get(a + b) for a, b in pairs]
    base = len({*alphabet} & {*vocab})
    if base != 256 or made != list(range(base, base + len(pairs))):
        return None
    ranks = {token: i for i, token in enumerate(table[: base + len(pairs)])}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same_bytes(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of the span of ``b``."""
    size = a_to - a_from
    out = size == b_to - b_from
    at = np.flatnonzero(out)
    n = size[at]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = a[np.repeat(a_from[at], n) + step] != b[np.repeat(b_from[at], n) + step]
    out[np.repeat(at, n)[differ]] = False
    return out


class ForcedBoundaryBpe:
    """Encoder and decoder of one byte-level BPE tokenizer file (the JSON format of the tokenizers library)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer with its usual pattern, no prefix space and no normalizer is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens that reach over white space can't be cut around")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        table = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            table[i] = bytes(alphabet[c] for c in token)
        for t in spec["added_tokens"]:
            table[t["id"]] = t["content"].encode()
        self.bytes_of = flat_table(table)
        self.digits_of = flat_table([b"%d," % i for i in range(len(table))])
        inside = np.zeros((256, 256), dtype=bool)
        flat, off = self.bytes_of
        joint = np.ones(max(0, len(flat) - 1), dtype=bool)
        joint[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(flat))] - 1] = False  # the last byte of a token and the first of the next
        inside[flat[:-1][joint], flat[1:][joint]] = True
        for pair in ("ll", "ve", "re"):
            inside[ord(pair[0]), ord(pair[1])] = True
        inside[SPACE, :] = inside[:, 0x80:0xC0] = inside[:, ord("'")] = inside[ord("'"), :] = True  # after white space, inside a character, at an apostrophe
        #: By the first byte and the second: certain cuts, if the first doesn't end a white-space character beyond ASCII.
        self.forced = ~inside.ravel()
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.fast = _rank_encoder(table[: len(vocab)], vocab, spec["model"]["merges"], alphabet)
        none = np.zeros(1, np.int64)
        self.cache = np.zeros(0, np.uint64), np.zeros(0, np.int64), none, np.zeros(0, np.uint8), none

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the fragments of all rows, ascending; row starts are among them."""
        if len(buf) == 0:
            return np.zeros(0, np.int64)
        cut = np.zeros(len(buf) + 1, dtype=bool)
        at = np.flatnonzero(self.forced[buf[:-1].astype(np.int32) * 256 + buf[1:]]) + 1
        ok = np.ones(len(at), dtype=bool)
        if (high := np.flatnonzero(buf[at - 1] >= 0x80)).size:  # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
            p = at[high]
            b, c = buf[p - 2], buf[np.maximum(p - 3, 0)]
            z = buf[p - 1]
            wide = (b == 0xC2) & ((z == 0x85) | (z == 0xA0))
            wide |= (c == 0xE1) & (b == 0x9A) & (z == 0x80)
            wide |= (c == 0xE2) & (b == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            wide |= (c == 0xE2) & (b == 0x81) & (z == 0x9F)
            wide |= (c == 0xE3) & (b == 0x80) & (z == 0x80)
            ok[high[wide]] = False
        cut[at[ok]] = True
        cut[offs[:-1]] = True
        cut[len(buf)] = False
        return np.flatnonzero(cut)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows together, and where each row's ids start (one more at the end)."""
        starts = self.cuts(buf, offs)
        if len(starts) == 0:
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(buf))
        h = hash_spans(buf, starts, ends)
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        lead = where[inverse]
        apart = not same_bytes(buf, starts, ends, buf, starts[lead], ends[lead]).all()
        if apart:  # two fragments have one hash: they are told apart by their bytes alone
            seen: dict[bytes, int] = {}
            inverse = np.array([seen.setdefault(buf[x:y].tobytes(), len(seen)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
            _, where = np.unique(inverse, return_index=True)
            unique = h[where]
        known, flat, off, data, d_off = self.cache
        slot = np.searchsorted(known, unique)
        slot[slot == len(known)] = 0
        hit = known[slot] == unique if len(known) else np.zeros(len(unique), dtype=bool)
        at = np.flatnonzero(hit)
        hit[at] = same_bytes(buf, starts[where[at]], ends[where[at]], data, d_off[slot[at]], d_off[slot[at] + 1])
        apart |= len(at) != hit.sum()
        new = np.flatnonzero(~hit)
        if len(new):
            a, z = starts[where[new]], ends[where[new]]
            own, own_off = self._encode_fragments(buf, a, z)
            size = np.concatenate([off[1:] - off[:-1], own_off[1:] - own_off[:-1]])
            slot[new] = len(known) + np.arange(len(new))
            flat, off = np.concatenate([flat, own]), np.concatenate([[0], np.cumsum(size)])
            if len(known) + len(new) <= CACHE_FRAGMENTS and not apart:
                order = np.argsort(known := np.concatenate([known, unique[new]]))
                kept, k_off = gather_bytes(flat, off, order)
                added = np.concatenate([buf[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)])
                held, h_off = gather_bytes(np.concatenate([data, added]), np.concatenate([d_off, d_off[-1] + np.cumsum(z - a)]), order)
                self.cache = known[order], kept, k_off, held, h_off
        ids, first = gather_bytes(flat, off, slot[inverse])
        return ids, first[np.searchsorted(starts, offs)]

    def _added(self, buf: np.ndarray) -> np.ndarray:
        """Where added tokens' contents begin in ``buf``."""
        whole, found = buf.tobytes(), []
        for content in self.added:
            p = whole.find(content)
            while p >= 0:
                found.append(p)
                p = whole.find(content, p + 1)
        return np.array(sorted(found), dtype=np.int64)

    def _encode_fragments(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each fragment, and where they start: those of plain characters by the rank encoder, others by the tokenizer."""
        odd = ~PLAIN[buf] if self.fast is not None else np.ones(len(buf), dtype=bool)
        odd[self._added(buf)] = True
        odd = np.concatenate([[0], np.cumsum(odd)])
        plain = odd[ends] == odd[starts]
        data = memoryview(buf)
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: list = [None] * len(texts)
        for i in np.flatnonzero(plain).tolist():
            ids[i] = self.fast.encode_ordinary(texts[i])
        rest = np.flatnonzero(~plain).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, off[-1]), off

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows together and their offsets; added tokens stand for their content."""
        flat, at = gather_bytes(*self.bytes_of, ids)
        return flat, at[first]


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _rows(df: DataFrame, out: list[T.StructField], work) -> DataFrame:
    """``df`` with columns ``out``, made by ``work(batch)``, in place of columns of those names."""
    names = {f.name.lower() for f in out}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                own = [b.column(i) for i, n in enumerate(b.schema.names) if n.lower() not in names]
                for lo, hi, cols in work(b):
                    arrays = [c.slice(lo, hi - lo) for c in own] + cols
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
        finally:
            codec.cache_clear()  # tasks go round all of an executor's Python workers, and each would keep a vocabulary

    return df.transform(arrow_map, run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` in column ``ids``."""

    def work(b: pa.RecordBatch):
        for lo, hi, buf, offs in chunks(*text_buffer(b.column(text)), CHUNK):
            got, first = codec(path).encode(buf, offs)
            yield lo, hi, [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(got.astype(np.int32)))]

    return _rows(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with column ``text``: the text that ``ids`` stand for; null ids are an empty text."""

    def work(b: pa.RecordBatch):
        for i, row in enumerate(b.column(ids)):
            got = np.array(row.as_py() or [], dtype=np.int64)
            data, _ = codec(path).decode(got, np.array([0, len(got)]))
            yield i, i + 1, [pa.array([data.tobytes().decode("utf-8", "replace")])]

    return _rows(df, [T.StructField(text, T.StringType())], work)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, decoded again from its ids, both digested."""

    def work(b: pa.RecordBatch):
        c = codec(path)
        for lo, hi, buf, offs in chunks(*text_buffer(b.column(text)), CHUNK):
            ids, first = c.encode(buf, offs)
            decoded, at = c.decode(ids, first)
            digits, d_at = gather_bytes(*c.digits_of, ids)
            d_at = d_at[first]
            said, back = memoryview(digits), memoryview(decoded)
            a = [_sha(said[x : max(x, y - 1)]) for x, y in zip(d_at[:-1].tolist(), d_at[1:].tolist(), strict=True)]
            d = [hashlib.sha256(back[x:y].tobytes().decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield lo, hi, [pa.array(first[1:] - first[:-1]), pa.array(a), pa.array(d)]

    return _rows(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], work)


def digests(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the token ids and their number; rows and their other columns stay."""
    return encode(docs, path).withColumn("n_tokens", F.size("ids").cast("long"))
