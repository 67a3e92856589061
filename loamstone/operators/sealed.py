"""Sealed records: a keystream and a tag of HMAC-SHA-256, verified before anything is opened.

A sealed value is ``HMACS:``, 16 bytes of nonce, the plain bytes XOR the keystream (the digests of nonce and block number), and
the tag over nonce and cipher text. The nonce is a digest of the record under the key, so that a task that runs again
seals alike and different records never share a keystream. Values that begin ``FERNET:`` are opened too: their tag is verified,
and their AES-CBC part goes through Spark's own decryption. The key reaches the tasks as a broadcast value or as a column
that a task makes; it is in no plan.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.sources.shared import arrow_map

#: Marks of the two formats (fixed values).
PLAIN_MARK, FERNET_MARK = b"HMACS:", b"FERNET:"


def key_bytes(key: bytes | str) -> bytes:
    """32 bytes as they are; of anything else its digest."""
    data = key.encode() if isinstance(key, str) else bytes(key)
    return data if isinstance(key, bytes) and len(data) == 32 else hashlib.sha256(data).digest()


def stored_key(spark: SparkSession, path: str) -> bytes:
    """The key in the file at ``path``; a random one is written where there is none. Without it no sealed record can be opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p, False)
        out.write(bytearray(secrets.token_bytes(32)))
        out.close()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def _keystream(key: bytes, nonce: bytes, n: int) -> np.ndarray:
    blocks = (hmac.digest(key, nonce + i.to_bytes(8, "big"), "sha256") for i in range(-(-n // 32)))
    return np.frombuffer(b"".join(blocks), np.uint8)[:n]


def _xor(key: bytes, nonce: bytes, data: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ _keystream(key, nonce, len(data))).tobytes()


def seal_bytes(key: bytes, data: bytes, salt: bytes = b"") -> bytes:
    nonce = hmac.digest(key, b"nonce" + len(salt).to_bytes(8, "big") + salt + data, "sha256")[:16]
    sealed = nonce + _xor(key, nonce, data)
    return PLAIN_MARK + sealed + hmac.digest(key, sealed, "sha256")


def open_bytes(key: bytes, blob: bytes | None) -> tuple[bytes | None, bytes | None]:
    """The plain bytes, or what AES is still to decrypt (the initial block and the cipher text); nothing where the tag is wrong."""
    if blob is None:
        return None, None
    if blob.startswith(PLAIN_MARK):
        body = blob[len(PLAIN_MARK) :]
        if len(body) >= 48 and hmac.compare_digest(body[-32:], hmac.digest(key, body[:-32], "sha256")):
            return _xor(key, body[:16], body[16:-32]), None
    elif blob.startswith(FERNET_MARK):
        try:
            raw = base64.urlsafe_b64decode(blob[len(FERNET_MARK) :])
        except ValueError:
            return None, None
        if len(raw) >= 73 and raw[0] == 0x80 and hmac.compare_digest(raw[-32:], hmac.digest(key[:16], raw[:-32], "sha256")):
            return None, raw[9:-32]
    return None, None


def _mapped(df: DataFrame, column: str, out: list[str], work) -> DataFrame:
    """``df`` with binary columns ``out``, made from ``column`` by ``work(value)``."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType()) for n in out)])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [work(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[i] for m in made], pa.binary()) for i in range(len(out)))], names=[f.name for f in schema])

    return arrow_map(df, run, schema)


def sealed(df: DataFrame, column: str, out: str, key: bytes | str, salt: str = "") -> DataFrame:
    """``df`` with the sealed form of a string or binary column; a null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(key_bytes(key))
    work = lambda x: (None if x is None else seal_bytes(shared.value, x, salt.encode()),)
    if dict(df.dtypes)[column] == "binary":
        return _mapped(df, column, [out], work)
    return _mapped(df.withColumn("__plain", F.col(column).cast("binary")), "__plain", [out], work).drop("__plain")


def opened(df: DataFrame, column: str, out: str, key: bytes | str) -> DataFrame:
    """``df`` with the plain bytes of a sealed column; null where the tag is wrong or the format unknown."""
    shared = df.sparkSession.sparkContext.broadcast(key_bytes(key))

    def work(x: bytes | None) -> tuple:
        plain, rest = open_bytes(shared.value, x)
        return plain, rest, None if rest is None else shared.value[16:]

    rows = _mapped(df, column, ["__plain", "__aes", "__key"], work)
    return rows.withColumn(out, F.coalesce("__plain", F.try_aes_decrypt("__aes", "__key", F.lit("CBC"), F.lit("PKCS")))).drop("__plain", "__aes", "__key")
