import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from loamstone.operators import jobs as J
from loamstone.operators import sealed as Z

KEY = bytes(range(32))


def test_round_trip_and_tampering(spark):
    texts = ["", "a", "é" * 40, "x" * 5000, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    shut = Z.sealed(rows, "text", "blob", KEY)
    assert KEY.hex() not in shut._jdf.queryExecution().toString() and str(list(KEY)[:8])[1:-1] not in shut._jdf.queryExecution().toString()
    got = Z.opened(shut, "blob", "plain", KEY)
    assert {r.id: None if r.plain is None else bytes(r.plain).decode() for r in got.collect()} == dict(enumerate(texts))
    blobs = [bytes(r.blob) for r in shut.filter("text IS NOT NULL").collect()]
    assert len({b[6:22] for b in blobs}) == 4 and all(b.startswith(b"HMACS:") for b in blobs)
    for b in blobs:
        body = b[6:]
        assert hmac.digest(KEY, body[:-32], "sha256") == body[-32:]
        for k in {0, 7, len(b) // 2, len(b) - 1}:
            assert Z.open_bytes(KEY, b[:k] + bytes([b[k] ^ 1]) + b[k + 1 :]) == (None, None)
    assert Z.open_bytes(bytes(32), blobs[1]) == (None, None) and Z.open_bytes(KEY, b"HMACS:") == (None, None) and Z.open_bytes(KEY, b"other") == (None, None)


def test_the_other_format_is_opened(spark):
    iv, text = bytes(range(16)), "hello, 世界"
    made = spark.createDataFrame([(text, KEY[16:], iv)], "t string, k binary, iv binary").select(F.expr("aes_encrypt(cast(t as binary), k, 'CBC', 'PKCS', iv)").alias("x")).first().x
    raw = b"\x80" + (1_700_000_000).to_bytes(8, "big") + bytes(made)
    token = b"FERNET:" + base64.urlsafe_b64encode(raw + hmac.digest(KEY[:16], raw, "sha256"))
    bad = token[:40] + (b"A" if token[40:41] != b"A" else b"B") + token[41:]
    rows = spark.createDataFrame([(1, bytearray(token)), (2, bytearray(bad)), (3, bytearray(b"FERNET:?"))], "id int, blob binary")
    got = {r.id: r.plain and bytes(r.plain).decode() for r in Z.opened(rows, "blob", "plain", KEY).collect()}
    assert got == {1: text, 2: None, 3: None}


def test_keys(spark, tmp_path):
    assert Z.key_bytes(KEY) == KEY and Z.key_bytes("k") == hashlib.sha256(b"k").digest()
    path = str(tmp_path / "backup.key")
    key = Z.stored_key(spark, path)
    assert len(key) == 32 and Z.stored_key(spark, path) == key


def test_backfill_goes_on_where_it_was_cut_off(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i:02d}", f"text {i}") for i in range(20)], "id string, content string").coalesce(1)
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts, dim, die=None, fail=None):
        for t in texts:
            with open(calls / hashlib.md5(t.encode()).hexdigest(), "a") as f:
                f.write("x")
        if die in texts:
            raise RuntimeError("killed")
        if fail in texts:
            raise OSError("down")
        return J.hash_embedding(texts, dim)

    path = str(tmp_path / "backfill")
    with pytest.raises(Exception, match="killed"):
        J.backfill(rows, path, lambda t, d: embed(t, d, die="text 13"), 8, per_file=4)
    done = {int(r.memory_id[1:]) for r in spark.read.parquet(f"{path}/vectors/*").collect()}  # files come in any order
    number = lambda i: len(f.read_text()) if (f := calls / hashlib.md5(f"text {i}".encode()).hexdigest()).exists() else 0
    assert len(done) % 4 == 0 and 13 not in done
    got = {int(r.memory_id[1:]) for r in J.backfill(rows, path, lambda t, d: embed(t, d, fail="text 17"), 8, per_file=4).collect()}
    assert done <= got and len(got) == (20 if 17 in done else 16) and (17 in got) == (17 in done)  # the failed call's file waits for the next run
    assert all(number(i) == 1 for i in done) and number(13) >= 2
    whole = {r.memory_id: r.vec for r in J.backfill(rows, path, embed, 8, per_file=4).collect()}
    assert len(whole) == 20 and all(number(i) == 1 for i in done)
    assert whole["m05"] == pytest.approx(J.hash_embedding(["text 5"], 8)[0].tolist())


def test_batches_of_sealed_copies_are_bounded(spark):
    """Python holds a few MB of copies at a time, however large a partition is."""
    from loamstone.sources.shared import arrow_map

    rows = spark.range(3000, numPartitions=1).select(F.concat(F.lit("m"), F.col("id")).alias("id"), F.lit("semantic").alias("kind"), F.expr("repeat(sha2(cast(id as string), 256), 150)").alias("content"), F.lit(5).alias("importance"), F.lit(0).cast("long").alias("created_ts"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    Z.sealed(rows, "content", "blob", KEY)  # sets the session's bound where there is none
    assert arrow_map(rows, sizes, "n long").agg(F.max("n")).first()[0] < 6 << 20
    shards = J.replicas(rows.limit(40), KEY, 5)
    bad = shards.withColumn("payload", F.when(F.col("copy") < 2, F.concat("payload", F.lit("x").cast("binary"))).otherwise(F.col("payload")))
    assert J.restored(bad, KEY).count() == 40
    newer = bad.unionByName(shards.filter("memory_id = 'm0'").withColumns({"created_ts": F.lit(9).cast("long"), "sha256": F.lit("0")}))
    got = J.restored(newer, KEY)
    assert got.count() == 39 and got.filter("memory_id = 'm0'").isEmpty()
    # other bytes under the same copy number: the first whole copy whose tag is right
    forged = shards.filter("memory_id = 'm1'").withColumn("payload", F.lit("HMACS:no").cast("binary")).withColumn("sha256", F.sha2("payload", 256)).withColumn("copy", F.lit(-1))
    assert {r.memory_id: '"m1"' in r.record for r in J.restored(shards.filter("memory_id = 'm1'").unionByName(forged), KEY).collect()} == {"m1": True}
