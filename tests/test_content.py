import struct

from pyspark.sql import functions as F

from inodelake.functions import codec
from inodelake.operators import content


def test_chunks_at_the_block_edge(spark):
    sizes = [0, 1, 4095, 4096, 4097, 8192]
    files = spark.createDataFrame([(n, bytes([n % 251]) * n) for n in sizes], "file_id long, content binary")
    pieces = content.chunks(files)
    assert {r[0]: r[1] for r in pieces.groupBy("file_id").count().collect()} == {1: 1, 4095: 1, 4096: 1, 4097: 2, 8192: 2}
    back = {r["file_id"]: bytes(r["content"]) for r in content.reassembled(pieces).collect()}
    assert back == {n: bytes([n % 251]) * n for n in sizes if n}


def test_append_ends_every_line(spark):
    rows = spark.createDataFrame([(1, 2, "b\n"), (1, 1, "a"), (1, 3, None), (2, 1, "")], "file_id long, seq long, line string")
    assert dict(content.appended(rows).collect()) == {1: "a\nb\n\n", 2: "\n"}


def test_upsert_replaces_whole_rows(spark):
    rows = spark.createDataFrame([("p", 1, "long old text"), ("p", 2, "new"), ("q", 1, None)], "path string, seq long, body string")
    assert {(r["path"], r["body"]) for r in content.latest(rows, "path", ["seq"]).collect()} == {("p", "new"), ("q", None)}


def test_compression_modes(spark):
    data = [(1, b"A" * 10_240, "auto"), (2, b"A" * 100, "auto"), (3, b"A" * 100, "always"), (4, b"A" * 10_240, "never"), (5, None, "auto")]
    rows = spark.createDataFrame(data, "id long, content binary, mode string").withColumn("packed", codec.zstd_encode("content"))
    rows = rows.withColumn("stored", codec.stored(F.col("content"), F.col("packed"), F.col("mode"))).withColumn("back", codec.zstd_decode("packed"))
    got = {r["id"]: r for r in rows.collect()}
    assert [len(got[k]["stored"]) < len(got[k]["content"]) for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert all(got[k]["back"] == got[k]["content"] for k in got)


def test_compression_gets_few_bytes_at_a_time(spark):
    # each batch's largest row count and bytes, as a function in the same session sees them
    rows = spark.range(0, 4000, 1, 1).withColumn("content", F.rpad(F.col("id").cast("string"), 20_000, F.lit("x")).cast("binary"))
    rows = rows.withColumn("same", codec.zstd_decode(codec.zstd_encode("content")) == F.col("content"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    assert rows.where("same").count() == 4000
    n, size = rows.select("content").mapInArrow(sizes, "n long, size long").agg(F.max("n"), F.max("size")).first()
    assert n <= codec.ROWS and size <= 5 << 20


def test_the_policy_query_gets_few_bytes_at_a_time(spark):
    from inodelake.plans.queries import QUERIES
    from inodelake.runtime import BATCH_BYTES

    rows, size = (f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes"))
    spark.conf.set(rows, "10000")
    spark.conf.set(size, str(64 << 20))
    assert QUERIES["compress_policy"](spark, "/root/testdata/sf0.001").where("restored").count() == 200
    assert int(spark.conf.get(rows)) <= codec.ROWS and int(spark.conf.get(size)) <= BATCH_BYTES


def test_encryption_hides_and_authenticates(spark):
    key, wrong = codec.derive_key("secret", b"s" * 16), codec.derive_key("other", b"s" * 16)
    assert key != codec.derive_key("secret", b"t" * 16)
    rows = spark.createDataFrame([(k, b"a distinctive plaintext") for k in range(5)], "id long, content binary").withColumn("sealed", codec.encrypt(F.col("content"), key))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = rows.select("content", "sealed", codec.decrypt(F.col("sealed"), key).alias("open"), codec.decrypt(F.col("sealed"), wrong).alias("wrong")).collect()
    assert len({bytes(r["sealed"]) for r in got}) == 5
    assert all(r["open"] == r["content"] and r["wrong"] is None and b"distinctive" not in bytes(r["sealed"]) for r in got)


def test_little_endian_equals_struct(spark):
    values = [0, 1, 255, 256, 0x4F494653, 2**53 + 1, 2**63 - 1]
    rows = spark.createDataFrame([(v, struct.pack("<Q", v)) for v in values], "v long, raw binary")
    for r in rows.select("v", "raw", codec.to_little_endian(F.col("v")).alias("out"), codec.from_little_endian(F.col("raw")).alias("back")).collect():
        assert r["out"] == r["raw"] and r["back"] == r["v"]
    big = spark.createDataFrame([(struct.pack("<Q", 2**63),)], "raw binary")
    assert big.select(codec.from_little_endian(F.col("raw"))).first()[0] is None
