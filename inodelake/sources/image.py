"""Reading block images as tables: superblock, inodes, dirents, bitmap, blocks and file contents.

An image is one file of at most a few hundred megabytes; Spark reads many of
them as rows of ``binaryFile`` and the fixed-width records are decoded with
column functions. Only directory entries, whose places depend on the ones before, are decoded in Python, a
directory block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inodelake import layout
from inodelake.functions import codec
from inodelake.operators.content import reassembled

# Fields of the packed little-endian records and their bytes.
SUPERBLOCK = (
    ("magic", 4),
    ("block_size", 4),
    ("block_count", 8),
    ("inode_bitmap_block", 8),
    ("data_bitmap_block", 8),
    ("inode_table_block", 8),
    ("inode_count", 8),
    ("data_block_start", 8),
    ("root_inode", 8),
    ("encrypted", 1),
    ("encryption_salt", -16),
    ("encryption_version", 1),
)
INODE = (("mode", 4), ("size", 8), ("compressed_size", 8), ("created_at", 8), ("modified_at", 8), *((f"b{k}", 8) for k in range(layout.POINTERS)), ("encrypted", 1), ("encryption_nonce", -24))


def fields(data: Column, record: tuple) -> list[Column]:
    """The fields of a record at the start of ``data``; a negative size is bytes as they are."""
    out, at = [], 0
    for name, size in record:
        out.append((codec.from_little_endian(data, at, size) if size > 0 else F.substring(data, at + 1, -size)).alias(name))
        at += abs(size)
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content and superblock fields of the images at ``path``; others than images, and images without data blocks, are an error."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.select("path", "content", *fields(F.col("content"), SUPERBLOCK)).withColumn("encrypted", F.col("encrypted") != 0)
    good = (F.col("magic") == layout.MAGIC) & (F.col("block_size") == layout.BLOCK) & (F.col("block_count") > F.col("data_block_start"))
    return rows.withColumn("magic", F.when(F.coalesce(good, F.lit(False)), F.col("magic")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), "path")).cast("long")))


def block(number: Column) -> Column:
    return F.substring("content", (number * layout.BLOCK + 1).cast("int"), F.lit(layout.BLOCK))


def bitmap(rows: DataFrame) -> DataFrame:
    """path, kind (inode, data), bit_index and used; data bits only as far as the image has blocks."""
    one = lambda kind, at, n: rows.select("path", F.lit(kind).alias("kind"), block(F.col(at)).alias("bytes"), n.alias("n"))
    both = one("inode", "inode_bitmap_block", F.least("inode_count", F.lit(layout.SAFE_INODES))).union(one("data", "data_bitmap_block", F.least(F.col("block_count") - F.col("data_block_start"), F.lit(layout.BITS))))
    return both.select("path", "kind", F.posexplode(_bits(F.col("bytes"), F.col("n"))).alias("bit", "used")).select("path", "kind", F.col("bit").cast("long").alias("bit_index"), "used")


def _bits(data: Column, n: Column) -> Column:
    """The first ``n`` bits of ``data``, lowest of each byte first, as an array."""
    byte = lambda k: F.conv(F.hex(F.substring(data, F.floor(k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.getbit(byte(k), k % 8) == 1)


def inodes(rows: DataFrame) -> DataFrame:
    """path, inode_id and fields of every inode in use; mode is f or d, other modes are an error."""
    used = _bits(block(F.col("inode_bitmap_block")), F.least("inode_count", F.lit(layout.SAFE_INODES)))
    table_at = F.col("inode_table_block") * layout.BLOCK + 1
    # slots are cut from the image's own row, which is neither shuffled nor repeated
    cut = F.transform(used, lambda on, k: F.when(on, F.substring("content", (table_at + k * layout.INODE_SLOT).cast("int"), F.lit(layout.INODE_SLOT))))
    slots = rows.select("path", F.posexplode(cut).alias("inode_id", "slot")).where("slot is not null")
    read = slots.select("path", F.col("inode_id").cast("long").alias("inode_id"), *fields(F.col("slot"), INODE))
    mode = F.when(F.col("mode") == 0, "f").when(F.col("mode") == 1, "d").otherwise(F.raise_error(F.concat(F.lit("unknown mode in "), "path")))
    return read.select(
        "path", "inode_id", mode.alias("mode"), "size", "compressed_size", "created_at", "modified_at",
        F.array(*[f"b{k}" for k in range(layout.POINTERS)]).alias("blocks"), (F.col("encrypted") != 0).alias("encrypted"), "encryption_nonce",
    )


def data_blocks(rows: DataFrame) -> DataFrame:
    """path, block_id and data of every block from the first data block on."""
    cut = F.transform(F.sequence("data_block_start", F.col("block_count") - 1), lambda k: F.struct(k.alias("block_id"), block(k).alias("data")))
    return rows.select("path", F.explode(cut).alias("b")).select("path", "b.block_id", "b.data")


def blocks(rows: DataFrame) -> DataFrame:
    """path, inode_id, chunk_no and data of the blocks that inodes point to: pointers joined to blocks."""
    points = inodes(rows).select(F.col("path").alias("of"), "inode_id", F.posexplode("blocks").alias("chunk_no", "pointer")).where("pointer <> 0")
    met = points.join(data_blocks(rows), (F.col("path") == F.col("of")) & (F.col("block_id") == F.col("pointer")))
    return met.select("path", "inode_id", "chunk_no", "data")


def dirents(rows: DataFrame) -> DataFrame:
    """path, parent_id, slot, inode_id and name of every directory entry."""
    dirs = inodes(rows).where("mode = 'd'").select("path", "inode_id")
    held = blocks(rows).where("chunk_no = 0").join(dirs, ["path", "inode_id"]).select("path", "inode_id", "data")

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, parent, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, slot = 0, 0
                while at + layout.ENTRY_HEAD <= len(data):
                    n = int.from_bytes(data[at + 16 : at + 18], "little")
                    if not n or at + layout.ENTRY_HEAD + n > len(data):
                        break
                    name = data[at + layout.ENTRY_HEAD : at + layout.ENTRY_HEAD + n].decode()
                    out.append((path, parent, slot, int.from_bytes(data[at : at + 8], "little"), name))
                    at, slot = at + layout.ENTRY_HEAD + n, slot + 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["path", "parent_id", "slot", "inode_id", "name"])

    return held.mapInArrow(decode, "path string, parent_id long, slot long, inode_id long, name string")


def contents(rows: DataFrame) -> DataFrame:
    """path, inode_id, content and error of every plain file: blocks in order, cut to the stored size, decompressed.

    The content of an encrypted file, whose cipher isn't one of Spark's, is null, with an error.
    """
    stored = inodes(rows).where("mode = 'f'")
    key = F.struct("path", "inode_id")
    whole = reassembled(blocks(rows).select(key.alias("file_id"), "chunk_no", "data")).select(F.col("file_id.path").alias("of"), F.col("file_id.inode_id").alias("file"), F.col("content").alias("data"))
    physical = F.when(F.col("compressed_size") > 0, F.col("compressed_size")).otherwise(F.col("size"))
    cut = stored.join(whole, (F.col("path") == F.col("of")) & (F.col("inode_id") == F.col("file")), "left").withColumn("data", F.coalesce(F.substring("data", F.lit(1), physical.cast("int")), F.lit(b"")))
    packed = F.when((F.col("compressed_size") > 0) & ~F.col("encrypted"), F.col("data"))
    plain = F.when(~F.col("encrypted"), F.coalesce(codec.zstd_decode(packed), F.col("data")))
    return cut.select("path", "inode_id", plain.alias("content"), F.when(F.col("encrypted"), "encrypted").alias("error"))
