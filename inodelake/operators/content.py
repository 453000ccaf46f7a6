"""File content: chunks, reassembly, appends, overwrites and deletes as set-based batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inodelake import layout
from inodelake.operators.bitmap import contiguous_layout
from inodelake.runtime import with_running


def chunks(files: DataFrame) -> DataFrame:
    """file_id, chunk_no and data: the content (binary) in blocks; empty files have none."""
    n = F.ceil(F.octet_length("content") / layout.BLOCK).cast("int")
    # the blocks are cut before the rows are multiplied, so no row but the first holds the whole content
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("content", k * layout.BLOCK + 1, F.lit(layout.BLOCK)))
    return files.where(F.octet_length("content") > 0).select("file_id", F.posexplode(cut).alias("chunk_no", "data"))


def reassembled(pieces: DataFrame) -> DataFrame:
    """file_id and content from chunks (file_id, chunk_no, data) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "data")))
    # binaries are joined as hexadecimal text: array_join takes text only
    return pieces.groupBy("file_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["data"])), "")).alias("content"))


def ended(line: Column) -> Column:
    """A line with a line break at its end; null counts as empty."""
    line = F.coalesce(line, F.lit(""))
    return F.when(F.endswith(line, F.lit("\n")), line).otherwise(F.concat(line, F.lit("\n")))


def appended(lines: DataFrame) -> DataFrame:
    """file_id and content: the texts of ``lines`` (file_id, seq, line) in order, each ended by a line break.

    A whole content is one value, which Spark limits to 2 GB; ``append_places`` has no such limit.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", ended(F.col("line")).alias("line"))))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("content"))


def append_places(lines: DataFrame) -> DataFrame:
    """file_id, seq, line, start and n_bytes: where each of ``lines`` (file_id, seq, line) comes to stand in its log; no log is held in one task."""
    rows = lines.select("file_id", "seq", ended(F.col("line")).alias("line"))
    placed = with_running(rows, ["file_id"], [F.col("seq"), F.col("line")], F.octet_length("line"), "upto")
    n = F.octet_length("line").cast("long")
    return placed.select("file_id", "seq", "line", (F.col("upto") - n).alias("start"), n.alias("n_bytes"))


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an upsert of whole rows, reduced before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def without(entries: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``entries`` whose key is not in ``deleted``."""
    return entries.join(deleted.select(key), key, "left_anti")


def stored_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (file_id, content) laid out one after another: inodes (file_id, size, blocks) and blocks (block_id, data, filled up with zeros)."""
    placed = contiguous_layout(files.select("file_id", F.octet_length("content").cast("long").alias("size")))
    first = placed.select(F.col("file_id").alias("of"), "new_first_block", "n_blocks")
    pointers = F.when(F.col("of").isNull(), F.array().cast("array<long>")).otherwise(F.sequence("new_first_block", F.col("new_first_block") + F.col("n_blocks") - 1))
    inodes = files.select("file_id", F.octet_length("content").cast("long").alias("size")).join(first, F.col("file_id") == F.col("of"), "left").select("file_id", "size", pointers.alias("blocks"))
    data = chunks(files).join(first, F.col("file_id") == F.col("of")).select((F.col("new_first_block") + F.col("chunk_no")).alias("block_id"), F.rpad("data", layout.BLOCK, F.lit(b"\0")).alias("data"))
    return inodes, data


def read_files(inodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """file_id and content by joining the pointers of ``inodes`` (file_id, size, blocks) to ``blocks`` (block_id, data), in order, up to the first pointer 0, cut to the size."""
    held = F.when(F.array_contains("blocks", F.lit(0)), F.slice("blocks", 1, F.array_position("blocks", F.lit(0).cast("long")).cast("int") - 1)).otherwise(F.col("blocks"))
    pointers = inodes.select("file_id", F.posexplode(held).alias("chunk_no", "pointer"))
    met = pointers.join(blocks, F.col("pointer") == F.col("block_id")).select("file_id", "chunk_no", "data")
    whole = reassembled(met).select(F.col("file_id").alias("of"), F.col("content").alias("data"))
    out = inodes.join(whole, F.col("file_id").eqNullSafe(F.col("of")), "left")
    return out.select("file_id", F.coalesce(F.substring("data", F.lit(1), F.col("size").cast("int")), F.lit(b"")).alias("content"))


def as_text(files: DataFrame) -> DataFrame:
    """file_id, text and error: the content as UTF-8; null and an error where it is none."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(text.isNull() & F.col("content").isNotNull(), F.lit("non-UTF-8 data"))
    return files.select("file_id", text.alias("text"), error.alias("error"))
