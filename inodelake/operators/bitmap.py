"""Allocation: free runs, fragmentation, first fit, freeing and contiguous layout.

A bitmap is a DataFrame (bit_index, used). Every operator is set-based; sums and
ranks over all bits are done in two phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inodelake import layout
from inodelake.runtime import with_rank, with_running

#: Bits that one window looks at; runs are joined across these stretches afterwards.
STRETCH = 1 << 16


def free_runs(bits: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """run_start and run_length of every maximal run of free, consecutive bits.

    Runs are found inside stretches of ``stretch`` bits; only runs that touch the
    edge of a stretch, two a stretch at most, are looked at together.
    """
    free = bits.where(~F.col("used")).select("bit_index", F.expr(f"bit_index div {stretch}").alias("stretch"))
    order = Window.partitionBy("stretch").orderBy("bit_index")
    runs = free.withColumn("run", F.col("bit_index") - F.row_number().over(order)).groupBy("stretch", "run").agg(F.min("bit_index").alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    edge = (F.col("run_start") == F.col("stretch") * stretch) | (F.col("run_start") + F.col("run_length") == (F.col("stretch") + 1) * stretch)
    runs = runs.select("run_start", "run_length", edge.alias("edge"))
    across = Window.orderBy("run_start")
    joined = runs.where("edge").withColumn("new", F.coalesce(F.lag(F.col("run_start") + F.col("run_length")).over(across) != F.col("run_start"), F.lit(True)).cast("int"))
    joined = joined.withColumn("whole", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("whole").agg(F.min("run_start").alias("run_start"), F.sum("run_length").alias("run_length"))
    return runs.where("not edge").select("run_start", "run_length").union(joined.select("run_start", "run_length"))


def frag_stats(bits: DataFrame) -> DataFrame:
    """One row: blocks, free runs and the fragmentation ratio of a bitmap."""
    counts = bits.agg(F.count(F.lit(1)).alias("total_blocks"), F.count_if("used").alias("used_blocks"))
    runs = free_runs(bits).agg(F.count(F.lit(1)).alias("free_runs"), F.coalesce(F.max("run_length"), F.lit(0)).cast("long").alias("largest_free_run"), F.coalesce(F.avg("run_length"), F.lit(0.0)).alias("avg_gap_size"))
    free = F.col("total_blocks") - F.col("used_blocks")
    ratio = F.when((free > 0) & (F.col("free_runs") > 1), (F.col("free_runs") - 1) / F.greatest(free - 1, F.lit(1))).otherwise(0.0)
    return counts.crossJoin(runs).select("total_blocks", "used_blocks", free.alias("free_blocks"), "free_runs", "largest_free_run", "avg_gap_size", ratio.alias("fragmentation_ratio"))  # one row each


def size_report(stats: DataFrame) -> DataFrame:
    """One row: ``frag_stats`` in KB, the mean gap with two digits, and the ratio in percent."""
    kb = layout.BLOCK // 1024
    sizes = [(F.col(c) * kb).alias(c.replace("blocks", "kb")) for c in ("total_blocks", "used_blocks", "free_blocks")]
    return stats.select(*sizes, (F.col("largest_free_run") * kb).alias("largest_free_kb"), F.format_string("%.2f", "avg_gap_size").alias("avg_gap"), F.format_string("%.2f%%", F.col("fragmentation_ratio") * 100).alias("fragmentation"))


def defragmented(bits: DataFrame) -> DataFrame:
    """The bitmap with as many used bits as before, all at its start."""
    about = bits.agg(F.min("bit_index").alias("first"), F.count_if("used").alias("n"))
    return bits.crossJoin(about).select("bit_index", (F.col("bit_index") < F.col("first") + F.col("n")).alias("used"))  # one row beside each


def defrag_stats(bits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: what laying ``files`` (file_id, kind, size) out anew moves, and the bitmap's fragmentation before and after.

    blocks_freed is by how many free runs fell, not below 0.
    """
    moved = files.where("kind = 'f' and size > 0").agg(F.count(F.lit(1)).alias("files_processed"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_moved"))
    before = frag_stats(bits).select(F.col("free_runs").alias("runs_before"), F.col("fragmentation_ratio").alias("frag_before"))
    after = frag_stats(defragmented(bits)).select(F.col("free_runs").alias("runs_after"), F.col("fragmentation_ratio").alias("frag_after"))
    freed = F.greatest(F.col("runs_before") - F.col("runs_after"), F.lit(0)).alias("blocks_freed")
    return moved.crossJoin(before).crossJoin(after).select("files_processed", "bytes_moved", freed, "frag_before", "frag_after")  # one row each


def first_free(bits: DataFrame) -> DataFrame:
    """One row: the lowest free bit, null if there is none."""
    return bits.where(~F.col("used")).agg(F.min("bit_index").alias("first_free"))


def blocks_of(size: Column) -> Column:
    return F.ceil(size / layout.BLOCK).cast("long")


def allocate_first_fit(bits: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, nth and bit_index: the free bits, lowest first, dealt to ``requests`` (request_id, n_blocks) in order of request_id.

    Requests beyond the last free bit get null.
    """
    units = requests.where("n_blocks > 0").select("request_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("nth"))
    units = with_rank(units, [], [F.col("request_id"), F.col("nth")], "turn")
    free = with_rank(bits.where(~F.col("used")).select("bit_index"), [], [F.col("bit_index")], "free_turn")
    return units.join(free, F.col("turn") == F.col("free_turn"), "left").select("request_id", "nth", "bit_index")


def free_bits(bits: DataFrame, freed: DataFrame, offset: int = 0) -> DataFrame:
    """The bitmap after freeing the bits of ``freed`` (bit_index); numbers below ``offset`` are ignored."""
    gone = freed.where(F.col("bit_index") >= offset).select(F.col("bit_index").alias("gone")).distinct()
    return bits.join(gone, F.col("bit_index") == F.col("gone"), "left").select("bit_index", (F.col("used") & F.col("gone").isNull()).alias("used"))


def bit_address(bits: DataFrame) -> DataFrame:
    """Byte, place in the byte and mask of every bit, lowest bit first."""
    place = (F.col("bit_index") % 8).cast("int")
    return bits.select("bit_index", F.expr("bit_index div 8").alias("byte_index"), place.alias("bit_in_byte"), F.call_function("shiftleft", F.lit(1), place).alias("mask"), "used")


def contiguous_layout(files: DataFrame, first_block: int = layout.DATA_START) -> DataFrame:
    """file_id, n_blocks, new_first_block: files (file_id, size) laid out one after another in order of file_id; empty files are left out."""
    sized = files.where("size > 0").select("file_id", blocks_of(F.col("size")).alias("n_blocks"))
    placed = with_running(sized, [], [F.col("file_id")], F.col("n_blocks"), "upto")
    return placed.select("file_id", "n_blocks", (F.col("upto") - F.col("n_blocks") + first_block).alias("new_first_block"))


def superblock_layout(images: DataFrame) -> DataFrame:
    """The layout of images (image_id, total_blocks); ``valid`` tells whether any data block is left."""
    return images.select(
        "image_id",
        F.lit(layout.MAGIC).cast("long").alias("magic"),
        F.lit(layout.BLOCK).cast("long").alias("block_size"),
        F.col("total_blocks").alias("block_count"),
        F.lit(layout.INODE_BITMAP).cast("long").alias("inode_bitmap_block"),
        F.lit(layout.DATA_BITMAP).cast("long").alias("data_bitmap_block"),
        F.lit(layout.INODE_TABLE).cast("long").alias("inode_table_block"),
        F.lit(layout.INODES).cast("long").alias("inode_count"),
        F.lit(layout.DATA_START).cast("long").alias("data_block_start"),
        F.greatest(F.col("total_blocks") - layout.DATA_START, F.lit(0)).cast("long").alias("data_blocks"),
        F.least(F.greatest(F.col("total_blocks") - layout.DATA_START, F.lit(0)), F.lit(layout.BITS)).cast("long").alias("allocatable_blocks"),
        (F.col("total_blocks") > layout.DATA_START).alias("valid"),
    )
