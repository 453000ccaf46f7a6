"""Best-fit packing of token sequences: large items matched in pairs, small ones best-fit into the gaps.

Pieces of one length are interchangeable, so what is packed is the histogram of
lengths, which has at most ``capacity`` rows whatever the corpus. The result is
a table of slots, each for a run of ranks of one length; every piece finds its
slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.tokens import MEMORY, small_batches, tokenizer, word_bpe
from inodelake.runtime import running_start, table, written

SLOTS = "length int, first long, after long, each long, base long, offset int"


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, rank after the last, pieces a bin, first bin, offset) and the number of bins.

    Lengths above a third of the capacity go at most two to a bin: the longest
    takes the longest partner that fits. The others, longest first, go to the
    tightest gap that holds them, and to new bins when none does. Bins with the
    same gap and neighbouring numbers are handled together, so the work depends
    on the lengths, not on how many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first bin, how many)
    bins = 0

    def put(length: int, base: int, n_bins: int, each: int, offset: int) -> None:
        n = n_bins * each
        slots.append((length, used[length], used[length] + n, each, base, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, base: int, n_bins: int) -> None:
        if gap and n_bins:
            gaps.setdefault(gap, []).append((base, n_bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((p for p in large if p <= min(length, capacity - length) and left[p] > (p == length)), None)
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            if partner == length:
                put(length, bins, n, 2, 0)
                leave(capacity - 2 * length, bins, n)
            else:
                put(length, bins, n, 1, 0)
                if partner is not None:
                    put(partner, bins, n, 1, length)
                leave(capacity - length - (partner or 0), bins, n)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                each = capacity // length
                n = max(1, left[length] // each)
                gap, base = capacity, bins
                bins += n
            else:
                base, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            each = min(gap // length, left[length])
            full = min(n, left[length] // each)
            put(length, base, full, each, capacity - gap)
            leave(gap - each * length, base, full)
            leave(gap, base + full, n - full)
    return slots, bins


def pieces(docs: DataFrame, capacity: int, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The pieces of every document's ids, written to the shared folder.

    One row per piece: doc_id, piece, start, length, ids_crc32, and its running
    number ``nth`` among the pieces of its length in its partition ``part``.
    """
    path = path or word_bpe()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        codec, part = tokenizer(path, memory), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                whole = np.concatenate([ids, end]).astype("<u4")
                for k, a in enumerate(range(0, len(whole), capacity)):
                    one = whole[a : a + capacity]
                    rows.append((part, key, k, a, len(one), zlib.crc32(one), int(seen[len(one)])))
                    seen[len(one)] += 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(small_batches(rows).mapInArrow(cut, "part long, doc_id long, piece int, start long, length int, ids_crc32 long, nth long"), "pieces")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut.
    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end id alone; an empty table gives no rows;
    repeated rows are packed as often as they occur; rows without a doc_id are
    packed as well; other columns are ignored; texts of any length are encoded whole. ``memory``: words that a worker remembers.
    """
    spark, cut = docs.sparkSession, pieces(docs, capacity, end_id, path, id_col, text_col, memory)
    by_part = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots, _ = plan_bins(counts, capacity)
    placed = spark.createDataFrame(slots, SLOTS)
    # rank among the pieces of a length: those of earlier partitions, then nth in the own one
    at = (F.col("length").cast("long") * (1 << 32) + F.col("part")).alias("at")
    starts = running_start(by_part.select(at, "n"), "at", "n", "before", 1 << 32)
    firsts = spark.createDataFrame([(n, sum(c for m, c in counts.items() if m < n)) for n in counts], "length int, smaller long")
    # a row a part and length: it grows with the parts, so it is merged and not broadcast
    cut = cut.withColumn("at", at).join(starts.select("at", "before").hint("merge"), "at")
    cut = cut.join(F.broadcast(firsts), "length").withColumn("rank", F.col("before") - F.col("smaller") + F.col("nth"))
    slot = placed.withColumnRenamed("length", "slot_length")
    found = cut.join(F.broadcast(slot), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    along = F.col("rank") - F.col("first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("base") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("offset") + (along % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), 2048)
