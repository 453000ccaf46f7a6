"""Token-id files: frequency-ranked ids, byte-aligned variable length, control bytes apart.

One file holds consecutive documents in ascending id order:

    magic ``FVB1`` | header of five little-endian u64: documents, tokens,
    distinct ids, data bytes, end id | distinct ids by falling frequency (u32) |
    document ids (i64) | null marks of the document ids (u8) | document lengths (u64) |
    control bytes, four 2-bit lengths each | data bytes

A token is stored as the rank of its id in the file's own frequency table, in
one to four bytes. The table covers every token of the file, so a file can be
read alone and files can be written in one pass over the texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.stores import write_file
from inodelake.llm.tokens import small_batches, tokenizer, word_bpe
from inodelake.runtime import running_start, shared_folder, written

MAGIC = b"FVB1"
#: Bytes of the four tokens that a control byte stands for.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank table, control bytes and data bytes of ``ids``."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank[ids] if len(ids) else np.zeros(0, dtype=np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8)
    if len(table) > 1 << 16:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF).astype(np.uint8)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = extra
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ids) + 1)
    starts = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(ids) else 0, dtype=np.uint8)
    data[starts] = ranks & 0xFF
    for k in range(1, int(extra.max(initial=0)) + 1):
        more = np.flatnonzero(extra >= k)
        data[starts[more] + k] = ranks[more] >> 8 * k & 0xFF
    return table, control.astype(np.uint8), data


def unpack(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids that ``pack`` was given, by looking lengths and ids up in tables."""
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= data[starts[more] + k].astype(np.uint32) << 8 * k
    return table[ranks & MASKS[lengths]] if n else np.zeros(0, dtype=np.uint32)


def to_bytes(doc_ids: list[int | None], docs: list[np.ndarray], end_id: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    table, control, data = pack(ids)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    header = np.array([len(docs), len(ids), len(table), len(data), end_id], dtype="<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    lengths = np.array([len(d) for d in docs], dtype="<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (header, table.astype("<u4"), keys, nulls, lengths, control, data))])


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, document lengths and all ids of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n, distinct, size, _ = (int(x) for x in np.frombuffer(raw, "<u8", 5, 4))
    at = 44

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    table, keys, nulls, lengths = take("<u4", distinct), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    ids = unpack(table, take("u1", -(-n // 4)), take("u1", size), n)
    return [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)], lengths, ids


def write_id_files(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1 << 21) -> DataFrame:
    """Write the ids of every whole text to files below ``folder``; returns the manifest.

    Files are in ascending order of ``id_col`` (null first): the rows are
    range-partitioned on it, and a task starts a new file once it holds ``tokens``
    ids. A null or empty text has the end id alone; an empty table gives no
    file; repeated rows are kept as often as they occur; other columns are
    ignored. Texts of any length are encoded whole; one longer than ``tokens`` ids
    fills a file alone. Manifest: part, shard, stamp, docs, tokens, file. Only the
    files of tasks that ended well are in it; what a lost or repeated attempt left
    behind has another ``stamp`` in its name and is not read.
    """
    path = path or word_bpe()

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        codec, part, shard = tokenizer(path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0
        made = []

        def close() -> None:
            nonlocal shard, n
            stamp = uuid.uuid4().int >> 65
            file = write_file(folder, f"part-{part:06d}-{shard:06d}-{stamp:016x}.fvb", to_bytes(keys, held, end_id))
            made.append((part, shard, stamp, len(held), n, file))
            shard, n = shard + 1, 0
            keys.clear()
            held.clear()

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                keys.append(key)
                held.append(np.append(ids, np.array([end_id], dtype=np.uint16 if end_id < 1 << 16 else np.uint32)))
                n += len(held[-1])
                if n >= tokens:
                    close()
        if held:
            close()
        cols = list(zip(*made, strict=True)) or [[]] * 6
        kinds = (("part", pa.int64()), ("shard", pa.int64()), ("stamp", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("file", pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    # the running number deals rows with one id, or none, out to more than one task
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = F.col("id").asc_nulls_first(), F.col("tie")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.mapInArrow(write, "part long, shard long, stamp long, docs long, tokens long, file string"), "manifest")


def read_id_files(manifest: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files in ``manifest``: its id, start, n_tokens, ids_crc32, and its ids if asked for."""
    spark = manifest.sparkSession
    schema = "stamp long, id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stamp = int(name.rpartition("-")[2].removesuffix(".fvb"), 16)
                keys, lengths, ids = from_bytes(raw.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                words = ids.astype("<u4")
                cuts = list(zip((ends - lengths.astype(np.int64)).tolist(), ends.tolist(), strict=True))
                cols = [[stamp] * len(keys), keys, [a for a, _ in cuts], [b - a for a, b in cuts], [zlib.crc32(words[a:b]) for a, b in cuts]]
                arrays = [pa.array(c, pa.int64()) for c in cols]
                names = ["stamp", "id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([words[a:b] for a, b in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    if not manifest.take(1):
        docs = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fvb").load(folder)
        docs = files.select("path", "content").mapInArrow(read, schema)
    # a part has no more shards than 2**20 and files are few, so (part, shard) is one number that keeps their order
    starts = running_start(manifest.select((F.col("part") * (1 << 20) + F.col("shard")).alias("at"), "stamp", "tokens"), "at", "tokens", "before", 1 << 26)
    docs = docs.join(starts.select("stamp", "before"), "stamp")
    return docs.select(F.col("id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the id files."""
    from inodelake.runtime import table

    folder = f"{shared_folder(spark)}/ids"
    manifest = write_id_files(table(spark, sf_dir, "documents"), folder)
    return read_id_files(manifest, folder)
