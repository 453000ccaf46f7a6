"""Vectors as bytes, their classes of exact copies, and exact comparison in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.blocks import PAIR, core_links, paired
from inodelake.llm.ngram_join import _grouped, roots_of
from inodelake.runtime import written


def parts_of(column) -> list[np.ndarray | None]:
    """The vectors of an Arrow list column; None for one that is null or empty, or holds a null or a non-finite number, or is zero."""
    out: list[np.ndarray | None] = []
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = 0
    for n, valid in zip(column.value_lengths().to_pylist(), column.is_valid().to_pylist(), strict=True):
        if not valid or not n:
            out.append(None)
            continue
        v = values[at : at + n]
        at += n
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, dims, key (digest of the vector) and vec (little-endian doubles) of every row; the last three are null for vectors that take no part."""

    def prepare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vecs = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in parts_of(batch.column(1))]
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            dims = [None if v is None else len(v) // 8 for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "dims", "key", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(prepare, "id long, dims int, key binary, vec binary")


def lengths(rows: DataFrame) -> list[int]:
    """The numbers of dimensions that occur."""
    return sorted(r["dims"] for r in rows.where("dims is not null").select("dims").distinct().collect())  # a row a length


def hashed_sample(rows: DataFrame, keys: list[str], size: int, n: int) -> list:
    """The ``size`` of ``n`` rows with the smallest hashes of ``keys``; a threshold lets few more than these out of the tasks."""
    spread = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    most = (1 << 40) * min(1.0, (size + 8 * size**0.5 + 8) / max(1, n))
    got = rows.withColumn("__spread", spread).where(F.col("__spread") < most).collect()  # little more than ``size`` rows
    return sorted(got, key=lambda r: (r["__spread"], *(r[k] for k in keys)))[:size]


def matrix(parts: list[bytes], unit: bool = True, kind: str = "<f8") -> np.ndarray:
    """Vectors as rows, of length 1 if ``unit``; without vectors, a matrix without rows."""
    if not parts:
        return np.zeros((0, 0))
    out = np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1).astype(np.float64)
    if unit:
        out = out / np.abs(out).max(1, keepdims=True)
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out


def _cored(members: DataFrame, threshold: float, size: int) -> DataFrame:
    """``members`` (cluster, key, n, m, vec) with core and band: the core of a cluster of more than ``size`` vectors
    are those within half the threshold's angle of its first one, which are all linked with each other."""
    half = float(np.cos(np.arccos(min(1.0, max(-1.0, threshold))) / 2)) + 1e-9

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (matrix(batch.column(k).to_pylist()) for k in (3, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((x * y).sum(1) >= half)], names=["cluster", "key", "n", "vec", "core"])

    small = members.where(F.col("m") <= size).select("cluster", "key", "n", "vec", F.lit(False).alias("core"))
    large = members.where(F.col("m") > size)
    if large.take(1):
        firsts = large.where("key = cluster").select(F.col("cluster").alias("of"), F.col("vec").alias("first"))
        both = large.join(firsts, F.col("cluster") == F.col("of")).select("cluster", "key", "n", "vec", "first")
        small = small.union(written(both.mapInArrow(near, "cluster binary, key binary, n long, vec binary, core boolean"), "cores"))
    return small.withColumn("band", F.lit(0).cast("long"))


def linked_in_blocks(members: DataFrame, threshold: float, size: int) -> DataFrame:
    """key, links and root of the vectors of each cluster that have a link; members (written): cluster, key, n, m, vec.

    Links inside a cluster's core are counted by its weight; all other pairs are compared, in blocks of ``size``.
    """
    members = _cored(members, threshold, size)
    rows = paired(members, "key", size).select(*PAIR, "key", "n", "second", "vec")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, one, lo, two, hi, keys, n, second, vecs in _grouped(batches, 4):
            if len(keys) < 2:
                continue
            unit = matrix(vecs)
            close = unit @ unit.T >= threshold
            if (one[0], lo[0]) != (two[0], hi[0]):
                side = np.array(second)
                close &= side[:, None] != side[None, :]
            np.fill_diagonal(close, False)
            links, root = close @ np.array(n, dtype=np.int64), roots_of(close)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([keys[root[k]] for k in some], pa.binary())], names=["key", "links", "root"])

    found = rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(compare, "key binary, links long, root binary")
    return found.union(core_links(members, "key"))


#: Vectors that take part, in double precision.
USABLE_SQL = """SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0"""
