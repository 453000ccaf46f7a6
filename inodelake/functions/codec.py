"""Compression, authenticated encryption and little-endian integers.

The cipher is AES-GCM with a salted memory-hard key: the same capability as any
authenticated cipher, but images encrypted elsewhere can't be read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from inodelake import layout
from inodelake.runtime import small_batches

#: Contents that Python gets at a time: what is unpacked may be much larger than what the batch's bytes bound.
ROWS = 256
#: Bytes that encryption adds: initialisation vector and tag.
OVERHEAD = 28


@F.arrow_udf(BinaryType())
def _zstd_encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for part in parts:
        yield _each(part, packer.compress)


@F.arrow_udf(BinaryType())
def _zstd_decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for part in parts:
        yield _each(part, unpacker.decompress)


def _each(part: pa.Array, change: Callable) -> pa.Array:
    """``change`` of each value of a binary array, one value after another: beside the array only what comes out is held."""
    return pa.array((change(v.as_buffer()) if v.is_valid else None for v in part), pa.binary(), size=len(part))


def zstd_encode(content: Column | str) -> Column:
    small_batches(SparkSession.active(), ROWS)
    return _zstd_encode(content)


def zstd_decode(packed: Column | str) -> Column:
    small_batches(SparkSession.active(), ROWS)
    return _zstd_decode(packed)


def stored(content: Column, packed: Column, mode: Column) -> Column:
    """What is stored: always the packed bytes, never, or (auto) if the content is large and they are fewer."""
    auto = (F.octet_length(content) >= layout.COMPRESS_FROM) & (F.octet_length(packed) < F.octet_length(content))
    return F.when((mode == "always") | ((mode == "auto") & auto), packed).otherwise(content)


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def encrypt(content: Column, key: bytes) -> Column:
    return F.aes_encrypt(content, F.lit(key), F.lit("GCM"))


def decrypt(content: Column, key: bytes) -> Column:
    """Null for a wrong key or damaged content."""
    return F.try_aes_decrypt(content, F.lit(key), F.lit("GCM"))


def to_little_endian(value: Column, size: int = 8) -> Column:
    """The bytes of a non-negative integer, lowest first."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]))


def from_little_endian(data: Column, at: int = 0, size: int = 8) -> Column:
    """The unsigned integer in ``size`` bytes at ``at``; values from 2**63 on are null."""
    digits = F.concat(*[F.hex(F.substring(data, at + k + 1, 1)) for k in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).try_cast("long")
