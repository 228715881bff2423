"""Column expressions over byte blocks: cut, trim, pad, digest, place. All are built-in expressions but the digests Spark lacks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "\x00"
BUILT_IN = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
OTHERS = ("sha3_224", "sha3_256", "sha3_384", "sha3_512", "blake2b", "blake2s")


def block_count(size: Column, block_size: int) -> Column:
    """Blocks that hold so many bytes; none for an empty file."""
    return F.ceil(size / F.lit(block_size)).cast("long")


def blocks(data: Column, block_size: int) -> Column:
    """array<struct<block_number, data>>: the byte string cut in blocks, the last one as long as it is."""
    n = block_count(F.octet_length(data), block_size)
    numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("block_number"), F.substring(data, (i * block_size + 1).cast("int"), F.lit(block_size)).alias("data")))


def trim_zeros(data: Column) -> Column:
    """Without the NUL bytes at the end; a block of NULs becomes empty."""
    # a character for each byte, so that the built-in trim does it, in one pass over the end
    return F.encode(F.rtrim(F.decode(data, "ISO-8859-1"), F.lit(ZERO)), "ISO-8859-1")


def pad_zeros(data: Column, size: Column) -> Column:
    """NUL bytes put at the end up to size, as a reader sees a trimmed block."""
    return F.when(F.octet_length(data) >= size, data).otherwise(F.call_function("rpad", data, size.cast("int"), F.lit(b"\x00")))


def digest(data: Column, name: str = "md5") -> Column:
    """Lower-case hex digest. The built-in ones stay in the JVM; the others go through one vectorised function."""
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    if name in BUILT_IN:
        return F.sha2(data, int(name[3:]))
    if name not in OTHERS:
        raise ValueError(f"no digest {name!r}; there are {', '.join(BUILT_IN + OTHERS)}")

    @F.pandas_udf("string")
    def other(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else hashlib.new(name, b).hexdigest())

    return other(data)


def digest_path(hexadecimal: Column, levels: int = 4, width: int = 4) -> Column:
    """Folder fan-out of a block kept as a file: so many folders named by pieces of the digest, then the digest."""
    parts = [F.substring(hexadecimal, 1 + width * i, width) for i in range(levels)]
    return F.concat_ws("/", *parts, hexadecimal)


def partition_of(hash_id: Column, partitions: int) -> Column:
    """Which of the store's block partitions holds a hash."""
    return F.pmod(hash_id, F.lit(partitions)).cast("int")
