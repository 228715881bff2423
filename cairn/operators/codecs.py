"""Codecs for block payloads: best of several by size, with guards, and the way back. Arrow batches; nothing is shuffled."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.config import EVERY, EngineConfig, parse_codec


@dataclass(frozen=True)
class Codec:
    """least: the smallest input that the codec is tried on; fast, normal, best, default: named levels; low, high: their range."""

    name: str
    least: int
    fast: int | None = None
    normal: int | None = None
    best: int | None = None
    default: int | None = None
    low: int | None = None
    high: int | None = None

    def level(self, wanted: int | str | None) -> int | None:
        if self.default is None:
            return None
        n = getattr(self, wanted) if isinstance(wanted, str) else self.default if wanted is None else wanted
        return min(self.high, max(self.low, n))


#: Minimal input, levels, and range of levels.
CODECS = {
    c.name: c
    for c in (
        Codec("none", 0),
        Codec("zlib", 12, 1, 6, 9, 3, 0, 9),
        Codec("deflate", 3, 1, 6, 9, 3, 0, 9),
        Codec("bz2", 40, 1, 6, 9, 2, 1, 9),
        Codec("xz", 69, 0, 4, 9, 2, 0, 9),
        Codec("zstd", 18, 1, 9, 18, 3, -100, 20),
        Codec("brotli", 19, 0, 4, 11, 2, 0, 11),
        Codec("lz4", 15),
        Codec("lz4h", 15),
        Codec("snappy", 17),
    )
}


#: Codecs under another name in Arrow, and Arrow's level for them; lz4h is lz4's format by its slower, high compression.
ARROW = {"lz4": ("lz4_raw", None), "lz4h": ("lz4_raw", 9)}


def _arrow(name: str, level: int | None, data: bytes) -> bytes:
    """Arrow's raw codecs don't keep the size, so four bytes of it come first."""
    codec = pa.Codec(name, compression_level=level) if level is not None else pa.Codec(name)
    return len(data).to_bytes(4, "big") + codec.compress(data, asbytes=True)


def compress(name: str, data: bytes, level: int | str | None = None) -> bytes:
    n = CODECS[name].level(level)
    if name == "none":
        return data
    if name == "zlib":
        return zlib.compress(data, n)
    if name == "deflate":
        c = zlib.compressobj(n, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    if name == "bz2":
        return bz2.compress(data, n)
    if name == "xz":
        return lzma.compress(data, preset=n)
    return _arrow(*ARROW.get(name, (name, n)), data)


def decompress(name: str, data: bytes) -> bytes:
    if name == "none":
        return data
    if name == "zlib":
        return zlib.decompress(data)
    if name == "deflate":
        return zlib.decompress(data, -15)
    if name == "bz2":
        return bz2.decompress(data)
    if name == "xz":
        return lzma.decompress(data)
    return pa.Codec(ARROW.get(name, (name, None))[0]).decompress(data[4:], int.from_bytes(data[:4], "big"), asbytes=True)


def chosen(specs: tuple[str, ...]) -> list[tuple[str, int | str | None]]:
    """Codec specifications, with the methods that stand for all written out, by name."""
    out = {}
    for name, level in map(parse_codec, specs):
        if name in EVERY:
            out |= {c: EVERY[name] for c in CODECS if c != "none"}
        elif name not in CODECS:
            raise ValueError(f"no codec {name!r}; there are {', '.join(CODECS)}")
        else:
            out[name] = level
    return sorted(out.items())


def pack(data: bytes, config: EngineConfig) -> tuple[str, bytes]:
    """The smallest strictly smaller result of the configured codecs, of equal ones the first by name; else ('none', data).

    Data up to the minimal size are left as they are unless forced; so is a result that saves less than the minimal ratio.
    """
    if not data or (len(data) <= config.minimal_size and not config.forced):
        return "none", data
    name, best = "none", data
    for codec, level in chosen(config.codecs):
        if codec != "none" and len(data) >= CODECS[codec].least:
            made = compress(codec, data, level)
            if len(made) < len(best):
                name, best = codec, made
    if name != "none" and not config.forced and (len(data) - len(best)) / len(data) < config.minimal_ratio:
        return "none", data
    return name, best


def _over(f: Callable, schema: str) -> Callable:
    @F.pandas_udf(schema)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(None if x is None else bytes(x)) for x in column], columns=["codec", "data"])

    return run


def packed(data: Column, config: EngineConfig) -> Column:
    """struct<codec, data>."""
    return _over(lambda x: (None, None) if x is None else pack(x, config), "codec string, data binary")(data)


def unpacked(codec: Column, data: Column, try_all: bool = False) -> Column:
    """The stored bytes of a packed block. try_all: a block that its codec can't read is tried with every other."""

    @F.pandas_udf("binary")
    def run(names: pd.Series, column: pd.Series) -> pd.Series:
        def one(name: str, x: bytes | None) -> bytes | None:
            if x is None:
                return None
            for c in [name, *([c for c in CODECS if c not in (name, "none")] if try_all else [])]:
                try:
                    return decompress(c, bytes(x))
                except Exception:
                    if not try_all:
                        raise
            return bytes(x)

        return pd.Series([one(n, x) for n, x in zip(names, column, strict=True)], dtype=object)

    return run(codec, data)
