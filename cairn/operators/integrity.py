"""Whether stored blocks still are what their digests say; new digests; new codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.functions.binary import digest
from cairn.operators.codecs import chosen, packed, unpacked


def verify(blocks: DataFrame, hash_function: str = "md5", codec: str | None = "codec") -> DataFrame:
    """hash_id, digest, data[, codec] -> every block with what its bytes give now and whether that agrees. No shuffle."""
    data = unpacked(F.col(codec), F.col("data")) if codec else F.col("data")
    out = blocks.withColumn("found", digest(data, hash_function))
    return out.withColumn("valid", F.col("found") == F.col("digest")).drop("data")


def verified_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


def rehash(blocks: DataFrame, hash_function: str, codec: str | None = "codec") -> DataFrame:
    """The blocks under another digest, which the store's options must name from then on."""
    data = unpacked(F.col(codec), F.col("data")) if codec else F.col("data")
    return blocks.withColumn("digest", digest(data, hash_function))


def to_recompress(blocks: DataFrame, config: EngineConfig, deprecated: tuple[str, ...] = ()) -> DataFrame:
    """Blocks whose codec is deprecated or not one of the configured ones."""
    wanted = [c for c, _ in chosen(config.codecs)]
    return blocks.filter(F.col("codec").isin(*deprecated) | ~F.col("codec").isin(*wanted, "none")) if deprecated else blocks.filter(~F.col("codec").isin(*wanted, "none"))


def recompress(blocks: DataFrame, config: EngineConfig) -> DataFrame:
    """Every block in the best configured codec; codec, data and compressed_size change together."""
    raw = unpacked(F.col("codec"), F.col("data"))
    out = blocks.withColumn("_raw", raw).withColumn("_p", packed(F.col("_raw"), config))
    rest = [c for c in blocks.columns if c not in ("codec", "data", "compressed_size", "writed_size")]
    return out.select(*rest, F.octet_length("_raw").cast("long").alias("writed_size"), F.col("_p.codec").alias("codec"), F.col("_p.data").alias("data"), F.octet_length("_p.data").cast("long").alias("compressed_size"))
