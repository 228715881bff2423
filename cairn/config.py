"""Settings of a store. Block size, digest and partition count are fixed when the store is made and override later arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

KIB = 1024
BLOCK_MIN, BLOCK_DEFAULT, BLOCK_MAX = 512, 64 * KIB, 16 * KIB * KIB
ROOT = "@root"
FIXED = ("block_size", "hash_function", "partitions")
#: Methods that stand for every codec, and the level each of them takes.
EVERY = {"all": "default", "all_best": "best", "all_fast": "fast"}


def parse_codec(spec: str) -> tuple[str, int | str | None]:
    """'zstd:3' -> ('zstd', 3); 'zstd' -> ('zstd', None); a level may be a number or fast, normal, best, default."""
    m = re.fullmatch(r"\s*([a-z0-9_]+)(?:[:=](-?\d+|fast|normal|best|default))?\s*", spec)
    if not m:
        raise ValueError(f"not a codec: {spec!r}")
    level = m[2]
    return m[1], int(level) if level and re.fullmatch(r"-?\d+", level) else level


@dataclass(frozen=True)
class EngineConfig:
    block_size: int = BLOCK_DEFAULT
    hash_function: str = "md5"
    codecs: tuple[str, ...] = ("none",)
    minimal_size: int = 512
    minimal_ratio: float = 0.01
    forced: bool = False
    partitions: int = 1
    base_path: str | None = None
    cluster_path: str | None = None
    owner: str = "local"
    stored: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "block_size", min(BLOCK_MAX, max(BLOCK_MIN, int(self.block_size))))
        if self.minimal_size < 0:
            object.__setattr__(self, "minimal_size", 0)

    def with_stored(self, options: dict[str, str]) -> EngineConfig:
        """This configuration with what the store's option table fixes."""
        kept = {k: type(getattr(self, k))(options[k]) for k in FIXED if k in options}
        return replace(self, **kept, stored=dict(options))

    def to_options(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in FIXED}
