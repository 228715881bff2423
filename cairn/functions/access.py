"""Permission bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READ, WRITE, EXECUTE = 4, 2, 1
DIRECTORY, REGULAR, SYMLINK, KIND = 0o040000, 0o100000, 0o120000, 0o170000


def is_kind(mode: Column, kind: int) -> Column:
    return mode.bitwiseAND(KIND) == kind


def allowed(mode: Column, owner: Column, group: Column, uid: Column, gid: Column, wanted: int) -> Column:
    """Whether a caller may do all of `wanted`: user or group 0 may; else the owner's, the group's or the others' bits tell."""
    triplet = F.when(uid == owner, F.shiftright(mode, 6)).when(gid == group, F.shiftright(mode, 3)).otherwise(mode)
    return (uid == 0) | (gid == 0) | (triplet.bitwiseAND(wanted) == wanted)
