"""A store on disk: one Parquet folder for each table, those of a subvolume partitioned by subvol_id, block payloads by part.

A snapshot is a partition, never a table of its own: making one appends a partition, removing one deletes its folder. Base and cluster path part what a
node owns from what nodes share.

Rewritten tables go to new folders, and then one small file (CURRENT, in either path) is replaced, which names every table's folder: readers see all of a change or
nothing of it, and a writer that is lost leaves the old tables as they were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from cairn.config import EngineConfig
from cairn.operators.tables import CLASSES, SCHEMAS, BlockParts, Table

#: Tables that nodes share when there is a cluster path.
CLUSTERED = ("name", "hash", "block", "hash_sizes", "hash_compression_type", "compression_type", "hash_count", "hash_owner")
#: Tables with a row set for each subvolume.
PER_SUBVOLUME = ("tree", "inode", "link", "xattr", "inode_hash_block")


class Catalog:
    def __init__(self, spark: SparkSession, config: EngineConfig):
        self.spark, self.config = spark, config

    def _base(self, name: str) -> str:
        return self.config.cluster_path if name in CLUSTERED and self.config.cluster_path else self.config.base_path

    def _current(self, base: str) -> dict[str, str]:
        """The folder of every table under a path."""
        fs, p = self._fs(f"{base}/CURRENT")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, base: str, folders: dict[str, str | None]) -> None:
        """Replace the file that names the tables' folders, in one step; None: there is no such table any more."""
        now = {k: v for k, v in (self._current(base) | folders).items() if v}
        fs, p = self._fs(f"{base}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, self._fs(f"{base}/CURRENT")[1], how)

    def path(self, name: str) -> str:
        base = self._base(name)
        return f"{base}/{name}/{self._current(base).get(name, 'none')}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        return name in self._current(self._base(name))

    def size(self, name: str) -> int:
        """Bytes of a table's files."""
        fs, p = self._fs(self.path(name))
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], _parse_datatype_string(SCHEMAS[name]))

    def table(self, name: str) -> Table:
        """A table of the store, empty where it has not been written."""
        kind = CLASSES[name]
        if not self.exists(name):
            return BlockParts(self.empty(name), self.config.partitions) if name == "block" else kind(self.empty(name))
        # files of any age are read under today's schema: columns that they lack are null, and a folder without files is empty
        schema = _parse_datatype_string(SCHEMAS[name] + (", part int" if name == "block" else ""))
        rows = self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)
        return BlockParts(rows, self.config.partitions) if name == "block" else kind(rows)

    def write(self, name: str, table: Table | DataFrame, mode: str = "overwrite", compression: str | None = None) -> None:
        """Write a table, or append to it."""
        self.write_all({name: table}, mode, compression)

    def write_all(self, tables: dict[str, Table | DataFrame], mode: str = "overwrite", compression: str | None = None) -> None:
        """Write tables that may be read from one another: all go to new folders first, then the readers' file is switched. append: rows are added to the folder there is."""
        folders: dict[str, dict[str, str]] = {}
        gone = []
        for name, table in tables.items():
            rows = table.rows if isinstance(table, Table) else table
            by = ["subvol_id"] if name in PER_SUBVOLUME else ["part"] if name == "block" else []
            if name == "block" and "part" not in rows.columns:
                rows = BlockParts(rows, self.config.partitions).rows
            if by:  # a partition's rows are spread over tasks by their other columns; adaptive execution joins small pieces again
                pieces = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                key = [c for c in rows.columns if c not in by and not rows.schema[c].dataType.typeName().startswith(("binary", "map"))]
                rows = rows.repartition(*by, F.pmod(F.xxhash64(*key), F.lit(pieces)))
            base = self._base(name)
            old = self._current(base).get(name)
            folder = old if mode == "append" and old else uuid.uuid4().hex
            if folder != old:
                folders.setdefault(base, {})[name] = folder
                gone += [f"{base}/{name}/{old}"] if old else []
            out = rows.write.mode("append")
            if compression:
                out = out.option("compression", compression)
            (out.partitionBy(*by) if by else out).parquet(f"{base}/{name}/{folder}")
        for base, changed in folders.items():
            self._switch(base, changed)
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def drop(self, name: str) -> None:
        base = self._base(name)
        self._switch(base, {name: None})
        fs, p = self._fs(f"{base}/{name}")
        fs.delete(p, True)

    def drop_subvolume(self, id: int) -> None:
        """Delete a subvolume's partition of every table."""
        for name in PER_SUBVOLUME:
            fs, p = self._fs(f"{self.path(name)}/subvol_id={id}")
            fs.delete(p, True)

    def clean(self, name: str) -> None:
        """Without rows, the schema kept."""
        self.write(name, self.empty(name))

    def vacuum(self, name: str) -> int:
        """Rewrite a table's files; the bytes this saves."""
        before = self.size(name)
        self.write(name, self.table(name))
        return before - self.size(name)

    def in_memory(self, name: str) -> Table:
        """A table kept in memory, as a temporary view of its name too."""
        rows = self.table(name).rows.cache()
        rows.createOrReplaceTempView(name)
        return type(self.table(name))(rows) if name != "block" else BlockParts(rows, self.config.partitions)

    def has_field(self, name: str, column: str) -> bool:
        return column in self.spark.read.parquet(self.path(name)).columns

    def create(self) -> Catalog:
        """A new store: its fixed options, or those that it already has."""
        if self.exists("option"):
            self.config = self.config.with_stored({r.name: r.value for r in self.table("option").rows.collect()})
        else:
            self.write("option", self.spark.createDataFrame(sorted(self.config.to_options().items()), SCHEMAS["option"]))
        return self
