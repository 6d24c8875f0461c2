"""The index on disk: immutable Parquet parts of chunks, snapshots that list them, and a pointer that is swapped last.

A snapshot holds the manifest (with the part each file's chunks are in) and metadata (schema version, vector dimension, model,
parts). A run writes the chunks of what changed as one new part; chunks of an older part count only for the files that the
manifest has there. Parts are merged when they are many or mostly dead, so a run costs what changed, and a scan stays short.
Readers resolve the pointer once and see one snapshot whole; a run that fails leaves the one before.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex import SCHEMA_VERSION
from semdex.config import PROJECT_DIR
from semdex.operators.diff import without_files
from semdex.schema import CHUNKS, MANIFEST, MANIFEST_JSON, PLACED

KEPT_SNAPSHOTS = 2
#: More parts than this are merged, all but the largest.
MAX_PARTS = 8


@dataclass(frozen=True)
class Meta:
    schema_version: int
    dim: int | None
    model: str
    #: Files written to each part, which tells whether any of it is dead.
    parts: dict[str, int] = field(default_factory=dict)
    dead: list[str] = field(default_factory=list)


class SchemaMismatch(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root).absolute()
        self.dir = self.root / PROJECT_DIR
        self.snapshots = self.dir / "snapshots"

    @property
    def pointer(self) -> Path:
        return self.dir / "CURRENT"

    def current(self) -> Path | None:
        try:
            path = self.snapshots / self.pointer.read_text().strip()
        except OSError:
            return None
        return path if (path / "meta.json").exists() else None

    def meta(self) -> Meta | None:
        """Metadata of the current snapshot; unreadable or unversioned ones count as version 0."""
        at = self.current()
        if at is None:
            return None
        try:
            raw = json.loads((at / "meta.json").read_text())
            return Meta(int(raw.get("schema_version", 0)), raw.get("dim"), raw.get("model", ""), raw.get("parts", {}), raw.get("dead", []))
        except (OSError, ValueError):
            return Meta(0, None, "")

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(str(self.dir / "chunks" / name))

    def chunks(self, names: list[str] | None = None) -> DataFrame:
        """The live chunks, of all parts or of some."""
        meta, out = self.meta(), None
        for name in (meta.parts if names is None else names) if meta else ():
            one = self._part(name)
            if name in meta.dead:
                one = one.join(self.placed().where(F.col("part") == name).select("file_path"), "file_path", "left_semi").select(CHUNKS.names)
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], CHUNKS) if out is None else out

    def placed(self) -> DataFrame:
        """The manifest with the part of each file."""
        at = self.current()
        return self.spark.createDataFrame([], PLACED) if at is None else self.spark.read.schema(PLACED).parquet(str(at / "manifest"))

    def manifest(self) -> DataFrame:
        return self.placed().select(MANIFEST.names)

    def mtimes(self) -> DataFrame:
        """file_path and modified_at; without a manifest an error, since date filters would silently drop all hits."""
        if self.current() is None:
            raise FileNotFoundError(f"no index manifest under {self.dir}")
        return self.manifest().select("file_path", "modified_at")

    def count(self) -> int:
        return self.chunks().count()

    def check(self, dim: int, model: str) -> None:
        """Refuse vectors of another size or model than those stored."""
        meta = self.meta()
        if meta and meta.dim is not None and (meta.dim != dim or meta.model != model):
            raise SchemaMismatch(f"index holds {meta.dim}-dimensional vectors of {meta.model!r}, not {dim}-dimensional ones of {model!r}")

    def commit(self, fresh: DataFrame, entries: DataFrame, gone: DataFrame, meta: Meta) -> Path:
        """Write the chunks of new entries as a part and a snapshot next to the others, then swap the pointer.

        gone: files of the current snapshot that the new one lacks or has anew. The files of each part are counted; no more than a
        row for each of the few parts comes to the driver.
        """
        before, old = self.current(), self.meta()
        part = uuid.uuid4().hex
        carried = without_files(self.placed(), gone).select(PLACED.names)
        live = {r["part"]: r["count"] for r in carried.groupBy("part").count().collect()}
        known = {n: files for n, files in (old.parts if old else {}).items() if n in live}
        merged = [n for n, files in known.items() if 2 * live[n] < files]
        if len(known) - len(merged) >= MAX_PARTS:
            largest = max(known, key=known.get)
            merged = [n for n in known if n != largest]
        moved = without_files(self.chunks(merged), gone) if merged else None
        (fresh if moved is None else fresh.unionByName(moved)).select(CHUNKS.names).write.parquet(str(self.dir / "chunks" / part))
        name = f"v{SCHEMA_VERSION}-{len(list(self.snapshots.glob('v*'))) if self.snapshots.exists() else 0:06d}-{uuid.uuid4().hex[:8]}"
        at = self.snapshots / name
        home = F.when(F.col("part").isin(merged), F.lit(part)).otherwise(F.col("part")) if merged else F.col("part")
        manifest = carried.withColumn("part", home).unionByName(entries.select(MANIFEST.names).withColumn("part", F.lit(part)))
        manifest.select(PLACED.names).write.parquet(str(at / "manifest"))
        written = self.spark.read.schema(PLACED).parquet(str(at / "manifest")).where(F.col("part") == part).count()
        parts = {n: files for n, files in known.items() if n not in merged} | {part: written}
        meta = replace(meta, parts=parts, dead=[n for n in parts if n != part and live[n] < parts[n]])
        (at / "meta.json").write_text(json.dumps(asdict(meta)))
        fresh_pointer = self.dir / f".CURRENT-{uuid.uuid4().hex}"
        fresh_pointer.write_text(name)
        os.replace(fresh_pointer, self.pointer)
        self._sweep({at, before})
        return at

    def _sweep(self, keep: set[Path | None]) -> None:
        """Older snapshots beyond the last few go, and parts that no snapshot lists."""
        others = sorted((p for p in self.snapshots.iterdir() if p not in keep), key=lambda p: p.stat().st_mtime_ns)
        for old in others[: max(0, len(others) - (KEPT_SNAPSHOTS - 2))]:
            shutil.rmtree(old, ignore_errors=True)
        listed: set[str] = set()
        for found in self.snapshots.glob("*/meta.json"):
            listed |= set(json.loads(found.read_text()).get("parts", {}))
        for p in (self.dir / "chunks").iterdir():
            if p.name not in listed:
                shutil.rmtree(p, ignore_errors=True)

    def wipe(self) -> None:
        """Remove snapshots and pointer; the project's configuration stays."""
        self.pointer.unlink(missing_ok=True)
        shutil.rmtree(self.snapshots, ignore_errors=True)
        shutil.rmtree(self.dir / "chunks", ignore_errors=True)

    def migrate(self) -> bool:
        """Drop an index of another schema version. True if there was one."""
        meta = self.meta()
        if meta is None or meta.schema_version == SCHEMA_VERSION:
            return False
        self.wipe()
        return True

    def size_on_disk(self) -> int:
        return sum(p.stat().st_size for p in self.dir.rglob("*") if p.is_file()) if self.dir.exists() else 0


def manifest_from_json(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, manifest rows) of a JSON manifest; a missing version is 0."""
    raw = spark.read.schema(MANIFEST_JSON).option("multiLine", True).json(path)
    version = raw.select(F.coalesce("version", F.lit(0)).alias("v")).head()
    rows = raw.select(F.explode("files").alias("file_path", "f")).select(
        "file_path",
        (F.col("f.modified_at.secs_since_epoch") * 1_000_000_000 + F.col("f.modified_at.nanos_since_epoch")).alias("modified_ns"),
        F.timestamp_micros(F.col("f.modified_at.secs_since_epoch") * 1_000_000 + F.expr("f.modified_at.nanos_since_epoch div 1000")).alias("modified_at"),
        F.col("f.chunk_ids").alias("chunk_ids"),
    )
    return (version["v"] if version else 0), rows
