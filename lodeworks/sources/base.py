"""What a source parser is, and the file catalog all of them share."""

from __future__ import annotations

import os
import stat
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodeworks.sources import columns as C

CATALOG = "path string, filename string, extension string, size long, is_symlink int, symlink_target string, modified_time string"


class SourceParser(ABC):
    """Reads one kind of source tree into entity tables."""

    name = ""
    description = ""
    specificity = 50
    confidence = 0.5
    tier = "production"
    entity_types: tuple[str, ...] = ("files",)
    event_types: tuple[str, ...] = ()

    @abstractmethod
    def identify(self, source: str) -> bool:
        """Whether a directory looks like this parser's kind, by a bounded probe."""

    @abstractmethod
    def extract_entities(self, spark: SparkSession, source: str) -> dict[str, DataFrame]:
        """Entity tables by name."""

    def extract_relationships(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Tables with links between them filled in."""
        if {"daemons", "binaries", "files"} <= tables.keys():
            tables = tables | {"daemons": C.link_daemons(tables["daemons"], tables["binaries"], tables["files"])}
        return tables

    def verify(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Rows per table; ValueError if no file was found."""
        counts = {n: t.count() for n, t in tables.items()}
        if not counts.get("files"):
            raise ValueError(f"{self.name}: no files found")
        return counts

    def required_tools(self) -> tuple[str, ...]:
        return ()


def _shown(name: str) -> str:
    """A name as text; bytes that are none are written as escapes."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")


def _entries(source: str, folder: str, dirs: list[str], names: list[str]) -> Iterator[tuple]:
    for name in sorted([*names, *[d for d in dirs if os.path.islink(os.path.join(folder, d))]]):
        full = os.path.join(folder, name)
        try:
            info = os.lstat(full)
            link = stat.S_ISLNK(info.st_mode)
            target = _shown(os.readlink(full)) if link else None
        except OSError:
            continue
        if not link and not stat.S_ISREG(info.st_mode):
            continue
        path = "/" + _shown(os.path.relpath(full, source).replace("\\", "/"))
        extension = _shown(os.path.splitext(name)[1].lower())
        yield path, path.rsplit("/", 1)[-1], extension.lstrip(".") or None, 0 if link else info.st_size, int(link), target, None


def walk(source: str) -> Iterator[tuple]:
    """Catalog rows of regular files and symbolic links; links are not followed, other kinds are left out."""
    for folder, dirs, names in os.walk(source, followlinks=False):
        dirs.sort()
        yield from _entries(source, folder, dirs, names)


def _folders(source: str, most: int) -> list[tuple[bytes, bool]]:
    """Folders from the top down, and whether all below them is meant too; about ``most`` of them, however large the tree."""
    opened: list[str] = []
    waiting = deque([source])
    while waiting and len(opened) + len(waiting) < most:
        folder = waiting.popleft()
        opened.append(folder)
        try:
            with os.scandir(folder) as entries:
                waiting.extend(e.path for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:
            continue
    return [(os.fsencode(f), False) for f in opened] + [(os.fsencode(f), True) for f in waiting]


def catalog(spark: SparkSession, source: str, most_folders: int = 2000) -> DataFrame:
    """File catalog with link metadata, in no order.

    The driver opens folders from the top until there are ``most_folders``; their files, and
    all that is below the last of them, are listed in tasks.
    """
    source = os.path.abspath(source)
    schema = StructType.fromDDL(CATALOG)
    arrow = to_arrow_schema(schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for here, dirs, names in os.walk(os.fsdecode(folder), followlinks=False):
                    rows += _entries(source, here, dirs, names)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                    if not deep:
                        break
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    folders = _folders(source, most_folders)
    tasks = max(1, min(len(folders) // 8, 4 * spark.sparkContext.defaultParallelism))
    plan = spark.createDataFrame(folders, "folder binary, deep boolean").repartition(tasks)
    return plan.mapInArrow(listed, schema)


def contents(spark: SparkSession, source: str, limit: int = C.HASH_LIMIT) -> DataFrame:
    """path, length and content of regular files below the limit; larger ones are pruned before reading."""
    root = os.path.abspath(source).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") < limit)
    return raw.select(F.expr(f"substring(url_decode(replace(regexp_replace(path, '^file:/+', '/'), '+', '%2B')), {len(root) + 1})").alias("path"), "length", "content")


def with_ids(df: DataFrame, order: str = "path") -> DataFrame:
    """Deterministic ids from the natural key."""
    return df.withColumn("id", F.abs(F.xxhash64(order)))


def catalogued(spark: SparkSession, source: str, kinds: dict[str, str]) -> DataFrame:
    """The files table of a tree: catalog, content hash and type by extension."""
    files = catalog(spark, source)
    hashed = contents(spark, source).select(F.col("path").alias("_p"), C.content_hash(F.col("content"), F.col("length")).alias("sha256"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else None
    typed = F.coalesce(F.element_at(kind, F.concat(F.lit("."), F.col("extension"))), F.lit("unknown")) if kinds else F.coalesce("extension", F.lit("unknown"))
    joined = files.join(hashed, (F.col("path") == F.col("_p")) & (F.col("is_symlink") == 0), "left").drop("_p")
    return with_ids(joined.withColumn("file_type", F.when(F.col("extension").isNull(), F.lit("unknown")).otherwise(typed)))
