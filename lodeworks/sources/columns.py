"""Column logic of the parsers: paths, hashes, magic bytes, headers, units, JSON and links.

All of it stays in the JVM; the readers in this package compose it over ``binaryFile`` scans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

#: Files from this size on are neither hashed nor measured.
HASH_LIMIT = 50_000_000
UNIT_LIMIT = 1_000_000

#: Machine codes of the two header kinds (fixed values of the formats).
ELF_MACHINES = {0x03: "x86", 0x3E: "x86_64", 0xB7: "aarch64", 0x28: "arm", 0xF3: "riscv"}
PE_MACHINES = {0x014C: "x86", 0x8664: "x86_64", 0xAA64: "arm64", 0x01C0: "arm", 0x01C4: "armv7"}


def rooted_path(path: Column) -> Column:
    """Forward slashes and exactly one leading slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.translate(path, "\\", "/"), "^/+", ""))


def text(content: str) -> Column:
    """Binary content as text; malformed bytes become replacement characters."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def content_hash(content: Column, length: Column, regular: Column | None = None) -> Column:
    """SHA-256 of a regular file below the size limit, else null."""
    small = length < HASH_LIMIT
    return F.when(small if regular is None else small & regular, F.sha2(content, 256))


def has_magic(content: Column, magic: str) -> Column:
    """Whether the content starts with the bytes given as hex."""
    return F.hex(F.substring(content, 1, len(magic) // 2)) == magic.upper()


def little_endian(content: Column, offset: Column | int, size: int) -> Column:
    """Unsigned little-endian number at a byte offset; null beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    raw = F.hex(F.substring(content, at + 1, F.lit(size)))
    pairs = [F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))]
    return F.when(F.length(raw) == 2 * size, F.conv(F.concat(*pairs), 16, 10).cast("long"))


def _named(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(F.element_at(table, code), F.lit("unknown"))


def elf_arch(content: Column) -> Column:
    return F.when(has_magic(content, "7f454c46"), _named(little_endian(content, 18, 2), ELF_MACHINES))


def pe_arch(content: Column) -> Column:
    header = little_endian(content, 0x3C, 4)
    return F.when(has_magic(content, "4d5a"), _named(little_endian(content, (header + 4).cast("int"), 2), PE_MACHINES))


def exec_start(text: Column) -> Column:
    """Program of a service unit: first ExecStart line without prefix marks and arguments, or empty."""
    line = F.regexp_extract(text, r"(?m)^\s*ExecStart\s*=\s*(.+)$", 1)
    bare = F.ltrim(F.trim(line), F.lit("-@+!:"))
    return F.coalesce(F.regexp_extract(bare, r"^\s*(\S*)", 1), F.lit(""))


def json_keys(text: Column, most: int = 20) -> Column:
    """JSON array of the first keys in order, of objects only."""
    return F.to_json(F.slice(F.array_sort(F.json_object_keys(text)), 1, most))


@arrow_udf(DoubleType())
def shannon(contents: pa.Array) -> pa.Array:
    """Bits per byte, from byte counts of whole Arrow values; null for null and empty ones."""
    out = []
    for value in contents:
        data = np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid and len(value.as_buffer()) else None
        if data is None:
            out.append(None)
            continue
        p = np.bincount(data, minlength=256)
        p = p[p > 0] / len(data)
        out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return pa.array(out, pa.float64())


def entropy(files: DataFrame, limit: int = HASH_LIMIT) -> DataFrame:
    """id, shannon_entropy (4 digits) of binary contents; null for empty or too large ones."""
    small = F.when(F.length("content") < limit, F.col("content"))
    return files.select("id", F.round(shannon(small), 4).alias("shannon_entropy"))


def link_daemons(daemons: DataFrame, binaries: DataFrame, files: DataFrame) -> DataFrame:
    """daemons with binary_id filled, where it is null and the program is a binary's path.

    Of several binaries at a path the smallest id counts.
    """
    at = binaries.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy(F.col("path").alias("_p")).agg(F.min("id").alias("_b"))
    joined = daemons.join(at, (F.col("program") == F.col("_p")) & (F.col("program") != "") & F.col("binary_id").isNull(), "left")
    return joined.withColumn("binary_id", F.coalesce("binary_id", "_b")).drop("_p", "_b")


def dedup_events(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of every key; nulls are a key value like any other."""
    ranked = events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("_n = 1").drop("_n")


def foreign_key_violations(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """child, child_key, parent, violations of every (child, key, parent, parent key)."""
    parts = []
    for child, key, parent, parent_key in links:
        missing = tables[child].where(F.col(key).isNotNull()).join(tables[parent].select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
        parts.append(missing.agg(F.count("*").alias("violations")).select(F.lit(child).alias("child"), F.lit(key).alias("child_key"), F.lit(parent).alias("parent"), "violations"))
    return reduce(DataFrame.unionByName, parts)
