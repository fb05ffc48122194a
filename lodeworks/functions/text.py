"""Column builders for paths, hashes, labels and tokens. All stay in the JVM except NFC."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

WHITE = r"[\s\u0085   -     　]+"


@arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed Unicode (NFC). Whole batches; only texts beyond ASCII are touched at all."""
    plain = pc.fill_null(pc.string_is_ascii(text), True)
    if pc.all(plain).as_py() is not False:
        return text
    wide = pc.invert(plain)
    composed = [unicodedata.normalize("NFC", t) for t in text.filter(wide).to_pylist()]
    return pc.replace_with_mask(text, wide, pa.array(composed, type=text.type))


def slashes(path: Column) -> Column:
    """Forward slashes only, repeated slashes as one."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")


def canonical_path(path: Column) -> Column:
    return nfc(slashes(path))


def trimmed(text: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def canonical_label(label: Column) -> Column:
    return nfc(trimmed(label))


def hash_value(digest: Column) -> Column:
    """The digest itself: no algorithm prefix, lower case; blank counts as missing."""
    bare = F.regexp_replace(F.lower(trimmed(digest)), r"^(sha-?256[:=]|0x)\s*", "")
    return F.when(bare != "", bare)


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric runs (ASCII), in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")
