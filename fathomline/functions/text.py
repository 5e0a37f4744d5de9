"""Text as the published rules count and compare it: composed characters, white space of every kind, lengths in
16-bit units."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: The white space and line ends that trimming takes off.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    # pyarrow.compute.utf8_normalize(texts, "NFC") leaves characters decomposed, so they are composed here.
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(value: Column) -> Column:
    """The text in composed form. ASCII has no other, so it stays in the JVM and travels as null."""
    wide = value.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_composed(F.when(wide, value)), value)


def is_nfc(value: Column) -> Column:
    return nfc(value) == value


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def units(value: Column) -> Column:
    """Length in 16-bit units, in which characters beyond the first plane count twice."""
    return F.when(value.rlike(r"[^\x{0}-\x{ffff}]"), F.octet_length(F.encode(value, "UTF-16BE")) / 2).otherwise(F.char_length(value)).cast("long")
