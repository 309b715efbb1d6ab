"""What several text operators have in common."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave.operators.storage import materialise

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of ``text`` in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    """How often ``pattern`` matches in ``text``; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and its
    size is known, so Spark broadcasts it where it is small and shuffles it where not.
    """
    return materialise(df, name)


#: Bits of one chunk of a filter, as Spark's bitmap functions count them.
_CHUNK = 32768


def bit_filter(hashes: DataFrame, n: int, most_bits: int) -> bytes:
    """A filter of the ``n`` numbers in ``hashes`` (hash): 16 bits for each if ``most_bits``, a
    power of 2, allows that. It is built by Spark's bitmap aggregate, a row for each chunk.
    """
    n_bits = min(max(_CHUNK, 1 << (16 * n).bit_length()), most_bits)
    place = (F.col("hash").bitwiseAND(F.lit(n_bits - 1)) + 1).alias("place")
    chunks = (
        hashes.select(place)
        .groupBy(F.bitmap_bucket_number("place").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    bits = bytearray(n_bits // 8)
    for row in chunks.toLocalIterator():
        start = (row["chunk"] - 1) * _CHUNK // 8
        chunk = row["bits"][: len(bits) - start]
        bits[start : start + len(chunk)] = chunk
    return bytes(bits)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the ``hashes`` may be in a filter: all that are, and few others."""
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once for each application, so
    that their Python finds it wherever it was started.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        base = str(Path(tempfile.mkdtemp(prefix="usageweave-")) / "usageweave")
        context.addPyFile(shutil.make_archive(base, "zip", root, "usageweave"))
        _shipped.add(context.applicationId)
