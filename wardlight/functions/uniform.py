"""Reproducible uniforms: a hash of the row id, not a per-partition generator.

``rand(seed)`` depends on how rows fall into partitions.  These draws depend only on the row id, the seed and a
label, so a re-run task, another cluster size or a later plan gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 53


def hash_uniform(row_id: Column, seed: int, label: str | Column) -> Column:
    """A double in ``[0, 1)`` for each row id."""
    tag = F.lit(label) if isinstance(label, str) else label
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), tag, row_id), 64 - _BITS)
    return bits.cast("double") / float(2**_BITS)


def hash_seed(row_id: Column, seed: int) -> Column:
    """A non-negative 31-bit integer seed for each row id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.lit("seed"), row_id), 33)


def named_uniform(row_id: Column, label: str | Column) -> Column:
    """A double in ``[0, 1)`` from the first 32 bits of md5(``row_id:label``): coarser and slower, but other engines can recompute it."""
    tag = F.lit(label) if isinstance(label, str) else label
    bits = F.conv(F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(":"), tag).cast("binary")), 1, 8), 16, 10)
    return bits.cast("double") / float(2**32)
