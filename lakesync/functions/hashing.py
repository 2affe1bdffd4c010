"""Numbers from md5, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _limb(text: Column, i: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1 + 8 * i, 8), 16, 10).cast("long")


def md5_mod(text: Column, n: int) -> Column:
    """The whole md5, as one number, modulo n: four 32-bit limbs, from the highest on."""
    rest = F.lit(0).cast("long")
    for i in range(4):
        rest = (rest * ((1 << 32) % n) + _limb(text, i)) % n
    return rest.cast("int")


def md5_unit(text: Column) -> Column:
    """A number from 0 up to but not 1, from the first 32 bits of the md5."""
    return _limb(text, 0) / F.lit(float(1 << 32))
