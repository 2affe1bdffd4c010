"""The order of arrival, t_us and then seq, as one number: a hash aggregate holds numbers in place, and sorts all its rows for structs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Times count from here (73,000 years before 1970), numbers from the least long, so that moments are not negative.
_TIME, _SEQ, _STEP = 1 << 61, 1 << 63, 1 << 64


def moment(t_us: Column, seq: Column) -> Column:
    """A decimal that grows with (t_us, seq); nulls come first."""
    time, number = F.coalesce(t_us, F.lit(-_TIME)).cast("decimal(19,0)"), F.coalesce(seq.cast("long"), F.lit(-_SEQ)).cast("decimal(19,0)")
    return (time + F.lit(Decimal(_TIME))) * F.lit(Decimal(_STEP)) + (number + F.lit(Decimal(_SEQ)))


def time_of(moment: Column) -> Column:
    return F.call_function("div", moment, F.lit(Decimal(_STEP))).cast("long") - F.lit(_TIME)


def seq_of(moment: Column) -> Column:
    return ((moment % F.lit(Decimal(_STEP))) - F.lit(Decimal(_SEQ))).cast("long")
