"""Object keys: what they are, and which partition they are in. Partition values stay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesync.config import DATA_SUFFIXES, SKIPPED_SUFFIXES, TABLE_ROOT


def basename(key: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(key, "/", -1)


def is_data_file(key: Column) -> Column:
    """Ends in a data suffix, and its name in none of those that are skipped."""
    any_end = lambda column, ends: F.greatest(*[F.endswith(column, F.lit(e)) for e in ends])
    return any_end(key, DATA_SUFFIXES) & ~any_end(basename(key), SKIPPED_SUFFIXES)


def in_root(key: Column, root: str | Column = TABLE_ROOT) -> Column:
    return F.startswith(key, F.lit(root) if isinstance(root, str) else root)


def folders_below(key: Column, root: str | Column = TABLE_ROOT) -> Column:
    """The directories between root and file name, each with its slash."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.substring(key, F.length(root) + 1, F.length(key) - F.length(root) - F.length(basename(key)))


def has_partition(key: Column, root: str | Column = TABLE_ROOT) -> Column:
    """Whether any directory between root and file name is a k=v."""
    return F.instr(folders_below(key, root), "=") > 0


def partition_key(key: Column, root: str | Column = TABLE_ROOT) -> Column:
    """The k=v directories between root and file name joined by slashes, in order, others passed over; empty outside the root or without any."""
    pairs = F.regexp_replace(folders_below(key, root), "(?<![^/])[^/=]*/", "")
    return F.when(in_root(key, root), F.btrim(pairs, F.lit("/"))).otherwise("")


def partition_prefix(key: Column, root: str | Column = TABLE_ROOT) -> Column:
    return F.concat(F.lit(root) if isinstance(root, str) else root, key, F.lit("/"))


def directory(key: Column) -> Column:
    """Up to and with the last slash; a slash if there is none."""
    return F.when(F.instr(key, "/") > 0, F.left(key, F.length(key) - F.length(basename(key)))).otherwise("/")


def ancestor_prefixes(key: Column) -> Column:
    """Every directory above an object, each with its slash."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def hive_partition(i: Column, regions: int = 50, hours: int = 24) -> Column:
    """The i-th partition of the generator's space; months of 30 days, so some dates are not in any calendar."""
    day, rest = F.floor(i / (regions * hours)), i % (regions * hours)
    return F.format_string(
        "dt=2024-%02d-%02d/region=R%03d/hour=%02d", F.floor(day / 30) + 1, day % 30 + 1, F.floor(rest / hours).cast("long"), rest % hours
    )


def data_file(partition: Column, index: Column, root: str = TABLE_ROOT) -> Column:
    return F.concat(F.lit(root), partition, F.format_string("/part-%04d.parquet", index))


def short(text: Column, width: int) -> Column:
    """Cut to a width, the last two characters dots."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 2)), F.lit(".."))).otherwise(text)
