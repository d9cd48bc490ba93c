"""What file names and timestamps tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def field(name: Column, key: str) -> Column:
    """The value of ``key`` in names like ``sub-a_exp-b_date-c``; null if it isn't there."""
    return F.nullif(F.regexp_extract(name, rf"(?:^|_){key}-([^_]*)", 1), F.lit(""))


def moment(text: Column) -> Column:
    """ISO timestamps, compact ones too (``20240101T140000123456``), as microseconds; decimal seconds are taken as they are, as seconds."""
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(\d{0,6})$", "$1-$2-$3T$4:$5:$6.$7")
    seconds = F.when(text.rlike(r"^-?\d+(\.\d*)?([eE][-+]?\d+)?$"), text.try_cast("double"))
    return F.coalesce((seconds * 1_000_000).cast("bigint"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(dashed, r"\.$", "")).cast("timestamp")))
