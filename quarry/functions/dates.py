"""Dates as sortable strings, at a resolution."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by resolution.
FORMATS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss", "millisecond": "yyyyMMddHHmmssSSS"}


def to_string(ts: Column, resolution: str = "day") -> Column:
    return F.date_format(ts, FORMATS[resolution])


def to_time(text: Column, resolution: str = "day") -> Column:
    return F.to_timestamp(text, FORMATS[resolution])


def rounded(ts: Column, resolution: str = "day") -> Column:
    return F.date_trunc(resolution, ts)


def cells(ts: Column) -> Column:
    """The calendar cells that hold an instant, from years to hours."""
    return F.array(*[F.date_format(ts, FORMATS[r]) for r in ("year", "month", "day", "hour")])


def ip(text: Column) -> Column:
    """An IPv4 or IPv6 address as 16 bytes; null if it isn't one."""
    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                a = ipaddress.ip_address(x)
            except ValueError:
                return None
            return (ipaddress.IPv6Address("::ffff:" + str(a)) if a.version == 4 else a).packed

        return s.map(lambda x: None if x is None else one(x))

    return udf(text)


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number, inside the JVM."""
    parts = F.split(text, r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.get(parts, i).cast("long")
    return F.when(text.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), n)


def in_network(text: Column, cidr: str) -> Column:
    """Whether an IPv4 address lies in a network."""
    net = ipaddress.ip_network(cidr)
    return ipv4_number(text).between(int(net.network_address), int(net.broadcast_address))
