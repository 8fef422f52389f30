"""Scalar functions as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(c: Column, sep: str, keep_empty: bool = False) -> Column:
    """Parts of a separated list; empty ones are dropped unless kept."""
    parts = F.split(c, "\\Q" + sep + "\\E", -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def base32(n: Column) -> Column:
    """A non-negative number with the digits 0-9A-V."""
    return F.conv(n.cast("string"), 10, 32)


def strip_rs(name: Column) -> Column:
    return F.regexp_replace(name, "^rs", "")


def column_name(c: Column) -> Column:
    """A name for a database column: other than letters, digits and '-' become '_'."""
    return F.regexp_replace(c, "[^A-Za-z0-9-]", "_")


def timespan_minutes(c: Column) -> Column:
    """'5d', '3h', '10m' or '30s' in minutes; null where the text is no timespan."""
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)[dhms]$", 1)
    per = F.create_map(*[F.lit(x) for x in ("d", 1440.0, "h", 60.0, "m", 1.0, "s", 1 / 60)])
    return F.when(n != "", n.cast("double") * per[F.right(c, F.lit(1))])


def number_text(c: Column) -> Column:
    """Ten digits; scientific below 1e-4 and above 1e6."""
    return F.when((F.abs(c) < 1e-4) & (c != 0) | (F.abs(c) > 1e6), F.format_string("%.10e", c)).otherwise(F.format_string("%.10f", c))


def genotype_id(g: Column) -> Column:
    """Base-3 number of an array of dosages, the first most significant."""
    return F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc * 3 + x.cast("long"))


def genotype_of(gid: Column, k: int) -> Column:
    """The k dosages of a base-3 number."""
    return F.array(*[F.pmod(F.floor(gid / F.lit(3 ** (k - 1 - i))), F.lit(3)).cast("int") for i in range(k)])


def binomial(n: int, k: int) -> int:
    """Subsets of k of n things."""
    return math.comb(n, k) if 0 <= k <= n else 0
