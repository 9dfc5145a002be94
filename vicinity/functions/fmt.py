"""Text forms of numbers and labels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, digits: int) -> Column:
    """``v`` with so many decimals (1 at least), the exact binary value rounded to nearest and ties to even, as C prints it.
    The JVM's own format rounds the shortest decimal form, ties up."""
    v = v.cast("double")
    x, scale = F.abs(v), 10**digits
    whole = F.floor(x)
    rest = x - whole
    k = F.floor(rest * scale)
    # 2 * scale * rest - (2 k + 1) by its sign: both halves of rest take their products without rounding
    high = F.floor(rest * 2.0**26) / 2.0**26
    beyond = (high * (2.0 * scale) - (2 * k + 1)) + (rest - high) * (2.0 * scale)
    up = (beyond > 0) | ((beyond == 0) & (k % 2 == 1))
    total = whole * scale + k + up.cast("long")
    text = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(total / scale).cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))
    return F.when(x < 2.0**40, text).when(v.isNotNull(), F.format_string(f"%.{digits}f", v))


def _scaled(n: Column, base: float, units: tuple[str, ...], last: str, last_digits: int, suffix: str = "") -> Column:
    value, out = n.cast("double"), F
    for unit in units:
        out = out.when(F.abs(value) < base, F.struct(value.alias("value"), F.lit(unit).alias("unit"), F.lit(False).alias("is_last")))
        value = value / base
    out = out.otherwise(F.struct(value.alias("value"), F.lit(last).alias("unit"), F.lit(True).alias("is_last")))
    value = out.getField("value")
    text = fixed(value, 1) if last_digits == 1 else F.when(out.getField("is_last"), fixed(value, last_digits)).otherwise(fixed(value, 1))
    return F.concat(text, out.getField("unit"), F.lit(suffix))


def format_large_number(n: Column) -> Column:
    """1234 -> 1.2K; K, M, B, T, P in thousands with one decimal, then E with two."""
    return _scaled(n, 1000.0, ("", "K", "M", "B", "T", "P"), "E", 2)


def format_bytes(n: Column, suffix: str = "B", unit: str | None = None) -> Column:
    """1536 -> 1.5KB; steps of 1024 up to Z, then Y. With ``unit`` ("K") that one, whatever the size."""
    units = ("", "K", "M", "G", "T", "P", "E", "Z")
    if unit is not None:
        return F.concat(fixed(n.cast("double") / 1024.0 ** (*units, "Y").index(unit), 1), F.lit(unit + suffix))
    return _scaled(n, 1024.0, units, "Y", 1, suffix)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def method_label(method: Column, balancing: Column) -> Column:
    return F.concat_ws("_", method, balancing)


def list_text(values: Column) -> Column:
    """[a, b, c]"""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def timer_text(seconds: Column, rank: Column | None = None) -> Column:
    time = F.concat(F.lit("time="), fixed(seconds, 3))
    return time if rank is None else F.concat(F.lit("rank="), rank.cast("string"), F.lit(","), time)
