"""Fixed-width fields: lenient numbers from text, and numbers back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^\s*([+-]?\d+)"
_FLOAT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _slice(line: Column, start: int, width: int) -> Column:
    return F.substring(line, start + 1, width)


def lenient_int(text: Column) -> Column:
    """The integer that a text begins with, or 0; numbers beyond 32 bits give 0."""
    return F.coalesce(F.regexp_extract(text, _INT, 1).try_cast("int"), F.lit(0))


def lenient_double(text: Column) -> Column:
    """The decimal number that a text begins with, or 0.0."""
    return F.coalesce(F.regexp_extract(text, _FLOAT, 1).try_cast("double"), F.lit(0.0))


def int_field(line: Column, start: int, width: int) -> Column:
    return lenient_int(_slice(line, start, width))


def double_field(line: Column, start: int, width: int) -> Column:
    return lenient_double(_slice(line, start, width))


def text_field(line: Column, start: int, width: int) -> Column:
    return F.trim(_slice(line, start, width))


def split_widths(line: Column, widths: list[int]) -> list[Column]:
    """The line cut into trimmed fields of these widths."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return [text_field(line, a, w) for a, w in zip(starts, widths, strict=True)]


# ---- numbers to text ----------------------------------------------------------------------


def format_int(value: Column, width: int) -> Column:
    """Right-justified integer; a wider one is not cut."""
    text = F.coalesce(value.cast("bigint"), F.lit(0)).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def format_text(value: Column, width: int) -> Column:
    """Left-justified text, cut to the width."""
    return F.rpad(F.coalesce(value, F.lit("")), width, " ")


def let(value: Column, build) -> Column:
    """build(value), in which the value is computed once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _general(value: Column, digits: int) -> Column:
    """``%g`` with so many significant digits: no trailing zeros, exponents from 1e-5 down and from 10**digits up."""

    def plain(sign: Column, figures: Column, exponent: Column) -> Column:
        whole = F.when(exponent < 0, "0").otherwise(F.substring(figures, F.lit(1), exponent + 1))
        rest = F.when(exponent < 0, F.concat(F.repeat(F.lit("0"), -exponent - 1), figures)).otherwise(F.substring(figures, exponent + 2, F.lit(digits)))
        return F.concat(sign, F.regexp_replace(F.concat(whole, F.lit("."), rest), r"\.?0*$", ""))

    def scientific(sign: Column, figures: Column, exponent: Column) -> Column:
        mantissa = F.regexp_replace(F.concat(F.substring(figures, F.lit(1), F.lit(1)), F.lit("."), F.substring(figures, F.lit(2), F.lit(digits))), r"\.?0*$", "")
        return F.concat(sign, mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))

    def written(sci: Column) -> Column:
        parts = F.struct(F.regexp_extract(sci, "^(-?)", 1).alias("sign"), F.regexp_replace(F.regexp_extract(sci, r"^-?([0-9.]+)", 1), r"\.", "").alias("figures"), F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int").alias("exponent"))
        return let(parts, lambda p: F.when((p["exponent"] < -4) | (p["exponent"] >= digits), scientific(p["sign"], p["figures"], p["exponent"])).otherwise(plain(p["sign"], p["figures"], p["exponent"])))

    return let(F.format_string(f"%.{digits - 1}e", value), written)


def format_double(value: Column, width: int) -> Column:
    """Right-justified number: 0 as 0.0; from 1e6 up or under 1e-4 with an exponent; else the shortest form of width - 4 digits."""
    digits = max(1, width - 4)

    def text(v: Column) -> Column:
        sci = F.format_string(f"%.{max(1, width - 8)}e", v)
        return F.when(v == 0, "0.0").when((F.abs(v) >= 1e6) | (F.abs(v) < 1e-4), sci).otherwise(_general(v, digits))

    whole = let(F.coalesce(value.cast("double"), F.lit(0.0)), text)
    return let(whole, lambda t: F.when(F.length(t) < width, F.lpad(t, width, " ")).otherwise(t))


def join_card(fields: list[Column]) -> Column:
    return F.rtrim(F.concat(*fields))


# ---- other values -------------------------------------------------------------------------

# Pressure units in MPa.
UNITS = {"GPA": 1000.0, "MPA": 1.0, "KPA": 0.001, "PA": 0.000001}


def pressure_mpa(text: Column) -> Column:
    """A number with an optional GPa, MPa, kPa or Pa, in MPa; an unknown unit leaves the number, blank gives 0."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    unit = F.upper(F.trim(F.regexp_replace(text, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", "")))
    factor = F.lit(1.0)
    for name, by in UNITS.items():
        factor = F.when(unit == name, by).otherwise(factor)
    return F.coalesce(number, F.lit(0.0)) * factor


def density_tonnes_mm3(grams_cm3: Column) -> Column:
    return grams_cm3 * 1e-9


def direction_label(x: Column, y: Column, z: Column) -> Column:
    """The axis a vector lies along, with its sign; others are custom."""
    found = F.lit("custom")
    for name, (a, b, c) in {"+X": (x, y, z), "+Y": (y, x, z), "+Z": (z, x, y)}.items():
        found = F.when((b == 0) & (c == 0) & (a > 0), name).when((b == 0) & (c == 0) & (a < 0), name.replace("+", "-")).otherwise(found)
    return found
