"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks around extracted names that the cleaner takes off.
JUNK = r"""[\s_#$!@+\-*/()\[\]{}%"']+"""
LEADING_MARKERS = r"^\s*(\d+[.)]\s*|[*\-•+]\s*|\([a-zA-Z\d]+\)\s*)*"


def strip(x: Column) -> Column:
    """x without white space (of any script) at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_name(x: Column) -> Column:
    """An extracted name without list markers, a remark in parentheses at the end, surrounding junk and dots; null gives ''."""
    for pattern in (LEADING_MARKERS, r"\s+\([^)]*\)$", f"^{JUNK}|{JUNK}$", r"\s*\.{3,}$"):
        x = F.regexp_replace(strip(x) if pattern == LEADING_MARKERS else x, f"(?dU){pattern}", "")
    return F.coalesce(strip(x), F.lit(""))


def clean_names(xs: Column) -> Column:
    return F.transform(xs, clean_name)


def label_of(x: Column) -> Column:
    """A type as a graph label: upper case, spaces and hyphens as underscores."""
    return F.upper(F.translate(x, " -", "__"))


def roman_value(x: Column) -> Column:
    """The value of a numeral of I, V and X; null where it is outside 1 to 100 or holds another letter."""
    worth = F.transform(F.split(F.reverse(x), ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).otherwise(10))
    total = F.aggregate(
        worth,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(x.rlike("^[IVX]+$") & total.between(1, 100), total)


def color_of(category: Column) -> Column:
    """A stable color for a category: hue, saturation and lightness from its MD5, as #RRGGBB."""

    def modulo(m: int) -> Column:
        return F.aggregate(F.split(F.md5(category), ""), F.lit(0), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("int")) % m)

    hue, s, light = modulo(360), (60 + modulo(20)) / 100.0, (45 + modulo(20)) / 100.0
    c = (1 - F.abs(2 * light - 1)) * s
    x = c * (1 - F.abs((hue / 60.0) % 2 - 1))
    low = light - c / 2
    sector = F.floor(hue / 60.0).cast("int")
    pick = lambda *by: F.element_at(F.array(*[{"c": c, "x": x, "0": F.lit(0.0)}[k] for k in by]), sector + 1)
    part = lambda v: F.lpad(F.hex(F.floor((v + low) * 255).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(pick(*"cx00xc")), part(pick(*"xccx00")), part(pick(*"00xccx")))


def short_label(x: Column, most: int = 25) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def hover_text(id_: Column, type_: Column, role: Column) -> Column:
    kind = F.when(F.coalesce(type_, F.lit("")) == "", "Unknown").otherwise(type_)
    return F.concat(id_, F.lit("<br>Type: "), kind, F.when(F.coalesce(role, F.lit("")) == "", "").otherwise(F.concat(F.lit("<br>Role: "), role)))


def tokens(x: Column) -> Column:
    """Lower-case words of two or more ASCII letters or digits."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_][a-z0-9_]+"), F.lit(0))
