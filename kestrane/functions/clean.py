"""Coercion of dirty text to typed values: Column -> Column, all of them total (bad input is null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value; suffixes of grades and their codes.
MISSING = ("", "nan", "None", "NaN")
GRADE_SUFFIXES = {"2b": 2, "4b": 4, "6b": 6, "8b": 8, "2m": 10, "4m": 12}


def clean_str(c: Column) -> Column:
    """Trimmed text; null where it stands for a missing value."""
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def to_float(c: Column) -> Column:
    """A decimal comma counts as a dot; of several dots all but the last go."""
    dotted = F.regexp_replace(F.replace(clean_str(c), F.lit(","), F.lit(".")), r"\.(?=.*\.)", "")
    return dotted.try_cast("double")


def to_int(c: Column) -> Column:
    """Through a float, cut toward zero."""
    return clean_str(c).try_cast("double").try_cast("int")


def to_date(c: Column) -> Column:
    """YYYY-MM-DD, YYYYMMDD, or YYYYMM as the month's first day."""
    t = clean_str(c)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
        .when(t.rlike(r"^\d{6}$"), F.try_to_date(F.concat(t, F.lit("01")), "yyyyMMdd"))
    )


def norm_rbd(c: Column) -> Column:
    """The digits, padded to eight on the left and never cut; null without any."""
    digits = F.regexp_replace(clean_str(c), "[^0-9]", "")
    return F.when(digits != "", F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def parse_run(c: Column) -> Column:
    """National id: without dots and check digit, as a number."""
    return F.element_at(F.split(F.replace(clean_str(c), F.lit("."), F.lit("")), "-"), 1).try_cast("bigint")


def parse_grade(c: Column) -> Column:
    """A suffix label such as 4b, or a whole number."""
    t = F.lower(clean_str(c))
    known = F.create_map(*[x for k, v in GRADE_SUFFIXES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, t), t.try_cast("int"))


def mark(c: Column) -> Column:
    """A mark with comma or dot; a dash is missing."""
    t = clean_str(c)
    return F.when(t != "-", F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def birth_date(c: Column, cut_decimals: bool = False) -> Column:
    """Eight digits to ISO, six to YYYY-MM, anything else unchanged; teachers' dates lose what follows a dot."""
    t = F.element_at(F.split(c, r"\."), 1) if cut_decimals else c
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.regexp_replace(t, r"^(\d{4})(\d{2})$", "$1-$2")


def lat_lon(c: Column) -> Column:
    """A decimal comma becomes a dot where the whole value is such a number."""
    return F.when(c.rlike(r"^-?\d+,\d+$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(c)


def bounded(c: Column, low: float, high: float) -> Column:
    """Null outside the bounds; the row stays."""
    return F.when(c.between(low, high), c)


def fallback(*columns: Column) -> Column:
    """The first of the columns that has text, trimmed; empty counts as missing."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


_RANDOM_ID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])"


def year_in_name(stem: Column, parent: Column) -> Column:
    """The year 20xx in a file's name, else in its folder's; the random ids that writers put into names tell no year."""
    find = lambda x: F.nullif(F.regexp_extract(F.regexp_replace(x, _RANDOM_ID, "-"), r"(?<!\d)(20\d{2})(?!\d)", 1), F.lit(""))
    return F.coalesce(find(stem), find(parent)).try_cast("int")


def last_year_in_text(c: Column, low: int = 1990, high: int = 2030) -> Column:
    """The greatest year in the text between the bounds: 199x or 20xx standing alone."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d{2}|199\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(low, high)))


def granularity(name: Column) -> Column:
    """School, municipality, province or region, as the file's name tells."""
    return F.nullif(F.regexp_extract(F.lower(name), r"_(rbd|comuna|deprov|region)_", 1), F.lit(""))


def sheet_fields(name: Column) -> dict[str, Column]:
    """The six fields of a record sheet's file name: school, code, grade, letter, date and time."""
    pattern = r"(?i)^(\d+)_(\w+?)_(\w+?)_([A-Z])_(\d{8})_(\d{6})\.pdf$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return {"rbd": norm_rbd(part(1)), "codigo": part(2), "grado": part(3), "letra": part(4), "fecha": F.try_to_date(part(5), "ddMMyyyy"), "hora": part(6)}


def safe_file_name(c: Column, extension: str = ".csv") -> Column:
    """Nine forbidden characters become _, dots at the ends go, and the extension is there."""
    t = F.regexp_replace(F.translate(c, '<>:"/\\|?*', "_________"), r"^\.+|\.+$", "")
    return F.when(F.endswith(F.lower(t), F.lit(extension)), t).otherwise(F.concat(t, F.lit(extension)))


def canonical_header(name: str) -> str:
    """A column name trimmed, without byte order mark, in lower case and with single underscores."""
    out = name.strip().lstrip("﻿").strip().lower().replace(" ", "_").replace("-", "_")
    while "__" in out:
        out = out.replace("__", "_")
    return out
