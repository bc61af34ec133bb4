"""Labels and rules over metrics: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of subjects and grades; grade codes and their short labels.
SUBJECTS = {"mat": "Matemática", "lect": "Lectura", "cie": "Ciencias", "his": "Historia", "ing": "Inglés"}
GRADES = {"2b": "2° básico", "4b": "4° básico", "6b": "6° básico", "8b": "8° básico", "2m": "2° medio", "4m": "4° medio"}
GRADE_OF_CODE = {2: "2b", 4: "4b", 6: "6b", 8: "8b", 10: "2m"}
# Points from which a fit has that confidence.
CONFIDENCE = ((6, "alta"), (4, "media"), (3, "baja"))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return found if default is None else F.coalesce(found, default)


def grade_label(code: Column) -> Column:
    """Short label of a grade's code; the code itself where there is none."""
    return lookup(code.cast("int"), GRADE_OF_CODE, code.cast("string"))


def confidence(n: Column) -> Column:
    out = F.when(n >= CONFIDENCE[0][0], CONFIDENCE[0][1])
    for least, name in CONFIDENCE[1:]:
        out = out.when(n >= least, name)
    return out.otherwise("insuficiente")


def in_range(year: Column, start: int, end: int) -> Column:
    return year.between(start, end)


def fixed(value: Column, digits: int, sign: bool = False, scale: int = 4) -> Column:
    """A number with so many decimals, half away from zero, worked out in whole numbers.

    value is rounded to `scale` decimals first. With sign, a plus stands before what is not negative.
    """
    whole = F.round(value * 10**scale).cast("bigint")
    step = 10 ** (scale - digits)
    n = F.floor((F.abs(whole) + step // 2) / step).cast("bigint")
    body = F.floor(n / 10**digits).cast("bigint").cast("string")
    if digits:
        body = F.concat(body, F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    head = F.when(whole < 0, "-").otherwise("+" if sign else "")
    return F.concat(head, body)
