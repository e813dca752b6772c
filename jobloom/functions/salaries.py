"""Salaries in listing fields and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.common import col, non_zero


def range_min(text: Column | str) -> Column:
    """First integer of a range, in hundredths."""
    return F.regexp_extract(col(text), r"(\d+)", 1).try_cast("bigint") * 100


def range_max(text: Column | str) -> Column:
    """Second integer in hundredths, else the first."""
    second = F.regexp_extract(col(text), r"\d+\D+(\d+)", 1).try_cast("bigint") * 100
    return F.coalesce(second, range_min(text))


# amount, currency and the four phrasings that are told apart, in order (fixed values);
# a net/gross/monthly prefix before a range changes nothing, so it needs no pattern of its own
AMOUNT = r"(\d+[\s,\d]*)"
CURRENCY = "(BGN|лв|лева)"
PATTERNS = {
    "range": rf"{AMOUNT}\s*[-–]\s*{AMOUNT}\s*{CURRENCY}",
    "from_to": rf"от\s+{AMOUNT}\s+до\s+{AMOUNT}\s*{CURRENCY}",
    "up_to": rf"up\s+to\s+{AMOUNT}\s*{CURRENCY}",
    "up_to_bg": rf"до\s+{AMOUNT}\s*{CURRENCY}",
}


def plain_text(html: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(html), r"<[^>]*>", " "), r"[\s\u00a0]+", " ")


def with_page_salary(df: DataFrame, html: str, out: str = "salary") -> DataFrame:
    """Add struct(min, max, currency) of the first pattern that gives an amount, in whole currency units.

    One projection per step, so the text, the matches and the numbers are each made
    once per row and all of it stays in generated code.
    """

    def number(match: Column, group: int, pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract(match, f"(?iu){pattern}", group), r"[\s,]", "").try_cast("int")

    df = df.withColumn("_text", plain_text(html))
    df = df.withColumns({f"_m_{n}": F.regexp_extract("_text", f"(?iu){p}", 0) for n, p in PATTERNS.items()})
    numbers = {}
    for name, pattern in PATTERNS.items():
        match, both = F.col(f"_m_{name}"), name in ("range", "from_to")
        numbers[f"_lo_{name}"] = number(match, 1, pattern) if both else F.lit(None).cast("int")
        numbers[f"_hi_{name}"] = number(match, 2 if both else 1, pattern)
    df = df.withColumns(numbers)
    tries = []
    for name in PATTERNS:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        got = non_zero(low).isNotNull() | non_zero(high).isNotNull()
        tries.append(F.when(got, F.struct(low.alias("min"), high.alias("max"), F.lit("BGN").alias("currency"))))
    made = ["_text", *[f"_m_{n}" for n in PATTERNS], *numbers]
    return df.withColumn(out, F.coalesce(*tries)).drop(*made)
