"""Level, size and work-model labels. Labels, words and steps are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.common import any_contains, col, first_hit, half_up, lookup, non_zero


def experience_from_title(title: Column | str) -> Column:
    text = F.lower(col(title))
    return first_hit(
        (any_contains(text, ["senior", "lead", "principal"]), "senior"),
        (any_contains(text, ["junior", "graduate", "entry"]), "junior"),
        otherwise="mid",
    )


def employment_from_model(work_model: Column | str) -> Column:
    table = {
        "remote": "full-time",
        "hybrid": "full-time",
        "on-site": "full-time",
        "part-time": "part-time",
        "contract": "contract",
        "internship": "internship",
    }
    return lookup(F.lower(col(work_model)), table, F.lit("full-time"))


def quality(confidence: Column | str) -> Column:
    c = col(confidence)
    return first_hit((c >= 70, "high"), (c >= 50, "medium"), otherwise="low")


def score_level(score: Column | str) -> Column:
    s = col(score)
    return first_hit(
        (s >= 80, "excellent"), (s >= 60, "good"), (s >= 40, "average"), (s >= 20, "below-average"), otherwise="poor"
    )


def recommendation(score: Column | str) -> Column:
    s = col(score)
    return first_hit(
        (s.isNull() | (s == 0), "No rating"),
        (s >= 8.5, "Highly Recommended"),
        (s >= 7.5, "Recommended"),
        (s >= 6.5, "Good Option"),
        (s >= 5.5, "Consider Carefully"),
        otherwise="Proceed with Caution",
    )


def work_bucket(work_model: Column | str) -> Column:
    text = F.lower(col(work_model))
    return first_hit((text.contains("remote"), "remote"), (text.contains("hybrid"), "hybrid"), otherwise="office")


def salary_text(low: Column | str, high: Column | str, currency: Column | str) -> Column:
    """Such as ``€3k-5k``, ``From €3k``, ``Up to €5k`` or ``Competitive``; 0 counts as absent."""
    lo, hi = non_zero(low), non_zero(high)
    code = F.coalesce(col(currency), F.lit("EUR"))
    symbol = F.when(code == "EUR", "€").when(code == "USD", "$").otherwise(code)

    def amount(x: Column) -> Column:
        return F.when(x >= 1000, F.concat(half_up(x / 1000).cast("string"), F.lit("k"))).otherwise(x.cast("string"))

    return first_hit(
        (lo.isNotNull() & hi.isNotNull(), F.concat(symbol, amount(lo), F.lit("-"), amount(hi))),
        (lo.isNotNull(), F.concat(F.lit("From "), symbol, amount(lo))),
        (hi.isNotNull(), F.concat(F.lit("Up to "), symbol, amount(hi))),
        otherwise="Competitive",
    )


def _range(text: Column, span: str) -> Column:
    """The range as a whole: ``501-1000`` does not hold ``1-10``."""
    return text.rlike(rf"(^|[^0-9]){span}([^0-9]|$)")


def size_bucket(size: Column | str) -> Column:
    """startup, small, medium, large or enterprise; null is startup."""
    t = F.lower(col(size))
    return first_hit(
        (t.isNull() | (t == "") | _range(t, "1-10") | t.contains("startup"), "startup"),
        (_range(t, "11-50") | t.contains("small"), "small"),
        (_range(t, "51-200") | t.contains("medium"), "medium"),
        (_range(t, "201-1000") | t.contains("large"), "large"),
        otherwise="enterprise",
    )


def size_range(size: Column | str) -> Column:
    t = F.lower(col(size))
    return first_hit(
        (t.contains("startup") | _range(t, "1-10"), "1-10"),
        (t.contains("small") | _range(t, "11-50"), "11-50"),
        (t.contains("medium") | _range(t, "51-200"), "51-200"),
        (t.contains("large") | _range(t, "201-500"), "201-500"),
        (t.contains("enterprise") | t.contains("500+") | t.contains("1000+"), "1000+"),
    )


def size_in_page(text: Column) -> Column:
    """Size bucket named in a page text, first match wins."""
    t = F.lower(text)
    return first_hit(
        (t.contains("startup") | _range(t, "1-10"), "startup"),
        (t.contains("small") | _range(t, "11-50"), "small"),
        (t.contains("medium") | _range(t, "51-200"), "medium"),
        (t.contains("large") | _range(t, "201-500"), "large"),
        (t.contains("enterprise") | t.contains("500+") | t.contains("1000+"), "enterprise"),
    )


def size_standard(size: Column | str) -> Column:
    t = F.lower(col(size))
    return F.when(t.isin("startup", "small", "medium", "large", "enterprise"), t).otherwise("medium")


def size_headcount(size: Column | str) -> Column:
    """A representative headcount, longest range texts first."""
    t = F.lower(col(size))
    steps = [
        ("1000+", 1500), ("501-1000", 750), ("201-500", 350), ("51-200", 125), ("11-50", 30), ("1-10", 5),
        ("large", 750), ("medium", 125), ("small", 30), ("enterprise", 1500), ("startup", 15),
    ]
    return first_hit(*[(t.contains(text), F.lit(n)) for text, n in steps])


def first_integer(text: Column | str) -> Column:
    return F.regexp_extract(col(text), r"(\d+)", 1).try_cast("int")


def best_headcount(local: Column | str, it: Column | str, world: Column | str) -> Column:
    return F.coalesce(non_zero(local), non_zero(it), non_zero(world))
