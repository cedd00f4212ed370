"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("country", "level1", "level2", "level3", "level4")


def location(level: int) -> Column:
    """Country and the non-empty levels up to `level`, joined by ' / '; empty below 0."""
    if level < 0:
        return F.lit("")
    return F.concat_ws(" / ", *[F.nullif(F.col(c), F.lit("")) for c in LEVELS[: level + 1]])


def quarter(date: Column) -> Column:
    """'2001 Q3', with quarters that begin in March, June and September."""
    month = F.month(date)
    q = F.when(month >= 9, "Q4").when(month >= 6, "Q3").when(month >= 3, "Q2").otherwise("Q1")
    return F.concat_ws(" ", F.year(date).cast("string"), q)


def short_location(name: Column) -> Column:
    """Long names (two slashes or more and over 24 characters) keep the first two letters of the country in capitals,
    the initials of the middle parts and the last part."""
    parts = F.transform(F.split(name, "/"), lambda p: F.trim(p))
    initials = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.array_join(F.transform(F.split(p, " "), lambda w: F.upper(F.left(w, F.lit(1)))), ""))
    short = F.concat_ws(" / ", F.upper(F.left(F.get(parts, F.lit(0)), F.lit(2))), F.array_join(initials, " / "), F.element_at(parts, -1))
    return F.when((F.size(parts) >= 3) & (F.length(name) > 24), short).otherwise(name)


def truth(text: Column) -> Column:
    """Whether a flag of text starts with Y or y."""
    return F.upper(F.left(text, F.lit(1))) == "Y"


def species(text: Column) -> Column:
    """Parts between slashes, sorted; 'X' without any."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.split(text, "/")), "/"), F.lit("")), F.lit("X"))


def small_sample_flag(n: Column) -> Column:
    return F.when(n < 20, "red").when(n < 30, "yellow")


def ladder_score(rss: Column, peaks: Column, ladder: Column) -> Column:
    """1 less deductions for a suspicious or large sum of squares and for missing ladder peaks."""
    cost = F.when(rss <= 0, 0.25).otherwise(0.0)
    for limit, minus in ((50, 0.05), (255, 0.10), (1024, 0.10)):
        cost = cost + F.when(rss > limit, minus).otherwise(0.0)
    missing = ladder - peaks
    return F.lit(1.0) - cost - F.when(missing > 0, 0.025 * (missing - 1)).otherwise(0.0)


def ladder_reports(rss: Column, peaks: Column, ladder: Column) -> Column:
    """What `ladder_score` deducts for, in words, joined by '|'."""
    missing = ladder - peaks
    said = [F.when(missing > 0, F.format_string("QC missing peaks = %d", missing))]
    said += [F.when(rss > limit, f"QC RSS > {limit}") for limit in (1024, 255, 50)] + [F.when(rss <= 0, "QC RSS < 0")]
    return F.concat_ws("|", *said)


def wavelength_rgb(nm: Column, top: Column) -> Column:
    """array(red, green, blue) of a wavelength in nm, up to `top`; outside 380 to 780 all zero."""

    def part(*ramps: tuple[float, float, float, float]) -> Column:
        """(from, to, at from, at to): straight lines, else 0."""
        out = None
        for a, b, x, y in ramps:
            line = F.lit(float(x)) + (nm - a) / float(b - a) * float(y - x) if x != y else F.lit(float(x))
            cond = (nm >= a) & (nm < b)
            out = F.when(cond, line) if out is None else out.when(cond, line)
        return out.otherwise(0.0)

    red = part((380, 440, 1, 0), (510, 580, 0, 1), (580, 781, 1, 1))
    green = part((440, 490, 0, 1), (490, 580, 1, 1), (580, 645, 1, 0))
    blue = part((380, 490, 1, 1), (490, 510, 1, 0))
    fade = (
        F.when((nm >= 380) & (nm < 420), 0.3 + 0.7 * (nm - 380) / 40.0)
        .when((nm >= 420) & (nm < 701), 1.0)
        .when((nm >= 701) & (nm <= 780), 0.3 + 0.7 * (780 - nm) / 80.0)
        .otherwise(0.0)
    )
    return F.array(*[F.when(c * fade > 0, F.bround(top * F.pow(c * fade, F.lit(0.8)))).otherwise(0.0).cast("int") for c in (red, green, blue)])
