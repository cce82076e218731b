"""Casts, cleaning and null-aware column expressions. Everything here is row-local."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- text to number -------------------------------------------------------------------------


def parse_money(col: ColumnLike) -> Column:
    """``$1,234.00`` to 1234.0; unreadable text to null."""
    return F.regexp_replace(_c(col), "[$,]", "").try_cast("double")


def parse_percent(col: ColumnLike) -> Column:
    """``98%`` to 98.0; unreadable text to null."""
    return F.regexp_replace(_c(col), "%", "").try_cast("double")


def parse_first_number(col: ColumnLike) -> Column:
    """First run of digits: ``$1,234`` gives 1.0. Use ``parse_money`` unless that is wanted."""
    return F.nullif(F.regexp_extract(_c(col), r"(\d+)", 1), F.lit("")).try_cast("double")


def digits_only(col: ColumnLike) -> Column:
    return F.regexp_replace(_c(col), "[^0-9]", "")


# --- file names -----------------------------------------------------------------------------


def base_name(col: ColumnLike) -> Column:
    """Last part of a path, with the percent-escaped spaces of file URIs put back."""
    return F.regexp_replace(F.substring_index(_c(col), "/", -1), "%20", " ")


def file_date(col: ColumnLike) -> Column:
    """Snapshot date held in a file name, as yyyymmdd or yyyy-mm-dd."""
    digits = F.regexp_replace(F.regexp_extract(base_name(col), r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd")


def file_city(col: ColumnLike, pattern: str | None = None, offset: int = 0) -> Column:
    """City held in a file name: group 1 of ``pattern``, or the first word after ``offset``."""
    name = base_name(col)
    if pattern is not None:
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.get(F.split(F.substring(name, offset + 1, 2**31 - 1), " "), F.lit(0))


# --- arithmetic -----------------------------------------------------------------------------


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b; a zero divisor gives null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def rescale_rating(col: ColumnLike, top: float = 5, factor: float = 20) -> Column:
    """Bring ratings given out of 100 down to the 0..5 scale; text that is no number is null."""
    c = _c(col).try_cast("double")
    return F.when(c > top, c / factor).otherwise(c)


def booked_next30(availability_30: ColumnLike) -> Column:
    return F.lit(30) - _c(availability_30)


def band(col: ColumnLike, cuts: Sequence[float]) -> Column:
    """Number of cut points that are reached; null counts as the lowest band."""
    c = _c(col)
    out = F.lit(0)
    for i, cut in enumerate(sorted(cuts), start=1):
        out = F.when(c >= cut, i).otherwise(out)
    return out


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def label_if(cond: Column, yes: str, no: str) -> Column:
    """Two labels; an unknown condition stays unknown."""
    return F.when(cond.isNull(), None).when(cond, yes).otherwise(no)


def recode(col: ColumnLike, mapping: Mapping, default=None, keep_unmapped: bool = False) -> Column:
    """Map values; the rest becomes ``default``, or stays as it is with ``keep_unmapped``."""
    c = _c(col)
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    mapped = F.when(c.isNotNull(), F.try_element_at(table, c))
    return F.coalesce(mapped, c if keep_unmapped else F.lit(default))


def cap(col: ColumnLike, hi) -> Column:
    """Upper limit; null stays null (``least`` alone would return the limit)."""
    c = _c(col)
    return F.when(c > hi, hi).otherwise(c)


def floor_at(col: ColumnLike, lo) -> Column:
    """Lower limit; null stays null."""
    c = _c(col)
    return F.when(c < lo, lo).otherwise(c)


def row_max(*cols: ColumnLike) -> Column:
    """Largest of the columns, null if any of them is."""
    cs = [_c(c) for c in cols]
    return F.when(reduce(Column.__and__, [c.isNotNull() for c in cs]), F.greatest(*cs))


def row_count(*cols: ColumnLike) -> Column:
    """How many of the columns hold a value."""
    return reduce(Column.__add__, [_c(c).isNotNull().cast("int") for c in cols])


def row_mean(*cols: ColumnLike) -> Column:
    """Mean of the columns that hold a value."""
    total = reduce(Column.__add__, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])
    return ratio(total, row_count(*cols))


def odds_change_pct(col: ColumnLike) -> Column:
    """Logit coefficient as percentage change of the odds."""
    return (F.exp(_c(col)) - 1) * 100


def occupancy_estimate(
    stay: ColumnLike, reviews_ltm: ColumnLike, review_rate: float = 0.5, ceiling: float = 0.7
) -> Column:
    """Share of the year booked: nights per stay times stays implied by the reviews, with a ceiling."""
    return cap(_c(stay) * (_c(reviews_ltm) / review_rate) / 365, ceiling)


def cluster_value(count, listings, occupancy, guests, price) -> Column:
    """Yearly revenue of a host cluster."""
    return _c(count) * _c(listings) * (365 * _c(occupancy)) * (_c(guests) * _c(price))


# --- nulls ----------------------------------------------------------------------------------


def strict_avg(col: ColumnLike) -> Column:
    """Mean that is null as soon as one input is."""
    c = _c(col)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_max(col: ColumnLike) -> Column:
    """Maximum that is null as soon as one input is."""
    c = _c(col)
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))


def not_in(col: ColumnLike, values: Sequence) -> Column:
    """NOT IN that keeps nulls."""
    return ~F.coalesce(_c(col).isin(list(values)), F.lit(False))


def ne_keep_null(col: ColumnLike, value) -> Column:
    """Inequality that keeps nulls."""
    return ~_c(col).eqNullSafe(F.lit(value))


def is_missing(col: ColumnLike) -> Column:
    return _c(col).isNull()


def contains_any(col: ColumnLike, needles: Sequence[str]) -> Column:
    """True if the text holds at least one of the literal needles."""
    return reduce(Column.__or__, [_c(col).contains(n) for n in needles])


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Infinite and not-a-number values of the double columns to null."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    names = [c for c in doubles if cols is None or c in cols]
    bad = {n: F.isnan(n) | (F.abs(F.col(n)) == float("inf")) for n in names}
    return df.withColumns({n: F.when(~bad[n], F.col(n)) for n in names})


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty strings to null, on every string column unless some are named."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in texts if cols is None or n in cols})


# --- output formats -------------------------------------------------------------------------


def fmt(col: ColumnLike, kind: str, decimals: int = 0) -> Column:
    """Number as text: ``number`` 1,234 · ``percent`` 12% (of a share) · ``currency`` $1,234 · ``millions`` $1.2M."""
    c = _c(col)
    if kind == "number":
        return F.format_number(c, decimals)
    if kind == "percent":
        return F.concat(F.format_number(c * 100, decimals), F.lit("%"))
    if kind == "currency":
        return F.concat(F.lit("$"), F.format_number(c, decimals))
    if kind == "millions":
        return F.concat(F.lit("$"), F.format_number(c / 1_000_000, decimals), F.lit("M"))
    raise ValueError(f"unknown format {kind!r}")
