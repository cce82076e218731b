"""Ranks, running totals, exact quantiles and top-n that hold up when one group has most of the rows.

A window over a whole group would put that group into one task. Here the rows are range-partitioned by
(group, value) and stored, so a large group is spread over many ranges; totals per range are tiny, and a
window then only ever runs inside one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.runtime import broadcast_if_small, materialize

_RANGE = "__range"


def _stored_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Store ``df`` range-partitioned by keys and order, with the number of the range in each row."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn(_RANGE, F.spark_partition_id()))


def _offsets(stored: DataFrame, keys: Sequence[str], weights: Mapping[str, Column]) -> DataFrame:
    """Per (keys, range): total of each weight here (``<w>__in``) and in all earlier ranges (``<w>__off``)."""
    totals = stored.groupBy(*keys, _RANGE).agg(*[F.sum(c).alias(f"{w}__in") for w, c in weights.items()])
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {f"{w}__off": F.coalesce(F.sum(f"{w}__in").over(earlier), F.lit(0)) for w in weights}
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weights: Mapping[str, Column],
) -> DataFrame:
    """Add for each weight ``w`` a column ``w`` with its total over the rows that come earlier in the group.

    ``order`` must be a total order within the group (end it with a unique key). Rows whose keys are
    null are dropped, as grouping in data frames does.
    """
    df = df.dropna(subset=list(keys)) if keys else df
    stored = _stored_ranges(df, keys, order)
    offsets = _offsets(stored, keys, weights)
    on = [*keys, _RANGE]
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = stored.withColumns({f"{w}__run": F.coalesce(F.sum(c).over(inside), F.lit(0)) for w, c in weights.items()})
    out = out.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"{w}__off") + F.col(f"{w}__run")).alias(w) for w in weights])


def with_row_number(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "row") -> DataFrame:
    """Gapless row number from 1 in a total order, over everything or per group."""
    out = running_totals(df, keys, order, {name: F.lit(1)})
    return out.withColumn(name, F.col(name) + 1)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, name: str = "__n") -> DataFrame:
    """Rows per (keys, value), nulls left out; the map-side combine takes the repeats away."""
    return df.dropna(subset=[*keys, value]).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(name))


# Cells that a span of values is cut into, rows of a wanted cell at which it is looked at value by value, and most rounds.
CELLS, CELL_ROWS, ROUNDS = 4_096, 200_000, 12


def _cells(data: DataFrame, keys: Sequence[str], spans: DataFrame) -> DataFrame:
    """The cells of ``spans`` that hold a wanted rank, as narrower spans with the ranks that they hold."""
    t, a, b = F.col("t"), F.col("__a"), F.col("__b")
    cell = F.when(b > a, F.least(F.floor((t - a) / (b - a) * CELLS), F.lit(CELLS - 1))).otherwise(0)
    inside = _inside(data, keys, spans.select(*keys, "__a", "__b"))
    counts = inside.groupBy(*keys, "__a", cell.alias("__cell")).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys, "__a").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__cell")
    out = counts.join(spans.drop("__b", "__n"), [*keys, "__a"]).withColumn("__first", F.col("__base") + F.col("__before"))
    out = out.withColumn("__held", F.filter("__ranks", lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__n")))).where(F.size("__held") > 0)
    named = {"__lo": "__a", "__hi": "__b", "__first": "__base", "__held": "__ranks", "__n": "__n", "__total": "__total"}
    return out.select(*keys, *[F.col(c).alias(n) for c, n in named.items()])


def _inside(data: DataFrame, keys: Sequence[str], spans: DataFrame) -> DataFrame:
    """Rows within a span of their group, with its bounds; the spans of a group do not overlap."""
    within = F.col("t").between(F.col("__a"), F.col("__b"))
    if not keys:
        return data.join(F.broadcast(spans), within)  # two spans for each wanted quantile at most
    return data.join(broadcast_if_small(spans), list(keys)).where(within)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation per group, as array column ``q`` beside the count ``n``.

    A selection without a sort: the span of each group's values, on a scale that long tails do not stretch, is cut into
    cells that one aggregate counts. Only cells that hold a wanted rank are cut further, and looked at value by value
    when they hold few rows. All groups and quantiles go through the same passes.
    """
    keys = list(keys)
    v = F.col("v")
    scale = F.least(F.greatest(F.signum(v) * F.log1p(F.abs(v)), F.lit(-1000.0)), F.lit(1000.0))
    data = df.select(*keys, F.col(value).cast("double").alias("v")).dropna(subset=[*keys, "v"]).withColumn("t", scale)
    total = F.col("__total")
    places = {}
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (total - 1)
        places[f"__lo{i}"], places[f"__hi{i}"] = F.floor(at), F.ceil(at)
    spans = data.groupBy(*keys).agg(F.min("t").alias("__a"), F.max("t").alias("__b"), F.count(F.lit(1)).alias("__total")).where(total > 0)
    spans = materialize(spans.withColumns({"__base": F.lit(0).cast("long"), "__ranks": F.array_distinct(F.array(*places.values())), "__n": total}))
    for _ in range(ROUNDS):
        # A cell whose values are all equal on the scale is not cut any further.
        if spans.where((F.col("__b") > F.col("__a")) & (F.col("__n") > CELL_ROWS)).isEmpty():
            break
        spans = materialize(_cells(data, keys, spans))
    values = _inside(data, keys, spans.select(*keys, "__a", "__b")).groupBy(*keys, "__a", "v").agg(F.count(F.lit(1)).alias("__m"))
    earlier = Window.partitionBy(*keys, "__a").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = values.withColumn("__first", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).join(spans.drop("__b", "__n", "__ranks"), [*keys, "__a"])
    first = F.col("__base") + F.col("__first")
    picked = near.groupBy(*keys).agg(
        F.max("__total").alias("__total"),
        *[F.max(F.when(c.between(first, first + F.col("__m") - 1), v)).alias(name) for name, c in places.items()],
    )
    between = [F.lit(float(q)) * (total - 1) - F.floor(F.lit(float(q)) * (total - 1)) for q in probs]
    found = [F.col(f"__lo{i}") + F.when(w > 0, w * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).otherwise(0.0) for i, w in enumerate(between)]
    return picked.select(*keys, total.alias("n"), F.array(*found).alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """One quantile per column, as rows (column, quantile)."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "value")
    return exact_quantiles(long, ["column"], "value", [q]).select("column", F.get("q", F.lit(0)).alias("quantile"))


def top_n_by(df: DataFrame, keys: Sequence[str], col: str, n: int, name: str = "rank") -> DataFrame:
    """Rows whose value is among the ``n`` largest of the group; all rows of a tie are kept and share a rank.

    Only the ``n`` largest distinct values per group can matter, and the row limit inside the window is
    pushed below the shuffle. ``df`` is read twice: store it first if ``col`` is a computed double.
    """
    values = value_counts(df, keys, col)
    order = Window.partitionBy(*keys).orderBy(F.desc(col))
    best = values.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n)
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = best.withColumn(name, (before + 1).cast("int")).where(F.col(name) <= n).drop("__n", "__k")
    return df.join(materialize(kept), [*keys, col]).select(*df.columns, name)


def avg_rank(df: DataFrame, keys: Sequence[str], col: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """Rank within the group, ties sharing the mean of their places. Null values get no row.

    ``df`` is read twice: store it first if ``col`` is a computed double.
    """
    order = F.desc(col) if descending else F.asc(col)
    ranked = running_totals(value_counts(df, keys, col), keys, [order], {"__before": F.col("__n")})
    place = F.col("__before") + 1 + (F.col("__n") - 1) / 2
    return df.join(ranked.select(*keys, col, place.alias(name)), [*keys, col]).select(*df.columns, name)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record per key in ``order``, which should end in a unique column.

    An aggregate, not a window: repeats are thrown away before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*").select(*df.columns)


def top_k(df: DataFrame, col: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest value, ties settled by the tiebreak columns ascending."""
    return df.orderBy(F.desc(col), *[F.asc(c) for c in tiebreak]).limit(n)


def order_rank(df: DataFrame, col: str, descending: bool = True, name: str = "place") -> DataFrame:
    """Place of each category in the order of its value, equal values sharing the best place."""
    order = F.desc(col) if descending else F.asc(col)
    ranked = running_totals(value_counts(df, [], col), [], [order], {name: F.col("__n")})
    return df.join(ranked.select(col, (F.col(name) + 1).cast("int").alias(name)), col, "left").select(*df.columns, name)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 123) -> DataFrame:
    """Repeatable random sample of ``n`` rows: those with the smallest seeded hash of the key.

    A counted threshold first keeps the few rows that can be among them, so the final sort is over
    little more than ``n`` rows however large the table is.
    """
    u = F.xxhash64(F.col(key), F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5
    total = df.count()
    drawn = df.withColumn("__u", u)
    if total > n:
        share = min(1.0, (n + 10 * n**0.5 + 50) / total)
        few = drawn.where(F.col("__u") < share)
        if share < 1 and few.count() >= n:
            drawn = few
    return drawn.orderBy("__u", key).limit(n).drop("__u")


def train_test(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 123) -> DataFrame:
    """Add boolean ``is_test``; a row is always on the same side, whatever the partitioning."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("is_test", u < test_share)
