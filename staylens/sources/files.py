"""File scans: listing snapshots, plain tables, folders, neighbourhood polygons."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.clean import base_name, file_city, file_date

# Free text in these files holds commas, quotes and line breaks.
LISTING_TYPES = {
    **dict.fromkeys(("id", "host_id"), "bigint"),
    **dict.fromkeys(("last_review", "calendar_last_scraped"), "date"),
    **dict.fromkeys(
        (
            "accommodates", "number_of_reviews", "number_of_reviews_ltm", "availability_30", "minimum_nights", "host_total_listings_count",
            "host_listings_count", "calculated_host_listings_count",
        ),
        "int",
    ),
    **dict.fromkeys(
        (
            "bedrooms", "beds", "minimum_nights_avg_ntm", "maximum_nights_avg_ntm", "review_scores_rating", "review_scores_accuracy",
            "review_scores_cleanliness", "review_scores_checkin", "review_scores_communication", "review_scores_location", "review_scores_value",
        ),
        "double",
    ),
}
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on any file system Spark can read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.options(header=True, quote='"', escape='"').csv(path).columns)


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Read CSV files whose column sets may differ; a column a file lacks is null there.

    The CSV reader goes by position, so the files are grouped by their header lines and each group is one
    scan. Columns are text unless ``schema`` types them (by name; unreadable values become null).
    """
    if not paths:
        raise FileNotFoundError("no file matches")
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    with ThreadPoolExecutor(16) as pool:
        for path, header in zip(paths, pool.map(lambda p: _header(spark, p), paths)):
            groups[header].append(path)
    frames = []
    for header, members in groups.items():
        texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
        frames.append(with_source(spark.read.options(**CSV_OPTIONS).schema(texts).csv(members)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if schema is None else typed(out, schema)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns the schema names; those the files lack are added as nulls."""
    cols = {}
    for f in schema:
        here = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols[f.name] = here.try_cast(f.dataType)
    return df.withColumns(cols)


def with_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the path of the file each row comes from."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def read_snapshots(
    spark: SparkSession,
    root: str,
    kind: str = "listings",
    city: str | None = None,
    period: str | None = None,
    tokens: Sequence[str] = (),
    schema: T.StructType | None = None,
    city_pattern: str | None = None,
) -> DataFrame:
    """Gz CSV snapshots whose names hold all the given tokens, with ``filedate``, ``city``, ``filecity`` and ``source_file``.

    ``city`` is the city of the file name where the files have no such column. Without ``schema`` the columns that
    jobs compute with get their types from ``LISTING_TYPES``; unreadable values become null.

    A gz file cannot be split, so the rows are rebalanced over the cluster right after the read.
    """
    wanted = [t for t in (kind, city, period, *tokens) if t]
    paths = [p for p in list_files(spark, f"{root.rstrip('/')}/*.gz") if all(t in p.rsplit("/", 1)[-1] for t in wanted)]
    df = read_files(spark, paths, schema)
    if schema is None:
        df = df.withColumns({c: F.col(c).try_cast(t) for c, t in LISTING_TYPES.items() if c in df.columns})
    df = df.withColumns(
        {
            "filedate": file_date("source_file"),
            "filecity": file_city("source_file", city_pattern) if city_pattern else file_city("source_file"),
        }
    )
    if "city" not in df.columns:
        df = df.withColumn("city", F.col("filecity"))
    return df.hint("rebalance")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Plain CSV table."""
    return read_files(spark, [path] if isinstance(path, str) else list(path), schema)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Every CSV file of a folder, compressed or not."""
    paths = [p for p in list_files(spark, f"{folder.rstrip('/')}/*") if ".csv" in p.rsplit("/", 1)[-1]]
    return read_files(spark, paths, schema)


POINTS = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str | Sequence[str], city_pattern: str | None = None, properties: Sequence[str] = ("neighbourhood",)) -> DataFrame:
    """Polygons of one or more GeoJSON files: rows (the properties, city, geometry, source_file).

    ``geometry`` is always an array of polygons; a single polygon is wrapped. ``city`` comes from the file name.
    """
    fields = ", ".join(f"`{p}`: string" for p in properties)
    schema = f"features array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>"
    df = with_source(spark.read.option("multiLine", True).schema(schema).json(path))
    feature = df.select("source_file", F.explode("features").alias("f"))
    shape, points = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    geometry = F.when(shape == "MultiPolygon", F.from_json(points, f"array<array<{POINTS}>>")).when(
        shape == "Polygon", F.array(F.from_json(points, f"array<{POINTS}>"))
    )
    city = file_city("source_file", city_pattern) if city_pattern else file_city("source_file")
    names = [F.col("f.properties")[p].alias(p) for p in properties]
    return feature.select(*names, city.alias("city"), geometry.alias("geometry"), "source_file")


def source_name(col: str = "source_file"):
    return base_name(col)
