"""Dataset links on stored index pages, and the bulk read of the files they name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.clean import ColumnLike, _c
from staylens.sources.files import read_files

# An attribute: its name, then perhaps a value that is quoted either way or ends at a blank or the end of the tag.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
# Elements whose content is text, whatever it looks like.
RAW_TEXT = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]
# What a page is read as from left to right, first form first; the group holds the attributes of an anchor.
_MARKUP = "(?is)" + "|".join(
    [
        r"<!--(?:-?>|.*?(?:--!?>|\z))",
        rf"<a(?=[\s/>])({_ATTRIBUTES})>",
        rf"<({'|'.join(RAW_TEXT)})(?=[\s/>]){_ATTRIBUTES}>.*?(?=</\2[\s/>]|\z)",
        rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>",
        r"<[!?/][^>]*+>",
    ]
)
# Named characters of links; others stay as they are written.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"


def unescape(col: ColumnLike) -> Column:
    """Text with numeric and the named character references above resolved once; numbers that are no character give U+FFFD."""

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#[xX]?0*([0-9a-fA-F]{0,8});$", 1)
        point = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), part)
        return F.when(part.rlike("^&#.+;$"), F.when(valid, character).otherwise("\ufffd")).otherwise(F.coalesce(named, part))

    # most links hold no reference at all
    parts = F.regexp_extract_all(_c(col), F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(_c(col), F.lit("&")), F.concat_ws("", F.transform(parts, one))).otherwise(_c(col))


def hrefs(html: ColumnLike) -> Column:
    """Array of the link of each anchor of a page, in order.

    Comments, content of scripts and the like, and values of other attributes hold no anchors. Names are read in any case,
    values with quotes of either kind or none; of two values the first holds, and one that is missing is empty. Anchors
    without ``href`` are left out, as are tags that the page ends in. A null page gives null.
    """
    tags = F.regexp_extract_all(_c(html), F.lit(_MARKUP), F.lit(1))

    def link(attributes: Column) -> Column:
        named = F.filter(F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(r"(?i)^href(?:\s*=|$)"))
        value = F.regexp_replace(F.get(named, F.lit(0)), r"(?s)^[^=]+(?:=\s*)?", "")
        return unescape(F.regexp_replace(value, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2"))

    return F.filter(F.transform(tags, link), lambda x: x.isNotNull())


def extract_links(pages: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), html: str = "html") -> DataFrame:
    """One row per anchor link that holds all of ``include`` and none of ``exclude``."""
    keep = [c for c in pages.columns if c != html]
    found = pages.select(*keep, F.explode(hrefs(html)).alias("link"))
    tests = [F.col("link").contains(t) for t in include] + [~F.col("link").contains(t) for t in exclude]
    return found.where(reduce(Column.__and__, tests)) if tests else found


def read_links(spark: SparkSession, links: DataFrame, root: str, col: str = "link") -> DataFrame:
    """Read the gz CSV files the links name from ``root``, a store that mirrors the site.

    The list of files is metadata, one entry per city and snapshot; the files themselves are read by Spark.
    """
    names = [r[0] for r in links.select(F.regexp_replace(F.col(col), r"^\w+://[^/]+", "").alias("p")).distinct().collect()]
    return read_files(spark, [f"{root.rstrip('/')}/{n.lstrip('/')}" for n in sorted(names)])
