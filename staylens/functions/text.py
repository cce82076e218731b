"""Text and set-valued column expressions. Everything here is row-local and runs in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.clean import ColumnLike, _c

WORD_PATTERN = r"[\p{L}\p{N}']+"

# Characters that are mark-up in the three ways a set is written as text.
SET_MARKUP = {"brackets": '"[]', "braces": '"{}', "quotes": "'[]"}


def strip_chars(col: ColumnLike, chars: str) -> Column:
    return F.translate(_c(col), chars, "")


def remove_phrases(col: ColumnLike, phrases: Sequence[str]) -> Column:
    """Delete literal phrases, one after the other in the order given."""
    out = _c(col)
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def replace_first(col: ColumnLike, literal: str, replacement: str) -> Column:
    """Replace only the first occurrence of a literal."""
    return F.regexp_replace(
        _c(col), f"(?s)^(.*?){re.escape(literal)}", "$1" + replacement.replace("\\", r"\\").replace("$", r"\$")
    )


def set_items(col: ColumnLike, dialect: str = "brackets") -> Column:
    """Set written as text to an array of trimmed items, in file order, repeats kept.

    ``brackets`` reads ``["a", "b"]``, ``braces`` reads ``{a,"b"}``, ``quotes`` reads ``['a', 'b']``; these
    drop the mark-up and cut at every comma. ``json`` honours quotes around commas. An empty set gives
    one empty item under the first three, as a plain split does.
    """
    if dialect == "json":
        return F.transform(F.from_json(_c(col), "array<string>"), lambda x: F.trim(x))
    return F.transform(F.split(strip_chars(col, SET_MARKUP[dialect]), ","), lambda x: F.trim(x))


def explode_items(df: DataFrame, col: str, dialect: str = "brackets", item: str = "item") -> DataFrame:
    """One row per item of a set written as text; rows with a null set give none."""
    return df.withColumn(item, F.explode(set_items(col, dialect)))


def delimiter_count(col: ColumnLike, delimiter: str = ",") -> Column:
    """Number of delimiters, that is items minus one."""
    return F.regexp_count(_c(col), F.lit(re.escape(delimiter)))


def words(col: ColumnLike) -> Column:
    """Lower-case words of a text, in order, punctuation dropped."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_PATTERN), F.lit(0))


def token_windows(tokens: ColumnLike, n: int) -> Column:
    """For each token the struct (x0, ..., x{n-1}) of it and the tokens after it, null past the end.

    Built by zipping shifted copies, so the lambdas only see their own arguments: a reference to an
    outer array would be evaluated again for every element.
    """
    t = _c(tokens)

    def longer(k: int):
        return lambda s, x: F.struct(*[s[f"x{i}"].alias(f"x{i}") for i in range(k)], x.alias(f"x{k}"))

    out = F.transform(t, lambda x: F.struct(x.alias("x0")))
    for k in range(1, n):
        shifted = F.slice(t, F.lit(k + 1), F.greatest(F.size(t), F.lit(1)))
        out = F.zip_with(out, shifted, longer(k))
    return out


def ngrams(tokens: ColumnLike, n: int = 2, sep: str = " ") -> Column:
    """n-grams of a token array, in order and within the array only."""
    full = F.filter(token_windows(tokens, n), lambda w: w[f"x{n - 1}"].isNotNull())
    return F.transform(full, lambda w: F.concat_ws(sep, *[w[f"x{i}"] for i in range(n)]))


def neighbours(tokens: ColumnLike) -> Column:
    """Array of (src, dst) for each token and the one after it."""
    full = F.filter(token_windows(tokens, 2), lambda w: w["x1"].isNotNull())
    return F.transform(full, lambda w: F.struct(w["x0"].alias("src"), w["x1"].alias("dst")))


def greedy_starts(matches: ColumnLike, n: int) -> Column:
    """Resolve overlapping n-gram matches from left to right.

    ``matches`` is an array of booleans, true where an n-gram starts. The result is an array of one
    letter per token: ``S`` a taken start, ``_`` a token swallowed by it, ``0`` an ordinary token.
    A regular expression scans left to right without overlap, which is the wanted order.
    """
    marks = F.concat_ws("", F.transform(_c(matches), lambda m: F.when(m, "1").otherwise("0")))
    taken = F.regexp_replace(marks, "1.{%d}" % (n - 1), "S" + "_" * (n - 1))
    return F.split(F.regexp_replace(taken, "1", "0"), "")


def apply_recode(tokens: ColumnLike, marks: ColumnLike, n: int, sep: str = " ") -> Column:
    """First token of a taken n-gram becomes the compound, the swallowed ones become null."""

    def pick(w: Column, m: Column) -> Column:
        return F.when(m == "S", F.concat_ws(sep, *[w[f"x{i}"] for i in range(n)])).when(m == "0", w["x0"])

    t = _c(tokens)
    return F.slice(F.zip_with(token_windows(t, n), _c(marks), pick), F.lit(1), F.size(t))


def phrase_hits(tokens: ColumnLike, phrases: Sequence[str], sep: str = " ") -> Column:
    """Array of booleans, true where one of the phrases starts; all have the same number of words."""
    (n,) = {len(p.split(sep)) for p in phrases}

    def hit(w: Column) -> Column:
        phrase = F.concat_ws(sep, *[w[f"x{i}"] for i in range(n)])
        return w[f"x{n - 1}"].isNotNull() & phrase.isin(list(phrases))

    return F.transform(token_windows(tokens, n), hit)


def recode_phrases(tokens: ColumnLike, phrases: Sequence[str], sep: str = " ") -> Column:
    """Recode a token array by a short fixed list of phrases, all of the same number of words."""
    (n,) = {len(p.split(sep)) for p in phrases}
    return apply_recode(tokens, greedy_starts(phrase_hits(tokens, phrases, sep), n), n, sep)


def letters(col: ColumnLike) -> Column:
    """Lower-case letters of a text, each run of other signs counting as one space, between two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_c(col)), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(col: ColumnLike) -> Column:
    """Character trigrams of ``letters``."""
    # a lookahead matches at every place without consuming, so overlapping trigrams come out in one scan
    return F.regexp_extract_all(letters(col), F.lit("(?=(...))"), F.lit(1))


# Spellings of arrival and departure brought to one form, applied in this order.
ARRIVAL_TERMS = {
    "check - in": "check-in",
    "checkin": "check-in",
    "check in": "check-in",
    "check - out": "check-out",
    "checkout": "check-out",
    "check out": "check-out",
}


def normalise_terms(col: ColumnLike, spellings: dict[str, str] = ARRIVAL_TERMS) -> Column:
    out = _c(col)
    for found, wanted in spellings.items():
        out = replace_first(out, found, wanted)
    return out


# --- description sections -------------------------------------------------------------------

# The headings that hosts' descriptions are cut at.
SPACE, ACCESS, NOTES, LICENSE = "The space", "Guest access", "Other things to note", "License number"
SECTIONS = ("Description", "Space", "Guest_access", "Other_things_to_note", "License")


def split_at(df: DataFrame, col: str, marker: str, right: str) -> DataFrame:
    """Cut ``col`` at ``marker``: it keeps the first piece, ``right`` gets the second, more are dropped."""
    pieces = F.split(F.col(col), re.escape(marker))
    return df.withColumns({col: F.get(pieces, F.lit(0)), right: F.get(pieces, F.lit(1))})


def unite(cols: Sequence[str], sep: str = "_") -> Column:
    """Join the non-null columns with ``sep``; nothing at all gives null."""
    return F.nullif(F.concat_ws(sep, *cols), F.lit(""))


def description_sections(
    df: DataFrame,
    text: str = "description",
    markers: Sequence[str] = (SPACE, ACCESS, NOTES, LICENSE),
) -> DataFrame:
    """Add one column per section of ``text`` and one 0/1 column per section that says it is filled.

    The headings normally come in the order of ``markers``. The text is cut along that order first;
    what is left over (a heading before its turn, a heading with an earlier one missing) is cut again
    and gathered under its heading, pieces joined by ``_``.
    """
    space, access, notes, lic = markers
    main, fragments = "Description", {"Guest_access": [], "Other_things_to_note": [], "License": []}
    out = df.withColumn(main, F.col(text))
    made: list[str] = []

    def cut(out: DataFrame, left: str, marker: str, section: str) -> DataFrame:
        right = f"__{section}_{len(made)}"
        made.append(right)
        fragments[section].append(right)
        return split_at(out, left, marker, right)

    def last(section: str) -> str:
        return fragments[section][-1]

    # along the usual order
    out = split_at(out, main, space, "Space")
    out = cut(out, "Space", access, "Guest_access")
    out = cut(out, last("Guest_access"), notes, "Other_things_to_note")
    out = cut(out, last("Other_things_to_note"), lic, "License")
    # headings found in the opening text
    out = cut(out, main, access, "Guest_access")
    out = cut(out, last("Guest_access"), notes, "Other_things_to_note")
    out = cut(out, last("Other_things_to_note"), lic, "License")
    for left in ("Space", main):
        out = cut(out, left, notes, "Other_things_to_note")
        out = cut(out, last("Other_things_to_note"), lic, "License")
    # licence numbers still inside another section
    for left in (main, "Space", *fragments["Guest_access"]):
        out = cut(out, left, lic, "License")

    named = {s: unite(cols) for s, cols in fragments.items()}
    named |= {s: F.nullif(F.col(s), F.lit("")) for s in (main, "Space")}
    out = out.withColumns(named).drop(*made)
    return out.withColumns({f"has_{s}": F.col(s).isNotNull().cast("int") for s in SECTIONS[:4]})
