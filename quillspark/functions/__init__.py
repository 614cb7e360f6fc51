"""Row-wise expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The official key legend. A letter names two accepted options, Z all of them.
KEY_LEGEND = {
    "1": ["A"],
    "2": ["B"],
    "3": ["C"],
    "4": ["D"],
    "A": ["A", "B"],
    "B": ["A", "C"],
    "C": ["A", "D"],
    "D": ["B", "C"],
    "E": ["B", "D"],
    "F": ["C", "D"],
    "Z": ["A", "B", "C", "D"],
}
#: Marks for a right, wrong and missing answer; exams that are not listed follow the first.
MARKS = {"CTET": (1, 0, 0), "NEET": (4, -1, 0)}


def accepted(key_raw: Column) -> Column:
    """Option labels that a raw key accepts; null for an unknown key."""
    legend = F.create_map(*[x for k, v in KEY_LEGEND.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(legend, key_raw)


def half_up(c: Column) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(c + 0.5).cast("long")


def whole(c: Column) -> Column:
    """A number in ten-thousandths, so that quotients of sums are exact; further decimals are rounded."""
    return (c.cast("decimal(18,4)") * 10000).cast("long")


def half_up_quotient(a: Column, b: Column) -> Column:
    """a / b of whole numbers, b over 0, halves towards plus infinity; exact."""
    top, under = a * 2 + b, b * 2
    return F.call_function("div", top - F.pmod(top, under), under).cast("long")


def listed(c: Column, sep: str = ",") -> Column:
    """Sorted and joined."""
    return F.array_join(F.array_sort(c), sep)


def reasons(*parts: Column) -> Column:
    """The given messages that are not null, in order."""
    return F.array_compact(F.array(*parts))


def norm_stem(c: Column) -> Column:
    """Lower case, boilerplate openings and punctuation gone, single blanks."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n\r\f]+", " ")
    out = F.regexp_replace(out, r"^(which (one )?of the following|read the following|consider the following)", "")
    return F.trim(F.regexp_replace(out, r"[^a-z0-9 ]", ""))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def numbers(c: Column) -> Column:
    """Distinct numbers in a text, whatever their digits' script, separators or leading zeros."""
    latin = F.translate(c, "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")
    plain = F.regexp_replace(latin, r"([0-9]),(?=[0-9])", "$1")
    found = F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.when(F.ltrim(x, F.lit("0")) == "", "0").otherwise(F.ltrim(x, F.lit("0")))))


def clean_page(c: Column) -> Column:
    """Reprint notices and bare page numbers out, blanks collapsed."""
    out = F.regexp_replace(c, r"(?i)reprint[ ]*20[0-9][0-9][-–][0-9][0-9]|rationalised[ ]+20[0-9][0-9][-–][0-9][0-9]", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*[0-9]{1,3}[ \t]*$", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))
