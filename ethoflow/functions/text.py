"""Strings, dates and lists of plate metadata, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WELLS = 24
#: Layouts in which dates are written, tried in this order; days and months may have one digit.
DATE_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy")
#: Texts that stand for no value.
NO_VALUE = ("", "null", "none", "n/a", "nan")
#: Names by which a gene is known in transgene labels, in the order in which they are tried.
GENES = (("neurod2", "NeuroD2"), ("eef1a2", "Eef1a2"), ("eelfa2", "Eef1a2"), ("eefla2", "Eef1a2"), ("ap2b3", "Ap2b3"), ("egfla2", "Eef1a2"))
#: Letters of the clutches by their mothers.
CLUTCHES = {10: "A", 11: "B", 3: "P"}
#: Fixed value: words that mark a gradient or dose plate.
GRADIENT = r"(?i)\b(\d+\s*mm|ptz|4-?ap|vpa)\b"


def wells(text: Column) -> Column:
    """``1 to 5, 8-10`` as the sorted distinct well numbers from 1 to 24; ranges may run backwards.

    Numbers and ranges stand between commas and blanks; a range has no blank round its ``-``, other tokens are skipped.
    """
    plain = F.replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "), F.lit(" to "), F.lit("-"))
    parts = F.filter(F.split(plain, r"[,\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def span(p: Column) -> Column:
        first = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        last = F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        return F.sequence(F.least(first, last), F.greatest(first, last))

    return F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span)))), lambda w: w.between(1, WELLS))


def compact(numbers: Column) -> Column:
    """A sorted list of numbers as text: runs become ``a-b``."""
    keyed = F.transform(numbers, lambda x, i: F.struct(x.alias("x"), (x - i).alias("run")))
    runs = F.array_distinct(F.transform(keyed, lambda k: k["run"]))

    def text(run: Column) -> Column:
        own = F.transform(F.filter(keyed, lambda k: k["run"] == run), lambda k: k["x"])
        low, high = F.array_min(own), F.array_max(own)
        return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))

    return F.array_join(F.transform(runs, text), ",")


def parsed_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first layout that fits; null for impossible dates. Of years of two digits, 69 and more are of the last century."""
    found = []
    for f in formats:
        day = F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f)))
        short = f.count("y") == 2
        found.append(F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day) if short else day)
    return F.coalesce(*found)


def plain_name(text: Column) -> Column:
    """Lower case, letters and digits only, without a trailing ``mp4``."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), "mp4$", "")


def tail_key(text: Column) -> Column:
    """The nine digits (number and time) at the end of a plain name; null without them."""
    return F.nullif(F.regexp_extract(plain_name(text), r"(\d{9})$", 1), F.lit(""))


def prefix_key(text: Column) -> Column:
    """A plain name without the six digits of the time at its end, if three more digits stand before them; else null."""
    return F.nullif(F.regexp_extract(plain_name(text), r"^(.*?\d{3})\d{6}$", 1), F.lit(""))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def joined_label(parts: Sequence[str], empty: str = "WT") -> Column:
    """The parts that say something, with blanks between; a default if there are none."""
    kept = F.filter(F.array(*(F.trim(p) for p in parts)), lambda x: x.isNotNull() & ~F.lower(x).isin(*NO_VALUE))
    return F.when(F.size(kept) == 0, empty).otherwise(F.array_join(kept, " "))


def transgene_parts(text: Column) -> Column:
    """(gene, guide, is_control, is_empty, role) of a transgene label.

    Guides with ``5MM`` or ``null`` mark controls within an experiment; wells without an animal are empty.
    """
    plain = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(plain)
    empty = low.contains("no tad") | (plain == "")
    control = (low.contains("5mm") | low.contains("null")) & ~empty
    gene = F.when(empty, "empty").otherwise("WT/other")
    for name, shown in reversed(GENES):
        gene = F.when(low.contains(name), shown).otherwise(gene)
    after = F.trim(F.substring_index(plain, ":", -1))
    guide = F.when(low.contains("5mm"), "g15_5MM").when(low.contains("g20"), "g20").when(low.contains("null"), "null").when(after == "", "-").otherwise(after)
    role = F.when(empty, "empty").when(control, "internal control").otherwise("edited")
    return F.struct(gene.alias("gene"), guide.alias("guide"), control.alias("is_control"), empty.alias("is_empty"), role.alias("role"))


def clutch(mother: Column) -> Column:
    """The clutch's letter, or the mother's number."""
    out = mother.cast("string")
    for number, letter in CLUTCHES.items():
        out = F.when(mother == number, letter).otherwise(out)
    return out


def recording_day(text: Column) -> Column:
    """``20YY-MM-DD`` from the first six digits in a row; ``unknown`` without them."""
    digits = F.regexp_extract(text, r"(\d{6})", 1)
    return F.when(digits == "", "unknown").otherwise(F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2)))


def is_gradient(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(GRADIENT)


def clip_name(stem: Column, well: Column) -> Column:
    """The file name of one well's clip; wells in names count from zero."""
    return F.format_string("%s_well_%02d.mp4", stem, well.cast("int"))


def clip_parts(name: Column) -> Column:
    """(stem, well) of a clip's file name."""
    return F.struct(F.regexp_extract(name, r"^(.*)_well_\d+", 1).alias("stem"), F.regexp_extract(name, r"_well_(\d+)", 1).cast("int").alias("well"))


def initials_fit(initials: Column, first: Column, last: Column) -> Column:
    i, a, b = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (initials, first, last))
    sign = F.concat(F.substring(a, 1, 1), F.substring(b, 1, 1))
    return (a == i) | ((sign != "") & (sign == F.substring(i, 1, 2)))
