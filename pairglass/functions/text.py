"""Cleaning of sequences and fields of flat-file records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_length(rows: DataFrame, least: int = 0, most: int = 10_000) -> DataFrame:
    """Sequences longer than ``least`` and shorter than ``most``."""
    return rows.where((F.length("seq") > least) & (F.length("seq") < most))


def replace_nonstandard(seq: Column, bad: str = "XBZJ") -> Column:
    return F.translate(seq, bad, "-" * len(bad))


def clean_sequence(text: Column) -> Column:
    """Letters only, in capitals."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def concatenate(parts: Column, splicer: str = "") -> Column:
    return F.array_join(parts, splicer)


def identifiers(text: Column) -> Column:
    """All numbers of the form ``gi|123|``."""
    return F.regexp_extract_all(text, F.lit(r"gi\|(\d+)\|"), 1)


#: Where the fields of a flat-file record are, each within one line.
FIELDS = {
    "locus": r"(?d)LOCUS .*?(\S+)", "length": r"(?d)LOCUS +\S+\s+(\d+)", "organism": r"(?d)ORGANISM\s+(.+)", "strain": r'(?d)/strain="(.+)"', "locus_tag": r'(?d)/locus_tag="(.+)"',
    "gi": r"(?d)VERSION.+GI:(\d+)", "sub_species": r'(?d)/sub_species="(.+)"', "sub_strain": r'(?d)/sub_strain="(.+)"', "coded_by": r'(?d)/coded_by="(.+)"',
}


def between(text: Column, begin: str, end: str) -> Column:
    """What follows the first ``begin``, over lines, up to ``end`` (or another ``begin``, or the end); null without it."""
    return F.when(text.contains(begin), F.regexp_extract(text, rf"(?s){begin}(.*?)(?:{begin}|{end}|\z)", 1))


def record_fields(text: Column) -> dict[str, Column]:
    """The first match of each field, null without one; the length as a number, the sequence as capital letters.

    A definition goes over lines up to ACCESSION, its words joined by one blank; a title up to JOURNAL, without line
    ends; an organism is the first two words, genus and species; the number is that of the VERSION line.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    out = {k: some(F.regexp_extract(text, p, 1)) for k, p in FIELDS.items()}
    out["length"] = out["length"].cast("int")
    words = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^ | $", "")
    out["organism"] = F.concat_ws(" ", F.slice(F.split(words(out["organism"]), " "), 1, 2))
    out["organism"] = F.when(F.regexp_extract(text, FIELDS["organism"], 1) != "", out["organism"])
    out["definition"] = words(between(text, "DEFINITION", "ACCESSION"))
    title = F.replace(F.translate(F.regexp_replace(between(text, "TITLE", "JOURNAL"), "\n", ""), "\t", " "), F.lit("  "), F.lit(" "))
    out["title"] = F.regexp_replace(title, r"^\s+|\s+$", "")
    origin = r"ORIGIN([\sa-z0-9]+)"
    out["sequence"] = F.when(text.rlike(origin), clean_sequence(F.regexp_extract(text, origin, 1)))
    return out
