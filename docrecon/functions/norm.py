"""Normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions.fuzzy import once
from docrecon.settings import LEGAL_SUFFIXES, NO_REFERENCE

LINE_END = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null; letters match in either case. No pattern here has an empty group where it
    matches, so that one search tells both."""
    return once(F.regexp_extract(F.coalesce(c, F.lit("")), "(?iU)" + pattern, group), blank_to_null)


def company_name(c: Column) -> Column:
    """A company's name without case, remarks in brackets, punctuation and words for its legal form."""
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.replace(F.regexp_replace(s, r"\(.*?\)", " "), F.lit("&"), F.lit(" and "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), r"\s+", " "))
    # Others hold punctuation, which is gone by now. The longest comes first where several begin alike.
    forms = [x for x in sorted(LEGAL_SUFFIXES, key=len, reverse=True) if all(ch.isalnum() or ch == " " for ch in x)]
    s = F.regexp_replace(s, rf"\b(?:{'|'.join(forms)})\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def invoice_key(c: Column) -> Column:
    """Letters and digits of an invoice number, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def gstin_key(c: Column) -> Column:
    """Letters and digits of a tax id, in upper case."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def supplier_key(c: Column) -> Column:
    """A supplier's name without case and with single spaces."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " "))


def search_key(c: Column) -> Column:
    """Lower-case letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def year_key(c: Column) -> Column:
    """A financial year's folder name without spaces, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def file_token(c: Column) -> Column:
    """A text as part of a file name."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[/\\]|(?U:\s+)", "-"), "[^A-Za-z0-9._-]", "")
    return F.regexp_replace(s, r"^[-._]+|[-._]+$", "")


def reference_name(gstin: Column, number: Column) -> Column:
    """The file name that a return row's tax id and invoice number give."""
    part = lambda c, other: F.coalesce(blank_to_null(file_token(c)), F.lit(other))
    return F.concat(part(gstin, "NOGSTIN"), F.lit("__"), part(number, "NOINV"), F.lit(".pdf"))


def is_reference(c: Column) -> Column:
    """Whether a reference cell holds a file name and not one of our own remarks."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~s.isin(*NO_REFERENCE) & ~s.startswith("ambiguous")


def money(c: Column) -> Column:
    """An amount with commas, to two places; null if it is none."""
    return F.round(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double"), 2)


def day_first(c: Column) -> Column:
    """A date with the day first as yyyy-MM-dd; the month may be a name, short or long. Null if it is no date."""

    def read(parts: Column) -> Column:
        day, month, year = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
        name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3))).cast("int")
        number = F.when(month.rlike("^[0-9]+$"), month.try_cast("int")).otherwise(F.when(name > 0, name))
        full = F.when(F.length(year) <= 2, F.lit(2000) + year.try_cast("int") - F.when(year.try_cast("int") > 75, 100).otherwise(0)).otherwise(year.try_cast("int"))
        return F.struct(day.try_cast("int").alias("d"), number.alias("m"), full.alias("y"))

    def told(date: Column) -> Column:
        d, m, y = (date[x] for x in "dmy")
        swap = (m > 12) & (d <= 12)
        text = F.format_string("%04d-%02d-%02d", y, F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d))
        return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))

    return once(once(F.split(F.trim(c), "[-/]"), read), told)
