"""Text normalisation and text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.let import filled
from leadloom.schemas import LEAD_BADGES, META_LABELS

# White space as the pages' own scripting language sees it.  Java's \s is ASCII
# only and (?U)\s leaves out U+FEFF.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_CLASS}]"
# Word boundaries over ASCII word characters; Java's own \b depends on the JDK.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def clean_text(text: Column) -> Column:
    """Collapse white space, trim, and turn an empty result into NULL."""
    return filled(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))


def slugify(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")
    return F.regexp_replace(F.lower(trimmed), f"{SPACE}+", "-")


def plain_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("–"), F.lit("-"))


def strip_more_places(location: Column) -> Column:
    """Drop the "+N ..." tail of a cleaned place name."""
    return F.regexp_replace(location, r"(?s) *\+[0-9].*\z", "")


def strip_new_mark(title: Column) -> Column:
    """Drop the trailing "NOWA" mark of a cleaned title."""
    return F.regexp_replace(title, r" +NOWA\z", "")


def strip_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"\Ahttps?://", "")


def is_undisclosed(text: Column) -> Column:
    return text.rlike("(?i)undisclosed salary")


def has_currency(text: Column) -> Column:
    """Salary text by currency code, or the undisclosed-salary label."""
    return text.rlike(f"(?i){WORD_START}(?:PLN|USD|EUR|CHF){WORD_END}") | is_undisclosed(text)


def has_amount(text: Column) -> Column:
    """Salary text by an amount in PLN.

    A range "a - b PLN" always holds a single amount "b PLN", so the one
    pattern covers both forms.
    """
    return text.rlike(f"{WORD_START}[0-9][0-9{SPACE_CLASS}]*{SPACE}PLN{WORD_END}")


def is_time_left(text: Column) -> Column:
    return text.rlike(rf"(?i)\A(?:[0-9]+{SPACE}*d left|expires tomorrow)\z")


def is_label(text: Column) -> Column:
    """Card texts that name no title, company or place."""
    return text.isin(LEAD_BADGES + META_LABELS) | is_time_left(text)


def in_domain(value: Column, domain: list[str]) -> Column:
    return F.when(value.isin(domain), value)


def id_prefix(external_id: Column) -> Column:
    return F.split_part(external_id, F.lit(":"), F.lit(1))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def scorer_input(profile: Column, offer: Column) -> Column:
    """The text a scorer reads: the profile document, then the offer document."""
    return F.concat_ws(
        "\n", F.lit("CV MARKDOWN:"), profile, F.lit(""), F.lit("JOB OFFER MARKDOWN:"), offer
    )
