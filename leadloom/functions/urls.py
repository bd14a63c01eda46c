"""URL resolution, identity and search-URL building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.let import filled, let
from leadloom.functions.text import SPACE, slugify

_PARTS = r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
# An address that is already in canonical form.
_CANONICAL = r"\A[a-z][a-z0-9+.-]*://[^/?#A-Z]*(?:/(?!\.)[\x21-\x7E&&[^\"<>`{}/?#]]*)+(?:[?#].*)?\z"
# Characters a URL path may not hold as they are.
_UNSAFE = "[^\\x21-\\x7E]|[\"<>`{}]"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def encode_unsafe(path: Column) -> Column:
    """Percent-encode characters not allowed in a path, leaving the rest alone."""

    def encoded(p: Column) -> Column:
        return F.aggregate(
            F.array_distinct(F.regexp_extract_all(p, F.lit(_UNSAFE), F.lit(0))),
            p,
            lambda acc, ch: F.replace(
                acc, ch, F.when(ch == " ", F.lit("%20")).otherwise(F.url_encode(ch))
            ),
        )

    return let(path, lambda p: F.when(p.rlike(_UNSAFE), encoded(p)).otherwise(p))


def drop_dot_segments(path: Column) -> Column:
    """Resolve "." and ".." segments; a trailing one stands for its folder."""

    def kept(p: Column) -> Column:
        return F.aggregate(
            F.split(F.regexp_replace(p, r"/(\.\.?)\z", "/$1/"), "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..",
                F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
            )
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
            lambda acc: F.array_join(acc, "/"),
        )

    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(?:/|\z)"), kept(p)).otherwise(p))


def normalize(url: Column) -> Column:
    """Canonical form of an absolute URL: lower-case host, non-empty path, safe characters."""

    def rebuilt(u: Column) -> Column:
        path = encode_unsafe(drop_dot_segments(F.regexp_extract(u, _PARTS, 3)))
        return F.concat(
            F.lower(F.regexp_extract(u, _PARTS, 1)),
            F.lit("//"),
            F.lower(F.regexp_extract(u, _PARTS, 2)),
            F.coalesce(filled(path), F.lit("/")),
            F.regexp_extract(u, _PARTS, 4),
            F.regexp_extract(u, _PARTS, 5),
        )

    return let(
        url,
        lambda u: F.when(u.rlike(_CANONICAL) | ~u.rlike(_PARTS), u).otherwise(rebuilt(u)),
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of ``href`` as seen from ``base``."""

    def joined(h: Column) -> Column:
        folder = F.regexp_extract(base, r"(?s)\A[^/?#]*//[^/?#]*((?:/[^/?#]*)*/)", 1)
        return (
            F.when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, _PARTS, 1), h))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .when(h.startswith("?"), F.concat(F.regexp_replace(base, r"(?s)[?#].*\z", ""), h))
            .when(
                h.startswith("#") | (h == ""),
                F.concat(F.regexp_replace(base, r"(?s)#.*\z", ""), h),
            )
            .otherwise(
                F.concat(origin(base), F.coalesce(filled(folder), F.lit("/")), h)
            )
        )

    bare = F.regexp_replace(href, r"\A[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")
    return normalize(let(bare, joined))


def pathname(url: Column) -> Column:
    """Path of an absolute URL; "/" where it has none.

    Read by pattern and not by ``parse_url``, which gives NULL for addresses
    browsers accept.
    """
    path = F.regexp_extract(url, _PARTS, 3)
    return encode_unsafe(F.coalesce(filled(path), F.lit("/")))


def external_id(source: Column, url: Column) -> Column:
    """Row identity: source and path; query and fragment do not count."""
    return F.concat(source, F.lit(":"), pathname(url))


def encode_component(text: Column) -> Column:
    """Percent-encode a path component, leaving ``- _ . ! ~ * ' ( )`` alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _number_text(n: Column) -> Column:
    whole = F.floor(n)
    return F.when(n == whole, whole.cast("string")).otherwise(n.cast("string"))


def query_search_url(
    base_url: Column,
    keyword: Column,
    category: Column,
    location: Column,
    working_mode: Column,
    experience_level: Column,
    min_salary: Column,
    salary_currency: Column,
    with_salary: Column,
) -> Column:
    """Search URL with filters as query parameters; empty, zero and false ones are left out."""

    def text(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}="), F.url_encode(value)))

    params = F.concat_ws(
        "&",
        text("keyword", keyword),
        text("category", category),
        text("location", location),
        text("working-mode", working_mode),
        text("experience-level", experience_level),
        F.when(min_salary != 0, F.concat(F.lit("salary-from="), _number_text(min_salary))),
        text("salary-currency", salary_currency),
        F.when(with_salary, F.lit("with-salary=true")),
    )
    return F.concat(
        origin(base_url),
        F.lit("/job-offers/all-locations"),
        F.when(params == "", F.lit("")).otherwise(F.concat(F.lit("?"), params)),
    )


def path_search_url(base_url: Column, location: Column, keyword: Column, page_no: Column) -> Column:
    """Search URL with filters as path segments and ``?page=N`` from page 2 on.

    A "#" in a filter starts the fragment, which stays behind the page number.
    """
    path = F.concat(
        F.lit("/pl"),
        F.when(location != "", F.concat(F.lit("/"), slugify(location))).otherwise(""),
        F.when(keyword != "", F.concat(F.lit("/"), slugify(keyword))).otherwise(""),
    )
    return F.concat(
        origin(base_url),
        encode_unsafe(F.regexp_extract(path, "(?s)\\A([^#]*)", 1)),
        F.when(page_no > 1, F.concat(F.lit("?page="), page_no.cast("string"))).otherwise(""),
        encode_unsafe(F.regexp_extract(path, "(?s)(#.*)\\z", 1)),
    )


def comma_search_url(base_url: Column, keyword: Column, page_no: Column) -> Column:
    """Search URL with the keyword in a comma path; a missing keyword is an error."""
    needed = F.when(keyword != "", keyword).otherwise(
        F.raise_error(F.lit("filters.keyword is required")).cast("string")
    )
    trimmed = F.regexp_replace(needed, rf"\A{SPACE}+|{SPACE}+\z", "")
    return F.concat(
        origin(base_url),
        F.lit("/companies/jobs/s/skills,"),
        encode_component(trimmed),
        F.when(page_no > 1, F.concat(F.lit("/page,"), page_no.cast("string"))).otherwise(""),
    )
