"""Reading listing cards out of page markup with array functions.

A card is cut at its tags into two aligned arrays: the tag names and the texts
behind them.  One fold over the names gives each tag its depth; the whole text of
an element, its siblings and its parent are then look-ups in flat arrays, so a
card is read in the task that scanned its page, without a shuffle and without
Python.  An element without an end tag ends with the one around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.let import bind, filled, let
from leadloom.functions.text import clean_text

# Named entities decoded in texts and attributes ("&amp;" is last).
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": " ",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
    "&oacute;": "ó",
    "&Oacute;": "Ó",
    "&copy;": "©",
    "&middot;": "·",
    "&euro;": "€",
    "&amp;": "&",
}
# Elements without content, and elements whose text is not shown.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SILENT_TAGS = ["script", "style", "svg", "path"]


def decode_entities(text: Column) -> Column:
    """Named and numeric character references."""

    def numeric(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0))
        return F.aggregate(
            F.array_distinct(refs), t, lambda acc, ref: F.replace(acc, ref, _code_point(ref))
        )

    def named(t: Column) -> Column:
        for entity, char in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    def decoded(t: Column) -> Column:
        return named(F.when(F.contains(t, F.lit("&#")), numeric(t)).otherwise(t))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def _code_point(ref: Column) -> Column:
    digits = F.regexp_replace(ref, "[&#xX;]", "")
    code = F.when(ref.rlike("&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
    return let(
        F.upper(F.lpad(code, 8, "0")),
        lambda c: F.when(
            c.between("00000001", "0010FFFF") & ~c.between("0000D800", "0000DFFF"),
            F.decode(F.unhex(c), "UTF-32"),
        ).otherwise(F.lit("�")),
    )


def strip_silent(html: Column) -> Column:
    """Drop comments and the contents of scripts and styles, keeping their tags."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def anchors(html: Column) -> Column:
    """All anchor elements of a page, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a(?:\s[^>]*)?>.*?</a\s*>"), F.lit(0))


def inner(element: Column) -> Column:
    return F.regexp_extract(element, r"(?s)\A<[^>]*>(.*)</[^<]*\z", 1)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the first tag in ``tag``; NULL when missing or empty."""
    raw = F.regexp_extract(
        tag, rf"""(?is)\A<[^>\s]+(?:\s[^>]*?)?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1
    )
    return filled(decode_entities(F.regexp_replace(raw, r"""\A["']|["']\z""", "")))


_TAG = "<[^<>]*>"
_TAG_NAME = "<(/?[A-Za-z][A-Za-z0-9-]*/?)?[^<>]*>"
_CLOSED_TAG = "<([A-Za-z][A-Za-z0-9-]*)([^<>]*)/>"


def tokens(html: Column) -> Column:
    """``struct<names, texts>`` of a fragment.

    ``names`` holds one entry per tag: "div", "/div" for an end tag, "div/" for
    a tag closed in itself, "" for anything else.  ``texts`` holds the text
    before the first tag and then the text behind each tag, as it stands in the
    markup: entities are decoded where a text is read.
    """

    def cut(m: Column) -> Column:
        names = F.regexp_extract_all(F.lower(m), F.lit(_TAG_NAME), F.lit(1))
        return F.struct(names.alias("names"), F.split(m, _TAG).alias("texts"))

    def marked(h: Column) -> Column:
        closed = F.regexp_replace(h, _CLOSED_TAG, "<$1/$2>")
        return F.when(F.contains(h, F.lit("/>")), closed).otherwise(h)

    return let(let(html, marked), cut)


def tree(toks: Column) -> Column:
    """``struct<names, texts, levels>``: the tags as a tree in flat arrays.

    ``levels`` tells of each tag its depth from 1: "2" where an element opens,
    "/2" where the open element of that depth ends (and all deeper ones that
    lack an end tag), "2v" for an element without content, "" for an end tag
    without an open element and for anything else.  It is the only pass over the
    tags; closing places, parents, siblings and text spans are look-ups in it.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), none.alias("levels"))

    def moved(open_: Column, levels: Column, level: Column) -> Column:
        return F.struct(open_.alias("open"), F.concat(levels, F.array(level)).alias("levels"))

    def step(acc: Column, name: Column) -> Column:
        open_, levels = acc["open"], acc["levels"]
        depth = F.size(open_)
        bare = F.substr(name, F.lit(2))
        behind = F.array_position(F.reverse(open_), bare).cast("int")
        ended = moved(F.slice(open_, F.lit(1), depth - 1), levels, F.concat(F.lit("/"), depth.cast("string")))

        def lacking(n: Column) -> Column:
            # the element that ends lies n - 1 below the top: those above it end with it
            return F.when(n == 0, moved(open_, levels, F.lit(""))).otherwise(
                moved(F.slice(open_, F.lit(1), depth - n), levels, F.concat(F.lit("/"), (depth - n + 1).cast("string")))
            )

        closing = F.when(F.try_element_at(open_, F.lit(-1)) == bare, ended).otherwise(let(behind, lacking))
        below = (depth + 1).cast("string")
        empty = name.endswith("/") | name.isin(VOID_TAGS)
        return (
            F.when(name.startswith("/"), closing)
            .when(name == "", moved(open_, levels, F.lit("")))
            .when(empty, moved(open_, levels, F.concat(below, F.lit("v"))))
            .otherwise(moved(F.concat(open_, F.array(name)), levels, below))
        )

    levels = F.aggregate(toks["names"], start, step, lambda acc: acc["levels"])
    return F.struct(toks["names"].alias("names"), toks["texts"].alias("texts"), levels.alias("levels"))


def leaf_texts(toks: Column) -> Column:
    """Texts of elements without child elements, in document order.

    ``array<struct<tag, text>>``; empty texts and direct repeats are left out.
    """
    names, texts = toks["names"], toks["texts"]

    def leaf(name: Column, i: Column) -> Column:
        is_leaf = (F.get(names, i + 1) == F.concat(F.lit("/"), name)) & ~name.isin(SILENT_TAGS)
        text = clean_text(decode_entities(F.get(texts, i + 1)))
        return F.when(is_leaf, F.struct(name.alias("tag"), text.alias("text")))

    found = F.filter(F.transform(names, leaf), lambda x: x["text"].isNotNull())
    return drop_repeats(found, lambda x: x["text"])


def with_leaf_texts(df: DataFrame, html: str, out: str = "leaves") -> DataFrame:
    return bind(df, tokens(F.col(html)), lambda t: F.struct(leaf_texts(t).alias(out)))


def drop_repeats(items: Column, value: Callable[[Column], Column] = lambda x: x) -> Column:
    """Drop array entries equal to the entry right before them."""

    def kept(xs: Column) -> Column:
        shifted = F.slice(xs, F.lit(2), F.size(xs))
        pairs = F.zip_with(
            shifted, xs, lambda x, before: F.struct(x.alias("x"), before.alias("before"))
        )
        # The last pair has no entry of its own: it only pairs the last one with nothing.
        changed = F.filter(
            F.slice(pairs, F.lit(1), F.size(shifted)),
            lambda p: ~value(p["x"]).eqNullSafe(value(p["before"])),
        )
        return F.concat(F.slice(xs, 1, 1), F.transform(changed, lambda p: p["x"]))

    return let(items, kept)


def find_open(toks: Column, name: str, after: Column | None = None) -> Column:
    """1-based place of the first opening tag ``name`` behind place ``after``; NULL if none."""
    if after is None:
        return _found(F.array_position(toks["names"], name))
    tail = F.slice(toks["names"], after + 1, F.size(toks["names"]))
    return _found(F.array_position(tail, name)) + after


def _found(position: Column) -> Column:
    return F.get(F.filter(F.array(position.cast("int")), lambda p: p > 0), F.lit(0))


def _depth(t: Column, place: Column) -> Column:
    """Depth of the element opened at ``place``."""
    return F.rtrim(F.get(t["levels"], place - 1), F.lit("v")).cast("int")


def _behind(t: Column, place: Column) -> Column:
    return F.slice(t["levels"], place + 1, F.size(t["levels"]))


def _until_end(tail: Column, depth: Column) -> Column:
    """How many tags on the element of that depth ends; one more than ``tail`` has if it never does."""
    depths = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(depths, lambda k: F.array_position(tail, F.concat(F.lit("/"), k.cast("string"))).cast("int"))
    return F.coalesce(F.array_min(F.filter(ends, lambda p: p > 0)), F.size(tail) + 1)


def close_of(t: Column, place: Column) -> Column:
    """Place of the end tag that closes the element opened at ``place``: its own or one around it."""

    def close(p: Column) -> Column:
        level = F.get(t["levels"], p - 1)
        direct = F.get(t["levels"], p) == F.concat(F.lit("/"), level)
        return (
            F.when(p.isNull(), F.lit(None).cast("int"))
            .when(level.endswith("v"), p)
            .when(direct, p + 1)
            .otherwise(p + _until_end(_behind(t, p), _depth(t, p)))
        )

    return let(place, close)


def element_text(t: Column, place: Column) -> Column:
    """Cleaned whole text of the element opened at ``place``, children included."""

    def text(p: Column) -> Column:
        raw = F.array_join(F.slice(t["texts"], p + 1, close_of(t, p) - p), "")
        return F.when(p.isNotNull(), clean_text(decode_entities(raw)))

    return let(place, text)


def parent_of(t: Column, place: Column) -> Column:
    """Place of the element around ``place``; NULL at the top."""

    def parent(p: Column) -> Column:
        around = (_depth(t, p) - 1).cast("string")
        before = F.reverse(F.slice(t["levels"], F.lit(1), F.greatest(p - 1, F.lit(0))))
        return F.when(p.isNotNull() & (_depth(t, p) > 1), p - F.array_position(before, around).cast("int"))

    return let(place, parent)


def later_sibling(t: Column, place: Column, names: list[str] | None = None) -> Column:
    """Place of the first element behind ``place`` on its own level, of the given tag names if any."""

    def search(p: Column) -> Column:
        depth = _depth(t, p)
        level = depth.cast("string")

        def among(end: Column) -> Column:
            tail = _behind(t, end)
            # siblings lie before the element around them ends
            scope = F.slice(tail, F.lit(1), _until_end(tail, depth - 1) - 1)
            same = [level, F.concat(level, F.lit("v"))]
            if names is None:
                places = F.array(*(F.array_position(scope, x).cast("int") for x in same))
            else:
                bare = lambda i: F.rtrim(F.get(t["names"], end + i), F.lit("/"))
                places = F.transform(scope, lambda x, i: F.when(x.isin(same) & bare(i).isin(names), i + 1))
            # an end tag of another level ends the element around it as well
            own = F.get(t["levels"], end - 1).isin(F.concat(F.lit("/"), level), F.concat(level, F.lit("v")))
            return F.when(own, end + F.array_min(F.filter(places, lambda x: x > 0)))

        return F.when(p.isNotNull(), let(close_of(t, p), among))

    return let(place, search)
