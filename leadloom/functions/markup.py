"""The cards of a page, read in Python.

The same reading as the column functions of ``html``, ``text`` and ``urls``, for the
step that reads millions of cards: Spark interprets array functions entry by entry,
which takes several times as long.  Places of tags count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote_plus

from leadloom.functions.html import ENTITIES, SILENT_TAGS, VOID_TAGS
from leadloom.schemas import LEAD_BADGES, META_LABELS

_SPACE_CLASS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES = re.compile(f"[{_SPACE_CLASS}]+")
_ODD_SPACE = re.compile(f"  |[{_SPACE_CLASS.replace(' ', '')}]")
_REFERENCE = re.compile("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});")
_INNER = re.compile(r"\A<[^>]*>(.*)</[^<]*\Z", re.S)
_TAG = re.compile("<[^<>]*>")
_TAG_NAME = re.compile("<(/?[A-Za-z][A-Za-z0-9-]*/?)?[^<>]*>")
_CLOSED_TAG = re.compile("<([A-Za-z][A-Za-z0-9-]*)([^<>]*)/>")
_ALT_IMAGE = re.compile(r"<img\s(?:[^>]*?\s)?alt\b[^>]*>", re.I | re.S | re.A)
_ALT, _HREF = (
    re.compile(rf"""\A<[^>\s]+(?:\s[^>]*?)?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.S | re.A) for name in ("alt", "href")
)
_COMMENT = re.compile("<!--.*?-->", re.S)
_SILENT_TEXT = re.compile(r"(<(script|style)\b[^>]*>).*?(</\2\s*>)", re.I | re.S | re.A)
_ANCHOR = re.compile(r"<a(?:\s[^>]*)?>.*?</a\s*>", re.I | re.S | re.A)
_UNDISCLOSED = re.compile("undisclosed salary", re.I | re.A)
_CURRENCY = re.compile("(?<![A-Za-z0-9_])(?:PLN|USD|EUR|CHF)(?![A-Za-z0-9_])", re.I | re.A)
_AMOUNT = re.compile(f"(?<![A-Za-z0-9_])[0-9][0-9{_SPACE_CLASS}]*[{_SPACE_CLASS}]PLN(?![A-Za-z0-9_])")
_TIME_LEFT = re.compile(rf"\A(?:[0-9]+[{_SPACE_CLASS}]*d left|expires tomorrow)\Z", re.I | re.A)
_NEW_MARK = re.compile(r" +NOWA\Z")
_MORE_PLACES = re.compile(r" *\+[0-9].*\Z", re.S)
_LABELS = frozenset(LEAD_BADGES + META_LABELS)
_VOID, _SILENT = frozenset(VOID_TAGS), frozenset(SILENT_TAGS)

#: Title, company, salary text and location.
Fields = tuple["str | None", "str | None", "str | None", "str | None"]


def _character(reference: str) -> str:
    code = int(reference[3:-1], 16) if reference[2] in "xX" else int(reference[2:-1])
    if code == 0xFEFF:  # a byte order mark decodes to nothing
        return ""
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"


def decoded(text: str) -> str:
    """``html.decode_entities``"""
    if "&" not in text:
        return text
    if "&#" in text:
        for reference in dict.fromkeys(_REFERENCE.findall(text)):
            text = text.replace(reference, _character(reference))
    for entity, char in ENTITIES.items():
        text = text.replace(entity, char)
    return text


def clean(text: str) -> str | None:
    """``text.clean_text``"""
    return (_SPACES.sub(" ", text) if _ODD_SPACE.search(text) else text).strip(" ") or None


def attribute(tag: str, pattern: re.Pattern) -> str | None:
    """``html.attribute``"""
    found = pattern.match(tag)
    if not found:
        return None
    value = found[1]
    return decoded(value[1:-1] if value[0] in "\"'" else value) or None


def anchors(html: str) -> Iterator[tuple[int, str, str | None]]:
    """Place, markup and ``href`` of the anchors of a page."""
    if "<!--" in html:
        html = _COMMENT.sub("", html)
    bare = _SILENT_TEXT.sub(r"\1\3", html)
    return ((pos, m[0], attribute(m[0], _HREF)) for pos, m in enumerate(_ANCHOR.finditer(bare)))


class Card:
    """The tags of a card's markup and the texts between them; the tree is made when asked for."""

    def __init__(self, markup: str):
        self.markup = markup
        inside = _INNER.match(markup)
        html = inside[1] if inside else ""
        if "/>" in html:
            html = _CLOSED_TAG.sub(r"<\1/\2>", html)
        self.names = _TAG_NAME.findall(html.lower())
        self.texts = _TAG.split(html)
        self._tree: tuple[list[int], list[int], list[int]] | None = None

    def tree(self) -> tuple[list[int], list[int], list[int]]:
        """Depth, place of the end, and parent of each tag, from 1; see ``_tree``."""
        if self._tree is None:
            self._tree = _tree(self.names)
        return self._tree

    def find(self, name: str, after: int = 0) -> int | None:
        """Place of the first opening tag ``name`` behind ``after``."""
        try:
            return self.names.index(name, after) + 1
        except ValueError:
            return None

    def close(self, place: int) -> int:
        """Place of the end tag that closes an element: its own or one around it; one more than there are tags if there is none."""
        return self.tree()[1][place]

    def text(self, place: int | None) -> str | None:
        """Cleaned whole text of an element, children included."""
        return None if place is None else clean(decoded("".join(self.texts[place : self.close(place)])))

    def parent(self, place: int | None) -> int | None:
        return None if place is None else self.tree()[2][place] or None

    def later_sibling(self, place: int | None, names: tuple[str, ...] | None = None) -> int | None:
        """The first element behind ``place`` on its own level, of the given names if any."""
        if place is None:
            return None
        depths, closes, parents = self.tree()
        end, depth = closes[place], depths[place]
        # an end tag of another level ends the element around it as well
        if end > len(self.names) or (end != place and depths[end] != -depth):
            return None
        for at in range(end + 1, closes[parents[place]]):
            if depths[at] == depth and (names is None or self.names[at - 1].rstrip("/") in names):
                return at
        return None

    def leaves(self) -> list[str]:
        """Texts of elements without child elements; empty ones and direct repeats left out."""
        out: list[str] = []
        for i, (name, after) in enumerate(zip(self.names, self.names[1:], strict=False), start=1):
            if after == f"/{name}" and name not in _SILENT:
                text = clean(decoded(self.texts[i]))
                if text is not None and (not out or out[-1] != text):
                    out.append(text)
        return out

    def image_alt(self) -> str | None:
        image = _ALT_IMAGE.search(self.markup)
        value = attribute(image[0], _ALT) if image else None
        return value and clean(value)


def _tree(names: list[str]) -> tuple[list[int], list[int], list[int]]:
    """The levels of ``html.tree`` as numbers by place, place 0 being the whole card.

    Depths are negative where the element of that depth ends, and 0 for an end tag
    without an open element and for anything else.
    """
    n = len(names)
    depths, closes, parents = [0] * (n + 1), [n + 1] * (n + 1), [0] * (n + 1)
    open_, places = [], [0]
    for place, name in enumerate(names, start=1):
        if not name:
            continue
        if name[0] == "/":
            bare = name[1:]
            if bare in open_:
                while True:
                    closes[places.pop()] = place
                    if open_.pop() == bare:
                        break
                depths[place] = -len(places)
        else:
            depths[place], parents[place] = len(places), places[-1]
            if name[-1] == "/" or name in _VOID:
                closes[place] = place
            else:
                open_.append(name)
                places.append(place)
    return depths, closes, parents


def flat_fields(card: Card) -> Fields:
    """Title, company and place are the first three texts that are neither label nor salary.

    The salary is the first disclosed salary text behind the title and before the place.
    """
    texts = card.leaves()
    paid = [bool(_CURRENCY.search(t) or _UNDISCLOSED.search(t)) for t in texts]
    plain = [i for i, t in enumerate(texts) if not paid[i] and t not in _LABELS and not _TIME_LEFT.match(t)][:3]
    title, company, place = plain + [None] * (3 - len(plain))
    salary = None
    if title is not None:
        behind = range(title + 1, len(texts) if place is None else place)
        salary = next((texts[i] for i in behind if paid[i] and not _UNDISCLOSED.search(texts[i])), None)
    return tuple(None if i is None else texts[i] for i in (title, company)) + (salary, None if place is None else texts[place])


def headed_fields(card: Card) -> Fields:
    """Fields by tag: title ``h3``, company ``h4``, place the box behind it; the salary is the first box that reads as an amount."""
    title, h4, salary = card.text(card.find("h3")), card.find("h4"), None
    place = card.text(card.later_sibling(h4, ("div", "span")))
    if "PLN" in card.markup:  # cards without the currency anywhere have no such box
        boxes = (card.text(i) for i, name in enumerate(card.names, start=1) if name in ("div", "span"))
        salary = next((t.replace("\u2013", "-") for t in boxes if t and _AMOUNT.search(t)), None)
    return title and _NEW_MARK.sub("", title), card.text(h4), salary, place and _MORE_PLACES.sub("", place)


def block_fields(card: Card) -> Fields:
    """Fields by block: title ``h3``, company the logo's name or the first box of the title's block, place the first box of the block behind it."""

    def first_box(inside: int | None) -> int | None:
        box = None if inside is None else card.find("div", inside)
        return box if box is not None and box < card.close(inside) else None

    h3 = card.find("h3")
    block = card.parent(h3)
    company = card.image_alt()
    if company is None and h3 is not None:
        company = card.text(card.find("div") if block is None else first_box(block))
    return card.text(h3), company, None, card.text(first_box(card.later_sibling(block)))


_EDGES = "".join(map(chr, range(0x21)))
_BREAKS = str.maketrans("", "", "\t\n\r")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\Z", re.S)
_ORIGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")
_FOLDER = re.compile(r"[^/?#]*//[^/?#]*((?:/[^/?#]*)*/)")
_BEHIND_PATH = re.compile(r"[?#].*\Z", re.S)
_CANONICAL = re.compile(r"[a-z][a-z0-9+.-]*://[^/?#A-Z]*(?:/(?!\.)[!$-.0-;=@-_a-z|~]*)+(?:[?#].*)?\Z")
_UNSAFE = re.compile("[^\x21-\x7e]|[\"<>`{}]")
_DOTS = re.compile(r"/\.\.?(?:/|\Z)")
_LAST_DOTS = re.compile(r"/(\.\.?)\Z")


def _encoded(path: str) -> str:
    """``urls.encode_unsafe``"""
    return _UNSAFE.sub(lambda m: "%20" if m[0] == " " else quote_plus(m[0]), path)


def _without_dots(path: str) -> str:
    """``urls.drop_dot_segments``"""
    if not _DOTS.search(path):
        return path
    out: list[str] = []
    for part in _LAST_DOTS.sub(r"/\1/", path).split("/"):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out)


def resolved(href: str, base: str | None) -> str | None:
    """``urls.resolve``"""
    h = href.strip(_EDGES)
    if not h.isprintable():
        h = h.translate(_BREAKS)
    if not _SCHEME.match(h):
        if base is None:
            return None
        origin = _ORIGIN.match(base)
        origin = origin[0] if origin else ""
        if h.startswith("//"):
            parts = _PARTS.match(base)
            h = (parts[1] if parts else "") + h
        elif h.startswith("/"):
            h = origin + h
        elif h.startswith("?"):
            h = _BEHIND_PATH.sub("", base) + h
        elif h.startswith("#") or not h:
            h = base.split("#", 1)[0] + h
        else:
            folder = _FOLDER.match(base)
            h = origin + (folder[1] if folder else "/") + h
    parts = None if _CANONICAL.match(h) else _PARTS.match(h)
    if not parts:
        return h
    path = _encoded(_without_dots(parts[3])) or "/"
    return f"{parts[1].lower()}//{parts[2].lower()}{path}{parts[4] or ''}{parts[5] or ''}"


def pathname(url: str | None) -> str:
    """``urls.pathname``"""
    parts = _PARTS.match(url) if url is not None else None
    return _encoded((parts and parts[3]) or "/")
