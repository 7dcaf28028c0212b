"""Text functions: names, similarity, tokens, visible text of pages, places of quotes."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Suffixes of names, and elements whose text isn't shown.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
HIDDEN_ELEMENTS = ("script", "style", "noscript", "template", "svg", "canvas")
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


@pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold() for t in texts], dtype=object)


def normal_name(name: Column) -> Column:
    """Letters without marks, lower case, no apostrophes or dots, other signs as single spaces."""
    plain = F.regexp_replace(_ascii(name), "['.]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def without_suffix(name: Column) -> Column:
    """A normal name without one suffix at its end."""
    return F.regexp_replace(name, f" ({'|'.join(SUFFIXES)})$", "")


def has_suffix(name: Column) -> Column:
    return name.rlike(f" ({'|'.join(SUFFIXES)})$")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & whole
    return len(a) - row.bit_count()


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by the sum of lengths; 1 for two empty texts."""
    return pd.Series([None if x is None or y is None else 2 * _common(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)])


def token_set(text: Column, stop: list[str] = []) -> Column:  # noqa: B006
    """Distinct words of letters and digits in lower case, without the given ones."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def jaccard(a: Column, b: Column) -> Column:
    """Common by all tokens; 0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


@pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Compatibility form with white space collapsed."""
    return pd.Series([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts], dtype=object)


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>=][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ZERO = re.compile(r"[+-]?0*\.?0*(px|em|rem|%|pt)?$")
_FAR = re.compile(r"-\d{3,}(\.\d*)?(px|em|rem)$")

#: Elements whose text is no markup, and which open elements a start tag ends first: those of its own kind and its like.
RAW_ELEMENTS = ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")
BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
ENDS = (
    {b: ("p",) for b in BLOCKS}
    | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("optgroup", "option"), "body": ("head",)}
    | {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
)
#: Elements that keep such an end inside: a list in a list item has items of its own.
KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "p": ("button", "li", "dd", "td", "th", "object", "table"), "option": ("select",), "optgroup": ("select",)}
KEEPS |= {t: ("table",) for t in ("tr", "td", "th", "tbody", "tfoot")}


def _style_hides(style: str) -> bool:
    """Whether a style's declarations take an element out of sight."""
    given = {}
    for declaration in style.lower().split(";"):
        name, _, value = declaration.partition(":")
        given["".join(name.split())] = "".join(value.split()).removesuffix("!important")
    is_zero = lambda *names: any(given.get(n) and _ZERO.match(given[n]) for n in names)
    return (
        given.get("display") == "none" or given.get("visibility") in ("hidden", "collapse") or given.get("content-visibility") == "hidden"
        or is_zero("opacity", "font-size") or given.get("clip", "").startswith("rect(") or given.get("clip-path", "").startswith(("inset(50%", "inset(100%"))
        or any(_FAR.match(given.get(n, "")) for n in ("left", "right", "top", "bottom", "text-indent"))
        or (given.get("overflow") == "hidden" and is_zero("width", "max-width", "height", "max-height"))
    )


def _local(name: str) -> str:
    """An element's name without its namespace."""
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """A tag's attributes from a place behind its name, the place behind the tag (-1: it has no end), and whether it ends itself."""
    given: dict[str, str] = {}
    while True:
        before = at
        at = _SPACE.match(page, at).end()
        if at >= len(page):
            return given, -1, False
        if page[at] == ">":
            return given, at + 1, page[at - 1] == "/" and at > before
        if page[at] == "=":  # a stray sign is part of a name
            key, at = "=", at + 1
        else:
            found = _KEY.match(page, at)
            key, at = found[0].lower(), found.end()
        value, equals = "", _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            mark = page[at : at + 1]
            if mark and mark in "\"'":
                end = page.find(mark, at + 1)
                if end < 0:
                    return given, -1, False
                value, at = page[at + 1 : end], end + 1
            else:
                found = _BARE.match(page, at)
                value, at = found[0], found.end()
        given.setdefault(key, value)


class _Open:
    """The open elements of a page: their names, which of them hide, and where each name stands."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.hides: list[bool] = []
        self.hidden = 0
        self.places: dict[str, list[int]] = {}

    def add(self, name: str, hides: bool) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.hides.append(hides)
        self.hidden += hides

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost element of these names; -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end(self, at: int) -> None:
        """End the element at a place and all in it."""
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.hidden -= self.hides.pop()

    def before(self, name: str) -> None:
        """End what a start tag of this name ends."""
        for kind in ENDS.get(name, ()):
            at = self.last((kind,))
            if at >= 0 and at > self.last(KEEPS.get(kind, ())):
                self.end(at)


def shown(page: str) -> str:
    """A page's text outside hidden elements, white space collapsed.

    One pass from tag to tag with the elements that are open.  A start tag ends
    those that can't hold it (an item the item before, a block the paragraph
    before); an end tag ends the innermost element of its name and what is open
    in it, or nothing; void elements and those that end themselves hold nothing.
    So an element without an end tag hides what it holds and no more.  Text of
    scripts and their like has no tags.  A tag without an end, as at a page cut
    off, is no text.  Time grows with the page's length.
    """
    parts: list[str] = []
    opened, at, closed = _Open(), 0, page.rfind(">")
    while at < len(page):
        tag = page.find("<", at)
        text = page[at : tag if tag >= 0 else len(page)]
        if text and not opened.hidden:
            parts.append(html.unescape(text))
        if tag < 0:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?", "</"), tag) and not (page.startswith("</", tag) and page[tag + 2 : tag + 3].isalpha()):
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, tag + 1 + page.startswith("</", tag))
        if not name:  # a sign, no tag
            if not opened.hidden:
                parts.append("<")
            at = tag + 1
            continue
        if closed < tag:  # no tag ends any more
            break
        given, end, alone = _attributes(page, name.end())
        if end < 0:
            break
        at, tag_name = end, _local(name[0])
        if page.startswith("</", tag):
            place = opened.last((tag_name,))
            if place >= 0:
                opened.end(place)
            continue
        opened.before(tag_name)
        if tag_name in VOID_ELEMENTS or alone:
            continue
        hides = tag_name in HIDDEN_ELEMENTS or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or ("style" in given and _style_hides(html.unescape(given["style"])))
        opened.add(tag_name, hides)
        if tag_name in RAW_ELEMENTS and name[0].lower() == tag_name:
            close = re.compile(rf"</{tag_name}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else len(page)
            if not opened.hidden:
                parts.append(html.unescape(page[at:stop]))
            at = stop
    return " ".join(" ".join(parts).split())


@pandas_udf(StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """What a reader of the page sees, white space collapsed."""
    return pd.Series([None if p is None else shown(p) for p in pages], dtype=object)


#: Signs that count as equal when a quote is sought, each as long as its stand-in.
FOLDED = ("‘’“”–— ", "''\"\"-- ")


def folded(text: Column) -> Column:
    return F.translate(text, *FOLDED)


@pandas_udf(IntegerType())
def quote_place(texts: pd.Series, quotes: pd.Series, hints: pd.Series) -> pd.Series:
    """Where the quote stands nearest to the hint, the smaller of equals; -1 if nowhere. Both must be folded."""

    def one(text: str | None, quote: str | None, hint: float | None) -> int:
        if not text or not quote:
            return -1
        at = int(hint or 0)
        after, before = text.find(quote, max(at, 0)), text.rfind(quote, 0, max(at, 0) + len(quote))
        found = [p for p in (before, after) if p >= 0]
        return min(found, key=lambda p: (abs(p - at), p), default=-1)

    return pd.Series([one(*x) for x in zip(texts, quotes, hints, strict=True)])


def _window_bounds(text: np.ndarray, quote: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each window the most that it can have in common with the quote, in order: by its letters, and by its pairs of letters.

    A letter of the quote that isn't common spoils two of its pairs at most, one
    of the window parts one.
    """

    def shared(of: np.ndarray, wanted: np.ndarray, short: int) -> np.ndarray:
        total, last = np.zeros(len(begin), np.int64), np.maximum(begin + size - short, begin)
        for kind, n in zip(*np.unique(wanted, return_counts=True), strict=True):
            upto = np.r_[0, np.cumsum(of == kind)]
            total += np.minimum(upto[np.minimum(last, len(of))] - upto[np.minimum(begin, len(of))], n)
        return total

    m, pair = len(quote), lambda x: x[:-1].astype(np.int64) << 32 | x[1:]
    letters = shared(text, quote, 0)
    if m < 2 or len(text) < 2:
        return letters
    return np.minimum(letters, (shared(pair(text), pair(quote), 1) + m + size + 1) // 3)


def nearest_passage(text: str, quote: str) -> tuple[int, int, float]:
    """Where the stretch of the text most like the quote begins and ends, and how like it is.

    Stretches are as long as the quote, shorter at the text's ends; likeness is
    twice the longest common subsequence by the sum of lengths, and of equals the
    first and longest counts.  Stretches are tried in the order of what they can
    reach by the letters and pairs of letters that they share with the quote,
    until none can reach more, with a bit for each of the quote's letters.
    """
    n, m = len(text), len(quote)
    if not m or not n:
        return 0, 0, float(n == m)
    if n <= m:
        begin, size = np.r_[np.zeros(n, np.int64), np.arange(1, n)], np.r_[np.arange(n, 0, -1), np.arange(n - 1, 0, -1)]
    else:
        begin = np.r_[np.zeros(m - 1, np.int64), np.arange(n - m + 1), np.arange(n - m + 1, n)]
        size = np.r_[np.arange(1, m), np.full(n - m + 1, m), np.arange(m - 1, 0, -1)]
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, quote)]
    bound = 2 * _window_bounds(*codes, begin, size) / (size + m)
    best = (-1.0, 0, 0)
    for i in np.lexsort((-size, begin, -bound)).tolist():
        if bound[i] < best[0]:
            break
        a, k = int(begin[i]), int(size[i])
        best = max(best, (2 * _common(quote, text[a : a + k]) / (k + m), -a, k))
    return -best[1], -best[1] + best[2], best[0]


@pandas_udf(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("similarity", DoubleType())]))
def nearest(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    """nearest_passage of each row; nulls where the text or the quote is null."""
    found = [nearest_passage(t, q) if t is not None and q is not None else (None, None, None) for t, q in zip(texts, quotes, strict=True)]
    return pd.DataFrame(found, columns=["begin", "end", "similarity"]).astype({"begin": "Int32", "end": "Int32", "similarity": "Float64"})


def half_even(value: Column, places: int = 0) -> Column:
    """Rounding to the even neighbour at the middle."""
    return F.bround(value, places)


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The index of the first pattern that the text has; null if none."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)))
