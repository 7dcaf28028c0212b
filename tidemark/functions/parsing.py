"""Parsing: codes and aliases, pasted lines, lineups, JSON with checks, local times."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of those who don't take part, marks of made-up sources.
INACTIVE = ("O", "OUT", "INACTIVE", "IR", "PUP", "SUSPENDED")
SYNTHETIC = ("fixture", "test", "synthetic")


def inactive(status: Column, official: Column) -> Column:
    """Whether someone is out: the official word if there is one (unavailable or available), else the status."""
    return F.when(official == "unavailable", True).when(official == "available", False).otherwise(F.coalesce(F.upper(F.trim(status)).isin(*INACTIVE), F.lit(False)))


def synthetic(source: Column) -> Column:
    """Whether a source's name has a made-up source's mark as a word."""
    return F.lower(source).rlike(f"(^|[^a-z0-9])({'|'.join(SYNTHETIC)})([^a-z0-9]|$)")


def alias(code: Column, canonical: dict[str, str]) -> Column:
    """The canonical code of a variant; null for what the map doesn't know."""
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(canonical.items()))), F.upper(F.trim(code)))


def pasted_line(line: Column) -> Column:
    """A pasted name without bullet or number in front, status behind, and with parentheses as commas."""
    plain = F.regexp_replace(line, r"^[\s]*([-*•]|[0-9]+[.)])[\s]*", "")
    plain = F.regexp_replace(plain, r"[\s]*[(]([^()]*)[)]", ", $1")
    return F.trim(F.regexp_replace(plain, r"(?i)[\s]*[-:][\s]*(out|in|questionable|doubtful)[\s]*$", ""))


def lineup(text: Column, slots: list[str]) -> Column:
    """(slot, name) of a lineup's text, slots as words; null unless the text begins with one."""
    word = "|".join(slots)
    starts = F.regexp_extract_all(text, F.lit(rf"(?:^|\s)({word})(?=\s)"), F.lit(1))
    parts = F.split(text, rf"(?:^|\s)(?:{word})(?=\s)")
    names = F.slice(parts, F.lit(2), F.size(parts))
    pairs = F.zip_with(starts, names, lambda s, n: F.struct(s.alias("slot"), F.trim(n).alias("name")))
    return F.when(text.rlike(rf"^({word})\s"), pairs)


_TEXT = r'"([^"\\]|\\.)*"'


def text_array(json: Column) -> Column:
    """A JSON array of texts; null for anything else, numbers in the array too."""
    return F.when(json.rlike(rf"^\s*\[\s*({_TEXT}(\s*,\s*{_TEXT})*)?\s*\]\s*$"), F.from_json(json, "array<string>"))


def played(json: Column) -> Column:
    """yes, no, unknown or conflict, from what an object says in active, played and status."""
    f = F.from_json(json, "active boolean, played boolean, status string")
    said = F.when(F.upper(f["status"]).isin(*INACTIVE), False).when(F.upper(f["status"]) == "ACTIVE", True)
    signals = F.array_distinct(F.array_compact(F.array(f["active"], f["played"], said)))
    return F.when(F.size(signals) > 1, "conflict").when(F.get(signals, F.lit(0)), "yes").when(~F.get(signals, F.lit(0)), "no").otherwise("unknown")


def position(canonical: Column, slots: Column, base: list[str]) -> Column:
    """The canonical position if it is a base slot, else the first base slot among the slots, else whatever there is."""
    fitting = F.filter(slots, lambda s: s.isin(*base))
    return F.when(canonical.isin(*base), canonical).otherwise(F.coalesce(F.get(fitting, F.lit(0)), canonical, F.get(slots, F.lit(0))))


def framed(text: Column, name: str) -> Column:
    """Untrusted text between marks, without format controls."""
    return F.concat(F.lit(f"<<{name}>>\n"), F.regexp_replace(text, r"\p{Cf}", ""), F.lit(f"\n<</{name}>>"))


def local_instant(text: Column, zone: str, form: str = "MM/dd/yyyy hh:mma") -> Column:
    """Microseconds since 1970 of a local time as text in a named zone."""
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text, form), zone))


def month_window(year: int, month: int, zone: str) -> tuple[Column, Column]:
    """First microsecond of a local month and of the next, since 1970 in UTC."""
    at = lambda y, m: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.lit(f"{y:04d}-{m:02d}-01 00:00:00")), zone))
    return at(year, month), at(year + month // 12, month % 12 + 1)
