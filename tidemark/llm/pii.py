"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
CONTEXT = 40
#: Proposals of a text that are walked together.
CHUNK = 512


def _let(value: Column, body: callable) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
        ),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (spaces allowed) leaves 1 modulo 97, its first four characters put last."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(c == "", s)
        .when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97)
        .otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern: possessive, so that no text makes it backtrack or recurse deeply.
    hint: a cheap pattern that every text with a span matches.
    confirmed: a test of a proposed span; base: whether it is one of the base kinds.
    """

    name: str
    pattern: str
    hint: str
    confirmed: callable
    checksum: bool
    context: str
    base: bool = True


_MAIL = "A-Za-z0-9._%+-"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
KINDS = (
    # A local part starts where a run of its characters starts, or where the previous span ended inside one.
    Kind("email", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), False, "mail|write|contact|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), False, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)), True, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), False, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, True, "iban|account|bank|transfer", base=False),
)
_SPAN = "array<struct<start:bigint,end:bigint,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: start and end in code points, and a score.

    The pieces between proposals give their places, so the text is walked twice whatever the number of spans.
    """
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        hits,
        lambda piece, hit: F.struct(
            F.char_length(piece).cast("bigint").alias("before"),
            F.char_length(hit).cast("bigint").alias("size"),
            (hit.isNotNull() & kind.confirmed(hit)).alias("ok"),
            F.lower(F.right(piece, F.lit(CONTEXT))).rlike(kind.context).alias("near"),
        ),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["before"]
        score = F.lit(0.75 if kind.checksum else 0.5) + F.when(x["near"], 0.2).otherwise(0.0)
        one = F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), score.alias("score"))).cast(_SPAN)
        return F.struct(
            (start + F.coalesce(x["size"], F.lit(0))).cast("bigint").alias("at"),
            F.when(x["ok"], F.concat(state["out"], one)).otherwise(state["out"]).alias("out"),
        )

    # Arrays grow by copying, so spans are gathered per chunk of proposals and the chunks joined at the end.
    empty = F.array().cast(_SPAN)
    none = F.array().cast(f"array<{_SPAN}>")

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    walked = _let(
        pairs,
        lambda p: F.aggregate(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK)),
            F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
            chunk,
            lambda state: F.flatten(state["out"]),
        ),
    )
    return F.when(text.rlike(kind.hint), walked).otherwise(empty)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, and per kind an array of (start, end, score).

    Proposals are leftmost and do not overlap within a kind; one that fails its
    check is dropped and not tried again.  Null texts count as empty and have no
    spans.  Repeated rows are each returned; other columns are ignored.  Scores
    are 0.5, or 0.75 for kinds with a checksum, and 0.2 more when a context word
    of the kind stands in the 40 code points before the span.
    """
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return found.select("doc_id", *(_spans(text, k).alias(k.name) for k in KINDS))


def _written(kinds: list[Kind], score: bool = False) -> Column:
    def one(k: Kind) -> Column:
        return F.transform(
            F.col(k.name),
            lambda s: F.concat_ws(":", F.lit(k.name), s["start"].cast("string"), s["end"].cast("string"), *([s["score"].cast("string")] if score else [])),
        )

    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts, digests and written spans of personal_data()'s rows."""
    base = [k for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(list(KINDS)).alias("spans"),
        _written(list(KINDS), score=True).alias("scored"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The documents with every confirmed span of enough score replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first, then the longer one, is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def ordered(k: Kind) -> Column:
        sure = F.filter(_spans(text, k), lambda s: s["score"] >= least_score)
        return F.transform(sure, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(k.name).alias("kind")))

    all_spans = F.array_sort(F.concat(*(ordered(k) for k in KINDS)))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        fits = s["start"] >= state["at"]
        return F.struct(
            F.when(fits, (-s["back"]).cast("int")).otherwise(state["at"]).alias("at"),
            F.when(fits, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(
        F.transform(all_spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["back"].cast("int").alias("back"), s["kind"].alias("kind"))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done))
