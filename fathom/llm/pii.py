"""Personal data in texts, found with column expressions only.

Regular expressions propose spans, checksums and other rules confirm them, and words close by raise or lower a span's
score. Kinds with `base` are reported wherever their rule holds; those of the others whose score reaches THRESHOLD and
that meet no base span are added.

Every pattern takes time in proportion to the text, however long its runs of letters or digits are: a match can begin at
the start of a run only (which a look-behind tells), and nothing that has been taken is given back (possessive repeats,
which Java's engine also takes without recursion). The places of matches follow from the lengths of the pieces between
them; sums over blocks of BLOCK matches keep that linear, too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .members import _column

#: Characters of the local part of an address, and of the international telephone numbers.
LOCAL, PHONE_MARKS = "[A-Za-z0-9._%+-]", "+ ().-"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
#: The least score of a span that is not a base one; code points looked at on either side; what a word there changes.
THRESHOLD, CONTEXT, FOR, AGAINST = 0.5, 48, 0.3, 0.3
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _always(_: Column) -> Column:
    return F.lit(True)


def _luhn(match: Column) -> Column:
    return F.call_function("luhn_check", F.translate(match, " -", ""))


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.lpad(digits, 3, "0") <= "255")

    return F.forall(F.split(match, "\\."), small)


def _digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(F.translate(match, PHONE_MARKS, "")).between(least, most)


def _mod97(match: Column) -> Column:
    """An account number whose first four characters go last leaves 1, with letters counted from 10."""

    def step(rest: Column, char: Column) -> Column:
        value = F.instr(F.lit(ALPHABET), char) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return let(F.translate(match, " ", ""), lambda v: F.length(v).between(15, 34) & (F.aggregate(F.split(F.concat(F.substr(v, F.lit(5)), F.left(v, F.lit(4))), ""), F.lit(0), step) == 1))


def _has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9]"))


@dataclass(frozen=True)
class Kind:
    """`prior` is the score of a confirmed span with no known word around it; `may` is a cheap test without which a text
    has no match; words are patterns without regard to case."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    prior: float
    base: bool
    may: Callable[[Column], Column]
    words: str
    against: str = ""


KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.7, True, lambda t: F.contains(t, F.lit("@")), "e-?mail|mail|contact|kontakt|correo|courriel", "example|sample"),
    Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.5, True, _has_digit, "ip|host|server|address|adresse|client|login", "version|release|build|chapter|section"),
    Kind("card", r"[0-9](?<![0-9][ -]?[0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", _luhn, 0.6, True, _has_digit, "card|visa|mastercard|credit|debit|karte|carte|tarjeta|cvv", "order|isbn|tracking|invoice"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _digits(9, 15), 0.6, True, lambda t: F.contains(t, F.lit("+")), "phone|tel|call|mobile|fax|telefon|téléphone|teléfono|handy"),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", _mod97, 0.8, False, _has_digit, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"[0-9](?<![0-9.-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", _always, 0.3, False, _has_digit, "ssn|social security|taxpayer"),
    Kind("national_phone", r"[(0-9](?<![0-9+.-][(0-9])(?:(?<=\()[0-9]{3}\) ?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", _always, 0.3, False, _has_digit, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono|handy", "isbn|order|invoice"),
)


def _score(kind: Kind, context: Column) -> Column:
    def near(words: str, by: float) -> Column:
        return F.when(F.rlike(context, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")), by).otherwise(0.0)

    score = F.lit(kind.prior) + near(kind.words, FOR)
    score = score - near(kind.against, AGAINST) if kind.against else score
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def _located(matches: Column, pieces: Column, kind: Kind) -> Column:
    """The confirmed ones of all matches, between which lie the pieces, as spans."""

    def total(lengths: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, first + 1, n), F.lit(0).cast("long"), lambda a, b: a + b)

    def spans(v: Column) -> Column:
        def span(i: Column) -> Column:
            block = (i / BLOCK).cast("int")
            start = v["before"][block] + total(v["lengths"], block * BLOCK, i % BLOCK) + F.length(pieces[i])
            context = F.concat(F.right(pieces[i], F.lit(CONTEXT)), F.lit(" "), F.left(pieces[i + 1], F.lit(CONTEXT)))
            return let(start, lambda s: F.struct(F.lit(kind.name).alias("kind"), s.alias("start"), (s + F.length(matches[i])).alias("end"), _score(kind, context).alias("score"), F.lit(kind.base).alias("base")))

        places = F.sequence(F.lit(0), F.size(matches) - 1)
        return F.transform(F.filter(places, lambda i: kind.confirm(matches[i])), span)

    blocks = F.sequence(F.lit(0), ((F.size(matches) - 1) / BLOCK).cast("int"))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    summed = lambda v: F.struct(v.alias("lengths"), F.transform(blocks, lambda b: total(v, b * BLOCK, F.lit(BLOCK))).alias("sums"))
    before = lambda v: F.struct(v["lengths"].alias("lengths"), F.transform(blocks, lambda b: total(v["sums"], F.lit(0), b)).alias("before"))
    return let(let(let(lengths, summed), before), spans)


def _found(text: Column, kind: Kind) -> Column:
    none = F.array().cast(SPAN)

    def placed(matches: Column) -> Column:
        both = F.struct(matches.alias("matches"), F.split(text, kind.pattern, -1).alias("pieces"))
        return let(both, lambda v: _located(v["matches"], v["pieces"], kind))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = let(matches, lambda m: F.when(F.exists(m, kind.confirm), placed(m)))
    return F.when(kind.may(text), F.coalesce(spans, none)).otherwise(none)


def _fresh(name: str, taken: list[str]) -> str:
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def with_pii(docs: DataFrame, text_col: str = "text", column: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with a column of spans (kind, start, end, score, base): code points from 0, end exclusive, in the order of
    kinds and then of places. A null text counts as empty and has none. Rows are looked at one by one, so rows that repeat
    are each answered and an empty table gives an empty one; other columns may have any names but `column`'s."""
    text = F.coalesce(_column(text_col), F.lit(""))
    sure, more = (_fresh(n, docs.columns) for n in ("_base", "_more"))
    both = {sure: [k for k in kinds if k.base], more: [k for k in kinds if not k.base]}
    found = docs.withColumns({name: F.concat(F.array().cast(SPAN), *(_found(text, k) for k in part)) for name, part in both.items()})

    def added(s: Column) -> Column:
        return (s["score"] >= THRESHOLD) & ~F.exists(_column(sure), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return found.withColumn(column, F.concat(_column(sure), F.filter(_column(more), added))).drop(sure, more)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or group of spans that overlap, replaced by the kind of the first in angle brackets."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def cut(begin: Column, end: Column) -> Column:
        return F.substr(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    def step(done: Column, s: Column) -> Column:
        fresh = F.concat(done["parts"], F.array(cut(done["at"], s["start"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))
        parts = F.when(s["start"] >= done["at"], fresh).otherwise(done["parts"])
        return F.struct(parts.alias("parts"), F.greatest(done["at"], -s["back"]).alias("at"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), cut(done["at"], F.length(text).cast("long"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text column redacted; null texts become empty."""
    spans = _fresh("_pii", docs.columns)
    return with_pii(docs, text_col, spans).withColumn(text_col, redacted(_column(text_col), _column(spans))).drop(spans)
