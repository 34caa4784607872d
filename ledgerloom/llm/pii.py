"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; those of IBANs are as long as their country says.
Checks confirm them: Luhn for cards, modulo 97 for IBANs, ranges for addresses, digit
counts for phones. Words near a span move its score; kinds that a shape alone can't settle
are reported only where such words lift them.

The expressions are written so that matching takes linear time and no deep recursion:
runs are possessive, and a match can start inside a run of its first class only where the
previous match ended. Positions come from the lengths of the pieces between matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Code points on each side of a span, up to the next match of its kind, that are searched for context words, and the least score reported.
NEAR, REPORTED = 40, 0.5
_STEP = 512


@dataclass(frozen=True)
class Kind:
    """needs: text without a match of this has none. base: reported whatever the context."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Of 13 to 19 digits; every second one from the right counts double, less 9 above 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _iban(match: Column) -> Column:
    """First four characters moved to the end, letters read as 10 to 35: 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    each = F.transform(F.split(moved, ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    rest = F.aggregate(each, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(F.lit(False))


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_MAIL = "A-Za-z0-9._%+-"
#: Characters of an IBAN by country, blanks not counted: those registered, then those in use without it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
UNREGISTERED_LENGTHS = {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for lengths in (IBAN_LENGTHS, UNREGISTERED_LENGTHS) for n, c in lengths.items())

KINDS = (
    Kind("email", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.8, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", _card, 0.7, "card|visa|master|amex|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, r"phone|\btel|call|fax|mobile|telefon"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _iban, 0.7, "iban|account|bank|konto|cuenta|compte", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: F.lit(True), 0.3, r"\bssn\b|social security|tax id", False),
)


def _before(lengths: Column) -> Column:
    """Sum of the lengths before each, in steps, so that long arrays aren't copied for each item."""
    none = F.array().cast("array<bigint>")

    def step(at: Column, part: Column) -> Column:
        start = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda k: F.slice(lengths, k * _STEP + 1, F.lit(_STEP)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))

    def joined(a: Column, part: Column) -> Column:
        total = F.aggregate(part, a["at"], lambda s, x: s + x)
        return F.struct(total.alias("at"), F.concat(a["out"], F.array(step(a["at"], part)["out"])).alias("out"))

    return F.flatten(F.aggregate(parts, start, joined)["out"])


_SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def _spans(kind: Kind, found: Column, pieces: Column, before: Column) -> Column:
    def span(match: Column, i: Column) -> Column:
        left, right = F.get(pieces, i), F.get(pieces, i + 1)
        start = F.get(before, i) + F.char_length(left)
        near = F.lower(F.concat_ws(" ", F.right(left, F.lit(NEAR)), F.left(right, F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.2).otherwise(0.0)
        good = F.when(kind.valid(match), F.lit(True) if kind.base else score >= REPORTED).otherwise(F.lit(False))
        return F.when(good, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"), score.alias("score")))

    return F.filter(F.transform(found, span), lambda s: s.isNotNull()).cast(_SPANS)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with pii: spans (kind, start, end, score) by kind in the order of KINDS, then start.

    Positions are code points, end exclusive; matches of a kind are leftmost and don't
    overlap, and a match that its check refuses is dropped without another try. Spans of
    base kinds (email, ip, card, phone) are all reported; the others where shape, check and
    context reach REPORTED. Null and empty texts have none. Every row comes back once, with
    its columns, but for one called pii; no shuffle.
    """
    helpers = [f"{p}_{k.name}" for k in KINDS for p in ("found", "pieces", "before", "spans")]
    docs = without(docs, "pii", "whole_text", *helpers)
    out = docs.withColumn("whole_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    text = F.col("whole_text")
    out = out.withColumns({f"found_{k.name}": F.when(text.rlike(k.needs), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"pieces_{k.name}": F.when(F.size(f"found_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in KINDS})
    sums = {}
    for k in KINDS:
        found, pieces = F.col(f"found_{k.name}"), F.col(f"pieces_{k.name}")
        lengths = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: (F.char_length(m) + F.char_length(p)).cast("bigint"))
        sums[f"before_{k.name}"] = F.when(F.size(found) > 0, _before(lengths)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns(sums)
    out = out.withColumns({f"spans_{k.name}": F.when(F.size(f"found_{k.name}") > 0, _spans(k, *(F.col(f"{c}_{k.name}") for c in ("found", "pieces", "before")))).otherwise(F.array().cast(_SPANS)) for k in KINDS})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(*[F.col(f"spans_{k.name}") for k in KINDS]).alias("pii"))
