"""Personal data: patterns propose spans, checksums confirm them, context sets the score.

All in SQL functions: matches come from one function and the gaps between them from
another, running lengths of both give the spans' places, and the nearest of both their context,
so that a text's cost follows its length however many matches it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions.text import let

from .common import free_name, text_or_empty

#: A part of an address, at most 255, with any leading zeros.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Characters before and after a span in which context words count.
NEAR = 40
#: A match and the gap beside it have two characters at least, so that so many hold the context.
_UNITS = NEAR // 2
#: Values whose running sums are made together, and characters of a text looked up together.
_TOGETHER, _CUT = 64, 4096


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z")


def _is_card(match: Column) -> Column:
    return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _is_iban(match: Column) -> Column:
    """The remainder by 97 of the number that the rearranged characters make is 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _is_random(match: Column) -> Column:
    """Letters and digits, and as many bits of entropy a character as drawn ones have."""

    def bits(c: Column) -> Column:
        share = (F.length(match) - F.length(F.replace(match, c, F.lit("")))) / F.length(match)
        return -share * F.log2(share)

    each = F.transform(F.filter(F.array_distinct(F.split(match, "")), lambda c: c != ""), bits)
    mixed = match.rlike("[0-9].*[0-9].*[0-9]") & match.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return mixed & (F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6) >= 3.0)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``score`` rises by ``lift`` beside a context word.

    Patterns are written so that no start is tried twice: a match can only start where a
    run starts or the last match ended, and repeats give nothing back.
    """

    name: str
    pattern: str
    hint: str  # a cheap test that texts with a match pass
    score: float
    lift: float
    context: str
    valid: object = None
    least: float = 0.0  # spans below this score are no findings


_LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, "e-?mail|contact|write|reply"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, 0.3, "address|host|server|login|ip", _is_ip),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][ -]?[0-9]", 0.8, 0.2, "card|visa|credit|pay|account", _is_card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, 0.3, "phone|call|tel|mobile|fax", _is_phone),
)
#: Characters of an IBAN by country code: the registry's, and those in use beside it.
_IBAN_CODES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: As long as the code says, so that capitals and numbers after an IBAN are not taken with it.
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in _IBAN_CODES.items())
MORE = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, 0.1, "iban|bank|account|transfer", _is_iban, 0.5),
    Kind("key", r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "AKIA|ASIA|gh[pousr]_|AIza|eyJ", 0.9, 0.1, "token|secret|key|password|bearer|credential"),
    Kind("secret", r"[A-Za-z0-9+/_-]{20,}+", "[A-Za-z0-9+/_-]{20}", 0.3, 0.5, "token|secret|passw|pwd|key|api|bearer|credential|auth", _is_random, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, 0.4, "ssn|social|security|insurance", None, 0.5),
)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _cut_up(values: Column) -> Column:
    """The values in parts of :data:`_TOGETHER` (a slice copies its whole array, so few are taken)."""
    n = F.floor((F.size(values) - 1) / _TOGETHER).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(values, i * _TOGETHER + 1, F.lit(_TOGETHER)))


def _around(parts: Column, first: Column, last: Column) -> Column:
    """Values from first to last (less than a part apart, the last maybe missing) of what was cut up."""
    b = F.floor(first / _TOGETHER).cast("int")
    both = F.concat(F.get(parts, b), F.coalesce(F.get(parts, b + 1), F.slice(F.get(parts, b), 1, 0)))
    return F.coalesce(F.slice(both, first - b * _TOGETHER + 1, last - first + 1), F.slice(F.get(parts, F.lit(0)), 1, 0))


def _running(values: Column, add, zero: Column) -> Column:
    """What the values before each one come to: by parts, then inside each part."""

    def parted(parts: Column) -> Column:
        wholes = F.transform(parts, lambda p: F.aggregate(p, zero, add))
        offsets = let(wholes, lambda w: F.transform(w, lambda _, i: F.aggregate(F.slice(w, F.lit(1), i), zero, add)))
        inside = lambda o: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda _, k: F.aggregate(F.slice(p, F.lit(1), k), F.get(o, i), add))))
        return let(offsets, inside)

    return F.when(F.size(values) == 0, F.slice(values, 1, 0)).otherwise(let(_cut_up(values), parted))


def _places(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of confirmed matches, in code points, with their scores."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast(_SPAN)

    def found(x: Column) -> Column:
        """From the matches m and the gaps g around them."""
        m, g = x["m"], x["g"]
        # what ends before each match, and what starts after it, cut to what context needs
        ends = F.transform(m, lambda _, i: F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(g, i)), F.lit(NEAR)))
        begins = F.concat(F.transform(m, lambda c, i: F.left(F.concat(F.get(g, i), c), F.lit(NEAR))), F.array(F.left(F.element_at(g, -1), F.lit(NEAR))))
        before = _running(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda c, d: F.length(c) + F.length(d)), lambda a, n: a + n, F.lit(0))
        return let(F.struct(m.alias("m"), g.alias("g"), _cut_up(ends).alias("ends"), _cut_up(begins).alias("begins"), before.alias("before")), placed)

    def placed(x: Column) -> Column:
        here = F.transform(x["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i")))
        sure = here if kind.valid is None else F.filter(here, lambda h: kind.valid(h["m"]))

        def scored(h: Column) -> Column:
            i = h["i"]
            start = F.get(x["before"], i) + F.length(F.get(x["g"], i))
            first = F.greatest(i - (_UNITS - 1), F.lit(0))
            ahead = F.right(F.array_join(_around(x["ends"], first, i), ""), F.lit(NEAR))
            behind = F.left(F.array_join(_around(x["begins"], i + 1, i + _UNITS), ""), F.lit(NEAR))
            near = F.concat(ahead, F.lit(" "), behind).rlike(rf"(?i)(?<![a-z])(?:{kind.context})")
            score = F.when(near, F.lit(kind.score + kind.lift)).otherwise(F.lit(kind.score))
            end = start + F.length(h["m"])
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.cast("double").alias("score"))

        return F.filter(F.transform(sure, scored), lambda s: s["score"] >= kind.least).cast(_SPAN)

    both = F.struct(matches.alias("m"), F.split(text, kind.pattern, -1).alias("g"))
    return F.when(text.rlike(kind.hint), let(both, lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(found(x)))).otherwise(none)


def find_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: confirmed spans of each whole text, by start, then kind.

    Each span has start and end (code points, end exclusive), kind and score. A kind's
    matches don't overlap; those of different kinds may. Null and empty texts have none.
    Rows, ties and further columns pass through; an existing ``out`` column is replaced.
    """
    names = free_name(df, *(f"found_{k.name}" for k in (*BASE, *MORE)))
    t = text_or_empty(text)
    found = df.withColumns({n: _places(t, k, i) for i, (n, k) in enumerate(zip(names, (*BASE, *MORE), strict=True))})
    return found.withColumn(out, F.array_sort(F.concat(*names))).drop(*names)


def listed(spans: Column, with_score: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""

    def one(s: Column) -> Column:
        parts = [s["kind"], s["start"].cast("string"), s["end"].cast("string")]
        if with_score:
            parts.append(F.format_number(s["score"], 2))
        return F.concat_ws(":", *parts)

    return F.array_join(F.transform(spans, one), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text given in parts of equal length."""
    first, last = F.floor(start / _CUT).cast("int"), F.floor((end - 1) / _CUT).cast("int")
    joined = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(joined, start - first * _CUT + 1, end - start)).otherwise("")


def masked(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with every span of at least that score replaced by its kind in brackets.

    Spans that overlap are replaced together by the kind of the first. Null texts stay null;
    repeated rows and further columns pass through.
    """
    s, p = free_name(df, "pii_spans", "pii_parts")
    found = find_spans(df, text, s).withColumn(s, F.filter(s, lambda x: x["score"] >= least))
    found = found.withColumn(p, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)))
    spans, whole = F.col(s), F.length(F.col(text))

    def put(reach: Column) -> Column:
        """``reach`` is the largest end of the spans before each."""
        firsts = F.filter(F.transform(spans, lambda x, i: F.struct(x.alias("x"), F.get(reach, i).alias("from"))), lambda y: y["x"]["start"] >= y["from"])
        shown = F.transform(firsts, lambda y: F.concat(_between(F.col(p), y["from"], y["x"]["start"]), F.lit("["), y["x"]["kind"], F.lit("]")))
        return F.concat(F.array_join(shown, ""), _between(F.col(p), F.array_max(F.transform(spans, lambda x: x["end"])), whole))

    reach = _running(F.transform(spans, lambda x: x["end"]), lambda a, e: F.greatest(a, e), F.lit(0))
    return found.withColumn(text, F.when(F.size(s) > 0, let(reach, put)).otherwise(F.col(text))).drop(s, p)
