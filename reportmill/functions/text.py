"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as scripts and spreadsheets understand it: ASCII, Latin-1 and Unicode blanks.
WS = r"[\s\x0B\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Words without weight in a search (fixed values).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from",
    "had", "has", "have", "he", "her", "his", "if", "in", "into", "is", "it", "its",
    "of", "on", "or", "our", "she", "that", "the", "their", "there", "they", "this", "to",
    "was", "were", "will", "with", "you", "your",
]
TOKEN = r"\d+(?:\.\d+)?|[a-z]+"

#: Prefix a model expects before queries (fixed values).
QUERY_PREFIX = {
    "bge-small": "Represent this sentence for searching relevant passages: ",
    "gte-small": "",
    "minilm-l6": "",
}
CITATION = r"(?i)\[p\.\s*(\d+)(?:\s*[-\x{2013}]\s*\d+)?\]"
ELLIPSIS = "…"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def furniture_key(c: Column) -> Column:
    """What a running header or footer is compared by: digits blurred, case and blanks folded."""
    return trim_ws(collapse_ws(F.regexp_replace(F.lower(c), r"\d+", "#")))


def comparable(c: Column) -> Column:
    return F.lower(trim_ws(collapse_ws(c)))


def normalize_selection(c: Column) -> Column:
    return trim_ws(collapse_ws(c))


def is_explainable(c: Column) -> Column:
    flat = normalize_selection(c)
    return F.length(flat).between(2, 300) & flat.rlike(r"\p{L}")


def singular(word: Column) -> Column:
    kept = (F.length(word) <= 3) | ~word.endswith("s")
    for ending in ("ss", "us", "is", "as"):
        kept |= word.endswith(ending)
    return F.when(kept, word).otherwise(F.substring(word, F.lit(1), F.length(word) - 1))


def _is_number(token: Column) -> Column:
    """Whether a raw word is a number; these and words of small letters are all there are."""
    return token < ":"


def raw_words(c: Column) -> Column:
    """Numbers and words of the lower-cased text, as they stand."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def term_of(raw: Column) -> Column:
    """The comparable term of one raw word; null for stop words and single characters."""
    kept = (F.length(raw) >= 2) & ~raw.isin(STOP_WORDS)
    return F.when(kept, F.when(_is_number(raw), raw).otherwise(singular(raw)))


def plain_term(raw: str) -> str:
    """:func:`term_of` of a raw word in Python; "" for stop words and single characters."""
    if len(raw) < 2 or raw in STOP_WORDS:
        return ""
    plural = len(raw) > 3 and raw.endswith("s") and not raw.endswith(("ss", "us", "is", "as")) and raw >= ":"
    return raw[:-1] if plural else raw


def tokenize(c: Column) -> Column:
    """Comparable terms: whole decimals, and words without stop words or a plural s."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))
    return F.transform(kept, lambda t: F.when(_is_number(t), t).otherwise(singular(t)))


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9%]+", " "))


def name_forms(c: Column) -> Column:
    """Distinct non-empty spellings of a name: as printed, and without parentheticals."""
    bare = F.regexp_replace(c, r"\([^)]*\)", " ")
    return F.filter(F.array_distinct(F.array(normalize_name(c), normalize_name(bare))), lambda x: x != "")


def for_matching(c: Column) -> Column:
    """Text in which printed values are searched: thousands commas gone, case folded."""
    return collapse_ws(F.regexp_replace(F.lower(c), r"(\d),(\d{3})", "$1$2"))


def contains_number(text: Column, number: Column) -> Column:
    """Whether the number stands alone in the text, not inside a longer one."""
    needle = F.concat(F.lit(r"(?<![\d.])\Q"), F.replace(number, F.lit(","), F.lit("")), F.lit(r"\E(?!\d|\.\d)"))
    return F.regexp_like(text, needle)


def first_match(text: Column, terms: Column) -> Column:
    """The first place (from 0) where any term occurs in the lower-cased text, or -1."""
    low = F.lower(text)
    at = F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda p: p >= 0)
    return F.coalesce(F.array_min(at), F.lit(-1))


def add_snippet(df: DataFrame, text: str, terms: Column, out: str = "snippet", length: int = 160) -> DataFrame:
    """Add about ``length`` characters around the first term, cut at blanks, with ellipses.

    Built in steps of one column each, so that no step is worked out twice.
    """
    c = {n: F.col(f"_snip_{n}") for n in ("flat", "n", "at", "end0", "start0", "gap", "back", "start", "end")}
    steps = {
        "flat": trim_ws(collapse_ws(F.col(text))),
        "n": F.length(c["flat"]),
        "at": first_match(c["flat"], terms),
        "end0": F.least(c["n"], F.greatest(F.lit(0), c["at"] - length // 2) + length),
        "start0": F.greatest(F.lit(0), c["end0"] - length),
        "gap": F.instr(F.substr(c["flat"], c["start0"] + 1), " "),
        "back": F.instr(F.reverse(F.substr(c["flat"], F.lit(1), c["end0"] + 1)), " "),
    }
    next_gap, last_gap = c["gap"] - 1 + c["start0"], c["end0"] + 1 - c["back"]
    snapped = (c["start0"] > 0) & (c["gap"] > 0) & (next_gap < c["at"])
    steps["start"] = F.when(snapped, next_gap + 1).otherwise(c["start0"])
    steps["end"] = F.when((c["end0"] < c["n"]) & (c["back"] > 0) & (last_gap > c["start"]), last_gap).otherwise(c["end0"])
    for name, step in steps.items():
        df = df.withColumn(f"_snip_{name}", step)
    body = trim_ws(F.substr(c["flat"], c["start"] + 1, c["end"] - c["start"]))
    around = F.concat(F.when(c["start"] > 0, ELLIPSIS).otherwise(""), body, F.when(c["end"] < c["n"], ELLIPSIS).otherwise(""))
    head = F.concat(F.regexp_replace(F.substr(c["flat"], F.lit(1), F.lit(length)), rf"{WS}+\z", ""), F.lit(ELLIPSIS))
    shown = F.when(c["n"] <= length, c["flat"]).when(c["at"] < 0, head).otherwise(around)
    return df.withColumn(out, shown).drop(*(f"_snip_{n}" for n in steps))


def cited_pages(c: Column) -> Column:
    """Pages of [p.N] and [p.N-M] marks in order (the first of a range); page 0 is none."""
    found = F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))
    return F.filter(found, lambda p: p > 0)


def citation_parts(c: Column) -> Column:
    """Alternating text and citation parts: structs of (kind, text, page), empty texts left out."""
    mark = r"(?i)(?=\[p\.\s*0*[1-9]\d*(?:\s*[-\x{2013}]\s*\d+)?\])|(?<=\])"
    pieces = F.filter(F.split(c, mark, -1), lambda x: x != "")

    def part(x: Column) -> Column:
        n = F.regexp_extract(F.lower(x), r"^\[p\.\s*(\d+)(?:\s*[-\x{2013}]\s*\d+)?\]\z", 1).try_cast("int")
        cited = F.coalesce(n > 0, F.lit(False))
        return F.struct(
            F.when(cited, "citation").otherwise("text").alias("kind"), x.alias("text"), F.when(cited, n).alias("page")
        )

    return F.transform(pieces, part)


def format_passage(number: Column, page: Column, end_page: Column, headings: Column, text: Column) -> Column:
    pages = F.when(page == end_page, page.cast("string")).otherwise(F.concat_ws("-", page, end_page))
    path = F.when(F.size(headings) > 0, F.concat(F.lit(" · "), F.array_join(headings, " > "))).otherwise("")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] (p."), pages, path, F.lit(")\n"), text)


def embedding_text(headings: Column, text: Column) -> Column:
    return F.array_join(F.concat(headings, F.array(text)), "\n")


def query_text(model: str, query: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX[model]), query)


def cache_key(text: Column) -> Column:
    """Key of an embedding in the cache: 16 hex digits of the text's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def document_key(name: Column, size: Column) -> Column:
    return F.concat_ws(":", F.lit("file"), name, size.cast("string"))


def vector_key(doc: Column, model: str | None = None) -> Column:
    return F.concat(doc, F.lit(f"|local:{model}" if model else "|cloud"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def page_list(pages: Column) -> Column:
    """"page 2" or "pages 2, 3 and 5"."""
    texts = F.transform(pages, lambda p: p.cast("string"))
    most = F.array_join(F.slice(texts, F.lit(1), F.greatest(F.size(texts) - 1, F.lit(0))), ", ")
    last = F.element_at(texts, -1)
    return F.when(F.size(pages) == 1, F.concat(F.lit("page "), last)).when(
        F.size(pages) > 1, F.concat(F.lit("pages "), most, F.lit(" and "), last)
    )


def model_read_summary(found: Column, discarded: Column) -> Column:
    """What a machine reading came to: results found, and those that the report doesn't have."""
    none = F.lit("AI found no further results in the text.")
    some = F.concat(F.lit("AI found "), plural(found, "result"), F.lit(" in the text."))
    verb = F.when(discarded == 1, "was").otherwise("were")
    gone = F.concat(F.lit(" "), discarded.cast("string"), F.lit(" more "), verb, F.lit(" not in the report and "), verb, F.lit(" dropped."))
    return F.concat(F.when(found == 0, none).otherwise(some), F.when(discarded == 0, "").otherwise(gone))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def js_number(x: Column) -> Column:
    """A double as scripts print it: without a trailing .0."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))


def lit_terms(terms: Sequence[str]) -> Column:
    return F.array(*map(F.lit, terms))
