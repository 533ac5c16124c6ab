"""Scalar text functions as Columns; none of them is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from discloq import dictionaries as D

TOKEN = r"[0-9][0-9,.]*%?|[\p{L}]+"


def clean_cell(c: Column) -> Column:
    """Table cell: wrapped lines joined, split decimals repaired, blanks squeezed, pipes replaced."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")
    s = F.regexp_replace(s, r"[ \t]*\n[ \t]*", "")
    s = F.regexp_replace(s, r"(\d)\s*\.\s*(\d)", "$1.$2")
    return F.replace(F.trim(F.regexp_replace(s, r"[ \t]{2,}", " ")), F.lit("|"), F.lit("/"))


def cn_number(c: Column) -> Column:
    """Chinese numeral of 1 to 99 as int."""
    at = F.instr(c, "十")
    of = lambda x: F.when(F.length(x) > 0, F.instr(F.lit("一二三四五六七八九"), x)).otherwise(0)
    tens = F.when(at > 1, of(F.substring(c, 1, 1))).otherwise(1)
    ones = of(F.substr(c, at + 1))
    return F.when(at > 0, tens * 10 + ones).otherwise(of(c))


def norm_number(c: Column) -> Column:
    """Without white space and separators, so that numbers can be compared as substrings."""
    return F.regexp_replace(c, r"(?U)[\s,，、]", "")


def dedupe_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""), 1, 24)


def citation(company: Column, kind: Column, section: Column, page: Column) -> Column:
    return F.concat_ws("·", company, kind, section, F.concat(F.lit("P"), page.cast("string"), F.lit("页")))


def cited_company(cite: Column) -> Column:
    return F.nullif(F.regexp_extract(cite, "^([^·]+)·", 1), F.lit(""))


def page_list(c: Column) -> Column:
    """All P<number>, each once, in order, joined; a dash where there is none."""
    found = F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(P\d+)"), F.lit(1))), "·")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("—"))


def strip_markup(c: Column) -> Column:
    """HTML without scripts, styles and comments; tags are spaces, blanks squeezed."""
    s = F.regexp_replace(c, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sentences(c: Column, latin: bool = False) -> Column:
    """Cut after 。！？; with ``latin`` also after .!? before white space, so decimals stay whole."""
    marked = F.regexp_replace(c, "([。！？])", "$1\u0001")
    if latin:
        marked = F.regexp_replace(marked, r"([.!?])(\s|\z)", "$1\u0001$2")
    return F.split(marked, "\u0001")


def has_number(c: Column) -> Column:
    return c.rlike("[0-9]")


def to_simplified(c: Column, pairs: dict[str, str]) -> Column:
    """Character by character; ``pairs`` maps traditional characters to simplified ones."""
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def expand_synonyms(c: Column, groups: list[list[str]] = D.SYNONYMS) -> Column:
    """For each group with a member in the text: its members that are not."""
    parts = [F.when(contains_any(c, g), F.filter(F.array(*map(F.lit, g)), lambda w: ~F.contains(c, w))).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.flatten(F.array(*parts))


def detect_names(c: Column, aliases: dict[str, str] = D.ALIASES) -> Column:
    """Names in the text, by full or short name, in the order of the table."""
    return F.filter(F.array(*(F.when(c.contains(n) | c.contains(a), n) for n, a in aliases.items())), lambda x: x.isNotNull())


def strip_names(c: Column, aliases: dict[str, str] = D.ALIASES) -> Column:
    """Each name a blank, white space squeezed, blanks and ，,、。？? trimmed; the text itself if
    nothing is left."""
    s = reduce(lambda s, p: F.replace(F.replace(s, F.lit(p[0]), F.lit(" ")), F.lit(p[1]), F.lit(" ")), aliases.items(), c)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^[ ，,、。？?]+|[ ，,、。？?]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), c)


def focus_terms(query: Column, most: int = 6, groups=D.SYNONYMS, words=D.DOMAIN_WORDS) -> Column:
    """Whole groups of synonyms that are met, then words of the domain, longest first."""
    hay = F.concat_ws(" ", query, F.array_join(expand_synonyms(query, groups), " "))
    whole = [F.when(contains_any(hay, g), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in groups]
    ordered = sorted(dict.fromkeys([*words, *(w for g in groups for w in g)]), key=lambda w: -len(w))
    rest = F.filter(F.array(*map(F.lit, ordered)), lambda w: F.contains(hay, w))
    return F.slice(F.array_distinct(F.concat(F.flatten(F.array(*whole)), rest)), 1, most)


def token_runs(c: Column) -> Column:
    """Numbers, runs of Han characters and other words."""
    return F.regexp_extract_all(c, F.lit(r"([0-9][0-9,.]*%?|\p{IsHan}+|[\p{L}&&[^\p{IsHan}]]+)"), F.lit(1))


def han_pairs(t: Column) -> Column:
    """Overlapping pairs of a run of Han characters; any other run itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    return F.when((F.length(t) > 1) & t.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(t))


def domain_hits(c: Column, words=D.DOMAIN_WORDS) -> Column:
    """Words of the domain that the text contains, each once."""
    none = F.array().cast("array<string>")
    return F.when(c.rlike(r"\p{IsHan}"), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))).otherwise(none)


def is_token(t: Column) -> Column:
    """No stop word, no single character but a letter or digit, no digit string over 8."""
    return ~t.isin(*D.STOP_WORDS) & ((F.length(t) > 1) | t.rlike("^[0-9a-z]$")) & ~t.rlike("^[0-9]{9,}$")


def tokens(c: Column) -> Column:
    """All tokens of a text, lower-cased, in order, then words of the domain, as one array."""
    return F.filter(F.concat(F.flatten(F.transform(token_runs(c), lambda t: han_pairs(F.lower(t)))), domain_hits(c)), is_token)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def markdown_table(rows: Column) -> Column:
    """A grid (array of arrays of strings) as a pipe table: empty rows go, short rows are
    padded, empty columns go if two or more stay."""
    some = F.filter(F.transform(rows, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(some, lambda r: F.size(r)))
    full = F.transform(some, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    used = F.filter(F.sequence(F.lit(1), width), lambda j: F.exists(full, lambda r: F.element_at(r, j.cast("int")) != ""))
    cols = F.when(F.size(used) >= 2, used).otherwise(F.sequence(F.lit(1), width))
    kept = F.transform(full, lambda r: F.transform(cols, lambda j: F.element_at(r, j.cast("int"))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(cols, lambda j: F.lit("---")), "|"), F.lit("|"))
    body = F.concat(F.array(line(F.element_at(kept, 1)), rule), F.transform(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), line))
    return F.when(F.size(some) > 0, F.array_join(body, "\n")).otherwise("")
