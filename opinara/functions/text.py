"""Row-level text functions as Column expressions.

Null handling is stated per function; "empty" means null or the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import config

# The patterns of the cleaning steps.
# letters, digits and blanks of all scripts, where the classes of Java would be plain ASCII
_LETTER, _DIGIT, _BLANK = r"\p{L}\p{N}_", r"\p{Nd}", r"\s\x1C-\x1F\x85\p{Z}"
EMAIL = rf"[{_LETTER}.\-]+@[{_LETTER}.\-]+\.[{_LETTER}]+"
PHONE = rf"\+?{_DIGIT}{{1,4}}[\-.{_BLANK}]?\(?{_DIGIT}{{1,3}}\)?[\-.{_BLANK}]?{_DIGIT}{{1,4}}[\-.{_BLANK}]?{_DIGIT}{{1,4}}[\-.{_BLANK}]?{_DIGIT}{{1,9}}"
URL = rf"https?://[^{_BLANK}]+|www\.[^{_BLANK}]+"
BLANKS = rf"[{_BLANK}]+"
HANDLE = r"@[a-zA-Z0-9_]+|u/[a-zA-Z0-9_\-]+"
ASTRAL = r"[\x{10000}-\x{10FFFF}]+"
WORD = r"[\p{L}\p{N}_]+"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; the last one whatever it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def strip_details(c: Column) -> Column:
    """Without e-mail addresses, number runs, links, handles and astral symbols, blanks collapsed; empty gives ''."""
    for pattern in (EMAIL, PHONE, URL, HANDLE, ASTRAL):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(or_empty(c), BLANKS, " "))


def strip_markup(c: Column) -> Column:
    """Without tags, curly quotes straightened; empty gives ''."""
    return or_empty(F.translate(F.regexp_replace(c, r"<[^>]*>", ""), "‘’“”", "''\"\""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(WORD), 0)


def meaningful_words(c: Column, stop_words: list[str] | None = None) -> Column:
    """Number of words outside the stop list; empty gives 0."""
    stop = stop_words or config.LENGTH_STOP_WORDS
    return F.size(F.filter(words(c), lambda w: ~w.isin(*stop)))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text contains any of the keywords; null gives false, no keywords give false."""
    low = F.lower(or_empty(c))
    out = F.lit(False)
    for k in keywords:
        out = out | low.contains(k)
    return out


def whitespace_tokens(c: Column) -> Column:
    return F.split(F.lower(or_empty(c)), r"\s+")


def language_policy(lang: Column, text: Column) -> Column:
    """The label a text is kept under, or null: an allowed code, else ``hinglish`` if a listed word occurs."""
    hinglish = F.arrays_overlap(whitespace_tokens(text), F.array(*[F.lit(w) for w in config.HINGLISH_WORDS]))
    return F.when(lang.isin(*config.ALLOWED_LANGUAGES), lang).when(hinglish, F.lit("hinglish"))


def language_audit(lang: Column, text: Column) -> Column:
    """The stricter form: ``hinglish (xx)`` only for codes that Hinglish is mistaken for; empty text gives null."""
    hinglish = F.arrays_overlap(whitespace_tokens(text), F.array(*[F.lit(w) for w in config.HINGLISH_AUDIT_WORDS]))
    audited = F.when(lang.isin(*config.ALLOWED_LANGUAGES), lang).when(lang.isin(*config.CONFUSABLE_LANGUAGES) & hinglish, F.concat(F.lit("hinglish ("), lang, F.lit(")")))
    return F.when(or_empty(text) != "", audited)


def _gazetteer() -> tuple[str, list[tuple[str, str]]]:
    """One pattern of all keys, longer ones first, and the keys in order of rank: cities before regions, longer first."""
    longest = lambda d: sorted(d.items(), key=lambda kv: -len(kv[0]))
    ranked = longest(config.CITIES) + longest(config.REGIONS)
    keys = "|".join(re.escape(k) for k in sorted((k for k, _ in ranked), key=len, reverse=True))
    return rf"(?<![\p{{L}}\p{{N}}_])({keys})(?![\p{{L}}\p{{N}}_])", ranked


def _places(c: Column) -> Column:
    """Ranks of the gazetteer keys in a text.  A key inside a longer one (a city with a prefix) is found as the longer
    one, which stands for the same name and ranks higher."""
    pattern, ranked = _gazetteer()
    rank = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(ranked) for x in (k, i)])
    return F.transform(F.regexp_extract_all(F.lower(or_empty(c)), F.lit(pattern), 1), lambda k: rank[k])


def location_one(c: Column) -> Column:
    """The first gazetteer hit: cities before regions, longer keys first; null if none."""
    names = F.array(*[F.lit(v) for _, v in _gazetteer()[1]])
    return F.get(names, F.array_min(_places(c)))


def location_all(c: Column) -> Column:
    """The distinct names of all gazetteer hits, sorted."""
    names = F.array(*[F.lit(v) for _, v in _gazetteer()[1]])
    return F.array_sort(F.array_distinct(F.transform(_places(c), lambda i: F.get(names, i))))


def without_blanks(c: Column) -> Column:
    """Lower-cased, without blanks; empty gives ''."""
    return F.regexp_replace(F.lower(or_empty(c)), BLANKS, "")


def shingles(c: Column, k: int = config.SHINGLE) -> Column:
    """Distinct k-character shingles of the lower-cased text without blanks; shorter texts give none."""
    return F.array_distinct(F.regexp_extract_all(without_blanks(c), F.lit(rf"(?s)(?=(.{{{k}}}))."), 1))


def device(c: Column) -> Column:
    """The first device class of which a keyword occurs, else ``mobile``."""
    out = None
    for name, keys in config.DEVICE_RULES:
        out = F.when(contains_any(c, keys), name) if out is None else out.when(contains_any(c, keys), name)
    return out.otherwise("mobile")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}_\s\-]", ""), r"[\s_\-]+", "_"), F.lit("_"))


def link(source: Column, key: Column, templates: dict[str, str]) -> Column:
    """A link per source from a template with ``{id}``; thread prefixes are cut; other sources give ``#``."""
    clean = F.regexp_replace(key, r"^t[13]_", "")
    out = F.lit("#")
    for name, template in templates.items():
        head, _, tail = template.partition("{id}")
        out = F.when(source == name, F.concat(F.lit(head), clean if "{id}" in template else F.lit(""), F.lit(tail))).otherwise(out)
    return out


def cut(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def sha_id(source: Column, text: Column, at: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, text, at), 256)


def md5_id(kind: Column, text: Column, at: Column) -> Column:
    return F.md5(F.concat_ws("_", kind, F.substring(text, 1, 50), at))


def discovery_path(c: Column, all_discovery: bool = False) -> Column:
    """``discovery`` if a discovery keyword occurs, else the surface group: ads, bugs, widgets, general."""
    surface = F.when(contains_any(c, ["ad"]), "unrelated_ads").when(contains_any(c, config.BUG_KEYWORDS), "unrelated_bugs").when(contains_any(c, ["widget"]), "unrelated_widgets").otherwise("unrelated_general")
    return F.lit("discovery") if all_discovery else F.when(contains_any(c, config.DISCOVERY_KEYWORDS), "discovery").otherwise(surface)


def mentions_premium(metadata: Column, text: Column) -> Column:
    """Whether metadata or text mention the paid plan."""
    return or_empty(F.lower(metadata)).contains("premium") | or_empty(F.lower(text)).contains("premium")


def terms(c: Column) -> Column:
    """Words of 3 to 15 plain letters."""
    return F.filter(words(c), lambda w: w.rlike("^[a-z]{3,15}$"))
