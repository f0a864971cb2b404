"""Text expressions: Column -> Column, all evaluated inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACES = r"(?U)[\s\x1c-\x1f]+"

# Code point ranges deleted from corpus text. The last range also covers CJK,
# kana, Hangul and the variation selector; U+1F900 and above are kept.
CORPUS_EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}\x{24C2}-\x{1F251}"
)
# Code point ranges deleted from web page text.
PAGE_EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{1F30D}\x{FE0F}"
)

# Fixed values of the summariser's budget.
DIRECT_LIMIT = 1024
CHUNK_LIMIT = 900
LINE_MIN = 30


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that refers to it."""
    return F.transform(F.array(value), body)[0]


def py_strip(c: Column) -> Column:
    """Strip all Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def _replace_above(c: Column, floor: str, ranges: str) -> Column:
    """Delete characters of ``ranges``, all of which lie at or above ``floor``.

    Most texts hold no such character. Testing for one with a single range is several times
    faster than matching a class of many ranges, so only the others are rewritten.
    """
    affected = c.rlike(rf"[\x{{{floor}}}-\x{{10FFFF}}]")
    return F.when(affected, F.regexp_replace(c, f"[{ranges}]+", "")).otherwise(c)


# deleted characters by name, each with the least of them
EMOJI = {"corpus": ("24C2", CORPUS_EMOJI), "page": ("2600", PAGE_EMOJI)}


def strip_emoji(c: Column, emoji: str = "corpus") -> Column:
    return _replace_above(c, *EMOJI[emoji])


def strip_corpus_emoji(c: Column) -> Column:
    return strip_emoji(c, "corpus")


def keeps_corpus_text(c: Column, emoji: str = "corpus") -> Column:
    """True when ``strip_emoji(c, emoji)`` would be neither null nor empty.

    Stops at the first character that survives, so it is a cheap filter to push below the
    rewrite of the whole text.
    """
    return c.isNotNull() & c.rlike(f"[^{EMOJI[emoji][1]}]")


def strip_page_emoji(c: Column) -> Column:
    return strip_emoji(c, "page")


def kept_lines(c: Column, min_length: int = LINE_MIN) -> Column:
    """Stripped lines without emoji, those above ``min_length`` only."""
    lines = F.transform(F.split(strip_page_emoji(c), "\n"), py_strip)
    return F.filter(lines, lambda s: F.length(s) > min_length)


def clean_lines(c: Column, min_length: int = LINE_MIN) -> Column:
    """Drop emoji, then every line whose stripped length is not above ``min_length``."""
    return py_strip(F.array_join(kept_lines(c, min_length), "\n"))


def clean_title(c: Column) -> Column:
    return py_strip(strip_page_emoji(c))


def sentences(c: Column) -> Column:
    """Split after ``! ``, ``? `` and ``. ``; a literal ``|`` is a boundary too."""
    marked = c
    for stop in ("!", "?", "."):
        marked = F.replace(marked, F.lit(f"{stop} "), F.lit(f"{stop}|"))
    return F.filter(F.transform(F.split(marked, r"\|"), py_strip), lambda s: s != "")


def words(c: Column, pieces: int = -1) -> Column:
    """Whitespace-separated words; with ``pieces`` the text is split into at most so many."""
    return F.filter(F.split(c, SPACES, pieces), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def count_tokens(c: Column, special: int = 2, count=count_words) -> Column:
    """Tokens of a whole text: what ``count`` finds, plus ``special`` marker tokens.

    ``count`` is any Column -> Column; whitespace words stand in for a tokenizer.
    """
    return count(c) + F.lit(special)


def summary_budget(n: Column) -> Column:
    """``struct(min_len, max_len)`` for a text of ``n`` tokens."""
    longest = F.least(F.lit(128), F.greatest(F.lit(30), F.floor(n * F.lit(0.15)).cast("int")))
    shortest = F.greatest(F.lit(10), F.floor(longest * F.lit(0.4)).cast("int"))
    return F.struct(shortest.alias("min_len"), longest.alias("max_len"))


def route(n: Column) -> Column:
    return F.when(n <= DIRECT_LIMIT, "direct").otherwise("chunked")


def paragraphs(c: Column) -> Column:
    """Lines in order, empty ones kept."""
    return F.split(c, "\n")


def plausible_summary_length(summary: Column, source: Column) -> Column:
    got, base = count_words(summary), count_words(source)
    low = F.least(F.lit(5), F.floor(base * F.lit(0.1)).cast("int"))
    high = F.greatest(F.lit(150), F.floor(base * F.lit(0.5)).cast("int"))
    return (low < got) & (got < high)


def as_percent(c: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(c * 100 + F.lit(0.5)).cast("int")


def as_score(c: Column) -> Column:
    return F.round(c * 100, 4)
