"""Text expressions: index tokens, CJK bigrams, overlapping windows."""

import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their bases, by the rule of Unicode: the first letter of the decomposition, for Latin, Greek and Cyrillic.
_BASES = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if c == c.lower() and unicodedata.normalize("NFD", c)[0] != c}
MARKED, PLAIN = "".join(_BASES), "".join(_BASES.values())
_PLAIN = np.arange(0x2000, dtype="<u4")
_PLAIN[[ord(c) for c in MARKED + "ςſ"]] = [ord(c) for c in PLAIN + "σs"]
# Characters that may have a base: the ranges above, and the sign for angstrom, whose small letter is in them.
_MARKS = r"[\u00c0-\u052f\u1e00-\u1fff\u212b]"
# Kana, ideographs, hangul and compatibility ideographs, which are written without blanks.
CJK_RANGES = r"\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks. (Splitting at what stands between them: extracting matches copies the text for each.)"""
    plain = F.when(text.rlike(_MARKS), F.translate(F.lower(text), MARKED + "ςſ", PLAIN + "σs")).otherwise(F.lower(text))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def spaced(text: Column) -> Column:
    """The tokens of a text, marks and all, with blanks between them: one text, where a list costs a copy for each token. ``unmarked`` gives their plain forms."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{Co} \t-\r]+", " ")


def unmarked(text: str) -> str:
    """A lower-cased text without marks, as in ``tokens``: a mark's base is of the mark's own kind, so that it makes no difference whether a text is cut before or after."""
    if text.isascii():
        return text
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    small = c < len(_PLAIN)
    c[small] = _PLAIN[c[small]]
    return c.tobytes().decode("utf-32-le")


def query_tokens(text: Column) -> Column:
    """Runs of letters and digits of a query, as written."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """CJK runs as overlapping pairs (a single character stays), other runs trimmed, joined by blanks.

    One pass: a character inside a run is written at the end of a pair and again at the begin of the next, and an edge of a run, with the blanks at it, is one blank. (Extracting the runs copies the text for each.)
    """
    c, w = f"[{CJK_RANGES}]", r"[\s\p{Z}]"
    other = rf"[^{CJK_RANGES}\s\p{{Z}}]"
    spread = F.regexp_replace(text, rf"(?<={c})({c})(?={c})|(?<={c}){w}+(?={c})|(?<={c}){w}*(?={other})|(?<={other}){w}*(?={c})", "$1 $1")
    trimmed = lambda x: F.regexp_replace(x, rf"^{w}+|{w}+\z", "")
    return trimmed(F.when(text.rlike(c), spread).otherwise(text))


def excerpt(text: Column, terms: Column, most: int = 24) -> Column:
    """``most`` words from a little before the first that holds a term; without one, from the start. Cut ends are marked."""
    words = F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: F.arrays_overlap(tokens(w), terms)), True)
    begin = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - 4).cast("int")
    shown = F.array_join(F.slice(words, begin, most), " ")
    mark = lambda on: F.when(on, F.lit("…")).otherwise(F.lit(""))
    return F.concat(mark(begin > 1), shown, mark(F.size(words) >= begin + most))


def windows(length: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of ``size`` that overlap by ``overlap``; one window if the text fits."""
    last = F.greatest(F.lit(0), F.ceil((length - size) / (size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - overlap))


def title(text: Column, most: int = 80) -> Column:
    """First line that is not blank, without outer blanks, cut to ``most`` code points."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"[^ \t-\r][^\n]*", 0)
    return F.substring(F.regexp_replace(line, r"[ \t-\r]+\z", ""), 1, most)


def readable(text: Column) -> Column:
    """Length of the text without links and outer blanks."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://[^ \t-\r]+", ""))).cast("long")
