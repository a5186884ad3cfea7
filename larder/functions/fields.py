"""Checks and renderings of single fields, as expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that no file may have, and the roots and types of text assets.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10))]
ASSET_ROOTS = ("assets", "transcript", "ocr")
ASSET_TYPES = ("application/json", "text/plain", "text/markdown", "text/vtt")
PLATFORMS = ("bilibili", "github", "x", "zhihu")
SCOPED = ("bilibili", "zhihu")
MAX_ASSET = 2 * 1024 * 1024
BLANKS = " \t\n\x0b\x0c\r"


# Letters whose folded form is another than their lower case, by the rule of Unicode, and the sigmas, whose lower case depends on what follows.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1E944)) if c.casefold() != c.lower() and unicodedata.category(c) != "Cs"} | {"Σ": "σ", "ς": "σ"}


def casefold(s: Column) -> Column:
    """Text folded for comparison without case: lower case, but ß as ss, all sigmas alike and ligatures spelt out."""
    special = "[" + "".join(_FOLDS) + "]"
    table = F.create_map(*[F.lit(x) for kv in _FOLDS.items() for x in kv])
    folded = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c))), "")
    return F.when(s.rlike(special), folded).otherwise(F.lower(s))


def strip(s: Column) -> Column:
    return F.trim(s, F.lit(BLANKS))


def blank(s: Column) -> Column:
    return F.coalesce(strip(s) == "", F.lit(True))


def safe_id(s: Column) -> Column:
    """One path component of plain characters that no system reserves."""
    ok = s.rlike(r"\A[A-Za-z0-9._-]+\z") & ~s.isin(".", "..") & ~s.endswith(".") & ~F.upper(F.split(s, r"\.")[0]).isin(*RESERVED)
    return F.coalesce(ok, F.lit(False))


def safe_path(s: Column) -> Column:
    """A relative path whose every component is safe."""
    return F.coalesce(F.forall(F.split(s, "/"), safe_id), F.lit(False))


def http_url(s: Column) -> Column:
    """An absolute HTTP(S) address with a host, a port in range if any, and no blanks or control characters."""
    host = F.regexp_extract(s, r"\A(?i:https?)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(?::\d*)?(?:[/?#].*)?\z", 1)
    port = F.regexp_extract(s, r"\A[^/]*//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#@:]*):(\d+)(?:[/?#]|\z)", 1)
    return F.coalesce((host != "") & ~s.rlike(r"[\s\p{Z}\p{Cc}]") & ((port == "") | (port.try_cast("int") <= 65535)), F.lit(False))


def plain(s: Column, most: int = 200) -> Column:
    """Without control characters, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(s, r"\p{Cc}", ""), 1, most)


def language(s: Column) -> Column:
    """Letters, digits and ``._-`` of a language tag for a file name; ``subtitle`` if none is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]", ""), r"\A\.+|\.+\z", ""), F.lit("")), F.lit("subtitle"))


def component(s: Column) -> Column:
    """Text as a path component: other characters become dashes."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]", "-"), r"\A\.+|\.+\z", ""), F.lit("")), F.lit("unknown"))


def clock(seconds: Column) -> Column:
    """Seconds, cut to whole ones, as MM:SS, or HH:MM:SS from an hour on."""
    t = F.floor(seconds).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def clock_ms(seconds: Column) -> Column:
    """HH:MM:SS.mmm, half a millisecond to the even one."""
    t = F.rint(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def duration(seconds: Column) -> Column:
    """Whole seconds as 45s, 3m05s or 2h07m."""
    t = F.floor(seconds).cast("long")
    return F.when(t < 60, F.format_string("%ds", t)).when(t < 3600, F.format_string("%dm%02ds", F.floor(t / 60), t % 60)).otherwise(F.format_string("%dh%02dm", F.floor(t / 3600), F.floor(t / 60) % 60))


def tags(raw: Column, most: int = 8, fold=casefold) -> Column:
    """Tags stripped, folded (``fold``) and distinct in order, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(raw, lambda t: fold(strip(t))), lambda t: t != "")), 1, most)


def cjk_share(s: Column) -> Column:
    """Share of CJK characters among those that are not blank."""
    seen = F.length(F.regexp_replace(s, r"[\s\p{Z}]", ""))
    return F.when(seen > 0, F.regexp_count(s, F.lit(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힯豈-﫿]")) / seen).otherwise(0.0)


def summary_fault(body: Column, summary: Column) -> Column:
    """Why a summary is refused: unreadable (fewer than four characters of the body besides addresses and its media section), or not_shorter (than a body of 200 or more); null if it is not."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?ms)^##\s*(媒体|图片).*", ""), r"https?://\S+", "")
    size = F.length(F.coalesce(body, F.lit("")))
    return F.when(F.length(strip(bare)) < 4, "unreadable").when((size >= 200) & (F.length(summary) >= size), "not_shorter")


def tags_fault(body: Column, tags_: Column) -> Column:
    """``no_cjk`` where at least half of a body is CJK and no tag has such a character; else null."""
    some = F.exists(tags_, lambda t: t.rlike(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힯]"))
    return F.when((cjk_share(F.coalesce(body, F.lit(""))) >= 0.5) & ~F.coalesce(some, F.lit(False)), "no_cjk")


def utf8_head(s: Column, most: int) -> Column:
    """The longest start of a text that takes at most ``most`` bytes in UTF-8."""
    raw = F.encode(s, "UTF-8")
    cut = F.substring(raw, 1, most)
    # Up to three bytes of a character that was cut through go.
    tail = F.regexp_replace(F.hex(F.substring(cut, F.lit(-4), F.lit(4))), r"(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", "")
    whole = F.concat(F.substring(cut, F.lit(1), F.octet_length(cut) - 4), F.unhex(tail))
    return F.when(F.octet_length(raw) <= most, s).otherwise(F.decode(whole, "UTF-8"))
