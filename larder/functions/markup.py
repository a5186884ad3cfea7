"""Markdown into chunks with line ranges, and HTML into readable text. Both walk one text at a time, inside Arrow batches."""

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TITLE = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,}).*", re.S)
CHUNK = "array<struct<ordinal:int,line_start:int,line_end:int,heading:string,text:string>>"


def _heading(line: str) -> str | None:
    m = _TITLE.fullmatch(line)
    return re.sub(r"[ \t]+#+[ \t]*$", "", (m[1] or "").strip()).strip() if m else None


def _blocks(lines: list[str]):
    """(first line, line after the last, heading, has a fence) of each block. A heading goes with the block below it."""
    i, n, heading = 0, len(lines), None
    solid = lambda j: next((x for x in range(j, n) if lines[x].strip()), n)
    while (i := solid(i)) < n:
        start = body = i
        if (found := _heading(lines[i])) is not None:
            heading, body = found, solid(i + 1)
            if body == n or _heading(lines[body]) is not None:
                yield start, start + 1, heading, False
                i = body
                continue
        if fence := _FENCE.fullmatch(lines[body]):
            close = re.compile(rf" {{0,3}}{fence[1]}{fence[1][0]}*\s*")
            i = next((x + 1 for x in range(body + 1, n) if close.fullmatch(lines[x])), n)
        else:
            i = next((x for x in range(body + 1, n) if not lines[x].strip() or _heading(lines[x]) is not None or _FENCE.fullmatch(lines[x])), n)
        yield start, i, heading, bool(fence)


def chunks_of(text: str | None, size: int = 1200, overlap: int = 120) -> list[tuple]:
    """(ordinal, first line, last line, heading, text): blocks, small neighbours under one heading packed, long ones cut with overlap."""
    lines = (text or "").splitlines()
    packed: list[list] = []
    for start, end, heading, fenced in _blocks(lines):
        last = packed[-1] if packed else None
        if last and last[2] == heading and not fenced and not last[3] and len("\n".join(lines[last[0] : end])) <= size:
            last[1] = end
        else:
            packed.append([start, end, heading, fenced])
    out = []
    for start, end, heading, _ in packed:
        block = "\n".join(lines[start:end])
        for at in range(0, max(1, len(block) - overlap), size - overlap):
            piece = block[at : at + size]
            if piece.strip():
                first = start + 1 + block.count("\n", 0, at)
                out.append((len(out), first, first + piece.count("\n", 0, len(piece) - 1), heading, piece))
    return out


def markdown_chunks(files: DataFrame, text: str = "text", size: int = 1200, overlap: int = 120) -> DataFrame:
    """One row per chunk of ``files``: all its columns but ``text``, and ordinal, line_start, line_end, heading, text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("ordinal", "line_start", "line_end", "heading", "text"), c)) for c in chunks_of(t, size, overlap)] for t in texts], dtype=object)

    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.explode(F.pandas_udf(cut, CHUNK)(text)).alias("_c")).select(*kept, "_c.*")


def index_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The Markdown files of an item that are indexed, with ``place``: content.md first, then those of transcript, ocr and visual by folded path."""
    low = F.lower(path)
    parts = F.split(low, "/")
    kept = low.isin("content.md", "transcript.md", "ocr.md", "visual.md") | low.rlike(r"\A(transcript|ocr)/.*\.md\z")
    kept &= ~F.array_contains(parts, "assets") & (F.element_at(parts, -1) != "notes.md")
    return files.where(kept).withColumn("place", F.struct((low != "content.md").alias("rest"), low.alias("folded"), F.col(path).alias("path")))


def number_chunks(chunks: DataFrame, item: list[str]) -> DataFrame:
    """``ordinal`` counted over all files of an item, in the order of ``place``."""
    w = Window.partitionBy(*item).orderBy("place", "ordinal")
    return chunks.withColumn("ordinal", F.row_number().over(w) - 1)


# Tags whose begin and end part blocks.
_PARTING = ("p", "div", "figure", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "ul", "li")
_ITEM, _NEXT = re.compile(r"- |1\. "), re.compile(r"- |\d.{0,2}\. ", re.S)


class _Tokens(HTMLParser):
    """A page as a flat list: ("<p", attributes), ("</p", None) or ("text", what it says)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.list: list[tuple] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.list.append(("<" + tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.list.append(("</" + tag, None))

    def handle_data(self, data):
        self.list.append(("text", data))


def redirect_target(href: str) -> str:
    """The address behind a redirect of link.zhihu.com, which is escaped twice, or the address itself."""
    got = urlparse(href)
    target = parse_qs(got.query).get("target", ()) if got.netloc == "link.zhihu.com" else ()
    return next((unquote(t) for t in target), href)


def _link(words: str, href: str) -> str:
    """What a link reads as: its words, and its address in brackets where it is a web address that the words do not give."""
    address = href if href.startswith("http") else ""
    return f"{words} ({address})" if words and address not in ("", words) else words or address


def _linked(tokens_):
    """The tokens with each link as one text; words of a link that never ends are left out."""
    words, href = None, ""
    for name, value in tokens_:
        if name == "<a":
            words, href = [], redirect_target(value.get("href") or "")
        elif name == "</a":
            if words is not None:
                yield "text", _link(" ".join("".join(words).split()), href)
            words = None
        elif name == "text" and words is not None:
            words.append(value)
        else:
            yield name, value


def _steps(tokens_):
    """What the tokens do: ("say", text), or ("part", "code", "end") at the end of a block, the begin of a preformatted one and its end."""
    lists: list = []  # of the open lists, the next number, or None where they are not numbered
    for name, value in tokens_:
        tag = name.lstrip("</")
        if name == "text":
            yield "say", value
        elif name == "<br":
            yield "say", "\n"
        elif tag == "pre":
            yield ("end" if name[1] == "/" else "code"), ""
        elif tag in _PARTING:
            yield "part", ""
            if name in ("<ol", "<ul"):
                lists.append(1 if tag == "ol" else None)
            elif name in ("</ol", "</ul"):
                lists[-1:] = []
            elif name == "<li" and lists:
                yield "say", "- " if lists[-1] is None else f"{lists[-1]}. "
                lists[-1] = lists[-1] and lists[-1] + 1


def _paragraphs(steps):
    """The blocks that the steps make: blanks within a line as one and empty lines left out, preformatted ones as they are, in a fence."""
    said, code = "", False
    for step, text in [*steps, ("part", "")]:
        if step == "say":
            said += text
            continue
        if step == "end":
            block = "```\n" + said.strip("\n") + "\n```" if said.strip() else ""
        elif code:
            block = said.rstrip()
        else:
            block = "\n".join(line for line in map(" ".join, map(str.split, said.split("\n"))) if line)
        if block.strip():
            yield block
        said, code = "", step == "code" or (code and step == "part")


def html_text(html: str | None) -> tuple[str, list[str]]:
    """Readable text of a page (blocks parted by a blank line, list items by a line break) and its images, distinct in order."""
    found = _Tokens(html or "").list
    pictures = (at.get("data-actualsrc") or at.get("src") or "" for name, at in found if name == "<img")
    text, item = [], False
    for block in _paragraphs(_steps(_linked(found))):
        before, item = item, bool((_NEXT if item else _ITEM).match(block))
        text += ["\n" if before and item else "\n\n", block]
    return "".join(text).strip(), list(dict.fromkeys(p for p in pictures if p.startswith("http")))


def render_html(html: Column) -> Column:
    """(text, images) of HTML; null counts as empty."""

    def render(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_text(p) for p in pages], columns=["text", "images"])

    return F.pandas_udf(render, "text string, images array<string>")(html)
