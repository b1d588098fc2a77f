"""HTML: pages without what may run, and Markdown as HTML.

Both parse, so they run as Arrow UDFs, a text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go with all they hold; protocols an address may have.
FORBIDDEN = frozenset(("script", "style", "iframe", "object", "embed"))
LINKED = ("http", "https", "mailto")
SHOWN = ("http", "https")
SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):(.*)", re.I | re.S)
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def is_safe(url: str | None, schemes: Iterable[str]) -> bool:
    """An absolute address of an allowed protocol, without control characters."""
    found = SCHEME.fullmatch((url or "").strip())
    return bool(found and found[1].lower() in schemes and found[2].strip("/") and not CONTROL.search(url.strip()))


class Cleaner(HTMLParser):
    """Copies a page but for forbidden elements, handlers, styles and unsafe addresses. Tags that lose nothing stay as written."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.page, self.lines = page, [0, *(found.end() for found in re.finditer("\n", page))]
        self.out: list[str] = []
        self.inside: list[str] = []  # open forbidden elements

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        if tag in FORBIDDEN:
            if tag != "embed":  # as browsers do, whether or not the tag claims to be closed
                self.inside.append(tag)
                if closed and tag in self.CDATA_CONTENT_ELEMENTS:
                    self.set_cdata_mode(tag)
            return
        if self.inside:
            return
        kept = [(name, value) for name, value in attrs if self.keeps(name, value)]
        if len(kept) == len(attrs):
            self.out.append(self.get_starttag_text() or "")
        else:
            inner = "".join(f" {n}" if v is None else f' {n}="{escape(v)}"' for n, v in kept)
            self.out.append(f"<{tag}{inner}{' /' if closed else ''}>")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs, True)

    @staticmethod
    def keeps(name: str, value: str | None) -> bool:
        if name.startswith("on") or name == "style":
            return False
        return is_safe(value, LINKED) if name == "href" else is_safe(value, SHOWN) if name == "src" else True

    def handle_endtag(self, tag: str) -> None:
        if tag in FORBIDDEN:
            if tag in self.inside:
                del self.inside[self.inside.index(tag) :]
        else:
            self.copy(f"</{tag}>")

    def copy(self, text: str) -> None:
        if not self.inside:
            self.out.append(text)

    def handle_data(self, data: str) -> None:
        self.copy(data)

    def handle_entityref(self, name: str) -> None:
        self.reference(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self.reference(f"&#{name}")

    def reference(self, text: str) -> None:
        """A reference stays as written, which may be without its semicolon."""
        line, column = self.getpos()
        end = self.lines[line - 1] + column + len(text)
        self.copy(text + (";" if self.page.startswith(";", end) else ""))

    def handle_comment(self, data: str) -> None:
        self.copy(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.copy(f"<!{decl}>")


def clean(html: str) -> str:
    parser = Cleaner(html)
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


BLOCK = re.compile(r"(?P<level>#{1,6})\s+(?P<heading>.*)|(?P<number>\d+)\.\s+(?P<ol>.*)|[-*]\s+(?P<ul>.*)")
CODE = re.compile(r"`([^`]+)`")
STRONG = re.compile(r"\*\*([^*]+)\*\*")
EMPHASIS = re.compile(r"\*([^*]+)\*")
ADDRESS = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")


def inline(text: str) -> str:
    """Escaped text with code, strong, emphasis and safe links."""

    def link(found: re.Match) -> str:
        url = found[2].replace("&amp;", "&")
        return f'<a href="{found[2]}" target="_blank" rel="noopener">{found[1]}</a>' if is_safe(url, LINKED) else found[1]

    parts = CODE.split(escape(text, quote=False))
    for i in range(0, len(parts), 2):
        parts[i] = ADDRESS.sub(link, EMPHASIS.sub(r"<em>\1</em>", STRONG.sub(r"<strong>\1</strong>", parts[i])))
    return "".join(f"<code>{p}</code>" if i % 2 else p for i, p in enumerate(parts))


def rendered(markdown: str) -> str:
    """Headings, lists, fenced code and paragraphs, a line each; a list ends at any other line."""
    out: list[str] = []
    listed, fence = "", None

    def switch(to: str) -> None:
        nonlocal listed
        if listed != to:
            out.extend(tag for tag in (f"</{listed}>" if listed else "", f"<{to}>" if to else "") if tag)
            listed = to

    for line in markdown.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            if fence is None:
                switch("")
                fence = []
            else:
                out.append(f"<pre><code>{escape(chr(10).join(fence), quote=False)}</code></pre>")
                fence = None
            continue
        if fence is not None:
            fence.append(line)
            continue
        found = BLOCK.fullmatch(bare)
        if found and found["ol"] is not None:
            switch("ol")
            out.append(f"<li>{inline(found['ol'])}</li>")
        elif found and found["ul"] is not None:
            switch("ul")
            out.append(f"<li>{inline(found['ul'])}</li>")
        else:
            switch("")
            if found:
                out.append(f'<div class="heading">{inline(found["heading"])}</div>')
            elif bare:
                out.append(f"<p>{inline(bare)}</p>")
    switch("")
    if fence is not None:
        out.append(f"<pre><code>{escape(chr(10).join(fence), quote=False)}</code></pre>")
    return "\n".join(out)


def _each(f):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


def cleaned(html: Column) -> Column:
    """Null stays null."""
    return _each(clean)(html)


def from_markdown(text: Column) -> Column:
    """Null stays null."""
    return _each(rendered)(text)
