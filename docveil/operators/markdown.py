"""Markdown to well-formed XHTML: a fold over the lines of a text into blocks, and marks inside them.

Headings, rules, fenced code, tables, quotes, lists that nest by indentation, paragraphs; code, strong,
emphasis, links, pictures, line breaks and escapes.
"""

from __future__ import annotations

import re
from html import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_QUOTE = re.compile(r"^ {0,3}> ?")
#: Quotes and lists inside each other.
DEPTH = 40
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|>~])")
_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.DOTALL)
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(\s*<?([^\s()<>]*)>?(?:\s+\"([^\"]*)\")?\s*\)")
_INLINE = ((re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), "strong"), (re.compile(r"(?<!\w)(_)(?=\S)(.+?)(?<=\S)_(?!\w)|(\*)(?=\S)(.+?)(?<=\S)\*", re.DOTALL), "em"))


def inline(text: str) -> str:
    """The marks inside a block. What is code, a link's address or escaped is put aside, so that no other mark is found in it."""
    held: list[tuple[str, str]] = []

    def aside(made: str, bare: str = "") -> str:
        held.append((made, bare))
        return f"\x02{len(held) - 1}\x03"

    def attribute(s: str) -> str:
        return escape(re.sub("\x02(\\d+)\x03", lambda m: held[int(m[1])][1], s))

    def marked(s: str) -> str:
        """An element is put aside whole, so no mark reaches from outside into it."""
        for pattern, tag in _INLINE:
            s = pattern.sub(lambda m, tag=tag: aside(f"<{tag}>{marked(m[2] or m[m.lastindex])}</{tag}>"), s)
        return s

    def link(m: re.Match) -> str:
        title = f' title="{attribute(m[4])}"' if m[4] else ""
        if m[1]:
            return aside(f'<img alt="{attribute(m[2])}" src="{attribute(m[3])}"{title} />')
        return aside(f'<a href="{attribute(m[3])}"{title}>{marked(escape(m[2], quote=False))}</a>')

    s = text.replace("\x02", "").replace("\x03", "")
    s = _CODE.sub(lambda m: aside(f"<code>{escape(m[2].strip(), quote=False)}</code>", m[2].strip()), s)
    s = _ESCAPE.sub(lambda m: aside(escape(m[1], quote=False), m[1]), s)
    s = marked(escape(_LINK.sub(link, s), quote=False))
    s = re.sub(r" {2,}\n", "<br />\n", s)
    while "\x02" in s:
        s = re.sub("\x02(\\d+)\x03", lambda m: held[int(m[1])][0], s)
    return s


def _cells(line: str) -> list[str]:
    row = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip() for c in re.split(r"(?<!\\)\|", row)]


def _table(lines: list[str]) -> str:
    marks = [(c.startswith(":"), c.endswith(":")) for c in _cells(lines[1])]
    sides = ["center" if a and b else "left" if a else "right" if b else None for a, b in marks]

    def row(line: str, tag: str) -> str:
        cells = (_cells(line) + [""] * len(sides))[: len(sides)]
        made = (f'<{tag} style="text-align: {side};">' if side else f"<{tag}>" for side in sides)
        return "<tr>\n" + "".join(f"{a}{inline(c)}</{tag}>\n" for a, c in zip(made, cells, strict=True)) + "</tr>\n"

    return "<table>\n<thead>\n" + row(lines[0], "th") + "</thead>\n<tbody>\n" + "".join(row(x, "td") for x in lines[2:]) + "</tbody>\n</table>"


def _list(lines: list[str], depth: int) -> tuple[str, int]:
    """A list from its first line on, and how many lines it takes. An item goes on with lines that are indented, or that follow without an empty line."""
    first = _ITEM.match(lines[0])
    ordered, items, loose, k = first[2][-1] in ".)", [], False, 0
    while k < len(lines):
        m = _ITEM.match(lines[k])
        if not m or (m[2][-1] in ".)") != ordered or _RULE.match(lines[k]):
            break
        body, k = [m[3]], k + 1
        indent = len(m[1]) + 2
        while k < len(lines):
            blank = not lines[k].strip()
            if blank and (k + 1 >= len(lines) or not lines[k + 1].startswith(" " * indent)):
                break
            if not blank and not lines[k].startswith(" " * indent) and (_ITEM.match(lines[k]) or not lines[k - 1].strip() or _begins(lines[k])):
                break
            body.append("" if blank else re.sub(rf"^ {{0,{max(4, indent)}}}", "", lines[k]) if lines[k].startswith(" " * indent) else lines[k])
            k += 1
        items.append(body)
        if k + 1 < len(lines) and not lines[k].strip() and (n := _ITEM.match(lines[k + 1])) and (n[2][-1] in ".)") == ordered:
            loose, k = True, k + 1
    loose = loose or any("" in body for body in items)
    tag, start = ("ol", int(first[2][:-1])) if ordered else ("ul", 1)
    made = []
    for body in items:
        inner = blocks(body, True, depth + 1)
        made.append("<li>" + ("\n" + inner + "\n" if loose else re.sub(r"^<p>(.*?)</p>", r"\1", inner, count=1, flags=re.DOTALL)) + "</li>")
    return f"<{tag}" + (f' start="{start}"' if start != 1 else "") + ">\n" + "\n".join(made) + f"\n</{tag}>", k


def _begins(line: str) -> bool:
    """Whether a line begins a block that ends a paragraph."""
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line))


def blocks(lines: list[str], item: bool = False, depth: int = 0) -> str:
    """Blocks behind each other. In an item of a list another list ends a paragraph; elsewhere a line that looks like one belongs to it. Quotes and lists inside DEPTH others are plain text."""
    out, k = [], 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif fence := _FENCE.match(line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() == fence[1]), len(lines))
            out.append("<pre><code>" + "".join(escape(x, quote=False) + "\n" for x in lines[k + 1 : end]) + "</code></pre>")
            k = end + 1
        elif heading := _HEADING.match(line):
            out.append(f"<h{len(heading[1])}>{inline(heading[2] or '')}</h{len(heading[1])}>")
            k += 1
        elif _RULE.match(line):
            out.append("<hr />")
            k += 1
        elif _QUOTE.match(line) and depth < DEPTH:
            end = k
            while end < len(lines) and lines[end].strip():
                end += 1
            out.append("<blockquote>\n" + blocks([_QUOTE.sub("", x) for x in lines[k:end]], False, depth + 1) + "\n</blockquote>")
            k = end
        elif _ITEM.match(line) and depth < DEPTH:
            made, n = _list(lines[k:], depth)
            out.append(made)
            k += n
        elif "|" in line and k + 1 < len(lines) and "|" in lines[k + 1] and _TABLE_RULE.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
            end = k + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                end += 1
            out.append(_table(lines[k:end]))
            k = end
        else:
            end = k + 1
            while end < len(lines) and lines[end].strip() and not _begins(lines[end]) and not (item and _ITEM.match(lines[end])):
                end += 1
            out.append("<p>" + inline("\n".join(x.lstrip() for x in lines[k:end]).rstrip()) + "</p>")
            k = end
    return "\n".join(out)


def to_xhtml(text: str) -> str:
    """A text's XHTML; every element is closed, whatever the text."""
    return blocks(re.split(r"\r\n|\r|\n", text.expandtabs(4)))


def markdown_xhtml(text: Column) -> Column:
    """The XHTML of Markdown texts; null for a null."""

    def made(texts: pa.Array) -> pa.Array:
        return pa.array([to_xhtml(t.as_py()) if t.is_valid else None for t in texts], pa.string())

    return F.arrow_udf(made, "string")(text)
