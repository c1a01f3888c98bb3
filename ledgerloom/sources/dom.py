"""Elements of web pages, with their attributes and the text that a reader sees.

Pages are read by an HTML tokenizer with a stack of open elements, in one Arrow
pass without a shuffle; a page's work is linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements whose content is no markup (hidden, and shown), elements that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption tbody tfoot thead tr ul xmp".split())
CELL = frozenset({"td", "th"})
# Fixed values of HTML: which open elements a start tag ends, and the elements beyond which it doesn't look.
_TABLE = frozenset("caption colgroup tbody thead tfoot tr td th".split())
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (CELL, frozenset({"tr", "table"})), "th": (CELL, frozenset({"tr", "table"})), "tr": (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    **{t: (_TABLE - CELL - {"tr"}, frozenset({"table"})) for t in ("caption", "colgroup", "tbody", "thead", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})), "optgroup": (frozenset({"optgroup", "option"}), frozenset({"select"})),
}
P_ENDERS = BLOCK - frozenset("html body caption tbody tfoot thead tr legend option optgroup".split())
#: An element inside one of these doesn't end what is outside.
WALLS = frozenset({"table", "td", "th", "caption", "button", "object", "template", "marquee", "applet", "html"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\r\f\xa0]+")


def _resolver(entities: tuple[str, ...] | None) -> Callable[[str], str]:
    """What resolves character references: all that HTML knows, those without a semicolon too, or only the named ones with one."""
    if entities is None:
        return unescape
    known = re.compile(f"&(?:{'|'.join(map(re.escape, entities))});") if entities else re.compile(r"(?!)")
    return lambda text: known.sub(lambda m: unescape(m.group()), text)


def _tag(html: str, at: int, resolved: Callable[[str], str] = unescape) -> tuple[dict[str, str], int] | None:
    """The attributes from `at` on and the place after the tag; null where the page ends inside it."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            end = html.find(">", at)
            return None if end < 0 else (found, end + 1)
        name, at, value = m.group(1).lower(), m.end(), ""
        if m.group(2) is not None:
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(html, at)
                value, at = m.group(), m.end()
        found.setdefault(name, resolved(value))


def tokens(html: str, entities: tuple[str, ...] | None = None) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, null), ("open", tag, attributes) and ("close", tag, null), in the page's order; comments and declarations are left out."""
    at, size, resolved = 0, len(html), _resolver(entities)
    lower = None
    while at < size:
        start = html.find("<", at)
        if start < 0:
            yield "text", resolved(html[at:]), None
            return
        if start > at:
            yield "text", resolved(html[at:start]), None
        after = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2 if html.startswith("<!-->", start) else start + 4)
            at = size if end < 0 else end + 3
        elif after in ("!", "?") and after or html.startswith("</", start) and not _NAME.match(html, start + 2):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
        elif after == "/":
            m = _NAME.match(html, start + 2)
            end = html.find(">", m.end())
            if end < 0:
                return
            yield "close", m.group().lower(), None
            at = end + 1
        elif m := _NAME.match(html, start + 1):
            tag, read = m.group().lower(), _tag(html, m.end(), unescape if entities is None else str)
            if read is None:
                return
            attributes, at = read
            yield "open", tag, attributes
            if tag in RAW:  # up to its own end tag nothing is markup
                lower = lower if lower is not None else html.translate(_LOWER)
                end = lower.find(f"</{tag}", at)
                while 0 <= end and not re.match(r"[\s/>]|$", html[end + 2 + len(tag) : end + 3 + len(tag)]):
                    end = lower.find(f"</{tag}", end + 1)
                end = size if end < 0 else end
                if end > at:
                    yield "text", resolved(html[at:end]) if tag in ("title", "textarea") else html[at:end], None
                at = end
        else:
            yield "text", "<", None
            at = start + 1


_LOWER = {c: c + 32 for c in range(65, 91)}


def _shown(parts: list[str]) -> str:
    """The lines of what is seen, blanks brought together, without empty lines."""
    lines = ("\t".join(_SPACE.sub(" ", cell).strip() for cell in line.split("\v")).strip() for line in "".join(parts).split("\0"))
    return "\n".join(line for line in lines if line)


def selected(html: str, tags: frozenset[str], css_class: str | None, entities: tuple[str, ...] | None = None) -> list[tuple[str, dict[str, str], str]]:
    """(tag, attributes, text) of each element with one of the tags, or the class, in the order in which they begin."""
    stack: list[tuple[str, int | None, int]] = []  # tag, place among the found, where its text begins
    found: list[tuple[str, dict[str, str], str]] = []
    parts: list[str] = []  # a line's end is \0, a cell's \v; neither is in the text
    hidden, count = 0, {}

    def leave(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag, place, begin = stack.pop()
            count[tag] -= 1
            hidden -= tag in HIDDEN
            if place is not None:
                found[place] = (*found[place][:2], _shown(parts[begin:]))
            if not hidden and tag in BLOCK:
                parts.append("\0")
            elif not hidden and tag in CELL:
                parts.append("\v")

    def up_to(wanted: frozenset[str], walls: frozenset[str]) -> int | None:
        """The depth of the innermost wanted element on this side of the walls."""
        if not any(count.get(t) for t in wanted):
            return None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in wanted:
                return depth
            if stack[depth][0] in walls:
                return None
        return None

    for kind, name, attributes in tokens(html, entities):
        if kind == "text":
            if not hidden:
                parts.append(name.replace("\0", "").replace("\v", " "))
        elif kind == "close":
            depth = up_to(frozenset({name}), frozenset() if name in WALLS else WALLS)
            if depth is not None:
                leave(depth)
        else:
            if name in P_ENDERS and (depth := up_to(frozenset({"p"}), WALLS)) is not None:
                leave(depth)
            if name in ENDS and (depth := up_to(*ENDS[name])) is not None:
                leave(depth)
            if not hidden and (name in BLOCK or name == "br"):
                parts.append("\0")
            wanted = name in tags or css_class is not None and css_class in _SPACE.split(attributes.get("class", ""))
            if wanted:
                found.append((name, attributes, ""))
            if name not in VOID:
                stack.append((name, len(found) - 1 if wanted else None, len(parts)))
                count[name] = count.get(name, 0) + 1
                hidden += name in HIDDEN
    leave(0)
    return found


def elements(pages: DataFrame, tags: tuple[str, ...] = (), css_class: str | None = None, key: str = "page_id", html: str = "html", entities: tuple[str, ...] | None = None) -> DataFrame:
    """(key, place, tag, attributes, text) of the elements with one of the tags or with the class, numbered from 0 in each page.

    Tags and attributes' names are in lower case; attributes may come in any
    order and with any quotes, the first of a name counts, entities are
    resolved. An element's text is what is seen of it, inner elements included:
    blanks brought together, a line for each block and each <br>, a tab between
    cells; scripts, styles and comments have no text. Elements that a page
    leaves open end where HTML ends them, at the page's end at last. With
    `entities`, only references of these names that end in a semicolon are
    resolved, and those of texts only: attributes stay as written. Null and
    empty pages have no elements; repeated rows have theirs each.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, place long, tag string, attributes map<string,string>, text string"
    wanted = frozenset(t.lower() for t in tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = [(row, place, *e) for row, page in enumerate(part.column(1).to_pylist()) for place, e in enumerate(selected(page or "", wanted, css_class, entities))]
                owner, place, tag, attributes, text = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), pa.array(place, pa.int64()), pa.array(tag, pa.string()), pa.array([list(a.items()) for a in attributes], pa.map_(pa.string(), pa.string())), pa.array(text, pa.string())],
                    names=[key, "place", "tag", "attributes", "text"],
                )

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, schema)
