"""Markup residue in texts: what kinds a text holds, and the text as a reader would see it."""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.runtime import slices

# Names as the public HTML standard has them, and common LaTeX commands.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button canvas cite code data datalist del dfn em font i iframe ins kbd label map mark meter nobr noscript object output picture progress q rp rt ruby s samp script select slot small span strike strong style sub sup svg template textarea time tt u var video audio".split())
ELEMENTS = VOID | BLOCK | INLINE
MATH = frozenset("math semantics annotation mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mspace mstyle".split())
INVISIBLE = frozenset("head script style template title noscript datalist iframe object audio video canvas svg".split())
BOOLEAN = frozenset("allowfullscreen async autofocus autoplay checked compact controls default defer disabled formnovalidate hidden inert ismap itemscope loop multiple muted nomodule noshade novalidate nowrap open playsinline readonly required reversed selected".split())
#: A start tag of the key ends an open element of the values, up to one of the scope below.
IMPLIED_END = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
OPTIONAL_END = frozenset(IMPLIED_END) | {"p", "thead"}
SCOPE = frozenset("ul ol dl table select html body menu".split())
COMMANDS = frozenset(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega "
    "frac dfrac tfrac sqrt sum prod int iint oint lim log ln exp sin cos tan max min sup inf det dim ker approx equiv sim simeq cong propto le leq ge geq ne neq ll gg pm mp times div cdot cdots ldots dots infty partial nabla forall exists in notin subset subseteq cup cap to rightarrow leftarrow Rightarrow Leftarrow mapsto implies iff lVert rVert lvert rvert langle rangle left right hat bar vec tilde overline underline mathbf mathrm mathbb mathcal text operatorname binom quad qquad "
    "begin end item section subsection subsubsection paragraph chapter part title author date maketitle documentclass usepackage label ref eqref pageref cite citep citet caption footnote textbf textit texttt textsc textrm textsf emph em bf it tt sc large small centering hline toprule midrule bottomrule includegraphics input include newline par noindent href url verb".split()
)
ENVIRONMENT_LISTS = {"itemize": "- ", "enumerate": "1. ", "description": "- "}
ENVIRONMENT_TABLES = frozenset("tabular tabularx array longtable".split())
ENVIRONMENT_FORMULAS = frozenset("equation align gather multline eqnarray math displaymath alignat flalign".split())
ENVIRONMENT_CODE = frozenset("verbatim lstlisting minted".split())

_TAG = re.compile(r"<(/?)([A-Za-z][-A-Za-z0-9]*)((?:\s+[A-Za-z_:][-\w:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_NO_COMMENT = re.compile(r"<![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>]*>|" + _TAG.pattern, re.S)
_HTML_TOKEN = re.compile(r"<!--.*?-->|" + _NO_COMMENT.pattern, re.S)
_END_TAG = re.compile(r"</([A-Za-z][-A-Za-z0-9]*)\s*>")
_START_TAG = re.compile(r"<([A-Za-z][-A-Za-z0-9]*)[\s/>]")
#: Depth from which indentation grows no further, or it would outgrow the text; depth itself has no limit.
_INDENTS = 40
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`~\n]*)$")
_CODE_SPAN = re.compile(r"(?<![`\\])`([^`\n]+)`(?!`)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(={3,}|-{3,})[ \t]*$")
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_BULLET = re.compile(r"^([ \t]*)([-*+])[ \t]+(?:\[([ xX])\][ \t]+)?(\S.*)$")
_NUMBER = re.compile(r"^([ \t]*)(\d{1,9})([.)])[ \t]+(\S.*)$")
_QUOTE = re.compile(r"^ {0,3}>(?:[ \t]?>)*+[ \t]?(.*)$")
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(([^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)")
_EMPHASIS = [
    re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?![\w*])"),
    re.compile(r"(?<![\w_\\])__(?=[^\s_])([^\n]*?[^\s_])__(?![\w_])"),
    re.compile(r"(?<![\w~\\])~~(?=[^\s~])([^~\n]*?[^\s~])~~(?![\w~])"),
    re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])"),
    re.compile(r"(?<![\w_\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])"),
]

_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)((?:\|[^\[\]|\n]*)*)\]\]")
_WIKI_STRONG = re.compile(r"'''''(?=\S)(.+?)'''''|'''(?=\S)(.+?)'''(?!')|''(?=[^\s'])(.+?)''(?!')")
_BRACES = re.compile(r"\{\{|\}\}")
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", re.M | re.S)

_ENVIRONMENT = re.compile(r"\\begin\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?|\\end\{([A-Za-z]+\*?)\}")
_DISPLAY = re.compile(r"\$\$(?=\s*[^\s$])([^$]+)\$\$|\\\[((?:(?!\\[\[\]]).)+)\\\]", re.S)
_INLINE_MATH = re.compile(r"\\\(((?:(?!\\[()]).)+)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]+)(?<=\S)\$(?![\w$])", re.S)
_MATH_SIGN = re.compile(r"[\\^_={}+<>|]|^[A-Za-z]$")
_SWITCH = re.compile(r"\\(?:em|bf|it|tt|sc|large|small)\b ?")
_SECTION = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{(.*)\}[ \t]*$")
_COMMAND = re.compile(r"(?<![:\\])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?")
_COMMAND_TOKEN = re.compile(_COMMAND.pattern + r"|\\.|[{}]", re.S)
_DROPPED = frozenset("label begin end usepackage documentclass input include includegraphics maketitle centering noindent hline".split())
_CITED = frozenset("ref eqref pageref cite citep citet".split())
_SOURCE = frozenset("frac dfrac tfrac binom sqrt".split())
_ANY_SIGN = re.compile(r"[<&*_`~#\[{|\\$=']|^[ \t]*(?:[-+>]|\d+[.)])[ \t]|^ {0,3}-{3}", re.M)
_PLACE = re.compile("\x00(\\d+)\x00")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list[Node | str] = field(default_factory=list)


@dataclass
class Block:
    """Rendered lines; ``loose`` blocks are set off by a blank line."""

    text: str
    loose: bool = True


def _join(blocks: list[Block]) -> str:
    out = ""
    for before, block in zip([None, *blocks], blocks, strict=False):
        if before is not None:
            out += "\n\n" if before.loose or block.loose else "\n"
        out += block.text
    return out


def _aligned(rows: list[list[str]]) -> str:
    """Cells in columns as wide as their widest, two blanks apart."""
    width = max((len(r) for r in rows), default=0)
    rows = [[re.sub(r"\s+", " ", c).strip() for c in r] + [""] * (width - len(r)) for r in rows]
    widths = [max(len(r[i]) for r in rows) for i in range(width)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def _indented(text: str, first: str, depth: int = 0) -> str:
    if depth >= _INDENTS:
        return first.lstrip() + text
    rest = " " * len(first)
    return "\n".join((first if i == 0 else rest if line else "") + line for i, line in enumerate(text.split("\n")))


class Reader:
    """Reads one text; ``found`` counts the constructs of each kind that it took as markup."""

    def __init__(self) -> None:
        self.found = {"html": 0, "markdown": 0, "wiki": 0, "latex": 0}
        self.kept: list[Block] = []

    def read(self, text: str) -> str:
        text = text.replace("\x00", "").replace("\r\n", "\n")
        if not _ANY_SIGN.search(text):
            return text
        if "```" in text or "~~~" in text:
            text = self._fences(text)
        text = _CODE_SPAN.sub(self._span, text)
        blocks = self._html(text) if "<" in text else None
        return self._restore(_join(blocks if blocks is not None else self._flow(text)).strip("\n"))

    # what is kept apart: code is never read as markup

    def _keep(self, block: Block) -> str:
        self.kept.append(block)
        return f"\x00{len(self.kept) - 1}\x00"

    def _restore(self, text: str) -> str:
        while _PLACE.search(text):
            text = _PLACE.sub(lambda m: self.kept[int(m[1])].text, text)
        return text

    def _fences(self, text: str) -> str:
        """Fenced code, from its opening line to the next line of a fence alone; without one it is no fence."""
        lines = text.split("\n")
        fences = {i: m for i, line in enumerate(lines) if (m := _FENCE.match(line))}
        ends = {c: [i for i, m in fences.items() if m[1][0] == c and not m[2].strip()] for c in "`~"}
        out: list[str] = []
        i = 0
        for start, m in fences.items():
            if start < i:
                continue
            closing = ends[m[1][0]]
            at = bisect_right(closing, start)
            while at < len(closing) and len(fences[closing[at]][1]) < len(m[1]):
                at += 1
            if at == len(closing):
                continue
            self.found["markdown"] += 1
            out.extend(lines[i:start])
            out.append(self._keep(Block(_indented("\n".join(lines[start + 1 : closing[at]]), "    "))))
            i = closing[at] + 1
        return "\n".join(out + lines[i:])

    def _span(self, m: re.Match) -> str:
        self.found["markdown"] += 1
        return self._keep(Block(m[1], False))

    # HTML: a tree with implied end tags, then its visible part

    def _is_tag(self, m: re.Match, text: str, ends: dict[str, int], starts: dict[str, int]) -> bool:
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name not in ELEMENTS:
            # of other names, only elements that begin and end
            return (name in MATH or "-" in name) and (starts.get(name, len(text)) < m.start() if closing else bool(m[4]) or ends.get(name, -1) >= m.end())
        closed = ends.get(name, -1) >= m.end()
        named = [(a[1], a[2]) for a in _ATTRIBUTE.finditer(attributes)]
        # words in angle brackets may be prose: attributes without values count if anything else says that this is a tag
        if not closed and all(value is None for _, value in named) and any(a.lower() not in BOOLEAN and "-" not in a for a, _ in named):
            return False
        before = text[m.start() - 1] if m.start() else " "
        # a type parameter looks like a start tag: it follows a name at once and is never closed
        return not (not closing and not attributes.strip() and name not in VOID and name not in OPTIONAL_END and (before.isalnum() or before == "_") and not closed)

    def _html(self, text: str) -> list[Block] | None:
        root = Node("", {})
        stack = [root]
        at = 0
        raw: str | None = None
        seen = 0
        ends_at = {m[1].lower(): m.start() for m in _END_TAG.finditer(text)}
        starts_at: dict[str, int] = {}
        for m in _START_TAG.finditer(text):
            starts_at.setdefault(m[1].lower(), m.start())
        # behind the last end of a comment, nothing begins one
        comments = text.rfind("-->") + 3 if "-->" in text else 0
        for m in chain(_HTML_TOKEN.finditer(text, 0, comments), _NO_COMMENT.finditer(text, comments)):
            if m[2] is not None and not self._is_tag(m, text, ends_at, starts_at):
                continue
            if raw is not None and not (m[2] and m[1] and m[2].lower() == raw):
                continue
            if m.start() > at:
                stack[-1].children.append(text[at : m.start()])
            at = m.end()
            seen += 1
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                raw = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and name not in SCOPE:
                        break
                continue
            ends = IMPLIED_END.get(name, set())
            for i in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[i].tag in ends:
                    del stack[i:]
                elif stack[i].tag in SCOPE:
                    break
            if name in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            node = Node(name, {a[1].lower(): (a[2] or "").strip("\"'") for a in _ATTRIBUTE.finditer(m[3])})
            stack[-1].children.append(node)
            if name not in VOID and not m[4]:
                stack.append(node)
                raw = name if name in ("script", "style", "textarea") else None
        self.found["html"] += seen
        if not seen:
            return None
        if at < len(text):
            stack[-1].children.append(text[at:])
        return self._blocks(root.children)

    @staticmethod
    def _hidden(node: Node) -> bool:
        style = node.attributes.get("style", "").replace(" ", "").lower()
        return node.tag in INVISIBLE or "hidden" in node.attributes or "display:none" in style or "visibility:hidden" in style or (node.tag == "input" and node.attributes.get("type", "").lower() == "hidden")

    def _blocks(self, children: list[Node | str], depth: int = 0) -> list[Block]:
        out: list[Block] = []
        run: list[str] = []

        def flush() -> None:
            if "".join(run).strip():
                out.extend(self._flow("".join(run).strip("\n")))
            run.clear()

        def inline(node: Node | str) -> None:
            if isinstance(node, str):
                run.append(node)
            elif self._hidden(node):
                return
            elif node.tag == "br":
                run.append("\n")
            elif node.tag == "img":
                run.append(html.unescape(node.attributes.get("alt", "")))
            elif node.tag in BLOCK:
                flush()
                out.extend(self._block(node, depth))
            else:
                if node.tag == "q":
                    run.append('"')
                for child in node.children:
                    inline(child)
                if node.tag == "q":
                    run.append('"')

        for child in children:
            inline(child)
        flush()
        return out

    def _text(self, node: Node, depth: int = 0) -> str:
        return _join(self._blocks(node.children, depth)).strip()

    def _block(self, node: Node, depth: int) -> list[Block]:
        tag = node.tag
        if tag == "pre":
            plain: list[str] = []

            def gather(n: Node) -> None:
                for c in n.children:
                    if isinstance(c, str):
                        plain.append(c)
                    elif c.tag == "br":
                        plain.append("\n")
                    else:
                        gather(c)

            gather(node)
            return [Block(self._keep(Block(_indented(self._references("".join(plain)).strip("\n"), "    "))))]
        if tag in ("ul", "ol", "menu", "dir"):
            items = []
            number = int(node.attributes["start"]) if re.fullmatch(r"-?\d{1,9}", node.attributes.get("start", "")) else 1
            for child in node.children:
                if isinstance(child, str):
                    if child.strip():
                        items.append(Block(child.strip(), False))
                elif not self._hidden(child):
                    inner = self._blocks(child.children, depth + 1)
                    if not any(isinstance(c, Node) and c.tag == "p" for c in child.children):
                        inner = [Block(x.text, False) for x in inner]
                    items.append(Block(_indented(_join(inner).strip(), f"{number}. " if tag == "ol" else "- ", depth), False))
                    number += 1
            return [Block(_join(items), depth == 0)] if items else []
        if tag == "table":
            rows: list[list[Node]] = []
            open_ = list(reversed(node.children))
            while open_:
                c = open_.pop()
                if isinstance(c, str) or self._hidden(c):
                    continue
                if c.tag == "tr":
                    rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")])
                elif c.tag in ("td", "th"):
                    rows.append([c])
                else:
                    open_.extend(reversed(c.children))
            caption = [Block(self._text(c)) for c in node.children if isinstance(c, Node) and c.tag == "caption"]
            return caption + ([Block(self._keep(Block(_aligned(self._grid(rows)))))] if rows else [])
        if tag == "blockquote":
            return [Block(_indented(self._text(node, depth + 1), "  ", depth))]
        if tag == "dd":
            return [Block(_indented(self._text(node, depth + 1), "    ", depth), False)]
        if tag == "hr":
            return []
        inner = self._blocks(node.children, depth)
        if tag in ("li", "dt", "tr", "option"):
            return [Block(_join(inner), False)]
        return inner

    def _grid(self, rows: list[list[Node]]) -> list[list[str]]:
        """Cells in their columns: a cell over several columns or rows leaves the other places empty."""

        def span(cell: Node, name: str) -> int:
            value = cell.attributes.get(name, "")
            # the public standard's greatest values
            return min(max(1, int(value)), 1000) if re.fullmatch(r"\d{1,9}", value) else 1

        out: list[list[str]] = []
        taken: dict[int, int] = {}
        for row in rows:
            line: list[str] = []
            below: dict[int, int] = {}
            for cell in row:
                while taken.get(len(line), 0):
                    line.append("")
                wide, high = span(cell, "colspan"), span(cell, "rowspan")
                if high > 1:
                    below |= {len(line) + i: high for i in range(wide)}
                line += [self._text(cell)] + [""] * (wide - 1)
            out.append(line)
            taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        return out

    def _references(self, text: str) -> str:
        def one(m: re.Match) -> str:
            if m[0][1] != "#" and m[0][1:] not in html5:
                return m[0]
            self.found["html"] += 1
            return html.unescape(m[0]).replace("\xa0", " ")

        return _REFERENCE.sub(one, text) if "&" in text else text

    # Markdown, wiki and LaTeX, by lines

    def _flow(self, text: str, depth: int = 0, environments: bool = True) -> list[Block]:
        if environments and "\\begin{" in text:
            text = self._environments(text)
        if "\\" in text or "$$" in text:
            text = _DISPLAY.sub(self._display, text)
        if "{{" in text and "}}" in text:
            text = self._templates(self._formulas(text))
        if "{|" in text and "|}" in text:
            text = _WIKI_TABLE.sub(self._wiki_table, text)
        lines = text.split("\n")
        out: list[Block] = []
        paragraph: list[str] = []

        def flush() -> None:
            if paragraph:
                body = self._inline("\n".join(paragraph)).strip()
                if body:
                    out.append(Block(body))
                paragraph.clear()

        i = 0
        while i < len(lines):
            line = lines[i]
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if not line.strip():
                flush()
            elif (m := _PLACE.fullmatch(line.strip())) and self.kept[int(m[1])].loose:
                flush()
                out.append(Block(line.strip()))
            elif m := _WIKI_HEADING.match(line):
                flush()
                self.found["wiki"] += 1
                out.append(Block(self._inline(m[2])))
            elif m := _HEADING.match(line):
                flush()
                self.found["markdown"] += 1
                out.append(Block(self._inline(m[2])))
            elif m := _SECTION.match(line):
                flush()
                self.found["latex"] += 1
                out.append(Block(self._inline(m[2])))
            elif "|" in line and "|" in after and _TABLE_RULE.match(after):
                flush()
                self.found["markdown"] += 1
                rows = [line]
                i += 2
                while i < len(lines) and "|" in lines[i]:
                    rows.append(lines[i])
                    i += 1
                i -= 1
                out.append(Block(self._keep(Block(_aligned([[self._inline(c) for c in r.strip().strip("|").split("|")] for r in rows])))))
            elif not paragraph and _UNDERLINE.match(after) and not _BULLET.match(line) and not _QUOTE.match(line) and not _UNDERLINE.match(line):
                self.found["markdown"] += 1
                out.append(Block(self._inline(line.strip())))
                i += 1
            elif paragraph and _UNDERLINE.match(line):
                # the last line of a paragraph is the heading
                title = paragraph.pop()
                flush()
                self.found["markdown"] += 1
                out.append(Block(self._inline(title.strip())))
            elif m := _QUOTE.match(line):
                flush()
                quoted = []
                while i < len(lines) and (q := _QUOTE.match(lines[i])):
                    quoted.append(q[1])
                    i += 1
                i -= 1
                self.found["markdown"] += 1
                out.append(Block(_indented(_join(self._flow("\n".join(quoted), depth + 1)), "  ", depth)))
            elif _BULLET.match(line) or self._numbered(lines, i):
                flush()
                items = []
                while i < len(lines) and (_BULLET.match(lines[i]) or self._numbered(lines, i)):
                    if b := _BULLET.match(lines[i]):
                        mark = {" ": "- [ ] ", "x": "- [x] ", "X": "- [x] "}.get(b[3] or "", "- ")
                        indent, body = len(b[1].expandtabs(4)), b[4]
                    else:
                        n = _NUMBER.match(lines[i])
                        indent, mark, body = len(n[1].expandtabs(4)), f"{n[2]}. ", n[4]
                    i += 1
                    # indented lines that begin nothing of their own go on with the item
                    while i < len(lines) and (c := lines[i].expandtabs(4)).strip() and len(c) - len(c.lstrip()) >= indent + 2 and not (_BULLET.match(lines[i]) or _NUMBER.match(lines[i]) or _PLACE.fullmatch(c.strip())):
                        body += "\n" + c.strip()
                        i += 1
                    items.append(Block(" " * indent + _indented(self._inline(body), mark).replace("\n", "\n" + " " * indent), False))
                i -= 1
                self.found["markdown"] += len(items)
                out.append(Block(_join(items)))
            else:
                paragraph.append(line)
            i += 1
        flush()
        return out

    @staticmethod
    def _numbered(lines: list[str], i: int) -> bool:
        """Whether a line that begins with a number is a list item: the first of a list, or next to its neighbour."""
        m = _NUMBER.match(lines[i])
        if not m:
            return False
        near = [_NUMBER.match(lines[k]) for k in (i - 1, i + 1) if 0 <= k < len(lines)]
        return int(m[2]) == 1 or any(n and abs(int(n[2]) - int(m[2])) <= 1 for n in near)

    def _display(self, m: re.Match) -> str:
        source = (m[1] or m[2]).strip()
        if m[1] is not None and not _MATH_SIGN.search(source):
            return m[0]
        self.found["latex"] += 1
        return "\n" + self._keep(Block(source)) + "\n"

    def _environments(self, text: str) -> str:
        """Environments from the innermost out, in one pass; a begin or an end without the other stays as it is."""
        last = {m[2]: m.start() for m in _ENVIRONMENT.finditer(text) if m[2]}
        # of every open environment its name, where its source and body begin, and what came of its body so far
        open_: list[tuple[str, int, int, list[str]]] = [("", 0, 0, [])]
        names: dict[str, int] = {}
        at = 0
        for m in _ENVIRONMENT.finditer(text):
            if m.start() < at:
                continue
            name = m[1] or m[2]
            open_[-1][3].append(text[at : m.start()])
            at = m.end()
            if m[1]:
                if last.get(name, -1) < m.end():
                    open_[-1][3].append(m[0])
                elif name.rstrip("*") in ENVIRONMENT_CODE:
                    # nothing is read inside
                    end = f"\\end{{{name}}}"
                    stop = text.index(end, m.end())
                    open_[-1][3].append("\n" + self._environment(name, text[m.end() : stop], len(open_)) + "\n")
                    at = stop + len(end)
                else:
                    open_.append((name, m.start(), m.end(), []))
                    names[name] = names.get(name, 0) + 1
                continue
            if not names.get(name):
                open_[-1][3].append(m[0])
                continue
            while True:
                own, start, body, out = open_.pop()
                names[own] -= 1
                if own == name:
                    break
                open_[-1][3].extend([text[start:body], *out])
            inner = text[body : m.start()] if name.rstrip("*") in ENVIRONMENT_FORMULAS else "".join(out)
            open_[-1][3].append("\n" + self._environment(name, inner, len(open_)) + "\n")
        open_[-1][3].append(text[at:])
        while len(open_) > 1:
            _, start, body, out = open_.pop()
            open_[-1][3].extend([text[start:body], *out])
        return "".join(open_[0][3])

    def _environment(self, name: str, body: str, depth: int) -> str:
        self.found["latex"] += 1
        name = name.rstrip("*")
        if name in ENVIRONMENT_CODE:
            return self._keep(Block(_indented(body.strip("\n"), "    ")))
        if name in ENVIRONMENT_FORMULAS:
            return self._keep(Block(body.strip()))
        if name in ENVIRONMENT_LISTS:
            parts = re.split(r"\\item\b(?:\[[^\]\n]*\])?", body)[1:]
            marks = [f"{k}. " if name == "enumerate" else "- " for k in range(1, len(parts) + 1)]
            inner = ["\n".join(self._restored(x.text) for x in self._flow(p.strip(), depth, False)) for p in parts]
            return self._keep(Block(_join([Block(_indented(t, mark, depth), False) for t, mark in zip(inner, marks, strict=True)])))
        if name in ENVIRONMENT_TABLES:
            rows = [r for r in re.split(r"\\\\(?:\[[^\]\n]*\])?|\\hline|\\(?:top|mid|bottom)rule", body) if r.strip()]
            return self._keep(Block(_aligned([[self._inline(c) for c in re.split(r"(?<!\\)&", r)] for r in rows])))
        return self._keep(Block(_join(self._flow(body.strip(), depth, False))))

    def _restored(self, text: str) -> str:
        """A list within an item as text, so that it is indented with it."""
        m = _PLACE.fullmatch(text)
        return self.kept[int(m[1])].text if m else text

    def _wiki_table(self, m: re.Match) -> str:
        self.found["wiki"] += 1
        rows: list[list[str]] = [[]]
        for line in m[1].split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                rows.append([line[2:]])
                rows.append([])
            elif line[:1] in ("|", "!"):
                rows[-1].extend(re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:]))
            elif line and rows[-1]:
                rows[-1][-1] += " " + line
        return self._keep(Block(_aligned([[self._inline(c) for c in r] for r in rows if r])))

    # inside a line

    def _formulas(self, text: str) -> str:
        return _INLINE_MATH.sub(self._formula, text) if "$" in text or "\\(" in text else text

    def _inline(self, text: str) -> str:
        text = self._formulas(text)
        if "[[" in text:
            text = _WIKI_LINK.sub(self._wiki_link, text)
        if "{{" in text and "}}" in text:
            text = self._templates(text)
        if "''" in text:
            text = _WIKI_STRONG.sub(self._wiki_strong, text)
        if "](" in text:
            text = _IMAGE.sub(self._taken("markdown"), text)
            text = _LINK.sub(self._taken("markdown"), text)
        if "*" in text or "_" in text or "~~" in text:
            for pattern in _EMPHASIS:
                text = pattern.sub(self._taken("markdown"), text)
        if "\\" in text:
            text = self._commands(text)
        return self._references(text)

    def _count(self, kind: str, text: str) -> str:
        self.found[kind] += 1
        return text

    def _taken(self, kind: str):  # noqa: ANN202
        return lambda m: self._count(kind, m[1])

    def _formula(self, m: re.Match) -> str:
        source = m[1] if m[1] is not None else m[2]
        if m[1] is None and not _MATH_SIGN.search(source):
            return m[0]
        return self._count("latex", self._keep(Block(source.strip(), False)))

    def _wiki_link(self, m: re.Match) -> str:
        target, rest = m[1].strip(), [x.strip() for x in m[2].split("|")[1:]]
        space = target.partition(":")[0].strip().lower() if ":" in target else ""
        if space == "category":
            return self._count("wiki", "")
        if space in ("file", "image"):
            words = [x for x in rest if x and x.lower() not in ("thumb", "frame", "left", "right", "center", "none", "frameless") and not x.endswith("px")]
            return self._count("wiki", words[-1] if words else "")
        return self._count("wiki", rest[-1] if rest and rest[-1] else target)

    def _templates(self, text: str) -> str:
        """Templates from the innermost out: double braces that belong together around a name."""
        open_: list[list[str]] = [[]]
        at = 0
        for m in _BRACES.finditer(text):
            open_[-1].append(text[at : m.start()])
            at = m.end()
            if m[0] == "{{":
                open_.append([])
            elif len(open_) > 1:
                body = "".join(open_.pop())
                open_[-1].append(self._template(body))
            else:
                open_[-1].append(m[0])
        open_[-1].append(text[at:])
        while len(open_) > 1:
            rest = open_.pop()
            open_[-1].extend(["{{", *rest])
        return "".join(open_[0])

    def _template(self, body: str) -> str:
        # bars within links divide nothing
        parts = _WIKI_LINK.sub(self._wiki_link, body).split("|") if "[[" in body else body.split("|")
        name = parts[0].strip()
        if not name or "\n" in name or "{" in name or "}" in name:
            return "{{" + body + "}}"
        plain = [x.strip() for x in parts[1:] if "=" not in x]
        return self._count("wiki", " ".join(x for x in plain if x))

    def _wiki_strong(self, m: re.Match) -> str:
        return self._count("wiki", m[1] or m[2] or m[3])

    def _commands(self, text: str) -> str:
        """Commands with their arguments, from the innermost out, in one pass; braces that don't close are text."""
        closed: dict[int, int] = {}
        waiting: list[int] = []
        tokens = list(_COMMAND_TOKEN.finditer(text))
        for m in tokens:
            if m[0] == "{":
                waiting.append(m.start())
            elif m[0] == "}" and waiting:
                closed[waiting.pop()] = m.start()
        ends = set(closed.values())
        # open groups: what came of them so far, and the command that they are an argument of
        open_: list[tuple[list[str], re.Match | None, list[str]]] = [([], None, [])]
        command, groups = None, []
        at = 0
        for m in tokens:
            if m.start() < at:
                continue
            if command is not None and not (m.start() == at and m[0] == "{" and m.start() in closed):
                open_[-1][0].append(self._command(command, groups))
                command, groups = None, []
            open_[-1][0].append(text[at : m.start()])
            at = m.end()
            if m[1]:
                # right behind a word, a backslash is mostly a path's
                if m.start() and text[m.start() - 1].isalnum() and not (m[1] in COMMANDS and m.end() in closed):
                    open_[-1][0].append(m[0])
                else:
                    command, groups = m, []
            elif m[0] == "{" and m.start() in closed:
                if command is None and (switch := _SWITCH.match(text, m.end())):
                    self.found["latex"] += 1
                    at = switch.end()
                    open_.append(([], switch, []))
                else:
                    open_.append(([], command, groups))
                command, groups = None, []
            elif m[0] == "}" and m.start() in ends and len(open_) > 1:
                out, command, groups = open_.pop()
                body = "".join(out)
                if command is None:
                    # within an argument, braces only group
                    open_[-1][0].append(body if open_[-1][1] is not None else "{" + body + "}")
                elif command.re is _SWITCH:
                    open_[-1][0].append(body)
                    command = None
                else:
                    groups = [*groups, body]
            else:
                open_[-1][0].append(m[0])
        if command is not None:
            open_[-1][0].append(self._command(command, groups))
        open_[-1][0].append(text[at:])
        return "".join(open_[0][0])

    def _command(self, m: re.Match, groups: list[str]) -> str:
        name = m[1]
        source = m[0] + "".join("{" + g + "}" for g in groups)
        if name not in COMMANDS and not (groups and len(name) > 1):
            return source
        self.found["latex"] += 1
        if name in _CITED:
            return f"[{', '.join(groups)}]"
        if name in _DROPPED:
            return ""
        return groups[-1] if groups and name not in _SOURCE else source


# elements within elements are read by calls within calls, which Python bounds only by this number
_CALLS = 2_000_000


def read(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup that were in it."""
    if not text:
        return text, []
    reader = Reader()
    calls = sys.getrecursionlimit()
    sys.setrecursionlimit(_CALLS)
    try:
        clean = reader.read(text)
    finally:
        sys.setrecursionlimit(calls)
    return clean, [kind for kind, n in reader.found.items() if n]


#: Content types whose data is no prose: their text is kept as it is.
VERBATIM_TYPES = ("code", "json")


def clean_texts(df: DataFrame, id_col: str = "id", data_col: str = "content.data", type_col: str = "content.type", texts: bool = True) -> DataFrame:
    """(id, kinds[, text]): every item's text as a reader would see it, and the kinds of markup it held.

    Reading decides by the text alone: a declared format may be missing or wrong. HTML is built into a tree with
    implied end tags and rendered without its invisible parts; Markdown, wiki and LaTeX are read by lines. Kept are
    headings (a line of their own), lists (with marks and depth), code (indented, never read as markup), formulas
    (their source), quotations (indented) and tables (aligned cells); block spacing is a blank line.

    Items of type code or json keep their data and have no kinds, null and empty data stay as they are. Rows are
    independent, nothing is shuffled; repeated rows are repeated. Texts are read whole. Other columns are not read,
    whatever their names.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(data_col).cast("string").alias("data"), F.col(type_col).cast("string").alias("type"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["data"]):
                part = batch.slice(a, b - a)
                done = [(text, []) if what in VERBATIM_TYPES else read(text) for text, what in zip(part["data"].to_pylist(), part["type"].to_pylist(), strict=True)]
                columns = {"id": part["id"], "kinds": pa.array([k for _, k in done], pa.list_(pa.string()))}
                yield pa.record_batch(columns | ({"text": pa.array([t for t, _ in done], pa.string())} if texts else {}))

    return source.mapInArrow(run, f"id {kind}, kinds array<string>" + ", text string" * texts).withColumnRenamed("id", id_col.split(".")[-1])


def markup_kinds(df: DataFrame) -> DataFrame:
    """(id, markup): one row for each kind of markup that an item holds (see ``clean_texts``)."""
    return clean_texts(df, texts=False).select("id", F.explode("kinds").alias("markup"))
