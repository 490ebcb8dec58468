"""Text with HTML, Markdown, wiki or LaTeX markup to clean text that keeps its structure.

Method: a style tree of each site (here: source). Every text is parsed once into a DOM: sections
open at their headings, containers (div, font, blockquote ..) at their tags; in them stand
headings, lists with their items, tables with their rows, code, formulas and paragraphs with
their lines. A node's path is the chain of its ancestors' kinds, styles and attributes (sections,
which no mark encloses, left out).

The DOMs of one source are merged by path. A path is a presentation node: it knows the pages
that have it and how differently they go on (the entropy of its children's styles; of a leaf,
the mean importance of its contents). Under it stand its content nodes, one for each different
content of the branch there, which are the less important the more evenly they are spread over
the source's pages (1 - log(pages with it) / log(pages)). A content node's composite importance
takes in that of its presentation. Branches of low importance that stand on a fixed share of
the source's pages are removed from each page with all that is below them, so that the same text
is removed at every size of a source. A presentation node that names itself (a class or id) and
all of whose contents are low goes with all of them. Contents are compared with their figures
and signs.

What stays is written as clean text in which headings, lists, code, formulas and tables can
still be told, with inline marks gone and entities resolved. The kinds of markup in a text are
read off the same nodes, before any is removed, as boilerplate markup is markup too.

Parsing is a scan in Arrow batches, once a text; the nodes are kept as a table. Paths and
contents travel as 64-bit hashes, merged with partial sums; joins on a source's hot contents are
spread over ``SALT`` parts, so a source with a third of all pages makes no hot group.

Defined results: null texts give no rows, an empty or blank text gives an empty clean text;
damaged markup counts as the kind it is a rest of; marks within code, formulas and tables count
for these alone. Repeated sections count once. Other columns aren't touched.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import once
from quire.session import kept

KINDS = ("heading", "list", "code", "formula", "table", "inline")

# Names of the dialects' marks.
TAGS = "a abbr acronym article aside b big blockquote body br center cite code dd del dfn dir div dl dt em figure font footer frame head header hr html i img ins kbd label li link main map mark math menu meta nav ol p page pre q ref s samp script section small source span strike strong style sub sup svg table tbody td tfoot th thead title tr tt u ul var wbr h1 h2 h3 h4 h5 h6 nowiki gallery poem syntaxhighlight object param iframe form input button select option textarea caption col colgroup".split()
ENTITIES = "nbsp amp lt gt quot apos ndash mdash hellip copy reg deg euro shy times laquo raquo ldquo rdquo lsquo rsquo bull middot sect frac12 eacute auml ouml uuml szlig".split()
MATH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Sigma Phi Psi Omega frac dfrac tfrac sqrt sum prod int lim le leq ge geq neq ne approx equiv cdot times div pm mp infty partial nabla in subset cup cap to rightarrow leftarrow left right mathrm mathbf hat bar vec overline ldots cdots".split()

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*[\w+#.-]*\s*$")
_CODE_OPEN = re.compile(r"<(pre|syntaxhighlight|source|listing|xmp)\b[^>]*>?|\\begin\{(verbatim|lstlisting|minted|alltt)\*?\}(?:\[[^\]]*\])?|<code\b[^>]*>(?=[^<\n]*(?:\n|$))", re.I)
_MATH_ENV = r"equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign"
_FORMULA_OPEN = re.compile(rf"\$\$|\\\[|\\\(|\\begin\{{({_MATH_ENV})\*?\}}|<math\b[^>]*>?", re.I)
_TABLE_OPEN = re.compile(r"<table\b[^>]*>?|^\s*\{\|[^\n]*|\\begin\{(tabular[xy*]?|longtable|table\*?|array)\}", re.I | re.M)
_RULE_ROW = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{2,}:?\s*\|\s*$")
_PIPE_ROW = re.compile(r"^\s*\|(?!\}).*\|\s*$")
_ATX = re.compile(r"^\s{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_WIKI_HEAD = re.compile(r"^\s*(={2,6})\s*([^=\s][^=\n]*?)\s*(={1,6})?\s*$")
_HTML_HEAD = re.compile(r"</?h[1-6]\b[^<>\n]*>?", re.I)
_TEX_HEAD = re.compile(r"\\(?:(?:sub){0,2}section|chapter|part|(?:sub)?paragraph)\*?\s*\{")
_SETEXT = re.compile(r"^\s{0,3}(=+|-+)\s*$")
_BULLET = re.compile(r"^\s*(?:[*+-]|\*{2,4})[ \t]+(?:\[[ xX]?\][ \t]*)?(?=\S)")
_NUMBERED = re.compile(r"^\s*(\d{1,4})[.)][ \t]+(?=\S)")
_PAGE_DASH = re.compile(r"^\s*-\s*[\divxlcIVXLC]{1,6}\s*-?\s*$")
_HTML_LIST = re.compile(r"</?(?:ul|ol|li|dl|dt|dd|menu)\b[^<>\n]*>?", re.I)
_TEX_LIST = re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}|\\item\b")
_TABLE_REST = re.compile(r"</?(?:table|tr|td|th|tbody|thead|tfoot|caption|colgroup)\b[^<>\n]*>?|\\(?:end\{tabular\}|hline\b|multicolumn\b)|^\s*\|[-}]\s*$|^\s*\|\}", re.I | re.M)
_CODE_REST = re.compile(r"</?(?:pre|syntaxhighlight)\b[^<>\n]*>?|\\end\{(?:verbatim|lstlisting|minted)\}", re.I)
_INLINE_MATH = re.compile(
    r"(?<![\w$\\])\$(?=[^\s$])[^$\n]+?(?<=[^\s\\])\$(?![\w$])"
    rf"|\$[^$\n]*(?:\\(?:{'|'.join(MATH)})\b|[\w)\]}}][\^_]\{{)[^$\n]*\$?"
    rf"|(?:\\(?:{'|'.join(MATH)})\b(?![\\\w])|[A-Za-z0-9)\]}}][\^_]\{{[^}}\n]*\}}?)[^$\n]*\$"
    rf"|[A-Za-z0-9)\]}}][\^_]\{{[^}}\n]*\}}|\\(?:{'|'.join(m for m in MATH if m not in ('in', 'to', 'left', 'right', 'div', 'times', 'mu', 'nu', 'pi', 'bar', 'hat', 'part'))})\b(?:\{{|\s|$)"
    rf"|</?math\b[^<>\n]*>?|\\\)|\\\]|\\end\{{(?:{_MATH_ENV})\*?\}}|<m[ionr]\b[^<>]*>"
)
_MATH_LIKE = re.compile(r"[\\^_=+<>]|^\$[A-Za-z]\$$")
_INLINE = re.compile(
    r"<!--|-->"
    rf"|</?(?:{'|'.join(TAGS)})(?=[\s/>]|$)[^<>\n]*>?"
    r"|</?[A-Za-z][\w:-]*(?:\s[^<>\n]*)?/?>"
    rf"|&(?:#\d{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,9}});|&(?:{'|'.join(ENTITIES)})(?![\w;])"
    r"|\*\*+(?=[^\s*])|(?<=[^\s*])\*\*+|(?<!\w)__(?=[^\s_])|(?<=[^\s_])__(?!\w)|~~(?=\S)|(?<=\S)~~"
    r"|(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])|(?<![\w_])_[^\s_](?:[^_\n]*[^\s_])?_(?![\w_])"
    r"|`[^`\n]*`|(?<!`)`(?!`)"
    r"|!?\[[^\[\]\n]*\]\([^()\n]*\)?|\[\[|\]\]|\{\{|\}\}|'{2,5}(?=\S)|(?<=\S)'{2,5}|\[\^\w+\]|\[https?://[^\]\n]*\]?"
    r"|(?<![A-Za-z]:)(?<!\\)\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\\\(?=\s|$)|(?<=[A-Za-z])~(?=[A-Za-z])|(?<!\\)\\[_%&#$*]|\\(?:noindent|newline|newpage|par|LaTeX|TeX|ldots|maketitle|bigskip|medskip|smallskip|clearpage|pagebreak)\b"
    r"|__(?:TOC|NOTOC|FORCETOC)__",
    re.I,
)

#: Quick check in Java's dialect; what it misses has no mark.
QUICK_CHECK = r"(?m)[<`~$\\{}]|&#?\w+;?|\*\S|\S\*|__|(?<![\w])_\S|\]\(|\[\[|\]\]|''|-->|\[\^|\[http|^\s*(?:[*+-]|\*{2,4})[ \t]|^\s{0,3}#{1,6}[ \t]|^\s*={1,6}|^\s*-{2,}\s*$|^\s*[|]|-{2,}:?\s*[|]|^\s*\d{1,4}[.)][ \t]+\S[^\n]*\n\s*\d{1,4}[.)][ \t]"


_IN_TABLE = re.compile(r"^\s*(?:</?(?:tr|td|th|tbody|thead|tfoot|caption|col|colgroup)\b|</table|[|!])|^.*\\\\\s*$|^\s*\\(?:hline|end)", re.I)


def _close(lines: list[str], i: int, rest: str, closer: re.Pattern, opener: re.Pattern | None = None) -> tuple[int, str, bool]:
    """From line i (its text after the opening mark): the line where it closes, the text after that, and whether it does.

    A damaged table (opener given) ends before another begins, or at a blank line behind which none of its rows follow."""
    m = closer.search(rest)
    if m:
        return i, rest[m.end() :], True
    for j in range(i + 1, len(lines)):
        if opener is not None:
            if opener.search(lines[j]) and not (closer.search(lines[j]) and closer.search(lines[j]).start() < opener.search(lines[j]).start()):
                return j - 1, "", False
            if not lines[j].strip():
                after = next((x for x in lines[j + 1 :] if x.strip()), "")
                if not _IN_TABLE.match(after):
                    return j - 1, "", False
        m = closer.search(lines[j])
        if m:
            return j, lines[j][m.end() :], True
    j = i
    while j + 1 < len(lines) and lines[j + 1].strip():  # damaged: to the next blank line
        j += 1
    return j, "", False


def _closer(opened: re.Match, kind: str) -> re.Pattern:
    t = opened.group().strip().lower()
    if t.startswith("<"):
        name = re.match(r"<(\w+)", t)[1]
        return re.compile(rf"</{name}\s*>?(?:\s*</pre\s*>)?", re.I)
    if t.startswith("\\begin"):
        name = re.match(r"\\begin\{(\w+\*?)", t)[1]
        return re.compile(rf"\\end\{{{re.escape(name)}\}}?", re.I)
    return {"$$": re.compile(r"\$\$"), "\\[": re.compile(r"\\\]"), "\\(": re.compile(r"\\\)")}.get(t, re.compile(r"^\s*\|\}", re.M))


class Node:
    """A block: kind, presentation, level, body, marks around it."""

    __slots__ = ("body", "kind", "level", "marks", "style")

    def __init__(self, kind: str, style: str, body: str, level: int = 0, marks: tuple[str, ...] = ()):
        self.kind, self.style, self.body, self.level, self.marks = kind, style, body, level, marks


def _follows(line: str, after: str) -> bool:
    """Whether two lines are numbered one after the other."""
    a, b = _NUMBERED.match(line), _NUMBERED.match(after)
    return bool(a and b) and int(b[1]) == int(a[1]) + 1


def parse(text: str) -> list[Node]:
    """The block nodes of a text in order."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[Node] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            out.append(Node("paragraph", "text", "\n".join(para)))
            para.clear()

    i, carry = 0, None
    while i < len(lines):
        line = lines[i] if carry is None else carry
        carry = None
        if not line.strip():
            flush()
            i += 1
            continue
        # fences
        m = _FENCE.match(line)
        if m:
            flush()
            mark, j = m[1], i + 1
            while j < len(lines) and not ((n := _FENCE.match(lines[j])) and n[1][0] == mark[0] and len(n[1]) >= len(mark) and lines[j].strip() == n[1]):
                j += 1
            if j == len(lines):  # no end: to the next blank line
                j = i + 1
                while j < len(lines) and lines[j].strip():
                    j += 1
                out.append(Node("code", "fence", "\n".join(lines[i + 1 : j])))
                i = j
            else:
                out.append(Node("code", "fence", "\n".join(lines[i + 1 : j])))
                i = j + 1
            continue
        # enclosed blocks that may start within a line: the first of them
        found = [(m, kind) for kind, rx in (("code", _CODE_OPEN), ("formula", _FORMULA_OPEN), ("table", _TABLE_OPEN)) if (m := rx.search(line))]
        if found:
            m, kind = min(found, key=lambda x: x[0].start())
            before = line[: m.start()]
            wrapped = kind == "formula" and re.fullmatch(r"\s*:*\s*(?:<p\s+class=[\"']?math[\"']?\s*>)?\s*", before)
            if before.strip() and not wrapped:
                para.append(before)
            j, rest, closed = _close(lines, i, line[m.end() :], _closer(m, kind), _TABLE_OPEN if kind == "table" else None)
            if not closed and kind == "formula" and m.group() in ("$$", "\\("):  # only this line
                j, rest = i, ""
            block = line[m.end() :] if j == i else "\n".join([line[m.end() :], *lines[i + 1 : j + 1]])
            body = block[: len(block) - len(rest)] if rest else block
            if closed:
                body = _closer(m, kind).sub("", body)
            inside = kind == "formula" and m.group() != "$$" and (before.strip() and not wrapped or re.sub(r"^\s*</p>", "", rest).strip())
            if not inside:
                flush()
            out.append(Node(kind, m.group().strip().lower().rstrip(">"), body, marks=("inline",) if wrapped and "<p" in before else ()))
            if wrapped and "<p" in before:
                rest = re.sub(r"^\s*</p\s*>", "", rest)
            i = j
            carry = rest
            if not rest.strip():
                i, carry = j + 1, None
            continue
        # pipe tables
        if "|" in line and ((i + 1 < len(lines) and _RULE_ROW.match(lines[i + 1])) or _RULE_ROW.match(line) or (_PIPE_ROW.match(line) and line.count("|") >= 2) or re.match(r"^\s*\|[-}]\s*$", line)):
            flush()
            j = i
            while j < len(lines) and ("|" in lines[j]) and lines[j].strip():
                j += 1
            out.append(Node("table", "pipe", "\n".join(lines[i:j])))
            i = max(j, i + 1)
            continue
        # headings
        m = _ATX.match(line)
        if m:
            flush()
            out.append(Node("heading", "atx", m[2], len(m[1])))
            i += 1
            continue
        m = _WIKI_HEAD.match(line)
        if m and re.search(r"\w", m[2]):
            flush()
            out.append(Node("heading", "wiki", m[2], len(m[1])))
            i += 1
            continue
        if i + 1 < len(lines) and (n := _SETEXT.match(lines[i + 1])) and len(n[1]) >= 3 and not para and not _BULLET.match(line) and re.search(r"[^\W\d_]", line) and (n[1][0] == "=" or abs(len(n[1]) - len(line.strip())) <= 3):
            flush()
            out.append(Node("heading", "setext", line.strip(), 1 if n[1][0] == "=" else 2))
            i += 2
            continue
        if _HTML_HEAD.search(line) or _TEX_HEAD.search(line):
            flush()
            level = re.search(r"<h([1-6])", line, re.I)
            out.append(Node("heading", "html" if _HTML_HEAD.search(line) else "tex", line, int(level[1]) if level else 1 + line.count("sub")))
            i += 1
            continue
        # lists
        if (_BULLET.match(line) and not _PAGE_DASH.match(line)) or _HTML_LIST.search(line) or _TEX_LIST.search(line):
            style = "html" if _HTML_LIST.search(line) else "tex" if _TEX_LIST.search(line) else "bullet"
            flush()
            if out and out[-1].kind == "list" and out[-1].style == style:
                out[-1].body += "\n" + line
            else:
                out.append(Node("list", style, line))
            i += 1
            continue
        # numbered items are a list if they count on; a number alone is plain text
        goes_on = not para and out and out[-1].style == "ordered" and _follows(out[-1].body.rsplit("\n", 1)[-1], line)
        if goes_on or (i + 1 < len(lines) and _follows(line, lines[i + 1])):
            flush()
            if goes_on:
                out[-1].body += "\n" + line
            else:
                out.append(Node("list", "ordered", line))
            i += 1
            continue
        if _TABLE_REST.search(line):
            flush()
            out.append(Node("table", "rest", line))
            i += 1
            continue
        if _CODE_REST.search(line):
            flush()
            out.append(Node("code", "rest", line))
            i += 1
            continue
        para.append(line)
        i += 1
    flush()
    return out


def _formulas(body: str) -> list[str]:
    return [m.group() for m in _INLINE_MATH.finditer(body) if not m.group().startswith("$") or _MATH_LIKE.search(m.group()) or re.fullmatch(r"\$[A-Za-z]\$", m.group())]


def _no_math(body: str) -> str:
    return _INLINE_MATH.sub(lambda m: " " if m.group() in _formulas(m.group()) or not m.group().startswith("$") else m.group(), body)


def node_kinds(n: Node) -> set[str]:
    """The kinds of markup that a block shows: its own, and those of the marks in and around it."""
    out = set(n.marks)
    if n.kind != "paragraph":
        out.add(n.kind)
    if n.kind in ("code", "formula", "table"):
        return out
    body = n.body
    if _formulas(body):
        out.add("formula")
        body = _no_math(body)
    body = _HTML_HEAD.sub(" ", _HTML_LIST.sub(" ", body)) if n.kind in ("heading", "list") else body
    if n.kind == "list":
        body = "\n".join(_TEX_LIST.sub(" ", _BULLET.sub("", x)) for x in body.split("\n"))
        if _HTML_HEAD.search(n.body):
            out.add("heading")
    if n.kind == "heading":
        body = _TEX_HEAD.sub(" ", body)
        if _HTML_LIST.search(n.body) or _TEX_LIST.search(n.body):
            out.add("list")
    if _INLINE.search(body):
        out.add("inline")
    return out


def kinds(nodes: list[Node]) -> set[str]:
    """The kinds of markup that the nodes show."""
    return set().union(*map(node_kinds, nodes))


_ANY_MARK = re.compile(r"[<&*_~`\\\[\]{}]|''")


def plain(body: str) -> str:
    """Text without inline marks, entities resolved."""
    if not _ANY_MARK.search(body):
        return body
    t = re.sub(r"<!--.*?(?:-->|$)", "", body, flags=re.S)
    t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
    t = re.sub(r"</?[A-Za-z!][^<>\n]*>", "", t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)?", r"\1", t)
    t = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier):(?:[^|\]\n]*\|)*([^|\]\n]*)\]\]", r"\1", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"\{\{[^|{}\n]*\|?([^{}\n]*)\}\}", lambda m: m[1].replace("|", " "), t)
    t = re.sub(r"\\(?:href)\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", t)
    t = re.sub(r"\\(?:cite|label|ref|eqref|vspace|hspace)\*?\{[^{}\n]*\}", "", t)
    t = re.sub(r"(?<![A-Za-z]:)\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}?", r"\1", t)
    t = re.sub(r"\*\*+|~~|(?<!\w)__(?=\S)|(?<=\S)__(?!\w)|'{2,5}|`", "", t)
    t = re.sub(r"(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])", r"\1", t)
    t = re.sub(r"(?<![\w_])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])", r"\1", t)
    t = re.sub(r"(?<=[A-Za-z])~(?=[A-Za-z])", " ", t)
    t = re.sub(r"\\\\(?=\s|$)", "", t)
    t = re.sub(r"\\([_%&#$*])", r"\1", t)
    return html.unescape(html.unescape(t))


def _cells(n: Node) -> list[list[str]]:
    b = n.body
    if n.style.startswith("<") or n.style == "rest":
        rows = [r for r in re.split(r"<tr\b[^>]*>|</tr>", b, flags=re.I) if re.search(r"<t[dh]\b", r, re.I) or r.strip()]
        return [[plain(c).strip() for c in re.split(r"<t[dh]\b[^>]*>", r, flags=re.I)[1:]] or [plain(r).strip()] for r in rows]
    if n.style.startswith("\\"):
        return [[plain(c).strip() for c in r.split("&")] for r in re.split(r"\\\\|\\hline", re.sub(r"^\{[^}]*\}", "", b.strip())) if r.strip()]
    rows, wiki = [], n.style.startswith("{")
    for line in b.split("\n"):
        if _RULE_ROW.match(line) or not line.strip() or line.strip().startswith(("{|", "|}")):
            continue
        if wiki and line.strip().startswith("|-"):
            continue
        rows.append([plain(c).strip() for c in (re.split(r"\|\||!!", line.strip().lstrip("|!")) if wiki else line.strip().strip("|").split("|"))])
    return rows


def items(n: Node) -> list[str]:
    """The items of a list, raw."""
    return [x for x in re.split(r"\n|(?=<li\b)|(?=<dt\b)|(?=\\item\b)", n.body, flags=re.I) if x.strip()]


def render_item(item: str, style: str) -> str:
    """An item as clean text: with its number, or a dash; empty if it holds marks alone."""
    number = _NUMBERED.match(item) if style == "ordered" else None
    x = item[number.end() :] if number else re.sub(r"<(?:li|dt)\b[^>]*>?", "", _BULLET.sub("", item), flags=re.I)
    x = plain(_TEX_LIST.sub("", re.sub(r"</dt>\s*<dd\b[^>]*>", ": ", x, flags=re.I))).strip()
    return (f"{number[1]}. " if number else "- ") + x if x else ""


def render(n: Node) -> str:
    """A node as clean text in which its kind can be told."""
    if n.kind == "heading":
        t = _TEX_HEAD.sub("", _HTML_HEAD.sub("", n.body)).strip().rstrip("}") if n.style in ("html", "tex") else n.body
        return "#" * max(1, min(6, n.level)) + " " + plain(t).strip()
    if n.kind == "list":
        return "\n".join(c for x in items(n) if (c := render_item(x, n.style)))
    if n.kind == "code":
        body = re.sub(r"</?(?:pre|code|syntaxhighlight|source)\b[^<>]*>", "", n.body, flags=re.I) if n.style != "fence" else n.body
        return "```\n" + (html.unescape(body) if n.style.startswith("<") else body).strip("\n") + "\n```"
    if n.kind == "formula":
        return "$$ " + re.sub(r"\s+", " ", re.sub(r"</?m[a-z]*\b[^<>]*>", "", n.body)).strip() + " $$"
    if n.kind == "table":
        return "\n".join("| " + " | ".join(re.sub(r"\s+", " ", c) for c in r) + " |" for r in _cells(n) if any(r))
    return plain(n.body).strip("\n")


# Tags that hold blocks.
CONTAINERS = "html body div section article main header footer nav aside blockquote center font form poem gallery".split()
_OPEN = re.compile(rf"^\s*<({'|'.join(CONTAINERS)})\b([^<>\n]*)>\s*$", re.I)
_SHUT = re.compile(rf"^\s*</({'|'.join(CONTAINERS)})\s*>?\s*$", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id)\s*=\s*[\"']?([\w -]*)", re.I)
_FIRST_TAG = re.compile(r"^\s*<(p|span|div|font|h[1-6]|ul|ol|dl|table|pre|small|center)\b([^<>\n]*)>?", re.I)


class Branch:
    """A node of the DOM: label, own content (leaves), its block's kinds of markup, children."""

    __slots__ = ("children", "clean", "content", "kinds", "label", "named")

    def __init__(self, label: str, clean: str | None = None, content: str = "", kinds: set[str] | frozenset[str] = frozenset(), named: bool = False):
        self.label, self.clean, self.content, self.kinds, self.named = label, clean, content, kinds, named
        self.children: list[Branch] = []


def _attributes(text: str) -> str:
    return "".join(f" {a.lower()}={' '.join(v.lower().split())}" for a, v in _ATTRIBUTE.findall(text))


def _compared(body: str) -> str:
    """What of a node's content is compared between pages: all but blanks and letter case; nothing of nodes without a letter, which aren't compared.

    Figures and signs count, as lines, lists and tables that differ in them alone are different text."""
    return " ".join(body.lower().split()) if re.search(r"[^\W\d_]", body) else ""


def build(nodes: list[Node]) -> Branch:
    """The DOM of a text's blocks."""
    root = Branch("page")
    open_: list[tuple[Branch, int, str]] = [(root, 0, "")]  # branch, level of a section, tag of a container

    def paragraph(lines: list[str], shown: set[str]) -> None:
        tag = _FIRST_TAG.match(lines[0])
        extra = _attributes(tag[2]) if tag else ""
        p = Branch(f"paragraph {tag[1].lower() if tag else ''}{extra}", kinds=shown, named=bool(extra))
        p.children = [Branch("line", plain(x), _compared(x)) for x in lines]
        open_[-1][0].children.append(p)

    for n in nodes:
        shown = node_kinds(n)
        if n.kind == "paragraph":
            lines: list[str] = []
            for x in n.body.split("\n"):
                begins, ends = _OPEN.match(x), _SHUT.match(x)
                if not begins and not ends:
                    lines.append(x)
                    continue
                if lines:
                    paragraph(lines, shown)
                    lines = []
                if begins:
                    extra = _attributes(begins[2])
                    b = Branch(f"{begins[1].lower()}{extra}", kinds=shown, named=bool(extra))
                    open_[-1][0].children.append(b)
                    open_.append((b, 0, begins[1].lower()))
                else:
                    at = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][2] == ends[1].lower()), None)
                    if at is None:  # nothing to close: a rest of damaged markup
                        open_[-1][0].children.append(Branch(f"rest {ends[1].lower()}", "", "", shown))
                    else:
                        open_[at][0].kinds = open_[at][0].kinds | shown
                        del open_[at:]
            if lines:
                paragraph(lines, shown)
            continue
        if n.kind == "heading":
            while len(open_) > 1 and not open_[-1][2] and open_[-1][1] >= max(1, n.level):
                open_.pop()
            b = Branch(f"section {max(1, n.level)}")
            open_[-1][0].children.append(b)
            open_.append((b, max(1, n.level), ""))
            b.children.append(Branch(f"heading {n.style}{_attributes(n.body) if n.style == 'html' else ''}", render(n), _compared(n.body), shown))
            continue
        extra = _attributes(n.style)
        b = Branch(f"{n.kind} {re.sub(r'[^a-z{|$~]', ' ', n.style.split(' ')[0])}{extra}", kinds=shown, named=bool(extra))
        if n.kind == "list":
            b.children = [Branch(f"item {'nested' if re.match(r'(?:[ \t]{2,}|[*]{2})', x) else ''}", render_item(x, n.style), _compared(x)) for x in items(n)]
        elif n.kind == "table" and (rows := render(n)):
            b.children = [Branch("row", x, _compared(x)) for x in rows.split("\n")]
        else:
            b.clean, b.content = render(n), _compared(n.body)
        open_[-1][0].children.append(b)
    return root


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_NODE_ARROW = [("kinds", pa.list_(pa.string())), ("path", pa.int64()), ("content", pa.int64()), ("goes_on", pa.int64()), ("named", pa.bool_()), ("end", pa.int32()), ("block", pa.int32()), ("clean", pa.string())]


def rows_of(text: str) -> list[dict]:
    """The nodes of a text's DOM in order, parents before children: path, content of the whole branch (null if there is nothing to compare), styles of the children (null for leaves), position behind the branch's last node, block, clean text of leaves."""
    out: list[dict] = []
    block = 0
    # parents first, without recursion, as containers may stand in each other without end
    stack: list[tuple[Branch, int, bool]] = [(build(parse(text)), 0, False)]
    at: dict[int, int] = {}
    while stack:
        b, path, done = stack.pop()
        if not done:
            block += not b.label.startswith(("line", "item", "row"))
            at[id(b)] = len(out)
            above, path = path, _hash(path, b.label)
            inner = b.clean is None
            out.append({"kinds": sorted(b.kinds), "path": path, "content": _hash(b.content) if b.content else None, "goes_on": _hash(*(c.label for c in b.children)) if inner else None, "named": b.named, "end": len(out), "block": block, "clean": b.clean})
            if inner:
                stack.append((b, path, True))
                # a section is a branch, yet what stands in it has the same look whatever it is under
                stack += [(c, above if b.label.startswith("section") else path, False) for c in reversed(b.children)]
        else:
            me = out[at[id(b)]]
            below = [out[at[id(c)]]["content"] for c in b.children]
            me["content"] = _hash(*below) if any(x is not None for x in below) else None
            me["end"] = len(out) - 1
    return out[1:]  # the page itself is no branch, and positions count from the first that is


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("path", T.LongType()), T.StructField("content", T.LongType()), T.StructField("goes_on", T.LongType()), T.StructField("named", T.BooleanType()), T.StructField("end", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("clean", T.StringType())])))
def _dom(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else rows_of(t) for t in batch.to_pylist()], pa.list_(pa.struct(_NODE_ARROW)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _dom_kinds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The kinds of the same DOM's nodes alone."""
    for batch in batches:
        out = []
        for t in batch.to_pylist():
            found: set[str] = set()
            stack = [] if t is None else [build(parse(t))]
            while stack:
                b = stack.pop()
                found |= b.kinds
                stack += b.children
            out.append(sorted(found))
        yield pa.array(out, pa.list_(pa.string()))


def marked(text: Column) -> Column:
    """Whether the text can have a mark at all."""
    return F.coalesce(text.rlike(QUICK_CHECK), F.lit(False))


def fields(sections: DataFrame, keys: tuple[str, ...] = ("section_key",)) -> DataFrame:
    """keys, field, region, text of content, ocr_markdown and each image's markdown; region 0 outside images."""
    own = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(0).alias("region"), F.col(c).alias("text")) for c in ("content", "ocr_markdown")))
    images = F.transform(F.coalesce("image_ocr", F.array()), lambda x: F.struct(F.lit("image_markdown").alias("field"), x["region"].alias("region"), x["markdown"].alias("text")))
    return sections.select(*keys, F.inline(F.concat(own, images))).where(F.col("text").isNotNull())


def found_kinds(sections: DataFrame, keys: tuple[str, ...] = ("section_key",)) -> DataFrame:
    """keys, field, region, kind: the kinds of markup in each field, read off its DOM; repeated sections count once."""
    some = fields(sections, keys).where(marked(F.col("text"))).withColumn("kinds", _dom_kinds("text"))
    # outer: an inner explode would make the optimizer filter on the array and so parse twice
    return some.select(*keys, "field", "region", F.explode_outer("kinds").alias("kind")).where(F.col("kind").isNotNull()).distinct()


#: Least importance a branch must have to stay, and the fewest pages on which a source can show its style.
LEAST_IMPORTANCE = 0.35
LEAST_PAGES = 5
#: Share of its source's pages that a node must stand on to be removed, whatever its importance: by entropy alone that share sinks as a source grows.
LEAST_SHARE = 0.2
#: Share of a content node's importance that its presentation's importance scales.
SHOWN = 0.2
#: Parts of a content's occurrences in joins with the nodes of the style tree.
SALT = 32


def dom(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """section_key, field, region, source, the DOM's nodes of each field and the clean texts of its leaves; kept as a table, as each text is parsed once."""
    narrow = once(sections.select("section_key", "doc_id", "content", "ocr_markdown", "image_ocr", "loaded_at"))
    known = narrow.join(documents.select("doc_id", "source"), "doc_id", "left")
    parsed = fields(known, ("section_key", "source")).select("section_key", "field", "region", "source", _dom("text").alias("_d"))
    slim = F.transform("_d", lambda x: F.struct(*(x[c].alias(c) for c in ("path", "content", "goes_on", "named", "end", "block"))))
    # in columns of their own, so that what compares nodes doesn't read the texts
    return kept(parsed.select("section_key", "field", "region", "source", slim.alias("nodes"), F.transform("_d", lambda x: x["clean"]).alias("cleans")))


def _spread(df: DataFrame) -> DataFrame:
    """Each row once for each part."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _part(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")


def occurrences(doms: DataFrame) -> DataFrame:
    """source, section_key, field, region, i, path, content, goes_on, named, end of each node; short rows without text."""
    slim = F.transform("nodes", lambda x, i: F.struct(i.alias("i"), x["path"].alias("path"), x["content"].alias("content"), x["goes_on"].alias("goes_on"), x["named"].alias("named"), x["end"].alias("end")))
    each = doms.where(F.col("source").isNotNull()).select("source", "section_key", "field", "region", slim.alias("_x"))
    return each.select("source", "section_key", "field", "region", F.inline_outer("_x")).where(F.col("path").isNotNull())


def style_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged tree of each source.

    Presentation nodes (source, path, importance, named, share of the source's pages) and content nodes
    (source, path, content, importance, composite importance, share)."""
    pages = nodes.groupBy("source", "section_key").agg(F.lit(1).alias("_one")).groupBy("source").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    of_pages = _spread(pages)
    # content: how evenly it is spread over the source's pages
    on_page = nodes.where(F.col("content").isNotNull()).groupBy("source", "path", "content", "section_key").agg(F.lit(1).alias("_one"))
    spread = on_page.groupBy("source", "path", "content").agg(F.count("*").alias("k")).withColumn("_salt", _part("path", "content")).join(of_pages, ["source", "_salt"]).drop("_salt")
    own = 1 - F.log(F.col("k").cast("double")) / F.log(F.col("m").cast("double"))
    content = spread.withColumn("importance", own).withColumn("share", F.col("k") / F.col("m"))
    # presentation: how differently its pages go on; of leaves the mean of what stands there
    ways = nodes.where(F.col("goes_on").isNotNull()).groupBy("source", "path", "goes_on").agg(F.count("*").alias("w"))
    # -sum(p log p) = log(t) - sum(w log w) / t
    inner = ways.groupBy("source", "path").agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.log("w")).alias("s")).select("source", "path", F.when(F.col("t") > 1, (F.log("t") - F.col("s") / F.col("t")) / F.log("t")).otherwise(1.0).alias("goes_on"))
    mean = content.groupBy("source", "path").agg((F.sum(F.col("importance") * F.col("k")) / F.sum("k")).alias("mean"), F.max("importance").alias("most"), F.max("m").alias("m"))
    seen = nodes.groupBy("source", "path", "section_key").agg(F.max("named").alias("named")).groupBy("source", "path").agg(F.count("*").alias("k"), F.max("named").alias("named"))
    presentation = mean.join(seen, ["source", "path"]).join(inner, ["source", "path"], "left")
    presentation = presentation.select("source", "path", F.coalesce("goes_on", "mean").alias("importance"), "mean", "most", "named", (F.col("k") / F.col("m")).alias("share"))
    shown = _spread(presentation.select("source", "path", F.col("importance").alias("_shown")))
    content = content.withColumn("_salt", _part("content")).join(shown, ["source", "path", "_salt"]).withColumn("composite", F.col("importance") * (1 - SHOWN + SHOWN * F.col("_shown")))
    return presentation, content.select("source", "path", "content", "importance", "composite", "share")


def removed(nodes: DataFrame, least: float = LEAST_IMPORTANCE, least_share: float = LEAST_SHARE) -> DataFrame:
    """section_key, field, region, gone: the positions of the nodes removed, each with all below it."""
    presentation, content = style_tree(nodes)
    low = content.where((F.col("share") >= least_share) & (F.col("composite") < least)).select("source", "path", "content")
    hit = nodes.withColumn("_salt", _part("section_key", "i")).join(_spread(low), ["source", "path", "content", "_salt"])
    # a presentation that names itself and shows nothing that matters
    bare = presentation.where(F.col("named") & (F.col("share") >= least_share) & (F.col("most") < least)).select("source", "path")
    whole = nodes.where("named").withColumn("_salt", _part("section_key", "i")).join(_spread(bare), ["source", "path", "_salt"])
    every = hit.select("section_key", "field", "region", "i", "end").unionByName(whole.select("section_key", "field", "region", "i", "end"))
    return every.groupBy("section_key", "field", "region").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("i"), F.col("end") - 1)))).alias("gone"))


def clean_text(sections: DataFrame, documents: DataFrame, least: float = LEAST_IMPORTANCE, least_share: float = LEAST_SHARE) -> DataFrame:
    """section_key, field, region, clean, n_removed: each field's clean text without its source's branches of low importance, and how many leaves went."""
    doms = dom(sections, documents)
    nodes = kept(occurrences(doms))  # short rows, read several times
    joined = doms.join(removed(nodes, least, least_share), ["section_key", "field", "region"], "left")
    leaves = F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.get("cleans", i).isNotNull())
    leaves = F.when(F.size("nodes") > 0, leaves).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("_all", leaves).withColumn("_kept", F.when(F.col("gone").isNull(), F.col("_all")).otherwise(F.array_except("_all", "gone")))
    # a blank line where a block begins
    lines = F.transform("_kept", lambda i, k: F.concat(F.when((k > 0) & (F.get("nodes", i)["block"] != F.get("nodes", F.get("_kept", k - 1))["block"]), "\n").otherwise(""), F.get("cleans", i)))
    return joined.select("section_key", "field", "region", F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n").alias("clean"), (F.size("_all") - F.size("_kept")).alias("n_removed"))
