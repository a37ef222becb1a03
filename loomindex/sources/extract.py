"""Symbols from source texts, one row per symbol.

A text is one row, so its lines are looked at inside that row: a short table of header patterns per
language finds where symbols begin, and one rule per block style finds where they end (indentation,
braces, ``end``). Names are qualified in signatures: ``A::B#m`` and ``A::B.m`` in Ruby, ``A.m(x)`` in scripts,
``m(x) -> int`` in Python. Python texts that parse are read from their syntax tree instead. What
no pattern matches becomes one fallback row. Relations between files are found with joins, see
``relations.py``.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomindex.functions.classify import OVERSIZE_CHARS

#: Fixed values. Characters of a fallback row, and the document of a Dockerfile's own row.
FALLBACK_CHARS = 500
DOCKERFILE_DOC = "Standalone Dockerfile record for file-level retrieval."
#: Characters of bodies after which rows are handed on.
BATCH_CHARS = 16_000_000
SCHEMA = "path string, language string, kind string, name string, signature string, body string, doc string, fallback boolean, extraction string, start_line int, start_column int, end_line int, end_column int"
_SCRIPT = [
    ("import", r"^(?P<name>import\b.*)$"),
    ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)"),
    ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
    ("function", r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>)"),
    ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name>[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$"),
]
_TYPED = [(k, rf"^(?:export\s+)?(?:declare\s+)?(?:const\s+)?{k}\s+(?P<name>[A-Za-z_$][\w$]*)") for k in ("interface", "type", "enum")]
#: Fixed values. Where symbols begin, by language: kind and pattern of the header line.
PATTERNS = {
    "python": [
        ("import", r"^\s*(?P<name>(?:from\s+[\w.]+\s+import|import\s+\w).*)$"),
        ("class", r"^\s*class\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)"),
    ],
    "javascript": _SCRIPT,
    "typescript": [*_SCRIPT[:4], *_TYPED, _SCRIPT[4]],
    "ruby": [
        ("import", r"^\s*(?P<name>require(?:_relative)?\s*\(?\s*[\"'][^\"']+[\"'].*)$"),
        ("module", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"),
        ("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"),
        ("method", r"^\s*def\s+(?P<self>self\.)?(?P<name>\w+[?!=]?)"),
        ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*=[^=]"),
    ],
    "markdown": [("heading", r"^#{1,6}\s+(?P<name>.*\S)\s*$")],
    "yaml": [("key", r"^\s*(?P<name>[A-Za-z0-9_.-]+)\s*:(?:\s|$)")],
    "shell": [("function", r"^\s*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+(?P<name>[A-Za-z_][\w-]*)\s*\{?")],
    "dockerfile": [
        ("stage", r"(?i:^\s*FROM\s+.+?\s+AS)\s+(?P<name>[A-Za-z0-9_.-]+)\s*$"),
        ("variable", r"^\s*(?P<kind>(?i:ARG|ENV))\s+(?P<name>[A-Za-z_]\w*)"),
        ("instruction", r"^\s*(?P<kind>[A-Z]+)\s+(?P<name>\S+(?:\s+\S+){0,3})"),
    ],
}
_COMPILED = {lang: [(k, re.compile(p)) for k, p in rules] for lang, rules in PATTERNS.items()}
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
_ONE_LINE = {"import", "constant", "key", "stage"}
#: What stands before a block of a style sheet, and what is blanked beforehand: comments and quoted texts, which may hold braces.
_CSS_HEAD = re.compile(r"([^{}]*)(?:(\{)|\}|\Z)")
_CSS_OPAQUE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _end_by_indent(lines: list[str], at: int) -> int:
    last = at
    for i in range(at + 1, len(lines)):
        if lines[i].strip():
            if _indent(lines[i]) <= _indent(lines[at]) and not lines[i].lstrip().startswith((")", "]", "}")):
                break
            last = i
    return last


def _end_by_braces(lines: list[str], at: int) -> int:
    depth, seen = 0, False
    for i in range(at, len(lines)):
        bare = _QUOTED.sub("", lines[i])
        depth += bare.count("{") - bare.count("}")
        seen = seen or "{" in bare
        if (seen and depth <= 0) or (not seen and bare.rstrip().endswith(";")):
            return i
    return len(lines) - 1


def _end_by_keyword(lines: list[str], at: int) -> int:
    depth = 0
    for i in range(at, len(lines)):
        bare = _QUOTED.sub("", lines[i])
        depth += bool(_RUBY_OPEN.search(bare))
        depth -= bool(re.match(r"^\s*end\b", bare))
        if depth <= 0:
            return i
    return len(lines) - 1


class Found(NamedTuple):
    """A symbol of a text; lines and columns count from 1, ``end_column`` is the one after the last character."""

    kind: str
    name: str
    signature: str | None
    body: str
    doc: str | None
    start_line: int
    start_column: int
    end_line: int
    end_column: int


_BRACKET = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?P<open>[(\[{])|(?P<close>[)\]}])", re.S)


def _bracketed(text: str, at: int) -> str:
    """The text from the bracket at ``at`` to the one that closes it; empty where there is none."""
    if text[at : at + 1] != "(":
        return ""
    depth = 0
    for m in _BRACKET.finditer(text, at):
        depth += {"open": 1, "close": -1}.get(m.lastgroup or "", 0)
        if depth == 0 and m.lastgroup:
            return text[at : m.end()]
    return ""


_DEF = re.compile(r"(?:async\s+)?(?:def|class)\s+\w+\s*(?:\[[^\]]*\]\s*)?")


def _python(text: str) -> list[Found] | None:
    """Imports, classes and functions by the syntax tree, in the order of the text; None where it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(line: int, column: int) -> int:
        found = lines[line - 1]
        return starts[line - 1] + (column if found.isascii() else len(found.encode()[:column].decode("utf-8", "ignore")))

    out = []
    for node in ast.walk(tree):
        if not isinstance(node, ast.Import | ast.ImportFrom | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        at, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
        body = text[at:end]
        if isinstance(node, ast.Import | ast.ImportFrom):
            kind, name, signature = "import", body, body
        else:
            kind, name = "class" if isinstance(node, ast.ClassDef) else "function", node.name
            header = _DEF.match(text, at)
            brackets = _bracketed(text, header.end()) if header else ""
            signature = f"class {name}{brackets}" if kind == "class" else f"{name}{brackets}"
            returns = getattr(node, "returns", None)
            if returns is not None:
                signature += f" -> {text[place(returns.lineno, returns.col_offset):place(returns.end_lineno, returns.end_col_offset)]}"
        out.append(Found(kind, name, signature, body, None, node.lineno, at - starts[node.lineno - 1] + 1, node.end_lineno, end - starts[node.end_lineno - 1] + 1))
    return sorted(out, key=lambda f: (f.start_line, f.start_column))


def _at_lines(kind: str, name: str, signature: str | None, body: str, first: int, last: int, lines: list[str], doc: str | None = None) -> Found:
    """A symbol that begins with the first sign of a line and ends with the last sign of another."""
    start, end = lines[first - 1], lines[min(last, len(lines)) - 1]
    return Found(kind, name, signature, body, doc, first, len(start) - len(start.lstrip()) + 1, last, len(end.rstrip()) + 1)


class _Page(HTMLParser):
    """Titles and elements with ids of a page, with the line that they begin on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []

    def handle_starttag(self, tag, attrs):
        name = dict(attrs).get("id")
        entry = None
        if tag == "title" or name:
            entry = {"kind": "title" if tag == "title" else "element", "name": name or "", "signature": self.get_starttag_text(), "body": "", "line": self.getpos()[0]}
            self.found.append(entry)
        if tag not in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"):
            self.open.append((tag, entry))

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for _, entry in self.open:
            if entry is not None:
                entry["body"] += data


def _html(text: str) -> list[Found]:
    lines = text.replace("\r\n", "\n").split("\n")
    page = _Page()
    page.feed(text)
    out = []
    for e in page.found:
        body = e["body"].strip()
        if e["kind"] == "title" and not body:
            continue
        name = body if e["kind"] == "title" else e["name"]
        out.append(_at_lines(e["kind"], name, "<title>" if e["kind"] == "title" else e["signature"], body, e["line"], e["line"] + e["body"].rstrip().count("\n"), lines))
    return out


def _parts(bare: str) -> list[tuple[int, int]]:
    """Bounds of the parts of a list between its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(bare):
        depth = max(depth + (c in "([") - (c in ")]"), 0)
        if c == "," and not depth:
            out.append((at, i))
            at = i + 1
    return [*out, (at, len(bare))]


def selector_aliases(selector: str) -> str:
    """What a selector is looked for by: its words, the words in a row, and run together; each once."""
    words = re.findall(r"[A-Za-z0-9_-]+", selector.lower())
    row = [" ".join(words)] if len(words) > 1 else []
    return " ".join(dict.fromkeys([*words, *row, *(["".join(words)] if words else [])]))


def _css(text: str) -> list[Found]:
    """Selectors and at-rules before each block, over the whole text."""
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    # Blanks of the same length keep all places; a comment is blank in both, a quoted text only for the search.
    blank = re.compile(r"[^\n]")
    shown = _CSS_OPAQUE.sub(lambda m: blank.sub(" ", m.group()) if m.group().startswith("/*") else m.group(), text)
    bare = _CSS_OPAQUE.sub(lambda m: blank.sub(" " if m.group().startswith("/*") else "_", m.group()), text)
    out, line, counted = [], 1, 0
    for m in _CSS_HEAD.finditer(bare):
        # What ends in a semicolon (imports, declarations around a nested rule) is no part of the head.
        if not m.group(2):
            continue
        begin = m.start() + m.group(1).rfind(";") + 1
        head = bare[begin : m.end(1)]
        rule = head.lstrip().startswith("@")
        for a, b in [(0, len(head))] if rule else _parts(head):
            name = " ".join(shown[begin + a : begin + b].split())
            if not name:
                continue
            first = begin + a + len(head[a:b]) - len(head[a:b].lstrip())
            line, counted = line + text.count("\n", counted, first), first
            end = line + head[a:b].strip().count("\n")
            out.append(_at_lines("at_rule" if rule else "selector", name, name, name, line, end, lines, None if rule else selector_aliases(name)))
    return out


_RETURNS = re.compile(r"\s*(:\s*(?:\{[^{}\n]*\}|[^{}=;\n])+?)\s*(?==>|\{|;|$)", re.M)


def _header(kind: str, name: str, line: str, text: str, at: int, language: str, inside: list[str]) -> str:
    """The signature of a symbol whose header begins at ``at``, with the names of what it is in."""
    if kind == "import" or language in ("yaml", "dockerfile"):
        return line.strip()
    after = at + line.find(name) + len(name)
    if language == "ruby":
        qualified = "::".join([*inside, name])
        if kind in ("class", "module"):
            return f"{kind} {qualified}"
        if kind == "constant":
            return qualified
        prefix = "::".join(inside) + ("." if re.match(r"\s*def\s+self\.", line) else "#") if inside else ""
        return f"{prefix}{name}{_bracketed(text, after)}"
    if language in ("javascript", "typescript"):
        if kind == "class":
            rest = re.match(r"(?:<[^{]*?>)?\s*((?:extends|implements)\b[^{]*)?", text[after : after + 500])
            return f"class {name} {(rest.group(1) or '').strip()}".strip() if rest else f"class {name}"
        if kind in ("interface", "type", "enum"):
            return f"{kind} {name}"
        opened = text.find("(", after)
        brackets = _bracketed(text, opened) if 0 <= opened and "{" not in text[after:opened] else ""
        returns = _RETURNS.match(text, opened + len(brackets)) if brackets and language == "typescript" else None
        owner = f"{inside[-1]}." if kind == "method" and inside else ""
        return f"{owner}{name}{brackets}{returns.group(1).rstrip() if returns else ''}"
    return line.strip().rstrip("{:").strip()


def symbols_of(text: str, language: str, path: str = "") -> list[Found]:
    """The symbols of a text, in the order in which they begin."""
    if language == "html":
        return _html(text) if len(text) <= OVERSIZE_CHARS else []
    if language == "css":
        return _css(text)
    text = text.replace("\r\n", "\n")
    if language == "python" and len(text) <= OVERSIZE_CHARS:
        found = _python(text)
        if found is not None:
            return found
    rules = _COMPILED.get(language, [])
    lines = text.split("\n")
    out: list[Found] = []
    if language == "dockerfile":
        whole = Found("file", path.rpartition("/")[2], path, text.strip(), DOCKERFILE_DOC, 1, 1, len(lines), len(lines[-1]) + 1)
        out.append(whole)
    keys: list[tuple[int, str]] = []
    around: list[tuple[int, str]] = []  # last line and name of the classes and modules that a line is in
    headings = [i for i, x in enumerate(lines) if language == "markdown" and rules[0][1].match(x)]
    at = 0
    for i, line in enumerate(lines):
        begin, at = at, at + len(line) + 1
        around = [(end, name) for end, name in around if end >= i]
        for kind, pattern in rules:
            m = pattern.match(line)
            if not m:
                continue
            groups = m.groupdict()
            name = (groups.get("name") or "").strip()
            kind = groups["kind"].lower() if groups.get("kind") else kind
            doc = None
            if kind == "key":
                keys = [(d, n) for d, n in keys if d < _indent(line)] + [(_indent(line), name)]
                name = ".".join(n for _, n in keys)
            if kind == "heading":
                end = headings[headings.index(i) + 1] - 1 if i != headings[-1] else len(lines) - 1
            elif kind in _ONE_LINE or language == "dockerfile":
                end = i
                if language == "dockerfile" and kind not in ("stage", "arg", "env"):
                    doc = re.sub(r"^(\S+)\s+", r"\1 ", line.strip()).lower()
            elif language == "python":
                end = _end_by_indent(lines, i)
            elif language == "ruby":
                end = _end_by_keyword(lines, i)
            else:
                end = _end_by_braces(lines, i)
            if name:
                signature = _header(kind, name, line, text, begin, language, [n for _, n in around])
                out.append(_at_lines(kind, name, signature, "\n".join(lines[i : end + 1]).strip(), i + 1, end + 1, lines, doc))
            if kind in ("class", "module") and end > i:
                around.append((end, name))
            if kind != "stage":
                break
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 7 + [pa.bool_(), pa.string(), *[pa.int32()] * 4]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for path, language, text in zip(*(batch[c].to_pylist() for c in ("path", "language", "text"))):
            text = text or ""
            found = symbols_of(text, language or "text", path)
            big = len(text) > OVERSIZE_CHARS
            how = "recovered" if big or language in ("javascript", "typescript", "ruby", "shell") else "parsed"
            doc = f"Recovered from oversized {language} source." if big else None
            rows += [(path, language, f.kind, f.name, f.signature, f.body, doc or f.doc, False, how, *f[5:]) for f in found]
            if not found:
                lines = text.replace("\r\n", "\n").split("\n")
                rows.append((path, language, "file", path, None, text[:FALLBACK_CHARS], None, True, "fallback", 1, 1, len(lines), len(lines[-1]) + 1))
            # Nested symbols repeat their text, so rows are handed on by their size.
            held += sum(len(f.body) for f in found)
            if held > BATCH_CHARS:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)


def extract_symbols(texts: DataFrame) -> DataFrame:
    """Symbols of (path, language, text) rows. Null paths give no row; null texts and languages a fallback row."""
    return texts.filter("path is not null").select("path", "language", "text").mapInArrow(_extract, SCHEMA)


def with_ids(symbols: DataFrame) -> DataFrame:
    """Adds ids that stay the same when a file is read again."""
    return symbols.withColumn("id", F.xxhash64("path", "kind", "name", F.coalesce("signature", F.lit("")), "start_line"))
