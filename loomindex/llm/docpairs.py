"""Functions paired with their documentation.

Each body is parsed into a syntax tree, its function nodes are visited, and the one with the symbol's
name (else the first) gives the attached documentation and the exact character range of the code.
Python bodies go through the ``ast`` module. For the other languages (and Python that does not parse)
a small parser builds the tree of nested blocks: braces, or Ruby's and shell's keywords up to their
``end``, outside strings and comments. Documentation is good if its prose has at least ``least_words``
distinct words that neither the name nor the signature has.

Scale: one narrow pass (scan, Arrow batches, filter) over the kinds asked for; what is shuffled to
count repeated rows once is only the result.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomindex.llm.prose import good_lines, new_words, words

KINDS = ("function", "method")
_HASH = {"python", "ruby", "shell", "yaml", "dockerfile"}
_LINE_COMMENT = {True: re.compile(r"[ \t]*#[^\n]*(?:\n|$)"), False: re.compile(r"[ \t]*//[^\n]*(?:\n|$)")}
_BLOCK_COMMENT = re.compile(r"[ \t]*(?:/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))[ \t]*(?:\n|$)?", re.S)
_RUBY_BLOCK = re.compile(r"=begin\b.*?(?:^=end[^\n]*(?:\n|$)|\Z)", re.S | re.M)
_DOCSTRING = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')(.*?)(?<!\\)\1", re.S)
_BLANK = re.compile(r"[ \t]*\r?\n")
_DECORATOR = re.compile(r"[ \t]*@[\w.]+")
_PY_RETURN = re.compile(r"\s*(?:->[^:]*)?:")


@dataclass
class FunctionNode:
    """Comments before the header, inner comment or docstring, and the code's range in the body."""

    before: str
    inside: str
    start: int
    find_end: Callable[[], int]

    @property
    def end(self) -> int:
        """Found when it is asked for: most functions have no documentation worth a pair."""
        return self.find_end()


def _comments(text: str, at: int, hashes: bool) -> tuple[str, int]:
    """Comments and blank lines from ``at`` on, and where they end."""
    begin = at
    while at < len(text):
        m = _BLANK.match(text, at) or _LINE_COMMENT[hashes].match(text, at)
        if not m and hashes:
            m = _RUBY_BLOCK.match(text, at)
        if not m and not hashes:
            m = _BLOCK_COMMENT.match(text, at)
        if not m or m.end() == at:
            break
        at = m.end()
    return text[begin:at], at


_TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?P<open>[(\[{])|(?P<close>[)\]}])", re.S)


def _skip_brackets(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; strings are skipped."""
    depth = 0
    for m in _TOKEN.finditer(text, at):
        if m.lastgroup == "open":
            depth += 1
        elif m.lastgroup == "close":
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


@dataclass
class Block:
    """A node of the block tree: where it opens and ends (None if it is not closed), and the blocks inside."""

    start: int
    end: int | None
    inner: list["Block"]


_BRACES = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<open>\{)|(?P<close>\})", re.S)
_BASH = re.compile(r"\"(?:\\.|[^\"\\])*\"|'[^']*'|(?<!\S)#[^\n]*|\$\{[^}\n]*\}|(?P<open>(?<!\S)\{(?=\s))|(?P<close>(?<!\S)\}(?![^\s;&|)]))", re.S)
#: Ruby's blocks: keywords at the start of a statement or after ``=``, and ``do`` at the end of a line.
_RUBY = re.compile(
    r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|(?P<open>(?:^|(?<=;)|(?<==))[ \t]*(?:(?:private|public|protected)[ \t]+)?(?:def|class|module|if|unless|while|until|case|for|begin)\b(?!:)|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:\#[^\n]*)?$))|(?P<close>(?<![\w.:@$])end\b(?![?!:]))",
    re.M,
)
_ENDLESS = re.compile(r"[ \t]*def\s+[\w.]+[?!]?(?:\([^()\n]*\))?\s*=\s")
_BLOCKS = {"ruby": _RUBY, "shell": _BASH}


def block_tree(text: str, language: str, at: int = 0) -> list[Block]:
    """The blocks of a text in any language but Python, nested."""
    top: list[Block] = []
    stack: list[Block] = []
    for m in _BLOCKS.get(language, _BRACES).finditer(text, at):
        if m.lastgroup == "open":
            if language == "ruby" and _ENDLESS.match(text, m.start()):
                continue
            block = Block(m.start(), None, [])
            (stack[-1].inner if stack else top).append(block)
            stack.append(block)
        elif m.lastgroup == "close" and stack:
            stack.pop().end = m.end()
    return top


def _code_end(text: str, header: int, header_end: int, language: str) -> int:
    """Where the function ends that begins at ``header``: its block's end, or the statement's, or the text's where a block is not closed."""
    whole = len(text.rstrip())
    if language == "python":
        return _indented_end(text, header, header_end)
    blocks = block_tree(text, language, header)
    if language == "ruby":
        own = next((b for b in blocks if b.start <= header_end), None)
        if own is None and _ENDLESS.match(text, header):
            line = text.find("\n", header_end)
            return whole if line < 0 else line
    else:
        own = next((b for b in blocks if b.start >= header_end - 1 and not text[header_end : b.start].strip()), None)
        if own is None and header_end < len(text) and text.rfind("{", header, header_end) < 0:
            # An expression body: up to the semicolon or the end of its line.
            line = text.find("\n", header_end)
            return whole if line < 0 else line
    if own is None or own.end is None:
        return whole
    tail = re.compile(r"[)\]]*;?").match(text, own.end)
    return tail.end() if tail else own.end


def _indented_end(text: str, header: int, header_end: int) -> int:
    """For Python that does not parse: the last line that is indented more than the header."""
    start = text.rfind("\n", 0, header) + 1
    margin = len(text[start:header].expandtabs()) if not text[start:header].strip() else 0
    end, at = header_end, text.find("\n", header_end) + 1
    while 0 < at < len(text):
        line_end = text.find("\n", at)
        line_end = len(text) if line_end < 0 else line_end
        line = text[at:line_end]
        if line.strip():
            if len(line) - len(line.lstrip()) <= margin and not line.lstrip().startswith((")", "]", "}")):
                break
            end = line_end
        at = line_end + 1
    return max(end, header_end)


def _header_end(text: str, at: int, language: str) -> int:
    """Where the function's header ends and its block begins."""
    line = text.find("\n", at)
    line = len(text) if line < 0 else line
    paren = text.find("(", at)
    if language == "ruby":
        return _ruby_end(text, at, line, paren)
    if 0 <= paren <= line:
        at = _skip_brackets(text, paren)
    if language == "python":
        m = _PY_RETURN.match(text, at)
        return m.end() if m else line
    # A return type may follow, with braces of its own only inside <> or after a colon.
    brace = text.find("{", at)
    return brace + 1 if brace >= 0 and "\n" not in text[at:brace].strip() else line


def _ruby_end(text: str, at: int, line: int, paren: int) -> int:
    if 0 <= paren <= line:
        after = _skip_brackets(text, paren)
        line = text.find("\n", after)
        return len(text) if line < 0 else line
    return line


def scan_function(body: str, language: str) -> FunctionNode:
    """The node of a body in any language, from its comments, header and block tree."""
    hashes = language in _HASH
    before, at = _comments(body, 0, hashes)
    header = at
    while _DECORATOR.match(body, header):
        paren, line = body.find("(", header), body.find("\n", header)
        line = len(body) if line < 0 else line
        stop = _skip_brackets(body, paren) if 0 <= paren < line else line
        line = body.find("\n", stop)
        header = len(body) if line < 0 else line + 1
        more, header = _comments(body, header, hashes)
        before += more
    end = _header_end(body, header, language)
    rest = end
    first = re.compile(r"[ \t]*\r?\n|[ \t]+").match(body, rest)
    while first and first.end() > rest:
        rest = first.end()
        first = re.compile(r"[ \t]*\r?\n|[ \t]+").match(body, rest)
    doc = _DOCSTRING.match(body, rest) if language == "python" else None
    inside = doc.group(2) if doc else _comments(body, rest, hashes)[0]
    return FunctionNode(before, inside, at, lambda: _code_end(body, header, end, language))


def _place(lines: list[str], dedented: list[str], line: int, column: int) -> int:
    """The character place in the body of a line (from 1) and byte column of the dedented source."""
    text = dedented[line - 1]
    margin = len(lines[line - 1]) - len(text)
    return sum(len(x) + 1 for x in lines[: line - 1]) + margin + len(text.encode()[:column].decode("utf-8", "ignore"))


def _functions(tree: ast.AST) -> Iterator[ast.FunctionDef | ast.AsyncFunctionDef]:
    """The functions of a tree, outer ones first; only statements are visited."""
    level = [tree]
    while level:
        below = []
        for node in level:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield node
            below += [x for part in ("body", "orelse", "handlers", "finalbody", "cases") for x in getattr(node, part, None) or () if isinstance(x, ast.AST)] if not isinstance(node, ast.expr) else []
        level = below


def parse_python(body: str, name: str | None = None) -> FunctionNode | None:
    """The node of a Python body by its syntax tree; None where it does not parse or has no function."""
    source = textwrap.dedent(body)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    last = re.split(r"[.#:]", name)[-1] if name else None
    first_function = next(_functions(tree), None)
    if first_function is None:
        return None
    node = first_function if last in (None, first_function.name) else next((n for n in _functions(tree) if n.name == last), first_function)
    lines, dedented = body.split("\n"), source.split("\n")
    first = min([node, *node.decorator_list], key=lambda n: n.lineno)
    column = first.col_offset - (first is not node)  # a decorator's expression begins after its @
    start = _place(lines, dedented, first.lineno, max(column, 0))
    scanned = scan_function(body, "python")
    doc = ast.get_docstring(node, clean=True)
    return FunctionNode(scanned.before, doc if doc is not None else scanned.inside, start, lambda: _place(lines, dedented, node.end_lineno, node.end_col_offset))


def function_node(body: str, language: str | None, name: str | None = None) -> FunctionNode:
    node = parse_python(body, name) if language == "python" else None
    return node or scan_function(body, language or "text")


def _pairs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("id", "language", "name", "signature", "body", "doc")]
            for id_, language, name, signature, body, doc in zip(*columns):
                known = words(name) | words(signature)
                # The field is looked at first; a body is only parsed where it has to be.
                node = function_node(body, language, name)
                for source, text in (("doc", doc), ("before", node.before), ("inside", node.inside)):
                    lines = good_lines(text)
                    if len(new_words(lines, known)) >= least_words:
                        end = node.end
                        out.append((id_, source, "\n".join(lines), body[node.start : end], node.start, end))
                        break
            ids, sources, texts, codes, starts, ends = (list(x) for x in zip(*out)) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(texts, pa.string()), pa.array(codes, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["symbol_id", "doc_source", "description", "code", "code_start", "code_end"],
            )

    return run


def function_doc_pairs(symbols: DataFrame, least_words: int = 4) -> DataFrame:
    """One row per function or method with documentation that says something.

    symbol_id, doc_source (doc, before, inside), description, code, and the code's range in the body.
    Null or blank bodies, null ids and other kinds give no row; a null doc, name, signature or language
    counts as empty. Rows delivered twice count once. Other columns are ignored.
    """
    wanted = symbols.filter(F.col("kind").isin(*KINDS) & F.col("id").isNotNull() & F.col("body").rlike(r"\S"))
    found = wanted.select("id", "language", "name", "signature", "body", "doc").mapInArrow(
        _pairs(least_words), "symbol_id bigint, doc_source string, description string, code string, code_start int, code_end int"
    )
    return found


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Repeated rows merged; of different rows of one id, the first in column order."""
    return pairs.groupBy("symbol_id").agg(F.min(F.struct("doc_source", "description", "code", "code_start", "code_end")).alias("pair")).select("symbol_id", "pair.*")
