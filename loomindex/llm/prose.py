"""Which lines of a comment are prose about code, and the words in them."""

from __future__ import annotations

import re

_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?=\s|$)|///?!?|#+!?|--+(?=\s|$)|;+(?=\s)|<!--|=begin\b|=end\b|\"\"\"|''')\s?")
_MARK_END = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_HTML = re.compile(r"</?[A-Za-z][^<>]*>")
#: Tags that describe a part of the signature: the text after them is documentation.
_TAG = re.compile(r"^[@\\:](?:params?|arg|argument|returns?|throws|raises?|exception|yields?|yieldparam|option|see|since|example|deprecated|author|version|rtype|type|api|note)\b:?", re.I)
_ANY_TAG = re.compile(r"^[@\\]\w[\w-]*")
_INLINE_TAG = re.compile(r"\{@\w+\s*|@\w[\w-]*")

#: Fixed values. Stand-ins for text still to be written.
_THING = r"(?:documentation|docs?|docstring|summary|description|explanation|comment|text|details?|content|information|name|purpose|usage)"
_STAND_IN = re.compile(
    rf"""^\W*(?:
      (?-i:TODO|FIXME|XXX|TBD|TBA|HACK|WIP)\b | (?:todo|fixme|xxx|tbd|wip)\s*(?:[:.!(\-]|$)
    | (?:a\s+)?place-?holder(?:\s+(?:for\s+)?(?:the\s+|this\s+)?{_THING})?\s*(?:[,.:;(\-]|$|to\s+be\b|until\b|only\b)
    | (?:no|without|missing)\s+(?:\w+\s+){{0,2}}?{_THING}\s*(?:[.!,;:]|$|yet|so\s+far|here|given|provided|available|written|found|exists?|added|is\b|was\b|has\b)
    | (?:please\s+)?(?:put|type|write|add|insert|enter|fill\s+in|provide|describe|document|place|complete)\s+(?:\w+\s+){{0,3}}?{_THING}?\s*(?:here|below|later|soon|please|before\b)
    | (?:please\s+)?(?:put|type|write|add|insert|enter|fill\s+in|provide|place)\s+your\s+(?:\w+\s+)?{_THING}\b
    | (?:please\s+)?(?:describe|document|explain)\s+(?:this|the|what)\s+(?:this\s+)?(?:function|method|class|module|thing|code|does)\W*$
    | (?:your\s+|the\s+|a\s+|some\s+)?(?:\w+\s+)?{_THING}\s+(?:goes|go|comes?|is|will\s+be|to\s+be|to\s+follow|still|missing|needed|pending|will\s+follow|follows|here|tbd|required)\b
      (?=.*\b(?:here|later|follow\w*|added|written|missing|needed|come|pending|tbd|soon|provided|required|replaced|done)\b|.*\bsee\s+the\s+board)
    | (?:to\s+be|still\s+to\s+be)\s+(?:documented|written|described|done|added|completed|filled|defined|determined|decided|explained)\b
    | (?:undocumented|not\s+(?:yet\s+)?documented|not\s+(?:yet\s+)?described)\b
    | lorem\s+ipsum
    )""",
    re.X | re.I,
)
#: Fixed values. Notices to tools.
_TOOL = re.compile(
    r"""^\W*(?:
      no-?qa\b | nosec\b | nolint\b | no-?lint\b | pragma\b | type:\s*ignore | (?:end)?region\b(?!\s+(?:of|that|which|is|where)) | fmt:\s | yapf:\s | isort:\s | mypy:\s | pyright:\s | ruff:\s | flake8:\s
    | pylint\s*: | eslint\b | jshint\b | jslint\b | tslint\b | prettier\b | stylelint\b | biome-ignore | rubocop\s*: | standard: | shellcheck\b | istanbul\b | c8\s+ignore | v8\s+ignore | webpack\w*: | @?ts-(?:ignore|nocheck|expect|check)\S*
    | sourceMappingURL | sorbet\b | typed:\s | frozen_string_literal | -\*- | vim?: | ex: | encoding: | coding[:=] | clang-format | spell-?checker: | cspell\b | codespell | sonar\w* | NOSONAR | LCOV_ | GCOV | checkstyle | \$(?:Id|Rev|Date|Author)
    | [\w.-]+[:\s-]\s*(?:disable|enable|ignore|skip|suppress|off|on)(?:-(?:next|line|file|all|this|same|previous)\S*|\s*$|\s+(?:[\w.-]*[/:][\w./-]*|[a-z]+(?:-[a-z]+)+)|\s*[:=]|\s.*\b(?:when|if)\s+run\s+on\b)
    | [\w-]*(?:lint|style|cop|coverage|cover|check|checker|format|formatter|type|spell|audit|scan)[\w-]*[:\s-]+(?:disable|enable|ignore|skip|suppress|off)\b
    )""",
    re.X | re.I,
)
#: Fixed values. Notices on rights.
_RIGHTS = re.compile(
    r"""^\W*(?:copyright\b|\(c\)\s|©|\xa9|spdx-|all\s+rights\s+reserved|licen[cs]ed?\b\s*(?:under|to|by|:|-|$|[A-Z0-9])|@?licen[cs]e\b|released\s+under|distributed\s+under|published\s+under|(?:used|shared|available|provided|covered)\s+under\s+the\s+terms|under\s+the\s+terms\s+of
    |permission\s+is\s+hereby|redistribution\s+and\s+use|the\s+(?:above\s+)?copyright|this\s+(?:file|software|code|work|source\s+code)\s+is\s+(?:part\s+of|licen[cs]ed|provided\s+|distributed|released|subject)|see\s+(?:the\s+)?(?:accompanying\s+)?(?:licen[cs]e|notice|copying)\b|portions\s+(?:of|copyright)|authors?:\s
    |urheberrecht|alle\s+rechte|tous\s+droits|todos\s+los\s+derechos|tutti\s+i\s+diritti|todos\s+os\s+direitos|alle\s+rechten)""",
    re.X | re.I,
)
#: Fixed values. Notices on how the row was extracted or the file was made.
_EXTRACTED = re.compile(
    r"""^\W*(?:recovered\s+from\s+(?:an?\s+)?over-?sized\b|extracted\s+(?:by|from|with|using)\s+(?:the\s+|a\s+|an\s+)?(?:\w+\s+)?(?:line|regex|scanner|parser|fallback|indexer|text|oversized|source)\b|fallback\s+(?:text\s+)?(?:record|row|symbol|entry|extraction|chunk)\b\W*$|fallback\s+(?:text\s+)?record\b
    |(?:this\s+)?(?:record|row|symbol|entry)\s+(?:was\s+)?(?:recovered|extracted|indexed|made|produced)\s+(?:by|from|with)\b|parsed\s+(?:by|with)\s+the\s+(?:fallback|line)|(?:auto-?generated|generated)\s+(?:by|with|from|stub|file|code|documentation)\b|this\s+(?:file|code)\s+(?:is|was)\s+(?:auto\w*\s*)?(?:-?\s*)?generated|do\s+not\s+edit\b)""",
    re.X | re.I,
)

_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)")
_SIGNS = re.compile(
    r"\w\(|\)\s*[;{:]?\s*$|[{}\[\]]|;\s*$|=>|->|<<|&&|\|\||::|(?<![<>!=])=(?!=)|[!=<>]=|\$\w|\+\+|\w\.\w+[(.\s)]|\w_\w|[a-z][A-Z]|^\s*[|&]|\b(?:nil|null|elif|esac|rescue|endif|async|await)\b"
)
_KEYWORD_LINE = re.compile(
    r"^\s*(?:if|elsif|elif|else|for|foreach|while|until|unless|try|except|catch|rescue|finally|ensure|with|switch|case|when|default|begin|end|done|fi|esac|do|then|return|break|continue|next|pass|nil|raise|throw|yield|class|def|function|const|let|var|import|from|export)\b[^.?!]{0,40}[:;({]?\s*$"
)
_PLAIN = re.compile(r"^[(\"'¿¡«]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[)\"',.;:!?»…]*$")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Runs of letters, lower-cased; names are split at ``_`` and between lower and upper case."""
    return {w.lower() for w in _LETTERS.findall(_CAMEL.sub(" ", text))} if text else set()


def is_code(line: str) -> bool:
    """A line of program text rather than a sentence: signs of code outweigh plain words."""
    bare = _QUOTED.sub(" x ", line)
    tokens = bare.split()
    plain = sum(1 for t in tokens if _PLAIN.match(t))
    signs = len(_SIGNS.findall(bare))
    if not signs:
        return False
    if plain >= 5 and plain >= 0.6 * len(tokens) and signs <= 1 + plain // 5:
        return False
    return signs >= 2 or plain <= 3 or plain < 0.6 * len(tokens)


def good_lines(text: str | None) -> list[str]:
    """The lines of a comment that are prose, without comment marks and tags.

    Null and blank texts have none. Stand-ins, notices (to tools, on rights, on extraction) and code
    are left out line by line, so that one of them after good prose does no harm.
    """
    if not text:
        return []
    kept, code = [], False
    for raw in text.splitlines():
        line = _MARK.sub("", raw)
        line = _MARK_END.sub("", line)
        line = _HTML.sub(" ", line).strip()
        if not line:
            continue
        if _TOOL.match(line):
            continue
        tagged = _TAG.match(line)
        if tagged:
            line = line[tagged.end() :].strip()
        elif _ANY_TAG.match(line):
            continue
        if not line or _STAND_IN.match(line) or _RIGHTS.match(line) or _EXTRACTED.match(line):
            continue
        if is_code(line):
            code = True
            continue
        kept.append((line, bool(_KEYWORD_LINE.match(line))))
    # Lines such as "else:" or "return x" are prose only where there is no code around them.
    return [_INLINE_TAG.sub(" ", line) for line, keyword in kept if not (code and (keyword or len(line.split()) < 3))]


def new_words(lines: list[str], known: set[str]) -> set[str]:
    """Distinct words of the lines that are not in ``known``."""
    return set().union(*(words(line) for line in lines)) - known if lines else set()
