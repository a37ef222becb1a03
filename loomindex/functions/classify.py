"""Classes of paths, kinds, extraction and trust as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Kinds that define something.
DEFINITIONS = ["class", "function", "title", "element", "heading"]
#: Fixed values. Score of a kind (lower is better).
KIND_SCORES = {"class": -1.1, "function": -1.0, "heading": -0.8, "title": -0.75, "element": -0.5, "import": 0.75, "file": 1.0}
#: Fixed values. Folders of operational documents.
STATE_FOLDERS = [".codex/", ".claude/", ".loomindex/"]
#: Fixed values. Folders of front-end code.
FRONT_FOLDERS = ["dashboard_frontend", "frontend", "web", "static/css", "static/js", "styles", "assets/css", "assets/js", "public"]
FRONT_LANGUAGES = ["javascript", "typescript", "css", "html"]
#: Fixed values. Extensions and names by language.
EXTENSIONS = {
    "py": "python", "rb": "ruby", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "yaml": "yaml", "yml": "yaml", "sh": "shell", "bash": "shell", "zsh": "shell", "css": "css",
}
CONTAINER_NAMES = ["dockerfile", "containerfile"]
#: Fixed values. Names of entry files.
ENTRY_NAMES = [
    "main.py", "app.py", "cli.py", "server.py", "main.js", "app.js", "cli.js", "server.js", "main.ts", "app.ts", "cli.ts", "server.ts", "manage.py", "bootstrap.py",
    "startup", "start", "run", "serve",
]
ENTRY_SCRIPTS = ["startup", "start", "run", "serve", "bootstrap"]
#: Fixed values. The first line of a shell script, and signs of one in a line with their points.
SHEBANG = r"^#!\s*(?:/usr/bin/env\s+(?:-S\s+)?(?:ba|z)?sh\b|/bin/(?:ba|z)?sh\b|/usr/bin/(?:ba|z)?sh\b)"
SHELL_SIGNS = [
    (r"^(?:set -[A-Za-z]+|set -o [A-Za-z-]+)$", 1),
    (r"^(?:function\s+)?[A-Za-z_][A-Za-z0-9_]*\s*(?:\(\))?\s*\{", 2),
    (r"^(?:if|then|elif|else|fi|for|do|done|case|esac|while|until|select|in)\b", 1),
    (r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*=", 1),
    (r"^(?:exec|source|\.)\s+", 1),
    (r"\$[({]", 1),
]
RECOVERED_MARK = "Recovered from oversized "
OVERSIZE_CHARS = 32_000


def folded(path: Column) -> Column:
    """Lower case, forward slashes."""
    return F.translate(F.lower(path), "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(folded(path), "/"), -1)


def is_definition(kind: Column) -> Column:
    return kind.isin(DEFINITIONS)


def is_test_path(path: Column) -> Column:
    p = folded(path)
    return p.startswith("tests/") | p.contains("/test")


def is_canonical_doc(path: Column) -> Column:
    p = folded(path)
    return p.startswith("docs/") | p.isin("readme.md", "plan.md", "roadmap.md")


def is_operational_doc(path: Column) -> Column:
    p = folded(path)
    return reduce(lambda x, y: x | y, [p.startswith(s) for s in STATE_FOLDERS], p.isin("agents.md", "claude.md"))


def in_folder(path: Column, folder: str) -> Column:
    p = folded(path)
    return p.startswith(f"{folder}/") | p.contains(f"/{folder}/")


def is_front_end(path: Column, language: Column) -> Column:
    return language.isin(FRONT_LANGUAGES) & reduce(lambda x, y: x | y, [in_folder(path, f) for f in FRONT_FOLDERS])


def matches_any(path: Column, needles: list[str] | None) -> Column:
    """Include filter: no list lets everything pass, a list of blanks nothing."""
    if not needles:
        return F.lit(True)
    wanted = [n.strip().replace("\\", "/").lower() for n in needles if n.strip()]
    return reduce(lambda x, y: x | y, [folded(path).contains(n) for n in wanted], F.lit(False))


def matches_none(path: Column, needles: list[str] | None) -> Column:
    wanted = [n.strip().replace("\\", "/").lower() for n in needles or [] if n.strip()]
    return reduce(lambda x, y: x & y, [~folded(path).contains(n) for n in wanted], F.lit(True))


def in_scope(path: Column, rules: list[str]) -> Column:
    """Whether a rule names the path or a folder above it."""
    return reduce(lambda x, y: x | y, [(path == r) | path.startswith(r.rstrip("/") + "/") for r in rules], F.lit(False))


def detected_language(path: Column) -> Column:
    """Language by file name, name prefix, then extension; null where none is known."""
    name = file_name(path)
    by_name = reduce(lambda x, y: x | y, [(name == n) | name.startswith(n + ".") for n in CONTAINER_NAMES])
    extension = F.regexp_extract(name, r"\.([^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(by_name, F.lit("dockerfile")).otherwise(F.try_element_at(known, extension))


def looks_like_shell(text: Column) -> Column:
    """Whether a text without extension is a shell script: a shebang, or enough signs in its first twelve lines that are not blank.

    Every sign of a line counts; comment lines have none.
    """
    blank = r"^\s+|\s+$"
    body = F.coalesce(text, F.lit(""))
    lines = F.slice(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.regexp_replace(x, blank, "")), lambda x: x != ""), 1, 12)

    def weight(x: Column) -> Column:
        signs = [F.when(x.rlike(pattern), points).otherwise(0) for pattern, points in SHELL_SIGNS]
        return F.when(x.startswith("#"), 0).otherwise(reduce(lambda p, q: p + q, signs))

    score = F.aggregate(lines, F.lit(0), lambda s, x: s + weight(x))
    first = F.regexp_replace(F.split(body, r"\r?\n")[0], blank, "")
    return ~body.contains("\u0000") & (first.rlike(SHEBANG) | (score >= 2))


def extraction_of(fallback: Column, doc: Column) -> Column:
    return F.when(F.coalesce(fallback, F.lit(False)), "fallback").when(F.coalesce(doc, F.lit("")).startswith(RECOVERED_MARK), "recovered").otherwise("parsed")


def trust_of(extraction: Column) -> Column:
    return F.when(extraction == "fallback", "low").when(extraction == "recovered", "medium").otherwise("high")


def retrieval_trust(extraction: Column, confidence: Column) -> Column:
    parsed = extraction == "parsed"
    return (
        F.when((extraction == "fallback") | (confidence == "fallback"), "low")
        .when(confidence == "exact", "high")
        .when(confidence == "strong", F.when(parsed, "high").otherwise("medium"))
        .otherwise(F.when(parsed, "medium").otherwise("low"))
    )


def root_reasons(path: Column, language: Column, names: Column) -> Column:
    """Why a file looks like an entry point: up to three reasons in a fixed order."""
    name = file_name(path)
    lowered = F.transform(names, lambda n: F.lower(n))
    style = in_folder(path, "static/css") | in_folder(path, "styles") | folded(path).contains("/assets/css/")
    front = in_folder(path, "dashboard_frontend") | in_folder(path, "frontend") | in_folder(path, "web")
    # The reasons as they are reported, in their order.
    rules = [
        (name == "__main__.py", "python __main__ entrypoint"),
        (name.isin(ENTRY_NAMES), "common startup or entrypoint filename"),
        ((language == "shell") & F.regexp_replace(name, r"\.[^.]+$", "").isin(ENTRY_SCRIPTS), "shell startup script name"),
        (in_folder(path, "bin") | in_folder(path, "scripts"), "script or bin path"),
        ((language == "css") & style, "frontend stylesheet path"),
        (language.isin("javascript", "typescript") & front, "frontend application path"),
        (F.array_contains(lowered, "main"), "top-level main symbol"),
        (F.arrays_overlap(lowered, F.array(*map(F.lit, ("cli", "run", "startup")))), "top-level entry symbol"),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])), 1, 3)
