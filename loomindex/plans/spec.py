"""What is known about a query before any row is read; the plans see only literals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from loomindex.functions.text import STOPWORDS

#: Fixed values. Words that show what a query is about.
DOC_WORDS = ["architecture", "backlog", "design", "decision", "doc", "docs", "guide", "notes", "plan", "readme", "roadmap", "workflow"]
CONTAINER_WORDS = ["dockerfile", "docker", "from", "run", "copy", "add", "cmd", "entrypoint", "workdir", "expose", "volume", "user", "python", "pip", "requirements", "base", "image", "mkdir"]
ROOT_WORDS = ["main", "entrypoint", "startup", "start", "bootstrap", "boot", "run", "serve", "server", "cli", "script", "launch", "worker"]
PARAMETER_WORDS = ["accept", "accepts", "take", "takes", "parameter", "parameters", "argument", "arguments"]
RETURN_WORDS = ["return", "returns", "yield", "yields", "output", "outputs"]


def lookup_key(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


def stem(term: str) -> str:
    if term.endswith("ies") and len(term) > 4:
        return term[:-3] + "y"
    if term.endswith("ing") and len(term) > 5:
        return term[:-3]
    return term[:-1] if term.endswith("s") and not term.endswith("ss") and len(term) > 3 else term


@dataclass(frozen=True)
class QuerySpec:
    """A query and its intent. ``limit`` must be positive; docs_only and code_only exclude each other."""

    text: str
    limit: int = 5
    kinds: tuple[str, ...] = ()
    docs_only: bool = False
    code_only: bool = False
    exclude_tests: bool = False
    prefer_implementation: bool = False
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    vector: tuple[float, ...] = field(default=(), repr=False)
    model: str | None = None
    provider: str | None = None

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("the query is empty")
        if self.limit < 1 or self.limit != int(self.limit):
            raise ValueError("the limit must be a positive whole number")
        if self.docs_only and self.code_only:
            raise ValueError("docs_only and code_only exclude each other")

    @cached_property
    def trimmed(self) -> str:
        return re.sub(r"\s+", " ", self.text).strip()

    @cached_property
    def lowered(self) -> str:
        return self.trimmed.lower()

    @cached_property
    def key(self) -> str:
        return lookup_key(self.trimmed)

    @cached_property
    def terms(self) -> list[str]:
        return [t for t in re.split("[^a-z0-9]+", self.lowered) if t]

    @cached_property
    def concepts(self) -> list[str]:
        return [t for t in self.terms if t not in STOPWORDS]

    @cached_property
    def required(self) -> list[str]:
        return self.concepts or self.terms

    @cached_property
    def phrases(self) -> list[list[str]]:
        """What the full-text index is asked for: each word as the phrase of its tokens, and the words run together."""
        words = list(dict.fromkeys(re.findall(r"[^\W]+", self.lowered)))
        if len(words) > 1 and self.key:
            words.append(self.key)
        phrases = [re.findall(r"[^\W_]+", w) for w in dict.fromkeys(words)]
        return [p for p in dict.fromkeys(tuple(p) for p in phrases if p)]

    @cached_property
    def variants(self) -> list[str]:
        """The query as it stands, without quotes, and the last part of a qualified name."""
        found = [self.trimmed]
        if len(self.trimmed) > 1 and self.trimmed[0] == self.trimmed[-1] and self.trimmed[0] in "\"'`":
            found.append(self.trimmed[1:-1].strip())
        found += [v.split("::")[-1].strip() for v in list(found) if "::" in v]
        return [v for v in dict.fromkeys(found) if v]

    @cached_property
    def segments(self) -> list[str]:
        return [s.strip() for s in self.trimmed.split("::") if s.strip()] if "::" in self.trimmed else []

    @cached_property
    def path_suffixes(self) -> list[str]:
        """File paths that the namespace of a qualified name leads to."""
        parts = [re.sub(r"[-\s]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", s)).lower() for s in self.segments]
        return ["/" + "/".join(parts) + ".rb", "/" + "/".join(parts)] if len(parts) > 1 else []

    @cached_property
    def is_symbol(self) -> bool:
        return bool(re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", self.trimmed)) and bool(re.search("[A-Z_]", self.trimmed))

    @cached_property
    def about_docs(self) -> bool:
        return any(t in DOC_WORDS for t in self.terms)

    @cached_property
    def about_containers(self) -> bool:
        return len({t for t in self.terms if t in CONTAINER_WORDS}) >= 2

    @cached_property
    def about_roots(self) -> bool:
        return any(t in ROOT_WORDS for t in self.terms)

    @cached_property
    def wants_code(self) -> bool:
        return self.prefer_implementation and not self.docs_only and not self.about_docs

    @cached_property
    def is_broad(self) -> bool:
        return not self.docs_only and not self.about_docs and not self.is_symbol and len(self.concepts) >= 2

    @cached_property
    def hides_operational_docs(self) -> bool:
        return not (self.docs_only or self.code_only or self.wants_code or self.about_docs)

    @cached_property
    def uses_concepts(self) -> bool:
        return not (self.docs_only or self.about_docs or self.is_symbol) and bool(self.concepts)

    @cached_property
    def hybrid(self) -> bool:
        return bool(self.vector)

    @cached_property
    def typed_terms(self) -> list[str]:
        """Stems that a signature must hold, where the query speaks of parameters or results."""
        hints = set(PARAMETER_WORDS + RETURN_WORDS)
        if not any(t in hints for t in self.concepts):
            return []
        return list(dict.fromkeys(stem(t) for t in self.concepts if t not in hints))
