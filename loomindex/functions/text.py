"""Text expressions: lookup keys, terms, stems, snippets, summaries. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Words that carry no concept.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "by", "do", "does", "for", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "what", "when", "where", "which",
    "why", "with", "work", "works",
]

SNIPPET_CHARS = 200
SUMMARY_LINES, SUMMARY_CHARS = 40, 4000
EMBEDDING_LINES, EMBEDDING_CHARS = 120, 6000


def lookup_key(text: Column) -> Column:
    """Lower case without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def stored_key(text: Column) -> Column:
    """The looser key of stored names: lower case without slashes, hyphens, blanks, dots and colons; other signs stay."""
    return F.translate(F.lower(text), "\\/- .:", "")


def snippet(text: Column) -> Column:
    """White space collapsed; long texts are cut and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= SNIPPET_CHARS, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, SNIPPET_CHARS - 3)), F.lit("...")))


def ascii_terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def concept_terms(text: Column) -> Column:
    return F.filter(ascii_terms(text), lambda t: ~t.isin(STOPWORDS))


def name_parts(text: Column) -> Column:
    """Words of an identifier, split at case changes and at anything that is no letter or digit."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return ascii_terms(F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def stem(term: Column) -> Column:
    """Plural and -ing endings of concept terms."""
    n = F.length(term)
    return (
        F.when(term.endswith("ies") & (n > 4), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when(term.endswith("ing") & (n > 5), F.substring(term, F.lit(1), n - 3))
        .when(term.endswith("s") & ~term.endswith("ss") & (n > 3), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


def stems(terms: Column) -> Column:
    return F.array_distinct(F.transform(terms, stem))


def folded_text(text: Column) -> Column:
    """Lower case, accents stripped."""
    return F.translate(F.lower(text), *_ACCENTS)


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits of the folded text; null has none."""
    return F.regexp_extract_all(folded_text(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by rule."""
    import unicodedata

    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x180))]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS = _accent_table()


def half_up(value: Column, places: int = 3) -> Column:
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def first_lines(text: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def embedding_text(path: Column, kind: Column, name: Column, signature: Column, doc: Column, body: Column) -> Column:
    """What is embedded for a symbol: its non-empty parts, a bounded number of lines and characters."""
    parts = F.array_compact(F.array(*[F.when(F.trim(c) != "", F.trim(c)) for c in (path, kind, name, signature, doc, body)]))
    return F.rtrim(F.substring(first_lines(F.array_join(parts, "\n"), EMBEDDING_LINES), 1, EMBEDDING_CHARS))


def body_summary(body: Column) -> Column:
    """Struct of how a body is shown: mode (full, summary), text, total lines and characters, shown lines."""
    lines = F.size(F.split(body, "\n"))
    long = (lines > SUMMARY_LINES) | (F.length(body) > SUMMARY_CHARS)
    head = first_lines(body, SUMMARY_LINES)
    cut = F.when(F.length(head) > SUMMARY_CHARS, F.concat(F.substring(head, 1, SUMMARY_CHARS - 3), F.lit("..."))).otherwise(head)
    return F.struct(
        F.when(long, F.lit("summary")).otherwise(F.lit("full")).alias("mode"),
        F.when(long, cut).otherwise(body).alias("text"),
        lines.alias("total_lines"),
        F.length(body).alias("total_chars"),
        F.when(long, F.size(F.split(cut, "\n"))).otherwise(lines).alias("shown_lines"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where either vector is empty or has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    return F.when((n <= 0) | (norms == 0), F.lit(0.0)).otherwise(dot / norms)
