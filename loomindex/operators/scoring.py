"""How well a symbol matches a query, as one expression: adjustment, reason and confidence.

Rules are tried from the most to the least telling; the first that holds gives the result. Facts of
the query are literals, so Catalyst drops the branches that cannot apply. The numbers and reasons of
the rules are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomindex.functions import classify
from loomindex.functions.text import ascii_terms, lookup_key, name_parts, stems
from loomindex.operators.candidates import any_of, bare_signature, namespace_evidence
from loomindex.plans.spec import QuerySpec, stem

#: Fixed values. What a definition gains, and a definition near the top of its file.
DEFINITION_BIAS, TOP_BIAS, TOP_LINES = -1.2, -0.4, 120
#: Fixed values. Least similarity, score and confidence of a similar vector.
SIMILARITY_LEVELS = [(0.9, -2.2, "exact"), (0.75, -1.35, "strong"), (0.6, -0.45, "related")]


def _result(adjustment: Column | float, reason: Column | str, confidence: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(adjustment).cast("double").alias("adjustment"), lit(reason).alias("reason"), lit(confidence).alias("confidence"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _bias() -> Column:
    return F.when(classify.is_definition(F.col("kind")), DEFINITION_BIAS).otherwise(0.0)


def _reason(other: str) -> Column:
    return F.when(F.col("kind") == "import", "import_reference").otherwise(other)


def _body_reason() -> Column:
    return F.when(F.col("kind") == "import", "import_reference").when(F.col("kind") == "heading", "heading_text").otherwise("body_text")


def _all_in(text: Column, terms: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [text.contains(t) for t in terms], F.lit(bool(terms)))


def _stem_hits(terms: list[str], groups: list[Column]) -> Column:
    """How many stems of the terms are among the stems of the groups."""
    wanted = list(dict.fromkeys(stem(t) for t in terms))
    if not wanted:
        return F.lit(0)
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), stems(F.concat(*groups))))


def concept_path_match(spec: QuerySpec) -> Column:
    """Match of the query's concepts with file name and path; null where there is none."""
    none = F.lit(None).cast("struct<adjustment:double,reason:string,confidence:string>")
    if not spec.concepts or spec.about_docs or not spec.key:
        return none
    path = F.col("path")
    base = F.regexp_replace(classify.file_name(path), r"\.[^.]+$", "")
    parts, all_parts = name_parts(base), name_parts(classify.folded(path))
    wanted = F.array(*map(F.lit, spec.concepts))
    several = len(spec.concepts) > 1
    top = F.when(F.col("start_line") <= TOP_LINES, TOP_BIAS).otherwise(0.0)
    same = (F.size(parts) == len(spec.concepts)) & (F.size(F.array_except(wanted, parts)) == 0) & F.lit(several)
    inside = (F.size(F.array_except(wanted, all_parts)) == 0) & classify.is_definition(F.col("kind")) & F.lit(several)
    open_ = (F.col("language") != "markdown") & ~F.col("kind").isin("import", "file") & ~classify.is_test_path(path)
    return (
        F.when(~F.coalesce(open_, F.lit(False)), none)
        .when(lookup_key(base) == spec.key, _result(F.lit(-3.25) + _bias() + top, "path_concept", "strong"))
        .when(same, _result(F.lit(-2.75) + _bias() + top, "path_concept", "strong"))
        .when(inside, _result(F.lit(-1.15) + top, "path_concept", "related"))
    )


def qualified_match(spec: QuerySpec) -> Column | None:
    """Match of a namespace-qualified query; None for others."""
    if not spec.segments:
        return None
    q, last, bias = spec.lowered, spec.segments[-1].lower(), _bias()
    signature, bare = F.lower(_text("signature")), bare_signature()
    container = F.col("kind").isin("class", "module")
    named = namespace_evidence(spec) & (F.lower(F.trim(_text("name"))) == last) & F.lit(len(spec.segments) >= 3)
    member = any_of([bare.startswith(q + s) for s in ("#", ".", "::")])
    return (
        F.when(named & container & (bare != q), _result(F.lit(-1.5) + bias, "normalized_symbol_name", "exact"))
        .when(named & ~container, _result(1.25, "normalized_symbol_name", "related"))
        .when(bare == q, _result(F.lit(-7.0) + bias, "signature_text", F.when(container, "exact").otherwise("strong")))
        .when(container & signature.contains(q), _result(F.lit(-4.75) + bias, "signature_text", "exact"))
        .when(member, _result(F.lit(-2.75) + bias, "signature_text", "strong"))
    )


def match(spec: QuerySpec) -> Column:
    """struct(adjustment, reason, confidence) of a row with the symbol's columns and ``similarity``.

    Null signatures and docs are empty texts; a null similarity is no match.
    """
    fallback = F.coalesce(F.col("fallback"), F.lit(False))
    weak = F.when(fallback, "fallback").otherwise("related")
    if not spec.key:
        return _result(0.0, F.when(fallback, "fallback_file").otherwise("body_text"), weak)
    q, lowered, sym, bias = spec.trimmed, spec.lowered, spec.is_symbol, _bias()
    name, signature = F.trim(_text("name")), F.trim(_text("signature"))
    key = lookup_key(_text("name"))
    low = {c: F.lower(_text(c)) for c in ("signature", "doc", "body")}
    holds = {c: lookup_key(_text(c)).contains(spec.key) | low[c].contains(lowered) for c in low}
    every = {c: _all_in(low[c], spec.required) for c in low}
    code = (F.col("language") != "markdown") & ~fallback & ~F.col("kind").isin("import", "file")
    groups = [name_parts(_text("name")), ascii_terms(_text("signature")), ascii_terms(_text("body"))]
    source = classify.folded(F.col("path")).startswith("src/") | classify.is_front_end(F.col("path"), F.col("language"))

    qualified = qualified_match(spec)
    rules: list[tuple[Column, Column]] = []
    if qualified is not None:
        rules.append((qualified.isNotNull(), qualified))
    rules += [
        (name == q, _result(F.lit(-6.0) + bias, "exact_symbol_name", "exact")),
        (F.lower(name) == lowered, _result(F.lit(-5.0) + bias, "exact_symbol_name", "exact")),
        (signature == q, _result(F.lit(-4.9) + bias, _reason("signature_text"), "exact")),
        (F.lower(signature) == lowered, _result(F.lit(-4.15) + bias, _reason("signature_text"), "exact")),
        (key == spec.key, _result(F.lit(-3.25 if sym else -4.5) + bias, "normalized_symbol_name", "strong" if sym else "exact")),
        (key.startswith(spec.key), _result(F.lit(-1.75 if sym else -2.5) + bias, "normalized_symbol_name", "strong")),
        (key.contains(spec.key), _result(F.lit(-0.85 if sym else -0.6) + bias, "normalized_symbol_name", "strong" if sym else "related")),
    ]
    if not sym:
        concept = concept_path_match(spec)
        rules.append((concept.isNotNull(), concept))
    near = F.when(classify.is_definition(F.col("kind")), -0.7).otherwise(0.0)
    rules += [(F.col("similarity") >= least, _result(F.lit(score) + near, "semantic_similarity", sure)) for least, score, sure in SIMILARITY_LEVELS]
    if spec.typed_terms:
        typed = F.col("language").isin("python", "typescript") & classify.is_definition(F.col("kind"))
        every_type = _stem_hits(spec.typed_terms, [ascii_terms(_text("signature"))]) == len(spec.typed_terms)
        rules.append((typed & every_type, _result(F.lit(-0.9) + bias, "signature_text", "strong")))
    if spec.is_broad:
        strong_body = every["body"] & ~every["signature"] & ~every["doc"] & code
        rules.append((strong_body, _result(F.lit(-0.95) + bias, F.when(F.col("kind") == "heading", "heading_text").otherwise("body_text"), "strong")))
        enough = _stem_hits(spec.required, groups) >= 2
        rules.append((code & classify.is_definition(F.col("kind")) & source & enough, _result(F.lit(-0.72) + bias, "body_text", "strong")))
    rules += [
        (holds["doc"], _result(-0.55, "doc_text", "strong")),
        (holds["signature"], _result(-0.2 if sym else -0.55, _reason("signature_text"), "strong")),
        (holds["body"], _result(-0.05 if sym else -0.45, _body_reason(), "strong")),
        (every["doc"], _result(-0.3, "doc_text", "related")),
        (every["signature"], _result(-0.05 if sym else -0.3, _reason("signature_text"), "related")),
        (every["body"], _result(0.0 if sym else -0.15, _body_reason(), weak)),
    ]
    out = _result(0.0, F.when(fallback, "fallback_file").otherwise("token_overlap"), weak)
    for condition, result in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), result).otherwise(out)
    return out


def kind_score() -> Column:
    known = F.create_map(*[F.lit(x) for pair in classify.KIND_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(0.0))


def path_score(spec: QuerySpec) -> Column:
    """What a symbol's place adds; depends on what the query is after."""
    path, kind, language = classify.folded(F.col("path")), F.col("kind"), F.col("language")
    tests = path.startswith("tests/") | path.contains("/test")
    operational, docs = classify.is_operational_doc(path), path.startswith("docs/")
    if spec.docs_only:
        return (
            F.when(tests, 0.75).when(operational, 3.0).when(docs, -1.2).when(path == "readme.md", -1.0).when(path.isin("plan.md", "roadmap.md"), -0.8).otherwise(-0.2)
        )
    if spec.about_docs:
        return (
            F.when(operational, 1.2).when(docs, -0.4).when(path.isin("readme.md", "plan.md"), -0.35).when(path == "roadmap.md", -0.25).when(tests, 0.25).otherwise(0.0)
        )
    code, broad = spec.wants_code, spec.is_broad
    if code:
        markdown = F.lit(2.5)
    elif broad:
        markdown = F.when(docs, 1.35).otherwise(0.95)
    else:
        markdown = F.when(docs, 0.35).when(path.startswith(".codex/") | path.startswith(".claude/"), 0.6).otherwise(0.2)
    definition = classify.is_definition(kind)
    source = F.lit(-2.6 if code else -1.1) + F.when(definition & F.lit(broad), -0.9).otherwise(0.0)
    front = (
        F.lit(-2.15 if code else -0.85)
        + F.when(definition & F.lit(broad), -0.8).otherwise(0.0)
        + F.when(language.isin("css", "html") & F.lit(code or broad), -0.2).otherwise(0.0)
    )
    out = (
        F.when(language == "markdown", markdown)
        .when(kind == "import", F.when(path.startswith("src/"), 2.1 if code else 1.4).otherwise(2.6 if code else 1.9))
        .when(path.startswith("src/"), source)
        .when(classify.is_front_end(path, language), front)
        .when(tests, 1.8 if code else 0.75)
    )
    if spec.about_containers:
        out = out.when(language == "dockerfile", F.when(kind == "file", -2.0).otherwise(-1.4))
    return out.otherwise(0.0)


def weak_doc_score(spec: QuerySpec, confidence: Column) -> Column:
    """What a weak match in an operational document loses."""
    if not spec.hides_operational_docs:
        return F.lit(0.0)
    path = classify.folded(F.col("path"))
    weak = confidence.isin("related", "fallback") & (F.col("language") == "markdown") & classify.is_operational_doc(path)
    return F.when(weak, F.when(path.isin("agents.md", "claude.md"), 3.5).otherwise(2.25)).otherwise(0.0)


def fits_intent(spec: QuerySpec) -> Column:
    """Filter on what the caller wants; applied after the channels' limits."""
    docs = F.col("language") == "markdown"
    path = F.col("path")
    rules = [classify.matches_any(path, list(spec.include_paths)), classify.matches_none(path, list(spec.exclude_paths))]
    if spec.docs_only:
        rules.append(docs)
    if spec.code_only or spec.wants_code:
        rules.append(~docs)
    if spec.exclude_tests:
        rules.append(~classify.is_test_path(path))
    return reduce(lambda x, y: x & y, rules)
