"""The search plan's reference statements: the same rules, written out in SQL for one query."""

from __future__ import annotations

from loomindex.functions import classify
from loomindex.operators.postings import FIELDS
from loomindex.plans.spec import QuerySpec, stem
from loomindex.plans.spec import lookup_key as key_of
from loomindex.queries import sqltext as q

_EMPTY = "NULL::DOUBLE AS raw_score, NULL::DOUBLE AS similarity, false AS lexical, false AS concept, false AS semantic, NULL::BIGINT AS lexical_rank, NULL::BIGINT AS concept_rank, NULL::BIGINT AS semantic_rank"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def occurrences(t: str, phrase) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({t}, lambda w: w = {s(phrase[0])}))"
    test = " AND ".join(f"{t}[i + {k}] = {s(p)}" for k, p in enumerate(phrase))
    return f"len(list_filter(range(1, len({t}) - {len(phrase) - 2}), lambda i: {test}))"


def bm25(spec: QuerySpec) -> str:
    """CTEs up to ``bm`` (id, raw_score)."""
    fields = ", ".join(f"{tokens(c)} AS t_{c}" for c in FIELDS)
    names = [f"t_{c}" for c in FIELDS] + ["t_content"]
    counts = ", ".join("(" + " + ".join(occurrences(t, p) for t in names) + f") AS f{i}" for i, p in enumerate(spec.phrases))
    stats = ", ".join(f"count_if(f{i} > 0)::DOUBLE AS n{i}" for i in range(len(spec.phrases)))
    score = " ".join(
        f"- (CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END)"
        f" * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))"
        for i in range(len(spec.phrases))
    )
    hit = " OR ".join(f"f{i} > 0" for i in range(len(spec.phrases)))
    return f"""tok AS (SELECT id, {fields} FROM sym), tok2 AS (SELECT *, list_concat(list_concat(t_name, t_signature), list_concat(t_doc, t_body)) AS t_content FROM tok),
cnt AS (SELECT id, {' + '.join(f'len({t})' for t in names)} AS length, {counts} FROM tok2), stat AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length, {stats} FROM cnt),
bm AS (SELECT id, round(0 {score}, 9) AS raw_score FROM cnt, stat WHERE {hit})"""


def _channel(name: str, source: str, **given: str) -> str:
    row = dict(part.split(" AS ")[::-1] for part in _EMPTY.split(", ")) | given
    return f"{name} AS (SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in row.items()) + f" FROM {source})"


def _filter(spec: QuerySpec) -> str:
    return f"kind IN {q.quoted(spec.kinds)}" if spec.kinds else "true"


def lexical(spec: QuerySpec) -> str:
    top = f"(SELECT id, raw_score, row_number() OVER (ORDER BY raw_score, id) AS r FROM bm JOIN sym USING (id) WHERE {_filter(spec)} ORDER BY raw_score, id LIMIT {max(10 * spec.limit, 100)})"
    return bm25(spec) + ", " + _channel("lex", top, raw_score="raw_score", lexical="true", lexical_rank="r")


def literal_matches(spec: QuerySpec) -> str:
    texts = [f"coalesce({c}, '')" for c in ("path", "name", "signature", "doc", "body")]
    tests = [f"contains(lower({c}), {s(spec.lowered)})" for c in texts] + [f"contains({q.key(c)}, {s(spec.key)})" for c in texts]
    level = q.first_true([f"lower(name) = {s(spec.lowered)}", f"contains(lower(signature), {s(spec.lowered)})", f"contains(lower(body), {s(spec.lowered)})"])
    raw = (
        f"CASE WHEN lower(name) = {s(spec.lowered)} OR {q.key('name')} = {s(spec.key)} THEN -6.5 WHEN contains(lower(signature), {s(spec.lowered)}) THEN -5.0"
        f" WHEN contains(lower(body), {s(spec.lowered)}) OR contains({q.key('body')}, {s(spec.key)}) THEN -4.0 ELSE -2.5 END::DOUBLE"
    )
    return f"SELECT id, start_line, {level} AS level, {q.kind_order(['class', 'function', 'heading'])} AS kind_order, {raw} AS raw_score FROM sym WHERE {_filter(spec)} AND ({' OR '.join(tests)})"


def bare() -> str:
    return "lower(trim(regexp_replace(coalesce(signature, ''), '^(class|module)\\s+', '')))"


def evidence(spec: QuerySpec) -> str:
    return "(" + " OR ".join([f"contains(lower(coalesce(signature, '')), {s(spec.lowered)})", *[f"ends_with({q.folded('path')}, {s(x)})" for x in spec.path_suffixes]]) + ")"


def exact_matches(spec: QuerySpec) -> str:
    keys = [k for k in dict.fromkeys(key_of(v) for v in spec.variants) if k]
    lowered = q.quoted(v.lower() for v in spec.variants)
    levels = [f"lower(trim({c})) IN {lowered}" for c in ("name", "signature", "path")] + [f"{q.stored_key(c)} IN {q.quoted(keys)}" for c in ("name", "signature", "path")]
    levels.append(f"ends_with({q.stored_key('signature')}, {s(keys[0])})")
    return f"SELECT * FROM (SELECT *, {q.first_true(levels)} AS level FROM sym WHERE {_filter(spec)}) WHERE level < {len(levels)}"


def exact(spec: QuerySpec) -> str:
    rules = [f"WHEN lower(trim(coalesce({c}, ''))) = {s(spec.lowered)} THEN {v}" for c, v in (("name", -7.5), ("signature", -7.0), ("path", -6.5))]
    if spec.segments:
        rules.append(f"WHEN kind IN ('class', 'module') AND {bare()} = {s(spec.lowered)} THEN -35.0")
        if len(spec.segments) >= 3:
            rules.append(f"WHEN kind IN ('class', 'module') AND {evidence(spec)} AND lower(trim(name)) = {s(spec.segments[-1].lower())} THEN -10.0")
    order = f"level, {q.kind_order(['class', 'function', 'selector', 'key', 'stage', 'file'])}, start_line, id"
    raw = f"CASE {' '.join(rules)} ELSE -6.0 END::DOUBLE"
    return f"exm AS ({exact_matches(spec)}), " + _channel("exa", f"(SELECT * FROM exm ORDER BY {order} LIMIT {max(2 * spec.limit, 10)})", raw_score=raw, lexical="true")


def concept_matches(spec: QuerySpec) -> str:
    every = " AND ".join(f"contains({q.folded('path')}, {s(t)})" for t in spec.concepts) or "false"
    return f"SELECT *, CASE WHEN contains({q.key('path')}, {s(spec.key)}) THEN 0 ELSE 1 END AS level FROM sym WHERE {_filter(spec)} AND kind NOT IN ('import', 'file') AND {every}"


def _path_match(spec: QuerySpec) -> tuple[str, str, str, str]:
    """Conditions: open row, same base name, same words, words inside the path."""
    base = f"regexp_replace({q.file_name('path')}, '\\.[^.]+$', '')"
    wanted = "[" + ", ".join(map(s, spec.concepts)) + "]"
    several = "true" if len(spec.concepts) > 1 else "false"
    opened = f"(language <> 'markdown' AND kind NOT IN ('import', 'file') AND NOT {q.is_test('path')})" if spec.concepts and not spec.about_docs else "false"
    same = f"({several} AND len({q.name_parts(base)}) = {len(spec.concepts)} AND list_has_all({q.name_parts(base)}, {wanted}))"
    inside = f"({several} AND list_has_all({q.name_parts(q.folded('path'))}, {wanted}) AND {q.is_definition('kind')})"
    return opened, f"{q.key(base)} = {s(spec.key)}", same, inside


def concept(spec: QuerySpec) -> str:
    opened, base, same, inside = _path_match(spec)
    raw = f"CASE WHEN {opened} AND ({base} OR {same}) THEN -7.5 WHEN {opened} AND {inside} THEN -5.5 ELSE -2.5 END::DOUBLE"
    order = f"level, {q.kind_order(['class', 'function', 'heading'])}, start_line, id"
    return f"com AS ({concept_matches(spec)}), " + _channel(
        "con", f"(SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM com ORDER BY {order} LIMIT {max(10 * spec.limit, 100)})", raw_score=raw, concept="true", concept_rank="r"
    )


def vector(model: str) -> str:
    return f"(SELECT embedding FROM symbol_embeddings WHERE model = {s(model)} AND embedding IS NOT NULL AND len(embedding) = dimensions AND symbol_id IS NOT NULL ORDER BY symbol_id, embedding LIMIT 1)"


def similar(model: str, provider: str | None) -> str:
    where = f"model = {s(model)}" + (f" AND provider = {s(provider)}" if provider else "")
    norm = lambda x: f"sqrt(coalesce(list_sum(list_transform({x}, lambda e: e * e)), 0))"
    return f"""emb AS (SELECT DISTINCT symbol_id AS id, list_filter(embedding, lambda e: e IS NOT NULL AND NOT isnan(e)) AS e FROM symbol_embeddings WHERE {where} AND symbol_id IS NOT NULL AND embedding IS NOT NULL),
qv AS (SELECT {vector(model)} AS v), cut AS (SELECT id, list_slice(e, 1, least(len(e), len(v))) AS a, list_slice(v, 1, least(len(e), len(v))) AS b FROM emb, qv),
sim AS (SELECT id, round(max(CASE WHEN len(a) = 0 OR {norm('a')} * {norm('b')} = 0 THEN 0 ELSE list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / ({norm('a')} * {norm('b')}) END), 9) AS similarity FROM cut GROUP BY id)"""


def semantic(spec: QuerySpec) -> str:
    order = "similarity DESC, id"
    top = f"(SELECT id, similarity, row_number() OVER (ORDER BY {order}) AS r FROM sim JOIN sym USING (id) WHERE similarity >= 0.6 AND {_filter(spec)} ORDER BY {order} LIMIT {max(10 * spec.limit, 100)})"
    return similar(spec.model, spec.provider) + ", " + _channel("sem", top, raw_score="0.0::DOUBLE", similarity="similarity", semantic="true", semantic_rank="r")


def merged(spec: QuerySpec) -> str:
    parts, names = [lexical(spec), exact(spec)], ["lex", "exa"]
    if spec.uses_concepts:
        parts.append(concept(spec))
        names.append("con")
    if spec.model:
        parts.append(semantic(spec))
        names.append("sem")
    union = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return (
        ", ".join(parts)
        + f", mer AS (SELECT id, min(raw_score) AS raw_score, max(similarity) AS similarity, bool_or(lexical) AS lexical, bool_or(concept) AS concept, bool_or(semantic) AS semantic,"
        f" min(lexical_rank) AS lexical_rank, min(concept_rank) AS concept_rank, min(semantic_rank) AS semantic_rank FROM ({union}) GROUP BY id)"
    )


def fusion() -> str:
    return (
        "-(coalesce(3.4::DOUBLE / (lexical_rank + 1), 0) + coalesce(2.8::DOUBLE / (concept_rank + 1), 0) + coalesce(5.8::DOUBLE / (semantic_rank + 1), 0) + 2.1::DOUBLE * coalesce(similarity, 0))"
        " - CASE WHEN semantic AND NOT lexical AND NOT concept THEN 0.75::DOUBLE ELSE 0 END"
    )


def match(spec: QuerySpec) -> str:
    """A struct expression over sym's columns and ``similarity``."""
    bias = f"CASE WHEN {q.is_definition('kind')} THEN -1.2 ELSE 0 END"
    weak = "CASE WHEN coalesce(fallback, false) THEN 'fallback' ELSE 'related' END"
    txt = {c: f"coalesce({c}, '')" for c in ("name", "signature", "doc", "body")}
    key, sym = s(spec.key), spec.is_symbol
    rules: list[tuple[str, str, str, str]] = []
    if spec.segments:
        box, ql = "kind IN ('class', 'module')", s(spec.lowered)
        named = f"({evidence(spec)} AND lower(trim(name)) = {s(spec.segments[-1].lower())} AND {'true' if len(spec.segments) >= 3 else 'false'})"
        member = "(" + " OR ".join(f"starts_with({bare()}, {s(spec.lowered + x)})" for x in ("#", ".", "::")) + ")"
        rules += [
            (f"{named} AND {box} AND {bare()} <> {ql}", f"-1.5 + {bias}", "'normalized_symbol_name'", "'exact'"),
            (f"{named} AND NOT {box}", "1.25", "'normalized_symbol_name'", "'related'"),
            (f"{bare()} = {ql}", f"-7.0 + {bias}", "'signature_text'", f"CASE WHEN {box} THEN 'exact' ELSE 'strong' END"),
            (f"{box} AND contains(lower({txt['signature']}), {ql})", f"-4.75 + {bias}", "'signature_text'", "'exact'"),
            (member, f"-2.75 + {bias}", "'signature_text'", "'strong'"),
        ]
    imp = lambda other: f"CASE WHEN kind = 'import' THEN 'import_reference' ELSE '{other}' END"
    body_reason = "CASE kind WHEN 'import' THEN 'import_reference' WHEN 'heading' THEN 'heading_text' ELSE 'body_text' END"
    rules += [
        (f"trim({txt['name']}) = {s(spec.trimmed)}", f"-6.0 + {bias}", "'exact_symbol_name'", "'exact'"),
        (f"lower(trim({txt['name']})) = {s(spec.lowered)}", f"-5.0 + {bias}", "'exact_symbol_name'", "'exact'"),
        (f"trim({txt['signature']}) = {s(spec.trimmed)}", f"-4.9 + {bias}", imp("signature_text"), "'exact'"),
        (f"lower(trim({txt['signature']})) = {s(spec.lowered)}", f"-4.15 + {bias}", imp("signature_text"), "'exact'"),
        (f"{q.key(txt['name'])} = {key}", f"{-3.25 if sym else -4.5} + {bias}", "'normalized_symbol_name'", "'strong'" if sym else "'exact'"),
        (f"starts_with({q.key(txt['name'])}, {key})", f"{-1.75 if sym else -2.5} + {bias}", "'normalized_symbol_name'", "'strong'"),
        (f"contains({q.key(txt['name'])}, {key})", f"{-0.85 if sym else -0.6} + {bias}", "'normalized_symbol_name'", "'strong'" if sym else "'related'"),
    ]
    if not sym:
        opened, base, same, inside = _path_match(spec)
        top = "CASE WHEN start_line <= 120 THEN -0.4 ELSE 0 END"
        rules += [
            (f"{opened} AND {base}", f"-3.25 + {bias} + {top}", "'path_concept'", "'strong'"),
            (f"{opened} AND {same}", f"-2.75 + {bias} + {top}", "'path_concept'", "'strong'"),
            (f"{opened} AND {inside}", f"-1.15 + {top}", "'path_concept'", "'related'"),
        ]
    near = f"CASE WHEN {q.is_definition('kind')} THEN -0.7 ELSE 0 END"
    rules += [(f"similarity >= {x}", f"{y} + {near}", "'semantic_similarity'", f"'{z}'") for x, y, z in ((0.9, -2.2, "exact"), (0.75, -1.35, "strong"), (0.6, -0.45, "related"))]
    stems = lambda groups: f"list_distinct(list_transform({groups}, lambda w: {q.stem('w')}))"
    as_list = lambda words: "[" + ", ".join(map(s, words)) + "]"
    if spec.typed_terms:
        rules.append(
            (f"language IN ('python', 'typescript') AND {q.is_definition('kind')} AND list_has_all({stems(q.terms('signature'))}, {as_list(spec.typed_terms)})", f"-0.9 + {bias}", "'signature_text'", "'strong'")
        )
    every = {c: "(" + (" AND ".join(f"contains(lower({txt[c]}), {s(t)})" for t in spec.required) or "false") + ")" for c in ("signature", "doc", "body")}
    code = "(language <> 'markdown' AND NOT coalesce(fallback, false) AND kind NOT IN ('import', 'file'))"
    if spec.is_broad:
        wanted = as_list(dict.fromkeys(stem(t) for t in spec.required))
        groups = f"list_concat(list_concat({q.name_parts('name')}, {q.terms('signature')}), {q.terms('body')})"
        place = f"({q.folded('path')} LIKE 'src/%' OR {q.is_front('path', 'language')})"
        rules += [
            (f"{every['body']} AND NOT {every['signature']} AND NOT {every['doc']} AND {code}", f"-0.95 + {bias}", "CASE WHEN kind = 'heading' THEN 'heading_text' ELSE 'body_text' END", "'strong'"),
            (f"{code} AND {q.is_definition('kind')} AND {place} AND len(list_intersect({stems(groups)}, {wanted})) >= 2", f"-0.72 + {bias}", "'body_text'", "'strong'"),
        ]
    holds = {c: f"(contains({q.key(txt[c])}, {key}) OR contains(lower({txt[c]}), {s(spec.lowered)}))" for c in ("signature", "doc", "body")}
    rules += [
        (holds["doc"], "-0.55", "'doc_text'", "'strong'"),
        (holds["signature"], "-0.2" if sym else "-0.55", imp("signature_text"), "'strong'"),
        (holds["body"], "-0.05" if sym else "-0.45", body_reason, "'strong'"),
        (every["doc"], "-0.3", "'doc_text'", "'related'"),
        (every["signature"], "-0.05" if sym else "-0.3", imp("signature_text"), "'related'"),
        (every["body"], "0" if sym else "-0.15", body_reason, weak),
    ]
    rules.append(("true", "0", "CASE WHEN coalesce(fallback, false) THEN 'fallback_file' ELSE 'token_overlap' END", weak))
    return "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN {{'adjustment': ({a})::DOUBLE, 'reason': {r}, 'confidence': {f}}}" for c, a, r, f in rules) + " END"


def kind_score() -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in classify.KIND_SCORES.items()) + " ELSE 0 END::DOUBLE"


def path_score(spec: QuerySpec) -> str:
    """For queries that are neither about documents nor restricted to them."""
    p, code, broad = q.folded("path"), spec.wants_code, spec.is_broad
    markdown = "2.5" if code else (f"CASE WHEN {p} LIKE 'docs/%' THEN 1.35 ELSE 0.95 END" if broad else f"CASE WHEN {p} LIKE 'docs/%' THEN 0.35 WHEN {p} LIKE '.codex/%' OR {p} LIKE '.claude/%' THEN 0.6 ELSE 0.2 END")
    extra = lambda x: f"CASE WHEN {q.is_definition('kind')} THEN {x} ELSE 0 END" if broad else "0"
    style = "CASE WHEN language IN ('css', 'html') THEN -0.2 ELSE 0 END" if code or broad else "0"
    docker = "WHEN language = 'dockerfile' THEN CASE WHEN kind = 'file' THEN -2.0 ELSE -1.4 END" if spec.about_containers else ""
    return f"""(CASE WHEN language = 'markdown' THEN {markdown}
  WHEN kind = 'import' THEN CASE WHEN {p} LIKE 'src/%' THEN {2.1 if code else 1.4} ELSE {2.6 if code else 1.9} END
  WHEN {p} LIKE 'src/%' THEN {-2.6 if code else -1.1} + {extra(-0.9)}
  WHEN {q.is_front('path', 'language')} THEN {-2.15 if code else -0.85} + {extra(-0.8)} + {style}
  WHEN {q.is_test('path')} THEN {1.8 if code else 0.75} {docker} ELSE 0 END)::DOUBLE"""


def search(spec: QuerySpec, support: str) -> str:
    """CTEs up to ``found``: ranked results of a query that does not ask for entry points, with relative scores."""
    collapse = "true"
    if spec.hides_operational_docs:
        collapse = "k IS NULL OR nth = 1 OR top NOT IN ('related', 'fallback')"
    key = f"CASE WHEN {q.is_operational('path')} THEN {q.key('name')} || '|' || substr({q.key(q.snippet('body'))}, 1, 120) END"
    trust = "CASE WHEN x = 'fallback' OR confidence = 'fallback' THEN 'low' WHEN confidence = 'exact' THEN 'high' WHEN confidence = 'strong' THEN CASE WHEN x = 'parsed' THEN 'high' ELSE 'medium' END ELSE CASE WHEN x = 'parsed' THEN 'medium' ELSE 'low' END END"
    return f"""{pool(spec)}, {support}, ranked AS (SELECT p.*, s.body, {q.extraction('p.fallback', 'p.doc')} AS x, p.adjusted + coalesce(g.graph_score, 0) AS distance, coalesce(g.signals, '') AS signals FROM pool p JOIN sym s USING (id) LEFT JOIN support g USING (id)),
spot AS (SELECT *, {key} AS k, row_number() OVER (ORDER BY distance, raw_score, id) AS place FROM ranked),
marked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS nth, first_value(confidence) OVER (ORDER BY place) AS top FROM spot),
kept AS (SELECT * FROM marked WHERE {collapse} ORDER BY place LIMIT {spec.limit}),
spread AS (SELECT *, row_number() OVER (ORDER BY place) AS position, min(distance) OVER () AS low, max(distance) OVER () AS high FROM kept),
found AS (SELECT *, {trust} AS retrieval_trust, floor(m * 1000 + 0.5) / 1000 AS margin, floor((1 - floor(m * 1000 + 0.5) / 1000) * 1000 + 0.5) / 1000 AS score FROM (SELECT *, CASE WHEN high > low THEN (distance - low) / (high - low) ELSE 0 END AS m FROM spread))"""


def turns(limit: int) -> str:
    """CTE ``turned``: ``found`` with the order in which files take turns."""
    return f"""whole AS (SELECT *, position = min(position) OVER () AS first, count(*) OVER () AS n FROM found),
rounds AS (SELECT *, row_number() OVER (PARTITION BY path, first ORDER BY position) AS round, min(position) OVER (PARTITION BY path, first) AS start FROM whole),
turned AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN first OR n <= {limit} THEN 0 ELSE round END, CASE WHEN first OR n <= {limit} THEN 0 ELSE start END, position) AS turn FROM rounds)"""


def pool(spec: QuerySpec) -> str:
    """CTEs up to ``pool``: id, path, kind, language, raw_score, adjusted, reason, confidence, similarity."""
    weak = "0"
    if spec.hides_operational_docs:
        weak = f"CASE WHEN m.confidence IN ('related', 'fallback') AND language = 'markdown' AND {q.is_operational('path')} THEN CASE WHEN {q.folded('path')} IN ('agents.md', 'claude.md') THEN 3.5 ELSE 2.25 END ELSE 0 END::DOUBLE"
    base = fusion() if spec.model else "raw_score"
    rules = ["true"]
    if spec.code_only or spec.wants_code:
        rules.append("language <> 'markdown'")
    if spec.exclude_tests:
        rules.append(f"NOT {q.is_test('path')}")
    return f"""{merged(spec)}, mat AS (SELECT sym.*, mer.* EXCLUDE (id), {match(spec)} AS m FROM sym JOIN mer USING (id) WHERE {' AND '.join(rules)}),
pool AS (SELECT id, path, kind, language, name, fallback, doc, lexical, concept, semantic, raw_score, ({base}) + {kind_score()} + {path_score(spec)} + ({weak}) + m.adjustment AS adjusted, m.reason AS reason, m.confidence AS confidence, similarity
  FROM mat ORDER BY adjusted, raw_score, id LIMIT {max(4 * spec.limit, 20)})"""
