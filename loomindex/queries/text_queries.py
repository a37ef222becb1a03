"""Text functions, classes of paths and files, extraction and trust over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomindex.functions import classify, text
from loomindex.plans.spec import QuerySpec
from loomindex.queries import sqltext as q
from loomindex.plans.opened import open_index
from loomindex.sources import tables

TYPED = QuerySpec("functions that accept a worker account argument")
INCLUDE, EXCLUDE = ["SRC/", "lib\\"], ["vendor", "/test"]
SCOPE = ["packages/inner-ferry-1", "shared/runtime/log.ts", "tools"]


def name_keys(spark, folder):
    s = open_index(spark, folder).symbols
    return s.select("id", text.lookup_key(F.col("name")).alias("name_key"), text.lookup_key(F.coalesce("signature", F.lit(""))).alias("signature_key"))


def name_parts(spark, folder):
    return open_index(spark, folder).symbols.select("id", F.array_join(text.name_parts(F.col("name")), " ").alias("parts"))


def concept_stems(spark, folder):
    """How many symbols have each stem in their name."""
    s = open_index(spark, folder).symbols.select("id", F.explode(text.stems(F.filter(text.name_parts(F.col("name")), lambda t: ~t.isin(text.STOPWORDS)))).alias("stem"))
    return s.groupBy("stem").agg(F.countDistinct("id").alias("symbols"))


def typed_intent(spark, folder):
    """Typed definitions whose signature holds every type that the query speaks of."""
    s = open_index(spark, folder).symbols.filter(F.col("language").isin("python", "typescript") & classify.is_definition(F.col("kind")))
    found = text.stems(text.ascii_terms(F.col("signature")))
    hits = F.size(F.array_intersect(F.array(*map(F.lit, TYPED.typed_terms)), found))
    return s.select("id", hits.cast("long").alias("hits")).filter("hits > 0")


def snippets(spark, folder):
    return open_index(spark, folder).symbols.filter("body is not null").select("id", text.snippet(F.col("body")).alias("snippet"))


def body_summaries(spark, folder):
    s = open_index(spark, folder).symbols.filter("body is not null").select("id", text.body_summary(F.col("body")).alias("s"))
    return s.select("id", "s.mode", F.md5("s.text").alias("text_md5"), F.col("s.total_lines").cast("long").alias("total_lines"), F.col("s.total_chars").cast("long").alias("total_chars"), F.col("s.shown_lines").cast("long").alias("shown_lines"))


def embedding_texts(spark, folder):
    s = open_index(spark, folder).symbols
    t = text.embedding_text(*[F.col(c) for c in ("path", "kind", "name", "signature", "doc", "body")])
    return s.select("id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("chars"))


def extraction_trust(spark, folder):
    kind = classify.extraction_of(F.col("fallback"), F.col("doc"))
    return open_index(spark, folder).symbols.select("id", kind.alias("extraction"), classify.trust_of(kind).alias("trust"))


def extraction_summary(spark, folder):
    from loomindex.plans.search import status

    return status(open_index(spark, folder).symbols, open_index(spark, folder).files)


def languages_present(spark, folder):
    return tables.table(spark, folder, "files").filter("language is not null").select("language").distinct()


def index_totals(spark, folder):
    s = open_index(spark, folder).symbols.agg(F.count("*").alias("symbols"), F.count(F.when(F.col("fallback"), 1)).alias("fallback_symbols"))
    f = open_index(spark, folder).files.agg(F.count("*").alias("files"))
    r = open_index(spark, folder).relations.agg(F.count("*").alias("relations"))
    # Three one-row frames side by side.
    return s.withColumn("one", F.lit(1)).join(f.withColumn("one", F.lit(1)), "one").join(r.withColumn("one", F.lit(1)), "one").drop("one")


def path_classes(spark, folder):
    f = open_index(spark, folder).files
    p = F.col("path")
    return f.select("path", classify.is_test_path(p).alias("is_test"), classify.is_canonical_doc(p).alias("is_canonical"), classify.is_operational_doc(p).alias("is_operational"), F.coalesce(classify.is_front_end(p, F.col("language")), F.lit(False)).alias("is_front_end"))


def path_filters(spark, folder):
    s = open_index(spark, folder).symbols
    return s.filter(classify.matches_any(F.col("path"), INCLUDE) & classify.matches_none(F.col("path"), EXCLUDE)).select("id", "path")


def scope_files(spark, folder):
    return open_index(spark, folder).files.filter(~classify.in_scope(F.col("path"), SCOPE)).select("path")


def language_detection(spark, folder):
    """Files whose recorded language is not that of their name."""
    f = open_index(spark, folder).files.select("path", "language", classify.detected_language(F.col("path")).alias("detected"))
    return f.filter(~F.col("language").eqNullSafe(F.col("detected")))


def shell_sniff(spark, folder):
    h = tables.table(spark, folder, "file_heads").filter("head is not null").groupBy("path").agg(F.max("head").alias("head"))
    return h.select("path", classify.looks_like_shell(F.col("head")).alias("is_shell"))


def kind_filter(spark, folder):
    return open_index(spark, folder).symbols.filter(F.col("kind").isin("class", "interface", "type")).groupBy("kind", "language").agg(F.count("*").alias("symbols"))


def intent_filter(spark, folder):
    from loomindex.operators.scoring import fits_intent

    spec = QuerySpec("merge account", prefer_implementation=True, exclude_tests=True, include_paths=("src/",), exclude_paths=("generated",))
    return open_index(spark, folder).symbols.filter(fits_intent(spec)).select("id")


_S, _F, _R = f"WITH {q.SYMBOLS}", f"WITH {q.FILES}", f"WITH {q.RELATIONS}"
_SUMMARY_TEXT = "array_to_string(list_slice(string_split(body, chr(10)), 1, 40), chr(10))"
_LONG = "(len(string_split(body, chr(10))) > 40 OR length(body) > 4000)"
_CUT = f"CASE WHEN length({_SUMMARY_TEXT}) > 4000 THEN substr({_SUMMARY_TEXT}, 1, 3997) || '...' ELSE {_SUMMARY_TEXT} END"
_PARTS = ", ".join(f"CASE WHEN trim({c}) <> '' THEN trim({c}) END" for c in ("path", "kind", "name", "signature", "doc", "body"))
_EMBED = f"rtrim(substr(array_to_string(list_slice(string_split(array_to_string(list_filter([{_PARTS}], lambda p: p IS NOT NULL), chr(10)), chr(10)), 1, 120), chr(10)), 1, 6000))"
_EXT = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in classify.EXTENSIONS.items())
_NAMES = " OR ".join(f"{q.file_name('path')} = '{n}' OR {q.file_name('path')} LIKE '{n}.%'" for n in classify.CONTAINER_NAMES)
_SHELL_WEIGHT = """CASE WHEN starts_with(x, '#') THEN 0 ELSE
 regexp_matches(x, '^(set -[A-Za-z]+|set -o [A-Za-z-]+)$')::INT + 2 * regexp_matches(x, '^(function\\s+)?[A-Za-z_][A-Za-z0-9_]*\\s*(\\(\\))?\\s*\\{')::INT
 + regexp_matches(x, '^(if|then|elif|else|fi|for|do|done|case|esac|while|until|select|in)\\b')::INT + regexp_matches(x, '^(export\\s+[A-Za-z_][A-Za-z0-9_]*=|[A-Za-z_][A-Za-z0-9_]*=)')::INT
 + regexp_matches(x, '^(exec|source|\\.)\\s+')::INT + (contains(x, '$(') OR contains(x, '${'))::INT END"""

QUERIES = {
    f.__name__: f
    for f in (
        name_keys, name_parts, concept_stems, typed_intent, snippets, body_summaries, embedding_texts, extraction_trust, extraction_summary, languages_present, index_totals,
        path_classes, path_filters, scope_files, language_detection, shell_sniff, kind_filter, intent_filter,
    )
}
SQL = {
    "name_keys": f"{_S} SELECT id, {q.key('name')} AS name_key, {q.key(chr(99) + 'oalesce(signature, ' + chr(39) * 2 + ')')} AS signature_key FROM sym",
    "name_parts": f"{_S} SELECT id, array_to_string({q.name_parts('name')}, ' ') AS parts FROM sym",
    "concept_stems": f"{_S}, t AS (SELECT id, unnest({q.name_parts('name')}) AS t FROM sym) SELECT {q.stem('t')} AS stem, count(DISTINCT id) AS symbols FROM t WHERE t NOT IN {q.STOP} GROUP BY 1",
    "typed_intent": f"{_S}, t AS (SELECT id, unnest({q.terms('signature')}) AS t FROM sym WHERE language IN ('python', 'typescript') AND {q.is_definition('kind')})"
    f" SELECT id, count(DISTINCT {q.stem('t')}) AS hits FROM t WHERE {q.stem('t')} IN {q.quoted(TYPED.typed_terms)} GROUP BY id",
    "snippets": f"{_S} SELECT id, {q.snippet('body')} AS snippet FROM sym WHERE body IS NOT NULL",
    "body_summaries": f"{_S} SELECT id, CASE WHEN {_LONG} THEN 'summary' ELSE 'full' END AS mode, md5(CASE WHEN {_LONG} THEN {_CUT} ELSE body END) AS text_md5, len(string_split(body, chr(10))) AS total_lines,"
    f" length(body) AS total_chars, len(string_split(CASE WHEN {_LONG} THEN {_CUT} ELSE body END, chr(10))) AS shown_lines FROM sym WHERE body IS NOT NULL",
    "embedding_texts": f"{_S} SELECT id, md5({_EMBED}) AS text_md5, length({_EMBED}) AS chars FROM sym",
    "extraction_trust": f"{_S}, e AS (SELECT id, {q.extraction('fallback', 'doc')} AS extraction FROM sym) SELECT *, CASE extraction WHEN 'fallback' THEN 'low' WHEN 'recovered' THEN 'medium' ELSE 'high' END AS trust FROM e",
    "extraction_summary": f"{_S}, {q.FILES}, e AS (SELECT language, {q.extraction('fallback', 'doc')} AS x FROM sym), s AS (SELECT language, count(*) AS symbols, count_if(x = 'parsed')::BIGINT AS parsed, count_if(x = 'recovered')::BIGINT AS recovered, count_if(x = 'fallback')::BIGINT AS fallback FROM e GROUP BY 1),"
    " f AS (SELECT language, count(*) AS files FROM fil GROUP BY 1) SELECT language, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, coalesce(parsed, 0) AS parsed, coalesce(recovered, 0) AS recovered, coalesce(fallback, 0) AS fallback FROM f FULL JOIN s USING (language)",
    "languages_present": "SELECT DISTINCT language FROM files WHERE language IS NOT NULL",
    "index_totals": f"{_S}, {q.FILES}, {q.RELATIONS} SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count_if(fallback) FROM sym)::BIGINT AS fallback_symbols, (SELECT count(*) FROM fil) AS files, (SELECT count(*) FROM rel) AS relations",
    "path_classes": f"{_F} SELECT path, {q.is_test('path')} AS is_test, ({q.folded('path')} LIKE 'docs/%' OR {q.folded('path')} IN ('readme.md', 'plan.md', 'roadmap.md')) AS is_canonical, {q.is_operational('path')} AS is_operational, coalesce({q.is_front('path', 'language')}, false) AS is_front_end FROM fil",
    "path_filters": f"{_S} SELECT id, path FROM sym WHERE (contains({q.folded('path')}, 'src/') OR contains({q.folded('path')}, 'lib/')) AND NOT contains({q.folded('path')}, 'vendor') AND NOT contains({q.folded('path')}, '/test')",
    "scope_files": f"{_F} SELECT path FROM fil WHERE NOT (" + " OR ".join(f"path = '{r}' OR starts_with(path, '{r}/')" for r in SCOPE) + ")",
    "language_detection": f"{_F}, d AS (SELECT path, language, CASE WHEN {_NAMES} THEN 'dockerfile' ELSE CASE regexp_extract({q.file_name('path')}, '\\.([^.]+)$', 1) {_EXT} END END AS detected FROM fil) SELECT * FROM d WHERE language IS DISTINCT FROM detected",
    "shell_sniff": "WITH h AS (SELECT path, max(head) AS head FROM file_heads WHERE head IS NOT NULL GROUP BY path), a AS (SELECT path, head, list_transform(string_split_regex(head, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS every FROM h),"
    " l AS (SELECT path, head, every[1] AS first, list_slice(list_filter(every, lambda x: x <> ''), 1, 12) AS lines FROM a)"
    " SELECT path, NOT contains(head, chr(0)) AND (regexp_matches(first, '^#!\\s*(/usr/bin/env\\s+(-S\\s+)?(ba|z)?sh\\b|/bin/(ba|z)?sh\\b|/usr/bin/(ba|z)?sh\\b)')"
    f" OR coalesce(list_sum(list_transform(lines, lambda x: {_SHELL_WEIGHT})), 0) >= 2) AS is_shell FROM l",
    "kind_filter": f"{_S} SELECT kind, language, count(*) AS symbols FROM sym WHERE kind IN ('class', 'interface', 'type') GROUP BY ALL",
    "intent_filter": f"{_S} SELECT id FROM sym WHERE language <> 'markdown' AND NOT {q.is_test('path')} AND contains({q.folded('path')}, 'src/') AND NOT contains({q.folded('path')}, 'generated')",
}
