"""Relations between files, found in their texts and resolved by joins against the indexed paths.

Specifiers and names are taken from the texts with regular expressions inside the JVM, distinct per
file; candidate paths are exploded with a priority and the best one that exists is taken. Nothing is
looked up one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCRIPTS = ["javascript", "typescript"]
#: Fixed values. Endings tried for a specifier without one.
SCRIPT_ENDINGS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".css"]
RUBY_ENDINGS = [".rb", "/init.rb"]
PYTHON_ENDINGS = [".py", "/__init__.py"]
#: Fixed values. Folders from which constants are loaded by name, in order.
AUTOLOAD_ROOTS = [
    "app/models", "app/models/concerns", "app/services", "app/controllers", "app/controllers/concerns", "app/helpers", "app/jobs", "app/workers", "app/mailers",
    "app/serializers", "app/policies", "app/queries", "app/forms", "app/presenters", "app/validators", "app/concerns", "app/lib", "lib", "lib/concerns", "",
]


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined_path(folder: Column, rest: Column) -> Column:
    """``rest`` as seen from ``folder``, with ``.`` and ``..`` resolved."""
    from loomindex.functions.paths import canonical_path

    return canonical_path(F.concat_ws("/", F.nullif(folder, F.lit("")), rest))


def first_of(*values: Column) -> Column:
    """The first value that is not null."""
    return F.coalesce(*values)


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))))


def import_specifiers(texts: DataFrame) -> DataFrame:
    """Distinct (path, language, specifier, label) of the imports in (path, language, text) rows."""
    rows = texts.filter("path is not null and text is not null")
    script = rows.filter(F.col("language").isin(SCRIPTS))
    named = script.select("path", "language", _all("text", r"(?m)(?:^\s*(?:import|export)\b[^\"';]*?from\s*|^\s*import\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)[\"']([^\"'\n]+)[\"']").alias("specifier"))
    ruby = rows.filter("language = 'ruby'").select("path", "language", _all("text", r"(?m)^\s*require_relative\s*\(?\s*[\"']([^\"'\n]+)[\"']").alias("specifier"))
    python = rows.filter("language = 'python'")
    plain = python.select("path", "language", _all("text", r"(?m)^\s*import\s+([\w. ,]+)$").alias("list")).select(
        "path", "language", F.explode(F.split("list", r"\s*,\s*")).alias("part")
    )
    plain = plain.select("path", "language", F.regexp_extract("part", r"^([\w.]+)", 1).alias("specifier"))
    out = named.union(ruby).union(plain.filter("specifier <> ''")).withColumn("label", F.col("specifier"))
    members = python.select("path", "language", _all("text", r"(?m)^\s*(from\s+[\w.]+\s+import\s+\(?[^\n#()]+)").alias("line")).select(
        "path", "language", F.regexp_extract("line", r"^from\s+([\w.]+)", 1).alias("module"), F.explode(F.split(F.regexp_extract("line", r"import\s+\(?(.*)$", 1), r"\s*,\s*")).alias("part")
    )
    members = members.withColumn("member", F.regexp_extract("part", r"^([\w*]+)", 1)).filter("member <> ''")
    dots = F.when(F.col("module").rlike(r"^\.+$"), F.concat("module", "member")).otherwise(F.concat_ws(".", "module", "member"))
    return out.union(members.select("path", "language", F.col("module").alias("specifier"), dots.alias("label"))).distinct()


def _with_endings(base: Column, endings: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(base, e))


def _python_base(specifier: Column) -> Column:
    """Module as a path; leading dots go up from the importing file's folder."""
    up = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(specifier, r"^\.+", ""), ".", "/")
    relative = joined_path(folder_of(F.col("path")), F.concat_ws("/", F.repeat(F.lit("../"), F.greatest(up - 1, F.lit(0))), rest))
    return F.when(up > 0, relative).otherwise(rest)


def import_relations(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, relation_kind, target_path, target_label) of imports; the target is null where none exists."""
    s = import_specifiers(texts)
    local = joined_path(folder_of(F.col("path")), F.col("specifier"))
    script = F.when(
        F.col("specifier").startswith("."),
        F.when(F.col("specifier").rlike(r"\.[A-Za-z]+$"), F.array(local)).otherwise(F.concat(_with_endings(local, SCRIPT_ENDINGS), _with_endings(F.concat(local, F.lit("/index")), SCRIPT_ENDINGS))),
    )
    ruby = F.when(F.col("specifier").endswith(".rb"), F.array(local)).otherwise(_with_endings(local, RUBY_ENDINGS))
    python = F.concat(_with_endings(_python_base(F.col("label")), PYTHON_ENDINGS[:1]), _with_endings(_python_base(F.col("specifier")), PYTHON_ENDINGS))
    paths = F.when(F.col("language").isin(SCRIPTS), script).when(F.col("language") == "ruby", ruby).when(F.col("language") == "python", python)
    tried = s.select("path", "label", F.posexplode_outer(paths).alias("priority", "target_path"))
    there = files.select(F.col("path").alias("target_path"), F.lit(True).alias("there")).filter("target_path is not null").distinct()
    best = tried.join(there, "target_path", "left").groupBy("path", "label").agg(F.min_by("target_path", F.when(F.col("there"), F.col("priority"))).alias("found"), F.bool_or("there").alias("any"))
    return best.select(F.col("path").alias("source_path"), F.lit("imports").alias("relation_kind"), F.when(F.col("any"), F.col("found")).alias("target_path"), F.col("label").alias("target_label"))


def namespace_of(signature: Column) -> Column:
    """The lexical namespace of a Ruby symbol's body, from its qualified signature; empty at the top level."""
    bare = F.regexp_replace(F.coalesce(signature, F.lit("")), r"^(class|module)\s+|\(.*$", "")
    whole = F.coalesce(signature, F.lit("")).rlike(r"^(class|module)\s")
    return F.when(whole, bare).otherwise(F.regexp_extract(bare, r"^([A-Z][\w:]*?)[#.]", 1))


def _category(root: Column) -> Column:
    """What a folder of constants holds: its last name, ``root`` for the top."""
    return F.when(root == "", "root").otherwise(F.element_at(F.split(root, "/"), -1))


def constant_relations(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Ruby constants resolved by the folders that they are loaded from; a tie of the best is left unresolved.

    A ``namespace`` column of the texts (``A::B``, see ``namespace_of``) is searched from the inside out;
    without it, constants are looked for at the top level only. A constant that is qualified itself is taken as it stands.
    """
    rows = texts.filter("language = 'ruby' and text is not null and path is not null")
    around = F.coalesce(F.col("namespace"), F.lit("")) if "namespace" in texts.columns else F.lit("")
    names = rows.select("path", around.alias("namespace"), _all("text", r"(?<![\w:])([A-Z]\w*[a-z]\w*(?:::[A-Z]\w*)*)").alias("constant")).distinct()
    parts = F.filter(F.split("namespace", "::"), lambda x: x != "")
    levels = F.when(F.col("constant").contains("::"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    leveled = names.withColumn("level", F.explode(levels)).withColumn("qualified", F.concat_ws("::", F.slice(parts, F.lit(1), F.col("level")), F.array(F.col("constant"))))
    snake = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("qualified", "::", "/"), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))
    roots = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(r).alias("root")) for i, r in enumerate(AUTOLOAD_ROOTS)])
    tried = leveled.withColumn("snake", snake).withColumn("r", F.explode(roots))
    # The project part of a path stands before the folder; files are matched on both.
    project = F.regexp_extract("path", r"^(.*?)(?:^|/)(?:app|lib|src)/", 1)
    inner = F.when(project != "", F.expr("substring(path, length(regexp_extract(path, '^(.*?)(?:^|/)(?:app|lib|src)/', 1)) + 2)")).otherwise(F.col("path"))
    own = first_of(*[F.when(inner.startswith(r + "/"), _category(F.lit(r))) for r in AUTOLOAD_ROOTS if r])
    target = F.concat_ws("/", F.nullif(project, F.lit("")), F.nullif(F.col("r.root"), F.lit("")), F.concat("snake", F.lit(".rb")))
    tried = tried.select("path", "namespace", "constant", "qualified", "level", "r.priority", _category(F.col("r.root")).alias("category"), own.alias("own"), target.alias("target_path"))
    there = files.select(F.col("path").alias("target_path")).filter("target_path is not null").distinct()
    same = F.coalesce(F.col("category") == F.col("own"), F.lit(False))
    score = 100 - F.col("priority") + F.when(same, 25).otherwise(0) + F.when(F.col("category") == "concerns", 8).otherwise(0) + F.when(same & (F.col("category") == "lib"), 6).otherwise(0) + 3 * F.col("level")
    key = ["path", "namespace", "constant"]
    found = tried.join(there, "target_path").filter("target_path <> path").withColumn("score", score)
    each = found.groupBy(*key, "target_path").agg(F.max("score").alias("score"), F.max_by("qualified", "score").alias("qualified"))
    w = Window.partitionBy(*key)
    best = each.withColumn("best", F.max("score").over(w)).filter("score = best").withColumn("ties", F.count("*").over(w)).filter("ties = 1")
    out = best.select(F.col("path").alias("source_path"), F.lit("uses").alias("relation_kind"), "target_path", F.col("qualified").alias("target_label"))
    return out.distinct()


def import_aliases(texts: DataFrame) -> DataFrame:
    """(path, root, label, renamed) of the names that imports bring into (path, language, text) rows.

    ``label`` is the import's, as in ``import_relations``; ``renamed`` tells whether the name is not part of it.
    """
    rows = texts.filter("path is not null and text is not null")

    def named(part: str, name: str) -> Column:
        """What ``name as other`` (or ``name: other``) brings in."""
        other = F.regexp_extract(part, rf"^{name}\s*(?:\s+as\s+|:\s*)(\w+)", 1)
        return F.when(other != "", other).otherwise(F.regexp_extract(part, rf"^({name})", 1))

    columns = ["path", "root", "label", "renamed"]
    python = rows.filter("language = 'python'")
    plain = python.select("path", _all("text", r"(?m)^\s*import\s+([\w. ,]+)$").alias("list")).select("path", F.explode(F.split("list", r"\s*,\s*")).alias("part"))
    plain = plain.withColumn("label", F.regexp_extract("part", r"^([\w.]+)", 1)).withColumn("name", named("part", r"[\w.]+"))
    plain = plain.select("path", F.regexp_extract("name", r"^(\w+)", 1).alias("root"), "label", (F.col("name") != F.col("label")).alias("renamed"))
    members = python.select("path", _all("text", r"(?m)^\s*(from\s+[\w.]+\s+import\s+\(?[^\n#()]+)").alias("line")).select(
        "path", F.regexp_extract("line", r"^from\s+([\w.]+)", 1).alias("module"), F.explode(F.split(F.regexp_extract("line", r"import\s+\(?(.*)$", 1), r"\s*,\s*")).alias("part")
    )
    members = members.withColumn("member", F.regexp_extract("part", r"^(\w+)", 1)).withColumn("root", named("part", r"\w+"))
    dots = F.when(F.col("module").rlike(r"^\.+$"), F.concat("module", "member")).otherwise(F.concat_ws(".", "module", "member"))
    members = members.select("path", "root", dots.alias("label"), (F.col("root") != F.col("member")).alias("renamed"))
    script = rows.filter(F.col("language").isin(SCRIPTS))
    clauses = [
        script.select("path", _all("text", pattern, 0).alias("line")).select(
            "path", F.regexp_extract("line", pattern, 1).alias("names"), F.regexp_extract("line", pattern, 2).alias("label")
        )
        for pattern in (r"(?m)^\s*import\s+(?:type\s+)?([^'\";]+?)\s+from\s*[\"']([^\"'\n]+)[\"']", r"(?m)^\s*(?:const|let|var)\s+([^=;]+?)\s*=\s*require\s*\(\s*[\"']([^\"'\n]+)[\"']")
    ]
    pieces = clauses[0].union(clauses[1]).select("path", "label", F.explode(F.split("names", r"\s*[{},]\s*")).alias("part"))
    pieces = pieces.select("path", named("part", r"(?:\*|\w+)").alias("root"), "label", F.lit(False).alias("renamed"))
    ruby = rows.filter("language = 'ruby'").select("path", _all("text", r"(?m)^\s*require_relative\s*\(?\s*[\"']([^\"'\n]+)[\"']").alias("label"))
    last = F.regexp_replace(F.element_at(F.split("label", "/"), -1), r"\.rb$", "")
    ruby = ruby.select("path", F.translate(F.initcap(F.translate(last, "_", " ")), " ", "").alias("root"), "label", F.lit(False).alias("renamed"))
    return reduce(DataFrame.union, [x.select(*columns) for x in (plain, members, pieces, ruby)]).filter("root rlike '^[A-Za-z_]'").distinct()


def use_relations(texts: DataFrame, imports: DataFrame, symbols: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Calls whose root is an imported name (target: that file) or a symbol of the same file (target: itself).

    ``aliases`` (see ``import_aliases``): the names that imports bring in; without it, they are taken from
    the imports' labels. A call by another name than the imported one is reported by the imported one.

    Where the texts have an ``id`` (a symbol's body), the relation has it as source_symbol_id, else null.
    """
    owner = F.col("id") if "id" in texts.columns else F.lit(None)
    rows = texts.filter("path is not null and text is not null").select("path", "text", owner.cast("long").alias("owner"))
    calls = rows.select("path", "owner", _all("text", r"(?<![\w.])(?<!\bdef\s)(?<!\bfunction\s)(?<!\bclass\s)([A-Za-z_]\w*(?:\.\w+)*)\s*\(").alias("call")).withColumn("root", F.regexp_extract("call", r"^(\w+)", 1))
    there = imports.filter("target_path is not null").select(F.col("source_path").alias("path"), "target_path", F.col("target_label").alias("label"))
    if aliases is None:
        tails = F.array(*[F.regexp_extract("label", pattern, 1) for pattern in (r"(\w+)(?:\.\w+)?$", r"(\w+)$")])
        names = there.select("path", "target_path", "label", F.explode(tails).alias("root"), F.lit(False).alias("renamed"))
    else:
        names = there.join(aliases, ["path", "label"])
    said = F.when(F.col("renamed"), F.concat("label", F.expr("substring(call, length(root) + 1)"))).otherwise(F.col("call"))
    outside = calls.join(names.distinct(), ["path", "root"]).select("path", "owner", "target_path", said.alias("call"))
    own = symbols.filter(~F.col("kind").isin("import", "file")).select("path", F.col("name").alias("root")).distinct()
    inside = calls.join(own, ["path", "root"], "left_semi").select("path", "owner", F.col("path").alias("target_path"), "call")
    found = outside.union(inside).distinct()
    return found.select(F.col("owner").alias("source_symbol_id"), F.col("path").alias("source_path"), F.lit("uses").alias("relation_kind"), "target_path", F.col("call").alias("target_label"))
