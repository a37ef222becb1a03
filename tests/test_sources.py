import ast

from pyspark.sql import functions as F

from loomindex.sources import extract, relations
from loomindex.sources.connectors import parse_git_status
from loomindex.sources.tree import TreeSource, scope_rules
from tests.helpers import files, rows, symbols


def found(text, language):
    return [(f.kind, f.name, f.start_line, f.end_line) for f in extract.symbols_of(text, language, "x/File")]


def test_python_agrees_with_the_syntax_tree():
    text = "import os\n\nclass A(B):\n    def m(self):\n        return {\n    'x': 1,\n        }\n\ndef f(\n    x,\n):\n    pass\n"
    tree = {n.name: (n.lineno, n.end_lineno) for n in ast.walk(ast.parse(text)) if hasattr(n, "name") and hasattr(n, "lineno") and not isinstance(n, ast.alias)}
    assert {n: (a, b) for k, n, a, b in found(text, "python") if k != "import"} == tree
    assert found("def broken(:\n  x\ny", "python") == [("function", "broken", 1, 2)]


def test_other_languages():
    js = "import x from './x'\nexport class A {\n  run(a) {\n    if (a) { go('}') }\n  }\n}\nconst f = (a) => {\n}\n"
    assert found(js, "javascript") == [("import", "import x from './x'", 1, 1), ("class", "A", 2, 6), ("method", "run", 3, 5), ("function", "f", 7, 8)]
    assert [k for k, *_ in found("interface I {\n}\ntype T = string;\nenum E {\n}", "typescript")] == ["interface", "type", "enum"]
    rb = "module M\n  class C\n    def go\n      x.each do |y|\n        y\n      end\n    end\n  end\nend\nMAX = 3"
    assert found(rb, "ruby") == [("module", "M", 1, 9), ("class", "C", 2, 8), ("method", "go", 3, 7), ("constant", "MAX", 10, 10)]
    assert found("# A\ntext\n## B\n", "markdown") == [("heading", "A", 1, 2), ("heading", "B", 3, 4)]
    assert found("a:\n  b: 1\nc: 2", "yaml") == [("key", "a", 1, 1), ("key", "a.b", 2, 2), ("key", "c", 3, 3)]
    assert found("go() {\n  echo 1\n}", "shell") == [("function", "go", 1, 3)]
    assert [(k, n) for k, n, *_ in found("FROM base AS build\nRUN make all", "dockerfile")] == [("file", "File"), ("stage", "build"), ("from", "base AS build"), ("run", "make all")]
    assert [n for _, n, *_ in found(".a, .b {\n}\n@media print {\n}", "css")] == [".a", ".b", "@media print"]
    page = "<html><title>Hi</title>\n<div id='x'><p>text</p></div></html>"
    assert [(k, n) for k, n, *_ in found(page, "html")] == [("title", "Hi"), ("element", "x")]


def signatures(text, language):
    return [f.signature for f in extract.symbols_of(text, language, "x/Dockerfile")]


def test_qualified_signatures():
    rb = "module Core\n  class Index\n    LIMIT = 3\n    def run(a, b = {})\n    end\n    def self.open(x)\n    end\n  end\nend\ndef free\nend\nrequire 'set'"
    assert signatures(rb, "ruby") == ["module Core", "class Core::Index", "Core::Index::LIMIT", "Core::Index#run(a, b = {})", "Core::Index.open(x)", "free", "require 'set'"]
    js = "export class K extends Base {\n  go(a) {\n  }\n}\nasync function f(a, b = (1)) {\n}\nconst g = (x) => x;\n"
    assert signatures(js, "javascript") == ["class K extends Base", "K.go(a)", "f(a, b = (1))", "g(x)"]
    ts = "class K {\n  go(a: number): string {\n  }\n}\nfunction f(a: T): number {\n}\ninterface I {\n}\nconst h = (x: T): U => x;\n"
    assert signatures(ts, "typescript") == ["class K", "K.go(a: number): string", "f(a: T): number", "interface I", "h(x: T): U"]
    py = "from a import (\n  b,\n)\nclass C(B, metaclass=M):\n    'def fake(): no'\n    @wrap\n    async def go(\n        self, x: int = f(1)\n    ) -> dict[str, int]:\n        return 1\n"
    assert signatures(py, "python") == ["from a import (\n  b,\n)", "class C(B, metaclass=M)", "go(\n        self, x: int = f(1)\n    ) -> dict[str, int]"]
    assert [(f.name, f.start_line, f.start_column, f.end_line, f.end_column) for f in extract.symbols_of(py, "python")][2] == ("go", 7, 5, 10, 17)
    docker = [f for f in extract.symbols_of("FROM a AS b\n# no\nARG X=1\nCOPY  Src /Dst\n", "dockerfile", "x/Dockerfile")]
    assert [(f.kind, f.name, f.doc) for f in docker[1:]] == [("stage", "b", None), ("from", "a AS b", "from a as b"), ("arg", "X", None), ("copy", "Src /Dst", "copy src /dst")]
    assert docker[0].signature == "x/Dockerfile" and docker[0].name == "Dockerfile"
    assert [f.doc for f in extract.symbols_of(".top-Bar .item { }", "css")] == ["top-bar item top-bar item top-baritem"]


def test_css_over_the_whole_text():
    assert found(".a{x:1}.b,.c{y:2}@media print{.d{z:3}}", "css") == [("selector", ".a", 1, 1), ("selector", ".b", 1, 1), ("selector", ".c", 1, 1), ("at_rule", "@media print", 1, 1), ("selector", ".d", 1, 1)]
    spread = "/* .no { } */\n@import 'x.css';\n.a,\n.b\n  > p,\n:is(h1, h2)\n{\n}\n[title=\"a,{b\"] { }\n"
    assert found(spread, "css") == [("selector", ".a", 3, 3), ("selector", ".b > p", 4, 5), ("selector", ":is(h1, h2)", 6, 6), ("selector", '[title="a,{b"]', 9, 9)]
    assert found("a { color: red; &:hover { } }", "css") == [("selector", "a", 1, 1), ("selector", "&:hover", 1, 1)]
    assert found("/* open", "css") == []


def test_extraction_rows(spark):
    texts = spark.createDataFrame([("a.py", "python", "def f(): pass"), ("b", None, None), ("c.rb", "ruby", "x" * 40000), (None, "python", "def g(): pass")], "path string, language string, text string")
    got = rows(extract.with_ids(extract.extract_symbols(texts)), "path", "kind", "extraction", "fallback")
    assert got == [("a.py", "function", "parsed", False), ("b", "file", "fallback", True), ("c.rb", "file", "fallback", True)]
    assert extract.extract_symbols(texts.limit(0)).count() == 0


def test_import_relations(spark):
    texts = spark.createDataFrame(
        [("src/a.ts", "typescript", "import { x } from './lib/b'\nimport y from 'react'"), ("p/m.py", "python", "from .q import z, w\nimport r.s as t"), ("r/a.rb", "ruby", "require_relative '../r/b'")],
        "path string, language string, text string",
    )
    f = files(spark, [(p, "x", 1, 1.0) for p in ("src/lib/b/index.ts", "p/q.py", "p/q/z.py", "r/s/__init__.py", "r/b.rb")])
    got = {(s, label): t for s, _, t, label in (tuple(r) for r in relations.import_relations(texts, f).collect())}
    assert got == {
        ("src/a.ts", "./lib/b"): "src/lib/b/index.ts", ("src/a.ts", "react"): None, ("p/m.py", ".q.z"): "p/q/z.py", ("p/m.py", ".q.w"): "p/q.py", ("p/m.py", "r.s"): "r/s/__init__.py",
        ("r/a.rb", "../r/b"): "r/b.rb",
    }


def test_uses_by_other_names(spark):
    texts = spark.createDataFrame(
        [
            ("p/m.py", "python", "import r.s as t\nfrom .q import z as w\nt.go(1)\nw()\nz()\n"), ("w/a.ts", "typescript", "import d, { x as y } from './b'\nimport * as n from './c'\nd(); y(); n.k()\n"),
            ("w/e.js", "javascript", "const { f: g, h } = require('./b')\ng(); h(); f()\n"), ("r/a.rb", "ruby", "require_relative 'line_item'\nLineItem.open(1)\n"),
        ],
        "path string, language string, text string",
    )
    f = files(spark, [(p, "x", 1, 1.0) for p in ("r/s.py", "p/q.py", "w/b.ts", "w/c.ts", "r/line_item.rb")])
    none = symbols(spark, []).limit(0)
    uses = relations.use_relations(texts, relations.import_relations(texts, f), none, relations.import_aliases(texts))
    assert rows(uses, "source_path", "target_path", "target_label") == [
        ("p/m.py", "p/q.py", ".q.z"), ("p/m.py", "r/s.py", "r.s.go"), ("r/a.rb", "r/line_item.rb", "LineItem.open"), ("w/a.ts", "w/b.ts", "d"), ("w/a.ts", "w/b.ts", "y"), ("w/a.ts", "w/c.ts", "n.k"),
        ("w/e.js", "w/b.ts", "g"), ("w/e.js", "w/b.ts", "h"),
    ]


def test_constants_and_uses(spark):
    texts = spark.createDataFrame([("app/models/a.rb", "ruby", "LineItem.new; Tie.x"), ("m.py", "python", "b.run()\nhelp(1)")], "path string, language string, text string")
    f = files(spark, [(p, "ruby", 1, 1.0) for p in ("app/models/line_item.rb", "lib/line_item.rb")])
    assert rows(relations.constant_relations(texts, f), "target_path", "target_label") == [("app/models/line_item.rb", "LineItem")]
    named = spark.createDataFrame(
        [("lib/foo/a.rb", "ruby", "Bar.new; Foo::Baz.x; Own", "Foo::Inner"), ("p/lib/x.rb", "ruby", "Deep", None)], "path string, language string, text string, namespace string"
    )
    f2 = files(spark, [(p, "ruby", 1, 1.0) for p in ("lib/foo/bar.rb", "bar.rb", "lib/foo/baz.rb", "app/models/own.rb", "lib/own.rb", "p/lib/deep.rb", "lib/deep.rb")])
    assert rows(relations.constant_relations(named, f2), "source_path", "target_path", "target_label") == [
        ("lib/foo/a.rb", "lib/foo/bar.rb", "Foo::Bar"), ("lib/foo/a.rb", "lib/foo/baz.rb", "Foo::Baz"), ("lib/foo/a.rb", "lib/own.rb", "Own"), ("p/lib/x.rb", "p/lib/deep.rb", "Deep"),
    ]
    sig = spark.createDataFrame([("class A::B",), ("A::B#m(x)",), ("A.m",), ("m(x)",), (None,)], "s string").select(relations.namespace_of(F.col("s")))
    assert [r[0] for r in sig.collect()] == ["A::B", "A::B", "A", "", ""]
    imports = spark.createDataFrame([("m.py", "imports", "b.py", "b")], "source_path string, relation_kind string, target_path string, target_label string")
    uses = relations.use_relations(texts.filter("language = 'python'"), imports, symbols(spark, [{"path": "m.py", "name": "help"}]))
    assert rows(uses, "target_path", "target_label") == [("b.py", "b.run"), ("m.py", "help")]


def test_tree_source(spark, tmp_path):
    for path in ("a.py", "_old/b.py", ".ci/c.yml", "node_modules/x.js", "sub/deep/d.md", "sub/skip/e.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    spark.dataSource.register(TreeSource)
    got = rows(spark.read.format("sourcetree").option("scope", "# note\n./sub\\skip/\n").load(str(tmp_path)), "path", "size", "text")
    assert got == [(p, len(p), p) for p in (".ci/c.yml", "_old/b.py", "a.py", "sub/deep/d.md")]
    assert scope_rules(" a/ \n#b\n\nc\\d") == ["a", "c/d"]


def test_git_status():
    assert parse_git_status("?? new.py\n D gone.py\nM  dir/mod.py\nR  old.py -> dir/moved.py\n") == [("new.py", "new"), ("gone.py", "deleted"), ("dir/mod.py", "changed"), ("dir/moved.py", "changed")]


def test_embedding_service(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from loomindex.sources.connectors import embed_texts

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id bigint, text string")
    got = rows(embed_texts(texts, f"http://127.0.0.1:{server.server_port}", "m"), "symbol_id", "dimensions", "embedding")
    server.shutdown()
    assert got == [(1, 2, [3.0, 1.0]), (2, 2, [0.0, 1.0])]
