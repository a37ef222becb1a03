import pytest

from loomindex.llm.docpairs import distinct_pairs, function_doc_pairs, function_node
from loomindex.llm.prose import good_lines, is_code, new_words, words

GOOD = [
    "Returns the newest row of every open table.",
    "/**\n * Keeps old entries while a caller waits.\n * @param x the entry to keep\n */",
    "# Liest die Datei zeilenweise und prüft jede Angabe.",
    "Lists todo items that a partial frame left behind.",
    "Gives the placeholder shown while a page loads.",
    "how many branches fit before the tree turns over",
    "noqa\nDrops whatever nobody asked for again.",
    "Generated names are checked here so nothing slips through.",
]
BAD = [
    None, "", "TODO", "TODO: write the documentation before the release", "Placeholder summary, to be replaced by the owner of this module.", "Put your summary here.", "No documentation given.",
    "(summary to follow in a later change, see the board)", "// eslint-disable-next-line no-shadow, max-lines, complexity", "# type: ignore[attr, name, other, more]", "lint-disable-next-line no-unused-names, no-shadow",
    "Copyright 2020 the workspace maintainers.\nUsed under the terms of the house licence.", "SPDX-License-Identifier: some licence text here", "Recovered from oversized python source file nearby.", "Fallback text record.",
    "for x in items:\n    total += cost(x)\nreturn total", "await send(user, { kind: 3, other: none });", "<p>run</p>", "@private", "==========", "@ts-check-off some words that follow here",
]


@pytest.mark.parametrize("text", GOOD)
def test_prose(text):
    assert len(new_words(good_lines(text), set())) >= 4


@pytest.mark.parametrize("text", BAD)
def test_no_prose(text):
    assert len(new_words(good_lines(text), set())) < 4


def test_words_split_names():
    assert words("readFile_now HTML") == {"read", "file", "now", "html"} and words(None) == set()


def test_code_lines():
    assert is_code("x = compute(y)") and is_code("foo.bar(baz);") and is_code("if (a) {")
    assert not is_code("Calls foo() before the next page is shown to users") and not is_code("Else this would be lost.")


def test_nodes():
    py = '# above\n@wrap(1)\ndef f(a,\n      b="x)") -> int:\n    """Inside text."""\n    return 1\n'
    node = function_node(py, "python")
    assert node.before.strip() == "# above" and node.inside == "Inside text." and py[node.start :].startswith("@wrap")
    broken = "def f(a):\n    '''Doc here'''\n    return (\n"
    assert function_node(broken, "python").inside == "Doc here"
    js = "/** before */\nasync f(a = { b: 1 }, c) {\n  // inside\n  return '}';\n}"
    node = function_node(js, "javascript")
    assert node.before.strip() == "/** before */" and node.inside.strip() == "// inside" and js[node.start : node.end].endswith("}")
    assert function_node("# one\ndef go(a)\n  # two\n  nil\nend", "ruby").inside.strip() == "# two"
    assert function_node("go() {\n  # says\n  echo\n}", "shell").inside.strip() == "# says"
    assert function_node("", "text").before == ""


RANGES = [
    ("python", "# hi\n@dec(1)\ndef a(x):\n    return 1\n\nx = 2\ny = 3\n", None, "@dec(1)\ndef a(x):\n    return 1"),
    ("python", "    def é(self):\n        return 'é'\n    z = 1\n", "é", "def é(self):\n        return 'é'"),
    ("python", "def a():\n    pass\ndef b():\n    return 1\nx = 2", "b", "def b():\n    return 1"),
    ("python", "def a(x:\n    return 1\nx=2", None, "def a(x:\n    return 1"),
    ("javascript", "// c\nfunction a(b) {\n  // it's }\n  if (b) { return '}'; }\n}\nconst z = 1;\n", None, "function a(b) {\n  // it's }\n  if (b) { return '}'; }\n}"),
    ("javascript", "  go(a, {b: 1} = {}) {\n    return a;\n  }\n  other() { }\n", None, "  go(a, {b: 1} = {}) {\n    return a;\n  }"),
    ("typescript", "const a = (x) => x + 1;\nfoo();", None, "const a = (x) => x + 1;"),
    ("ruby", "def self.a(x)\n  if x then y end\n  z = if x\n 1\n end\n  all.each do |i|\n   p i unless i\n  end\nend\nFOO = 1\n", None, "def self.a(x)\n  if x then y end\n  z = if x\n 1\n end\n  all.each do |i|\n   p i unless i\n  end\nend"),
    ("ruby", "def a(x) = x + 1\nB = 2", None, "def a(x) = x + 1"),
    ("shell", 'f() {\n  echo "${x}" # }\n  if true; then echo 1; fi\n}\necho done\n', None, 'f() {\n  echo "${x}" # }\n  if true; then echo 1; fi\n}'),
    ("javascript", "function a() {\n  b", None, "function a() {\n  b"),
    (None, "x", None, "x"),
]


@pytest.mark.parametrize("language,body,name,code", RANGES)
def test_code_ends_with_the_function(language, body, name, code):
    node = function_node(body, language, name)
    assert body[node.start : node.end] == code


def test_pairs(spark):
    schema = "id bigint, kind string, language string, name string, signature string, body string, doc string, code string"
    long = "def f():\n    '''Walks every single branch twice.'''\n" + "    x = 1\n" * 50_000
    rows = [
        (1, "function", "python", "f", None, "def f(): pass", "Walks every single branch twice.", "clash"),
        (1, "function", "python", "f", None, "def f(): pass", "Walks every single branch twice.", "clash"),
        (2, "function", "python", "walks_every", "walks_every(single, branch)", "def f(): pass", "Walks every single branch twice.", None),
        (3, "method", None, None, None, "// Walks every single branch twice.\nf() {}", None, None),
        (4, "function", "python", "f", "f()", long, "TODO", None),
        (5, "class", "python", "C", None, "class C: pass", "Walks every single branch twice.", None),
        (6, "function", "python", "f", None, "  ", "Walks every single branch twice.", None),
        (7, "function", "python", "f", None, None, "Walks every single branch twice.", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.symbol_id: r for r in distinct_pairs(function_doc_pairs(df)).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1].doc_source, got[3].doc_source, got[4].doc_source) == ("doc", "before", "inside")
    assert got[3].code == "f() {}" and len(got[4].code) == len(long.rstrip())
    assert function_doc_pairs(df.limit(0)).count() == 0
