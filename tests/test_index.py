from pyspark.sql import functions as F

from loomindex.plans import index
from loomindex.plans.search import best_by_name, query
from loomindex.plans.spec import QuerySpec
from tests.helpers import rows


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_tree_to_answers_and_refresh(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    write(
        root,
        src__app_DOT_py="from src.helpers import greet\n\nclass App:\n    def run(self):\n        return greet('x')\n",
        src__helpers_DOT_py="def greet(name):\n    return name\n",
        docs__notes_DOT_md="# Greeting\nHow to greet.\n",
        bin__start="#!/bin/sh\necho hi\n",
        notes="plain words",
    )
    assert index.refresh(spark, str(root), folder) == {"new": 4}
    t = index.read(spark, folder)
    assert rows(t["files"], "path", "language") == [("bin/start", "shell"), ("docs/notes.md", "markdown"), ("src/app.py", "python"), ("src/helpers.py", "python")]
    found = query(t["symbols"], t["relations"], t["files"], QuerySpec("greet")).orderBy("turn").collect()
    assert (found[0].name, found[0].confidence, found[0].retrieval_trust) == ("greet", "exact", "high")
    edges = rows(t["relations"].filter("relation_kind <> 'contained_in'"), "source_path", "relation_kind", "target_path")
    assert ("src/app.py", "imports", "src/helpers.py") in edges and ("src/app.py", "uses", "src/helpers.py") in edges
    assert best_by_name(t["symbols"], "App").first().kind == "class"

    assert index.refresh(spark, str(root), folder) == {}
    kept = {r.name: r.id for r in t["symbols"].collect()}
    write(root, src__helpers_DOT_py="def greet(name):\n    return name\n\ndef wave(x):\n    return x + 1\n")
    (root / "docs/notes.md").unlink()
    assert index.refresh(spark, str(root), folder) == {"changed": 1, "deleted": 1}
    t = index.read(spark, folder)
    names = {r.name: r.id for r in t["symbols"].collect()}
    assert "wave" in names and "Greeting" not in names and names["greet"] == kept["greet"]
    assert t["symbols"].count() == t["symbols"].select("id").distinct().count()


def test_qualified_names_from_tree_to_answer(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    write(
        root,
        lib__core__index_DOT_rb="module Core\n  class Index\n    def run(a)\n      Store.new\n    end\n  end\nend\n",
        lib__core__store_DOT_rb="module Core\n  class Store\n    def run\n    end\n  end\nend\n",
        web__panel_DOT_ts="export class Panel {\n  open(id: number): void {\n  }\n}\n",
    )
    index.refresh(spark, str(root), folder)
    t = index.read(spark, folder)
    found = query(t["symbols"], t["relations"], t["files"], QuerySpec("Core::Index")).orderBy("turn").first()
    assert (found.kind, found.signature, found.confidence) == ("class", "class Core::Index", "exact")
    assert best_by_name(t["symbols"], "Core::Store#run").first().path == "lib/core/store.rb"
    assert best_by_name(t["symbols"], "Panel.open(id: number): void").first().name == "open"
    uses = rows(t["relations"].filter("relation_kind = 'uses' and target_path <> source_path"), "source_path", "target_path", "target_label")
    assert uses == [("lib/core/index.rb", "lib/core/store.rb", "Core::Store")]


def test_status_and_watch_command(spark, tmp_path, capsys):
    import json

    from loomindex import cli

    root, folder = tmp_path / "tree", str(tmp_path / "index")
    write(root, src__main_DOT_py="def main():\n    return 1\n", src__b_DOT_py="def b():\n    return 2\n")
    assert cli.main(["--index", folder, "watch", str(root), "--once"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"new": 2}
    write(root, src__b_DOT_py="def b():\n    return 33\n")
    cli.main(["--index", folder, "--versions", "status", "--root", str(root)])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    told = {(x["section"], x["name"]): x.get("value") for x in lines}
    assert told[("totals", "files")] == "2" and told[("freshness", "changed")] == "1" and told[("freshness", "stale")] == "true"
    assert told[("extraction", "parsed")] == "2" and ("roots", "src/main.py") in told and told[("possible_orphans", "src/b.py")] == "b"


def test_vectors_are_made_for_what_has_none(spark, tmp_path, capsys):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from loomindex import cli

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": [[1.0, 0.0] if "alpha" in t else [0.0, 1.0] for t in asked["input"]]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    write(root, src__a_DOT_py="def alpha():\n    return 1\n", src__b_DOT_py="def beta():\n    return 2\n")
    index.refresh(spark, str(root), folder)
    assert index.refresh_vectors(spark, folder, url, "m") == {"made": 2, "dropped": 0}
    assert index.refresh_vectors(spark, folder, url, "m") == {"made": 0, "dropped": 0}
    write(root, src__b_DOT_py="def beta():\n    return 3\n")
    index.refresh(spark, str(root), folder)
    assert index.refresh_vectors(spark, folder, url, "m") == {"made": 1, "dropped": 1}
    vectors = index.read(spark, folder)["embeddings"]
    assert rows(vectors.join(index.read(spark, folder)["symbols"].select("id", "name"), vectors.symbol_id == F.col("id")), "name", "embedding") == [("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0])]
    cli.main(["--index", folder, "--versions", "query", "zzz alpha", "--service", url, "--model", "m", "--compact"])
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert found[0]["name"] == "alpha" and "doc" not in found[0]
    cli.main(["--index", folder, "--versions", "query", "alpha", "--groups"])
    groups = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    server.shutdown()
    assert groups[0]["path"] == "src/a.py" and groups[0]["names"] == ["alpha"]
