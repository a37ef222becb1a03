import random

import numpy as np
import pandas as pd

from loomindex.llm import linear
from loomindex.llm.provenance import Training, best_threshold, evidence, file_provenance, masked, training_sample, views


def test_evidence():
    code = "for (const a of run(b)) {\n  call(a, 'x');\n}\n" * 4
    yes = {
        "generated": [("a.py", "# @generated\nx"), ("a.js", "// Code generated by maker. DO NOT EDIT.\n" + code), ("a.js", "/* Automatisch erzeugt. Nicht von Hand ändern. */"), ("x/__generated__/a.ts", None), ("a_pb.ts", code)],
        "vendored": [("x/third-party/lib/a.js", None), ("a.js", "// Part of somelib 1.2.3. Bundled here so that builds work.\n"), ("lib/thing-4.1.0/a.js", code)],
        "minified": [("a.min.js", None), ("a.js", "function a(b){return c.d(e)}" * 20)],
        "data": [("a.py", "X = [\n" + "  [1.5, 2.5],\n" * 20)],
    }
    for kind, cases in yes.items():
        for path, head in cases:
            assert evidence(path, head)[kind], (kind, path, head)
    for path, head in (
        ("src/vendors/a_vendor.py", code), ("a.py", "# Written by hand; was generated by maker until last year.\n"), ("a.js", "// Loosely inspired by somelib, written from scratch.\n" + code), ("generated_check.ts", code),
        ("a.js", "// Copyright 2020 the workspace maintainers.\n// Used under the terms of the house licence.\n" + code), ("a.js", "// The ids below are generated by the caller.\n"), ("a.py", None),
    ):
        assert not any(evidence(path, head).values()), (path, head)


def test_masking_hides_the_giveaway():
    path, head = masked("p/third_party/x/a.g.ts", "// Code generated by maker. DO NOT EDIT.\nlet x = 1;\n")
    assert not any(evidence(path, head).values()) and "let x" in head


def test_machine_learns_and_holds_out():
    rng = random.Random(1)
    texts = [("abc " if i % 2 else "xyz ") * 3 + rng.choice("qrst") for i in range(120)]
    raw = [t.encode() for t in texts]
    f, r = linear.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), (2, 3), 12)
    y = np.array([1 if i % 2 else -1 for i in range(120)])
    rows = linear.sparse_rows(f, r, 120)
    w = linear.train(rows[:80], y[:80], 1 << 12)
    score = linear.row_scores(f, r, 120, w[None, :-1])[:, 0] + w[-1]
    assert (np.sign(score[80:]) == y[80:]).all()


def test_held_out_repositories_and_edge_cases(spark):
    rng = random.Random(2)
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    rows, heads = [], []
    for i in range(400):
        repo, name = f"packages/r{i % 40}", f"{rng.choice(names)}_{i}"
        code = "".join(f"{rng.choice(names)} = {rng.choice(names)}({rng.randrange(99)})\n" for _ in range(12))
        made = i % 3 == 0
        rows.append((f"{repo}/src/{name}.py", "python", len(code), float(i)))
        heads.append((f"{repo}/src/{name}.py", ("# @generated by tool, do not edit\n" if made else "") + code))
    # Machines alone decide, so a kind needs some examples.
    copied = [f"packages/r{i}/third_party/{rng.choice(names)}/a{i}.py" for i in range(40)]
    rows += [(rows[0][0], None, None, 0.0), ("packages/x/third_party/a.py", None, None, None), (None, "python", 1, 1.0), *[(p, "python", 9, 1.0) for p in copied]]
    files = spark.createDataFrame(rows, "path string, language string, size bigint, mtime_ms double")
    head = spark.createDataFrame([*heads, (None, "x"), ("packages/x/third_party/a.py", None)], "path string, head string")
    got = {r.path: r.kinds for r in file_provenance(files, head).collect()}
    assert len(got) == 441
    assert all((got[rows[i][0]] is not None) == (i % 3 == 0) for i in range(400))
    assert got["packages/x/third_party/a.py"] == ["vendored"]
    sample = pd.DataFrame({"path": [r[0] for r in rows[:400]], "head": [h[1] for h in heads], "size": [float(r[2]) for r in rows[:400]], "language": "python"})
    figures = Training(sample, True).machine("generated")[1]
    assert figures["precision"] >= 0.9 and figures["recall"] >= 0.9
    assert file_provenance(files.limit(0), head).count() == 0


def test_masked_positives_are_learned():
    rng = random.Random(4)
    words, paths, heads = ["alpha", "gamma", "omega", "delta"], [], []
    for i in range(300):
        made = i % 3 == 0
        lines = [f"{rng.choice(words)} = {rng.choice(words)}({rng.randrange(99)})\n" for _ in range(12)]
        code = "".join([*lines, "\n" if made else "", *lines])
        paths.append(f"packages/r{i % 40}/src/n{i}.py")
        # The second line of the header is no giveaway, but goes with it.
        heads.append(("# @generated by tool, do not edit\n# yystate table\n" if made else "") + code)
    sample = pd.DataFrame({"path": paths, "head": heads, "size": 100.0, "language": "python"})
    assert Training(sample, True).machine("generated")[1]["masked_recall"] >= 0.9


def test_threshold_and_sample(spark):
    assert best_threshold(np.array([3.0, 2.0, 1.0, -1.0]), np.array([True, True, False, False])) == 1.5
    assert best_threshold(np.array([1.0]), np.array([False])) == 0.0 and best_threshold(np.array([1.0]), np.array([True])) == 0.5
    rows = [(f"p/r/{'gen' if i % 4 == 0 else 'src'}/a{i}.py", None, 1.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, head string, size double, language string")
    taken = training_sample(df, 3, 5)["path"].tolist()
    assert len(taken) == 8 and sum("/gen/" in p for p in taken) == 3
    assert len(training_sample(df.limit(0), 3, 5)) == 0


def test_views_of_empty_texts():
    parts = views(["a", ""], [None, ""], [None, 3.0], [None, "x"])
    assert len(parts) == 5 and all(len(f) == len(r) for f, r in parts)
