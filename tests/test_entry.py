import importlib
import os

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_queries_and_sql_are_paired():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns[0] == "turn"


def test_core_does_not_know_the_llm_folder():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "loomindex"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loomindex.llm" not in path.read_text(), path


def test_command_line():
    from loomindex.cli import parser

    args = parser().parse_args(["--index", "x", "query", "merge key", "--top", "3", "--kind", "class", "--code-only"])
    assert (args.text, args.limit, args.kind, args.code_only) == ("merge key", 3, ["class"], True)
    with pytest.raises(SystemExit):
        parser().parse_args(["--index", "x", "query", "q", "--code-only", "--docs-only"])
