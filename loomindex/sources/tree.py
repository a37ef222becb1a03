"""A source tree as a table, by a Python data source.

Unlike the built-in file sources it also reads names that begin with ``_`` or ``.``. The driver opens
folders from the root down until there are ``PARTITIONS`` pieces of the tree, so that a tree under one top
folder is split too; tasks walk and read the pieces. Only files whose language is known by name, or that
have no extension, are read; others have a null text. The root must be a folder that all executors see.

    spark.dataSource.register(TreeSource)
    spark.read.format("sourcetree").option("scope", "build\\ndocs").load("/shared/project")
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomindex.functions.classify import CONTAINER_NAMES, EXTENSIONS

#: Fixed values. Folders that are never entered.
SKIPPED = {".git", ".hg", ".svn", ".venv", ".pytest_cache", ".pytest-basetemp", ".pytest-runs", ".pytest-tmp", ".ruff_cache", "__pycache__", "node_modules", ".loomindex", "backlog"}


def scope_rules(text: str) -> list[str]:
    """Rules of a scope file: one path a line; blank lines and ``#`` comments are dropped, slashes unified."""
    rules = [line.strip().replace("\\", "/").removeprefix("./").strip("/") for line in text.splitlines() if not line.strip().startswith("#")]
    return [r for r in rules if r]


def scope_signature(rules: list[str]) -> str:
    import json

    return json.dumps(rules)


def excluded(path: str, rules: list[str]) -> bool:
    return any(path == r or path.startswith(r + "/") for r in rules)


#: Pieces of a tree, at least, where it has as many folders.
PARTITIONS = 256


class _Piece(InputPartition):
    """Files of some folders: of ``folder`` alone, or of all below it too."""

    def __init__(self, folder: str, below: bool):
        self.folder, self.below = folder, below


class _Reader(DataSourceReader):
    def __init__(self, root: str, rules: list[str]):
        self.root, self.rules = root, rules

    def _open(self, folder: str) -> tuple[list[str], list[str]]:
        """(files, folders) inside a folder, by path from the root."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                found = [(f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False), e.name) for e in entries]
        except OSError:
            return [], []  # gone since it was listed
        found = sorted(x for x in found if not excluded(x[0], self.rules))
        return [p for p, is_dir, _ in found if not is_dir], [p for p, is_dir, name in found if is_dir and name not in SKIPPED]

    def partitions(self) -> list[InputPartition]:
        alone, below = [], [""]
        while below and len(alone) + len(below) < PARTITIONS:
            inner = [f for folder in below for f in self._open(folder)[1]]
            alone += below
            below = inner
        return [_Piece(f, False) for f in alone] + [_Piece(f, True) for f in below]

    def read(self, partition: _Piece) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            files, folders = self._open(waiting.pop())
            for path in files:
                yield from self._file(path)
            waiting += reversed(folders) if partition.below else []

    def _file(self, path: str) -> Iterator[tuple]:
        full = os.path.join(self.root, path)
        try:
            stat, text = os.stat(full), None
            if readable(path):
                with open(full, "rb") as data:
                    text = data.read().decode("utf-8", "replace")
        except OSError:
            return  # gone since it was listed
        yield path, stat.st_size, stat.st_mtime_ns / 1e6, text


def readable(path: str) -> bool:
    """Whether a file may have a known language, by its name."""
    name = path.rpartition("/")[2].lower()
    return "." not in name or name.rpartition(".")[2] in EXTENSIONS or any(name.startswith(n + ".") for n in CONTAINER_NAMES)


class TreeSource(DataSource):
    """Columns: path (relative, forward slashes), size, mtime_ms, text. Options: path, scope."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, size bigint, mtime_ms double, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], scope_rules(self.options.get("scope", "")))
