"""Connectors to the outside: the state of a git work tree, and an embedding service."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STATUS = "path string, change string"


def parse_git_status(output: str) -> list[tuple[str, str]]:
    """(path, change) of ``git status --porcelain`` lines; a rename counts for its new name."""
    out = []
    for line in output.splitlines():
        if len(line) < 4:
            continue
        code, path = line[:2], line[3:].split(" -> ")[-1].strip().strip('"').replace("\\", "/")
        out.append((path, "new" if code == "??" else "deleted" if "D" in code else "changed"))
    return out


def git_changes(spark: SparkSession, root: str, relevant: DataFrame | None = None) -> DataFrame:
    """(path, change) against the last commit; empty where there is no work tree. Restricted to ``relevant`` paths."""
    try:
        done = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "--untracked-files=all"], capture_output=True, text=True, timeout=60)
        rows = parse_git_status(done.stdout) if done.returncode == 0 else []
    except (OSError, subprocess.TimeoutExpired):
        rows = []
    changes = spark.createDataFrame(rows, STATUS)
    return changes if relevant is None else changes.join(relevant.select("path").distinct(), "path", "left_semi")


def embed_texts(texts: DataFrame, url: str, model: str, dimensions: int | None = None, batch: int = 64) -> DataFrame:
    """(symbol_id, provider, model, dimensions, embedding) of (id, text) rows, asked of a service in batches by the tasks.

    Without a service use the stored vectors. A failing request fails the task, which Spark repeats.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                body = {"model": model, "input": part["text"].fillna("").tolist(), "stream": False} | ({"dimensions": dimensions} if dimensions else {})
                request = urllib.request.Request(f"{url.rstrip('/')}/api/embed", json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=120) as answer:
                    vectors = json.load(answer)["embeddings"]
                if len(vectors) != len(part):
                    raise ValueError("the service gave another number of vectors than texts")
                yield pd.DataFrame({"symbol_id": part["id"].values, "provider": url, "model": model, "dimensions": [len(v) for v in vectors], "embedding": vectors})

    return texts.select("id", "text").mapInPandas(run, "symbol_id long, provider string, model string, dimensions int, embedding array<double>")
