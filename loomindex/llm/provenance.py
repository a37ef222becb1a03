"""Files that nobody wrote by hand: generated, minified, vendored, or holding data.

One linear support-vector machine per kind, on hashed character n-grams of the header comments, of
the code and of the path, on path components, and on a few shape facts (size, line length, share of
digits). The machines alone decide: a file is of a kind if that machine's score is above its threshold.

Training uses a bounded sample of files: by hash of the path, at most ``marked`` files of each kind and
``unmarked`` others (see ``file_provenance``). Their labels come from seeds: high-precision phrases, path
parts and shapes, which are used for nothing else. Files with giveaways are also shown with the giveaway
header masked, with the giveaway path parts masked, and with both masked. A masked copy keeps its label;
where nothing that a seed knows is left in it, it counts for ``DIM`` of a file, since much of what a tool
makes then looks like any other code. Repositories (the first two path parts) are split: a third of them
is held out, and each machine's threshold is the one with the best F1 there. Figures of the held-out
repositories, masked and as they are, come with the machines (``validation``).

Scale: each machine is trained in a task of its own on the broadcast sample; then one pass over the
joined tables scores every file. The weights that are broadcast have a fixed size.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.llm.linear import ngrams, row_scores, sparse_rows, train

KINDS = ("generated", "minified", "vendored", "data")
BITS = 17
#: One of so many parts of the repositories is held out.
PARTS = 3
#: Weight of a masked copy in which nothing is left that a seed knows.
DIM = 0.02
#: How much each view (header, code, path, path components, shape facts) counts in each machine.
EMPHASIS = {
    "generated": (1.2, 0.2, 0.8, 2.0, 0.5),
    "minified": (0.3, 1.0, 0.5, 1.5, 1.5),
    "vendored": (1.2, 0.2, 0.8, 2.0, 0.5),
    "data": (0.3, 1.0, 0.3, 1.0, 1.5),
}

#: Fixed values. Phrases of headers; the first group of each kind marks it, ``_HAND`` speaks against any.
_GENERATED = re.compile(
    r"""@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically\s+(?:generated|created|produced|built)|\b(?:code|file|source|output|module|this)\s+(?:is\s+|was\s+)?generated\s+(?:by|from|with|using|on)\b
    |^\W*generated\s+(?:by|from|with|using|on)\b|\bdo\s+not\s+(?:edit|modify|change|touch)\b(?!\s+the\s+order)|\bdon'?t\s+(?:edit|modify|touch)\b|\bedits?\s+(?:get|will\s+be|are)\s+(?:overwritten|lost)|\b(?:manual|hand|local)\s+(?:changes|edits)\s+(?:will|get|are)\b
    |\bmachine-?\s?(?:made|generated|written)\b|\bbuild\s+product\b|\bchange\s+the\s+(?:template|source|schema|definition)\s+instead|\bregenerate\b|\brun\s+the\s+(?:tool|generator|compiler)\s+again|\boutput\s+of\b.*\bhands\s+off|\bhands\s+off\b|\bcompiler:\s|\bsource:\s+\S+\.(?:tmpl|template|proto|schema|idl|tpl|g4)\b|\bprotoc\b
    |\b(?:produit|g[ée]n[ée]r[ée])\s+automatiquement|\bne\s+pas\s+(?:modifier|[ée]diter)|\bautomatisch\s+(?:erzeugt|generiert|erstellt|gegenereerd|aangemaakt)|\bnicht\s+(?:von\s+hand\s+|manuell\s+)?(?:[äa]ndern|bearbeiten|editieren)|\bniet\s+(?:met\s+de\s+hand\s+)?(?:bewerken|aanpassen|wijzigen)
    |\b(?:generado|creado|producido)\s+autom|\bno\s+(?:editar|modificar)\b|\b(?:generato|creato|prodotto)\s+automatic|\bnon\s+modificare|\b(?:gerado|criado|produzido)\s+automatic|\bn[ãa]o\s+(?:editar|modificar|edite|altere)""",
    re.I | re.X | re.M,
)
_VENDORED = re.compile(
    r"""\bvendored\b|\bthird[- ]party\s+code\b|\b(?:copied|taken|imported)\s+(?:unchanged|verbatim|as\s+is)\b|\bcopied\s+from\b|\bbundled\s+here\b|\bupstream:\s|\blocal\s+changes:\s|\bsnapshot\s+taken\b|\bnot\s+maintained\s+(?:by|in)\s+this\b|@license\s+\S+\s+v?\d|@preserve\b
    |\bpart\s+of\s+[\w.-]+\s+v?\d+\.\d|\(c\)\s+the\s+[\w-]+\s+authors|\bauthors:\s+the\s+[\w-]+\s+project|\bnotice\s+that\s+came\s+with|\bin\s+step\s+with\s+upstream|^\W*[\w-]+\s+v?\d+\.\d+\.\d+\s*(?:$|-|\|)|\bpermissive\s+licen[cs]e|\bsend\s+(?:fixes|patches)\s+to\s+(?:its|their)\b""",
    re.I | re.X | re.M,
)
_HAND = re.compile(
    r"""\bwritten\s+(?:by\s+hand|from\s+scratch)|\bhand-?written\b|\bwas\s+generated\b.*\buntil\b|\binspired\s+by\b|^\W*(?:adapter|wrapper|bindings?|glue|client|shim)\s+(?:for|around|to)\b|\binstalled\s+at\s+(?:build|run)\s*time|\bgenerated\s+by\s+the\s+caller|^\W*(?:builds?|checks?|makes?|writes?|reads?|lists?|minifies|compares?|parses?|generates?|vendors?|copies|bundles?|loads?)\s+(?:the|a|an|all|each|every)\b
    |\bnames\s+are\s+checked\b""",
    re.I | re.X | re.M,
)
_VENDOR_PATH = re.compile(r"(?:^|/)(?:_?vendor(?:ed)?|third[-_]?party|externals?|node_modules|bower_components|site-packages|deps|Pods|contrib|extern)/|(?:^|/)[A-Za-z][\w]*-v?\d+\.\d+(?:\.\d+)+(?:[/.]|$)")
_GENERATED_PATH = re.compile(r"(?:^|/)(?:__generated__|_?generated|auto-?generated|autogen|gen|\.generated|dist)/|[._-]generated\.\w+$|\.(?:g|gen|generated|pb|designer|auto)\.\w+$|_pb2?(?:_grpc)?\.\w+$|(?:^|/)[\w-]*\.lock\.\w+$|(?:^|/)[\w-]+-lock\.\w+$|(?:^|/)zz_generated")
_MINIFIED_PATH = re.compile(r"[.-]min\.\w+$|\.(?:bundle|chunk|packed|prod)\.(?:[0-9a-f]+\.)?\w+$|[.-][0-9a-f]{8,}\.\w+$")
_COMMENT = re.compile(r"\A(?:\s*(?:(?:\#(?!\w+\s*\{)|//|--|;)[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))[ \t]*(?:\n|\Z))+", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DATA_LINE = re.compile(r"^\s*(?:-\s*)?[\[{(]?[\s\d.,xXa-fA-F+\-\[\]{}()]+[\]})]?,?\s*$|^\s*[\[{(]\s*[\"'\d].*[\]})],?\s*$|^\s*[\"'][^\"']*[\"'],?\s*$")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{80,}")


def split_head(head: str | None) -> tuple[str, str]:
    """(header comments, code) of a head; a null head is empty."""
    if not head:
        return "", ""
    m = _COMMENT.match(head)
    header = m.group() if m else ""
    return header, head[len(header) :]


def shape(code: str) -> dict[str, float]:
    """Facts on the look of a piece of code."""
    lines = code.split("\n")
    n = max(len(code), 1)
    whole = lines[1:-1] if len(lines) > 3 else lines
    return {
        "line": n / max(len(lines), 1),
        "longest": max(map(len, lines)),
        "space": 1 - len("".join(code.split())) / n if code else 0.0,
        "digit": sum(map(code.count, "0123456789")) / n,
        "data": sum(1 for x in whole if _DATA_LINE.match(x)) / max(len(whole), 1),
        "base64": sum(len(x) for x in _BASE64.findall(code)) / n,
    }


def evidence(path: str, head: str | None) -> dict[str, bool]:
    """For each kind, whether the seeds speak for it."""
    header, code = split_head(head)
    hand = bool(_HAND.search(header))
    s = shape(code) if len(code) >= 60 else None
    dense = bool(s) and s["longest"] >= 180 and s["space"] < 0.1
    data = bool(s) and (s["data"] >= 0.7 or s["base64"] >= 0.3)
    return {
        "generated": not hand and bool(_GENERATED.search(header)) or bool(_GENERATED_PATH.search(path)),
        "vendored": not hand and bool(_VENDORED.search(header)) or bool(_VENDOR_PATH.search(path)),
        "minified": bool(_MINIFIED_PATH.search(path)) or dense and not data,
        "data": data,
    }


def masked(path: str, head: str | None, header_too: bool = True, path_too: bool = True) -> tuple[str, str]:
    """The file without its giveaways: marking phrases of the header, marking path parts."""
    header, code = split_head(head)
    if header_too:
        for pattern in (_GENERATED, _VENDORED):
            header = "\n".join(x for x in header.split("\n") if not pattern.search(x))
    if path_too:
        for pattern in (_VENDOR_PATH, _GENERATED_PATH, _MINIFIED_PATH):
            path = pattern.sub("/", path)
    return path, header + code


def _facts(path: str, size: float | None, language: str | None, code: str) -> list[str]:
    s = shape(code) if code else None
    known = size is not None and not math.isnan(size)
    out = [f"language:{language}", f"size:{int(math.log2(max(size, 1)))}" if known else "size:none"]
    if s:
        out += [f"{k}:{int(math.log2(s[k] + 1))}" for k in ("line", "longest")]
        out += [f"{k}:{int(s[k] * 20)}" for k in ("space", "digit", "data", "base64")]
        out.append(f"dense:{s['longest'] >= 180}:{s['space'] < 0.1}")
    else:
        out.append("head:none")
    return out


def _components(path: str) -> list[str]:
    parts = path.split("/")
    name = parts[-1]
    form = [re.sub(r"\d+", "0", re.sub(r"[A-Za-z]+", "a", p)) for p in parts]
    out = [f"dir:{p.lower()}" for p in parts[:-1]] + [f"word:{w.lower()}" for w in _WORDS.findall(name)]
    out += [f"form:{f}" for f in form] + [f"pair:{a.lower()}/{b.lower()}" for a, b in zip(parts[2:-2], parts[3:-1])]
    dots = name.split(".")
    out.append(f"last:{(_WORDS.findall(dots[0]) or [''])[-1].lower()}")
    return out + [f"ext:{'.'.join(dots[-2:]) if len(dots) > 2 else dots[-1]}", f"mark:{'.'.join(dots[1:-1])}", f"parts:{len(dots)}"]


def _tokens_as_codes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Whole tokens as single symbols, hashed from their bytes."""
    flat = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for x in lists for t in x], np.uint64)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def _bytes_as_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [re.sub(r"\d", "0", t).encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def views(paths: list[str], heads: list[str | None], sizes: list, languages: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each file in five views; each view is scaled by itself, so that a short header counts."""
    split = [split_head(h) for h in heads]
    header = ngrams(*_bytes_as_codes([re.sub(r"\s+", " ", h.lower()) for h, _ in split]), (3, 5), BITS, 1)
    code = ngrams(*_bytes_as_codes([c for _, c in split]), (3, 4), BITS, 2)
    path = ngrams(*_bytes_as_codes(["/" + p for p in paths]), (3, 5), BITS, 3)
    parts = ngrams(*_tokens_as_codes([_components(p) for p in paths]), (1,), BITS, 4)
    facts = ngrams(*_tokens_as_codes([_facts(p, s, x, c) for p, s, x, (_, c) in zip(paths, sizes, languages, split)]), (1,), BITS, 5)
    return [header, code, path, parts, facts]


def repository(path: str) -> str:
    return "/".join(path.split("/")[:2])


def _rows(paths: list, heads: list, sizes: list, languages: list, chunk: int = 500) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows over all views, a few files at a time."""
    out = []
    for at in range(0, len(paths), chunk):
        part = slice(at, at + chunk)
        n = len(paths[part])
        each = [sparse_rows(f, r, n) for f, r in views(paths[part], heads[part], sizes[part], languages[part])]
        out += [(np.concatenate([e[i][0] + (v << BITS) for v, e in enumerate(each)]), np.concatenate([e[i][1] for e in each])) for i in range(n)]
    return out


def best_threshold(scores: np.ndarray, positive: np.ndarray) -> float:
    """The score above which F1 is best, in the middle of the gap there; 0 without positives."""
    if not positive.any():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + positive.sum())
    at = int(np.argmax(f1))
    below = scores[order[at + 1]] if at + 1 < len(order) else scores[order[at]] - 1.0
    return float((scores[order[at]] + below) / 2)


class Training:
    """The views of a sample of files, from which the machines of all kinds are trained.

    ``files``: path, head, size, language of the sample; may be empty. With ``held_out``, a third of the
    repositories takes no part in the training and gives the figures.
    """

    def __init__(self, files: pd.DataFrame, held_out: bool):
        paths, heads = files["path"].tolist(), [h if isinstance(h, str) else None for h in files["head"]]
        shown = [(i, p, h) for i, (p, h) in enumerate(zip(paths, heads))]
        view = [0] * len(paths)
        for v, (header_too, path_too) in enumerate([(True, False), (False, True), (True, True)], 1):
            for i, (p, h) in enumerate(zip(paths, heads)):
                less = masked(p, h, header_too, path_too)
                # What was masked to nothing can show nothing.
                if less != (p, h or "") and (less[0].strip("/") or less[1].strip()):
                    shown.append((i, *less))
                    view.append(v)
        owner, self.view, self.held_out = np.array([i for i, _, _ in shown], np.int64), np.array(view, np.int64), held_out
        sizes, languages = files["size"].tolist(), files["language"].tolist()
        self.rows = _rows([p for _, p, _ in shown], [h for _, _, h in shown], [sizes[i] for i in owner], [languages[i] for i in owner])
        marks = [evidence(p, h) for _, p, h in shown]
        self.known = {kind: np.array([m[kind] for m in marks], bool) for kind in KINDS}
        self.labels = {kind: np.where(known[owner], 1, -1) for kind, known in self.known.items()}
        self.out = (np.array([zlib.crc32(repository(p).encode()) % PARTS == 0 for p in paths], bool) & held_out)[owner]

    def machine(self, kind: str, epochs: int = 8) -> tuple[np.ndarray, dict]:
        """(weights with the bias last, figures of the held-out repositories): threshold, precision, recall, masked_recall."""
        labels, view = self.labels[kind], self.view
        emphasis = np.array(EMPHASIS[kind], np.float32)
        importance = np.where((view > 0) & (labels > 0) & ~self.known[kind], DIM, 1.0)
        use = np.flatnonzero(~self.out)
        part = [(self.rows[i][0], self.rows[i][1] * emphasis[self.rows[i][0] >> BITS]) for i in use]
        w = train(part, labels[use], 5 << BITS, epochs, most=2.0, importance=importance[use])
        w[:-1] *= np.repeat(emphasis, 1 << BITS)
        figures = {"threshold": 0.0}
        if self.held_out:
            score = np.array([w[:-1][index] @ value + w[-1] for index, value in self.rows])
            mine, positive = (view == 0) & self.out, labels > 0
            figures["threshold"] = best_threshold(score[mine], positive[mine])
            hit = score > figures["threshold"]
            share = lambda of, among: float(of[among].mean()) if among.any() else None
            figures |= {"precision": share(positive, mine & hit), "recall": share(hit, mine & positive), "masked_recall": share(hit, (view > 0) & self.out & positive)}
        return w.astype(np.float32), figures


class Machines:
    """The trained machines; ``weights`` has a fixed size (kinds x views x 2**BITS)."""

    def __init__(self, spark: SparkSession, files: pd.DataFrame):
        """``files``: the bounded training sample; may be empty. Trainings run as tasks, two kinds in each."""
        sample = spark.sparkContext.broadcast(files)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kinds, held_out in zip(batch["kinds"].to_pylist(), batch["held_out"].to_pylist()):
                    training = Training(sample.value, held_out)
                    for kind in kinds:
                        w, figures = training.machine(kind)
                        packed = None if held_out else zlib.compress(w.tobytes(), 1)
                        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([json.dumps(figures)]), pa.array([packed], pa.binary())], ["kind", "figures", "weights"])

        jobs = spark.createDataFrame([(held_out, kinds) for held_out in (True, False) for kinds in (KINDS[::2], KINDS[1::2])], "held_out boolean, kinds array<string>")
        jobs = jobs.repartitionByRange(len(KINDS), "held_out", "kinds")
        self.weights, self.bias, self.threshold = np.zeros((len(KINDS), 5 << BITS), np.float32), np.zeros(len(KINDS)), np.zeros(len(KINDS))
        self.validation: dict[str, dict] = {}
        for row in jobs.mapInArrow(run, "kind string, figures string, weights binary").collect():  # two rows a kind, of a fixed size
            k = KINDS.index(row.kind)
            if row.weights is None:
                self.validation[row.kind] = json.loads(row.figures)
                self.threshold[k] = self.validation[row.kind]["threshold"]
            else:
                w = np.frombuffer(zlib.decompress(row.weights), np.float32)
                self.weights[k], self.bias[k] = w[:-1], w[-1]

    def margins(self, parts: list, n: int) -> np.ndarray:
        """Scores above the thresholds: files (rows) by kinds (columns)."""
        total = np.tile(self.bias - self.threshold, (n, 1))
        for v, (features, rows) in enumerate(parts):
            total = total + row_scores(features, rows, n, self.weights[:, v << BITS : (v + 1) << BITS])
        return total


def _score(machines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machines.value
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, len(whole), 1000)):
            d = batch.to_pydict()
            n = len(d["path"])
            if not n:
                continue
            found = model.margins(views(d["path"], d["head"], d["size"], d["language"]), n)
            kinds = [[k for k, v in zip(KINDS, row) if v > 0] for row in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["path"], pa.string()), pa.array([k or None for k in kinds], pa.list_(pa.string())), pa.array(found.max(axis=1))],
                ["path", "kinds", "score"],
            )

    return run


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, label): the first kind that the seeds know, for choosing the sample."""
    for batch in batches:
        label = [next((k for k, v in evidence(p, h).items() if v), None) for p, h in zip(batch["path"].to_pylist(), batch["head"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(label, pa.string())], ["path", "label"])


def _newest(files: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per path: newest state (mtime, then size) with its head; a path without head has null."""
    newest = (
        files.filter("path is not null")
        .groupBy("path")
        .agg(F.max(F.struct(F.coalesce("mtime_ms", F.lit(0.0)).alias("m"), "size", "language")).alias("f"))
        .select("path", F.col("f.size").alias("size"), F.col("f.language").alias("language"))
    )
    head = heads.filter("path is not null").groupBy("path").agg(F.max("head").alias("head"))
    return newest.join(head, "path", "left").select("path", "head", F.col("size").cast("double").alias("size"), "language")


def training_sample(rows: DataFrame, marked: int, unmarked: int) -> pd.DataFrame:
    """At most ``marked`` files of each label and ``unmarked`` without one, by hash of the path."""
    labels = rows.select("path", "head").mapInArrow(_labelled, "path string, label string")
    # A top-k per label, which Spark cuts off before its shuffle.
    order = Window.partitionBy("label").orderBy(F.xxhash64("path"), "path")
    most = F.when(F.col("label").isNull(), unmarked).otherwise(marked)
    taken = labels.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= max(marked, unmarked)).filter(F.col("turn") <= most)
    return rows.join(taken.select("path"), "path", "left_semi").toPandas().sort_values("path", ignore_index=True)


def file_provenance(files: DataFrame, heads: DataFrame, marked: int = 1500, unmarked: int = 6000) -> DataFrame:
    """One row per path: path, kinds (null for hand-written), score (largest margin over the machines).

    Null paths are left out; null size, language and head are allowed; an empty table gives no row.
    Rows delivered twice and older states count once. Other columns are ignored. Every file is scored;
    the machines are trained on at most ``marked`` files of each kind and ``unmarked`` others.
    """
    rows = _newest(files, heads)
    spark = files.sparkSession
    machines = spark.sparkContext.broadcast(Machines(spark, training_sample(rows, marked, unmarked)))
    return rows.mapInArrow(_score(machines), "path string, kinds array<string>, score double")
