"""Language of documents and of their segments, by hierarchical discrimination.

A first linear support-vector machine tells the language family; within the family, one-versus-one
machines tell the related languages apart. Features are hashed character n-grams inside words, with
word ends, so that the score of a text is the sum over its words and each distinct word is only
scored once per task. The machines are trained on sentences of certain language, each also without
its accents and in halves. Code, paths, identifiers and links are not read.

Scale: one narrow pass over the documents; what is broadcast is the machines (a fixed size).
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomindex.llm.linear import ngrams, sparse_rows, train

BITS = 16
ORDERS = (1, 2, 3, 4, 5)
#: Fixed values. Language families by two-letter code.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt")}
#: Fixed values. Other spellings of the codes.
SPELLINGS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "ita": "it", "italian": "it", "italiano": "it", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl",
}

_LINE_END = re.compile(r"\r\n?|[  \x85\x0b\x0c]")
_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_FRONT = re.compile(r"\A\s*---\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)
_FRONT_TITLE = re.compile(r"^(?:title|summary|description)\s*:(.*)$", re.I | re.M)
#: What is no prose inside a line, each with a sign that is quick to look for.
_INLINE = [(sign, re.compile(p)) for sign, p in (("`", r"`[^`\n]*`"), ("<", r"<[^<>\n]{1,200}>"), (":", r"\b(?:https?|ftp|file|mailto):\S+"), ("www.", r"\bwww\.\S+"), ("[", r"\[[ xX]\]"))]
#: Quoted output or code in brackets.
_ASIDE = re.compile(r"\([^()\n]*[`\"][^()\n]*\)")
_INDENTED = re.compile(r"^(?: {4,}|\t)[^\n]*[;{}()=\[\]$<>|][^\n]*$", re.M)
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
#: A word between blanks, with signs around it; taken from a whole paragraph at once.
_PROSE = re.compile(r"(?<!\S)(?:[^\w\s]|_)*([^\W\d_]+(?:['’\-‐][^\W\d_]+)*)[.,:;!?)»”\"'’…*\]]*(?!\S)")
_ELISION = re.compile(r"['’]")
_DAMAGED = re.compile("[ÃÂ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def _repair(m: re.Match) -> str:
    """Two characters that come from one accented letter read in the wrong encoding."""
    for encoding in ("cp1252", "latin-1"):
        try:
            return m.group().encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return m.group()


def plain_letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class _Words(dict):
    """Prose words as they are used: lower-case, empty for identifiers (names with an inner upper-case letter). Emptied when large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        plain = word.islower() or word[1:].islower() or word.isupper() or len(word) == 1 or "'" in word or "’" in word or "-" in word
        self[word] = found = word.lower() if plain else ""
        return found


_WORDS = _Words()


def paragraph_words(text: str) -> list[list[str]]:
    """The lower-case words of each paragraph's prose; paragraphs without words are left out."""
    text = _LINE_END.sub("\n", html.unescape(text) if "&" in text else text)
    if _DAMAGED.search(text):
        text = _DAMAGED.sub(_repair, text)
    front = _FRONT.match(text)
    if front:
        text = "\n".join(_FRONT_TITLE.findall(front.group(1))) + "\n\n" + text[front.end() :]
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "`" in text or '"' in text:
        text = _ASIDE.sub(" ", text)
    for sign, pattern in _INLINE:
        if sign in text:
            text = pattern.sub(" ", text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub("", text)
    out = []
    for paragraph in _BLANK.split(text):
        words = [found for w in _PROSE.findall(paragraph) if (found := _WORDS[w])]
        if words:
            out.append(words)
    return out


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label means; None where it names none of the known languages."""
    if not label or not label.strip():
        return None
    first = re.split(r"[-_. ]", label.strip().lower())[0]
    code = SPELLINGS.get(first, first)
    return code if any(code in f for f in FAMILIES.values()) else None


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    spaced = [f" {_ELISION.sub(' ', w)} " for w in words]
    codes = np.array([ord(c) for w in spaced for c in w], np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in spaced])]).astype(np.int64)
    return ngrams(codes, starts, ORDERS, BITS)


def main_language(judged: list[tuple[str, float]], paragraphs: list[list[str]]) -> str | None:
    """The language of most of the words; unsure paragraphs count for less."""
    weight: dict[str, float] = {}
    for (code, sure), words in zip(judged, paragraphs):
        weight[code] = weight.get(code, 0.0) + len(words) * sure
    return max(weight, key=lambda c: (weight[c], c)) if weight else None


class Discriminator:
    """The family machine and the one-versus-one machines of each family."""

    def __init__(self, samples: list[tuple[str, str]], more: list[tuple[str, list[str]]] = (), epochs: int = 10):
        """``samples``: (language code, text). ``more``: (language code, words). Languages outside FAMILIES are not used."""
        known = [(code, [w for p in paragraph_words(text) for w in p]) for code, text in samples]
        # Sentences are also shown in halves, so that short texts are learned too.
        self._fit([(code, part) for code, w in known for part in (w, w[: len(w) // 2], w[len(w) // 2 :])] + list(more), epochs)

    def agreed(self, label: str | None, text: str) -> list[tuple[str, list[str]]]:
        """(code, words) of a document's paragraphs that may be learned from.

        None if the label is not what these machines find; paragraphs that are surely in another language are left out.
        """
        code, paragraphs = label_code(label), [p for p in paragraph_words(text) if len(p) >= 5]
        judged = self.judge(paragraphs)
        if code is None or main_language(judged, paragraphs) != code:
            return []
        return [(code, p) for p, (guess, sure) in zip(paragraphs, judged) if guess == code or sure < 0.8]

    def _fit(self, known: list[tuple[str, list[str]]], epochs: int) -> None:
        """Each text is also shown without its accents."""
        texts, codes = [], []
        for code, part in known:
            if part:
                texts += [part, [plain_letters(w) for w in part]]
                codes += [code, code]
        data = []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            features, rows = _word_features([w for t in part for w in t])
            owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
            data += sparse_rows(features, owner[rows] if len(rows) else rows, len(part))
        codes = np.array(codes)
        first, second = FAMILIES.values()
        self.machines: list[tuple[tuple[str, ...], tuple[str, ...]]] = [(first, second)]
        for family in FAMILIES.values():
            self.machines += [((a,), (b,)) for a, b in combinations(family, 2)]
        self.weights, self.bias = np.zeros((len(self.machines), 1 << BITS)), np.zeros(len(self.machines))
        for i, (positive, negative) in enumerate(self.machines):
            use = np.flatnonzero(np.isin(codes, positive + negative))
            labels = np.where(np.isin(codes[use], positive), 1, -1)
            if len(set(labels)) == 2:
                w = train([data[j] for j in use], labels, 1 << BITS, epochs)
                self.weights[i], self.bias[i] = w[:-1], w[-1]
        self._known: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.machines) + 1))

    def _learn(self, words: set[str]) -> None:
        """Scores of words not seen yet in this task; the cache is emptied when it is large."""
        new = sorted(w for w in words if w not in self._known)
        if not new:
            return
        if len(self._known) > 400_000:
            self._known, self._scores, new = {}, self._scores[:0], sorted(words)
        features, rows = _word_features(new)
        parts = [np.bincount(rows, weights=w[features], minlength=len(new)) for w in self.weights]
        parts.append(np.bincount(rows, minlength=len(new)).astype(float))
        self._known |= {w: len(self._known) + i for i, w in enumerate(new)}
        self._scores = np.concatenate([self._scores, np.stack(parts, axis=1)])

    def judge(self, paragraphs: list[list[str]]) -> list[tuple[str, float]]:
        """(language, confidence) of each paragraph."""
        if not paragraphs:
            return []
        self._learn(set(chain.from_iterable(paragraphs)))
        at = np.fromiter(map(self._known.__getitem__, chain.from_iterable(paragraphs)), np.int64)
        first = np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])[:-1]])
        total = np.add.reduceat(self._scores[at], first, axis=0)
        margin = np.clip(total[:, :-1] / np.sqrt(total[:, -1:]) + self.bias, -50, 50)
        best, sure = np.zeros(len(paragraphs), object), np.zeros(len(paragraphs))
        for family, mine in zip(self.machines[0], (margin[:, 0] >= 0, margin[:, 0] < 0)):
            rows = np.flatnonzero(mine)
            # Of each language: machines won, sum of margins, least margin against another.
            won, points, least = (np.full((len(rows), len(family)), v) for v in (0.0, 0.0, 50.0))
            for i, (a, b) in enumerate(self.machines[1:], 1):
                if a[0] not in family:
                    continue
                value = margin[rows, i]
                for code, sign in ((a[0], 1), (b[0], -1)):
                    k = family.index(code)
                    won[:, k] += (value >= 0) == (sign > 0)
                    points[:, k] += sign * value
                    least[:, k] = np.minimum(least[:, k], sign * value)
            # Ties go to the later code.
            order = np.lexsort((np.broadcast_to(np.arange(len(family)), won.shape), points, won), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            best[rows] = np.array(family, object)[order]
            closest = least[np.arange(len(rows)), order]
            sure[rows] = 1 / (1 + np.exp(-2 * np.abs(margin[rows, 0]))) / (1 + np.exp(-2 * closest))
        return list(zip(best.tolist(), sure.tolist()))


_RESULT = "doc_id bigint, label string, lang_code string, confidence double, languages array<string>, segments array<struct<segment:int,lang_code:string,confidence:double,words:int>>"


def _label(model, least_words: int):
    kinds = pa.list_(pa.struct([("segment", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in batches:
            ids, labels, texts = (batch[c].to_pylist() for c in ("doc_id", "lang", "text"))
            out: list[list] = [[] for _ in range(6)]
            for start in range(0, len(ids), 500):
                docs = [paragraph_words(t) for t in texts[start : start + 500]]
                judged = iter(judge.judge([p for d in docs for p in d]))
                for k, doc in enumerate(docs):
                    segments = [{"segment": i, "lang_code": code, "confidence": sure, "words": len(p)} for i, (p, (code, sure)) in enumerate(zip(doc, judged))]
                    main = main_language([(s["lang_code"], s["confidence"]) for s in segments], doc)
                    mine = [s for s in segments if s["lang_code"] == main]
                    words = sum(s["words"] for s in mine)
                    sure = sum(s["words"] * s["confidence"] for s in mine) / words if words else None
                    more = sorted({s["lang_code"] for s in segments if s["words"] >= least_words and s["lang_code"] != main})
                    for column, value in zip(out, (ids[start + k], labels[start + k], main, sure, [main, *more] if main else [], segments)):
                        column.append(value)
            kinds_of = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_of)], ["doc_id", "label", "lang_code", "confidence", "languages", "segments"])

    return run


def _agreed(first):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, code, words) for i, label, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "lang", "text"))) for code, words in first.value.agreed(label, text)]
            ids, codes, words = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.string()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "code", "words"])

    return run


def document_languages(documents: DataFrame, samples: DataFrame, least_words: int = 10, max_samples: int = 5000, max_labelled: int = 2000, per_language: int = 500) -> DataFrame:
    """One row per document with a text: label, lang_code, confidence, languages, segments.

    ``languages`` has the main language, then others that a whole paragraph of ``least_words`` or more
    words is in. A text without prose has a null lang_code and no languages. Null texts and ids give no
    row. Other columns are ignored. Every document is judged; training is bounded: machines trained on at
    most ``max_samples`` sentences (by hash) go over about ``max_labelled`` labelled documents (by hash), and
    where they agree with the label, ``per_language`` paragraphs of each language (by hash) join the training.
    """
    spark = documents.sparkSession
    rows = samples.select("lang", "sample_text").filter("lang is not null and sample_text is not null").distinct()
    taken = [(r.lang, r.sample_text) for r in rows.orderBy(F.xxhash64("sample_text"), "sample_text", "lang").limit(max_samples).collect()]
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "lang", "text")
    labelled = texts.filter(meant_language(F.col("lang")).isNotNull())
    share = min(1.0, max_labelled / max(labelled.count(), 1))
    shown = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    agreed = shown.mapInArrow(_agreed(spark.sparkContext.broadcast(Discriminator(taken))), "doc_id bigint, code string, words array<string>")
    turn = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id", "words"), "doc_id", "words"))
    more = agreed.withColumn("turn", turn).filter(F.col("turn") <= per_language).select("code", "words").orderBy("code", "turn").collect()
    model = spark.sparkContext.broadcast(Discriminator(taken, [(r.code, r.words) for r in more], epochs=5 if more else 10))
    return texts.mapInArrow(_label(model, least_words), _RESULT)


def meant_language(label: Column) -> Column:
    """Column version of ``label_code``."""
    first = F.split(F.lower(F.trim(label)), r"[-_. ]")[0]
    known = F.create_map(*[F.lit(x) for pair in (SPELLINGS | {c: c for f in FAMILIES.values() for c in f}).items() for x in pair])
    return F.try_element_at(known, first)
