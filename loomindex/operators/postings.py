"""Full-text index over symbols and BM25 ranking with phrases.

Eight fields are indexed; ``content`` repeats name, signature, doc and body, so their terms count
twice. ``TextIndex`` keeps the index as tables: one row per token (term, symbol, place), partitioned and
sorted by term, and the length of each symbol. A query reads the rows of its own terms only; a term that
most symbols have lies in several files. Without an index, ``bm25`` counts a query's phrases in one narrow
pass over the texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomindex.functions.text import folded_text, search_tokens
from loomindex.session import materialize

FIELDS = ["path", "name", "kind", "signature", "body", "doc", "language"]
CONTENT = ["name", "signature", "doc", "body"]
#: Fixed values. Usual BM25 parameters, and the floor of a term's weight.
K1, B, LEAST_WEIGHT = 1.2, 0.75, 1e-6


def tokenised(symbols: DataFrame) -> DataFrame:
    """id, kind and a token array per field (t_path ...); null fields are empty."""
    fields = symbols.select("id", "kind", *[search_tokens(F.col(c)).alias(f"t_{c}") for c in FIELDS])
    return fields.withColumn("t_content", F.concat(*[F.col(f"t_{c}") for c in CONTENT]))


def postings(symbols: DataFrame) -> DataFrame:
    """(term, symbol_id, field, position), one row per token."""
    t = tokenised(symbols)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"t_{c}").alias("tokens")) for c in [*FIELDS, "content"]])).alias("f")
    return t.select("id", fields).select(F.posexplode("f.tokens").alias("position", "term"), F.col("id").alias("symbol_id"), "f.field").select("term", "symbol_id", "field", "position")


#: Stands between fields, so that no phrase goes on into the next one.
_EDGE = "\u0001"
_LETTER = r"\p{L}\p{N}"


def indexed_text(symbols: DataFrame) -> DataFrame:
    """id, kind and all indexed fields as one folded text."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in FIELDS]
    content = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in CONTENT])
    return symbols.select("id", "kind", folded_text(F.concat_ws(_EDGE, *fields, content)).alias("text"))


def occurrences(text: Column, phrase: list[str] | tuple[str, ...]) -> Column:
    """How often the phrase's tokens follow one another within a field of a folded text."""
    pattern = f"(?<![{_LETTER}])" + f"[^{_LETTER}{_EDGE}]+".join(phrase) + f"(?![{_LETTER}])"
    # Most rows do not hold the first token at all, which is cheaper to see.
    return F.when(text.contains(phrase[0]), F.regexp_count(text, F.lit(pattern))).otherwise(0)


@dataclass(frozen=True)
class TextIndex:
    """``postings``: (term, id, place), sorted by term; ``lengths``: (id, kind, length in tokens)."""

    postings: DataFrame
    lengths: DataFrame

    @staticmethod
    def build(symbols: DataFrame) -> TextIndex:
        """Writes the index of all symbols. Places of different fields are never next to each other."""
        t = tokenised(symbols)
        edge = F.array(F.lit(_EDGE))
        fields = [f"t_{c}" for c in [*FIELDS, "content"]]
        content = [x for c in CONTENT for x in (F.col(f"t_{c}"), edge)]
        tokens = F.concat(*[x for c in FIELDS for x in (F.col(f"t_{c}"), edge)], *content)
        rows = t.select("id", F.posexplode(tokens).alias("place", "term")).filter(F.col("term") != _EDGE)
        sorted_rows = rows.select("term", "id", "place").repartitionByRange("term", "id").sortWithinPartitions("term", "id", "place")
        lengths = t.select("id", "kind", reduce(lambda x, y: x + y, [F.size(f) for f in fields]).alias("length"))
        return TextIndex(materialize(sorted_rows, "postings"), materialize(lengths, "lengths"))

    @cached_property
    def totals(self) -> tuple[int, float]:
        """Number of symbols and their mean length."""
        row = self.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        return row.n, row.mean or 1.0

    def counts(self, phrases: list[list[str]]) -> DataFrame:
        """(id, f0, f1, ...): how often each phrase occurs in the symbols that have any of them."""
        found = []
        for i, phrase in enumerate(phrases):
            rows = self.postings.filter(F.col("term") == phrase[0]).select("id", "place")
            for k, term in enumerate(phrase[1:], 1):
                rows = rows.join(self.postings.filter(F.col("term") == term).select("id", (F.col("place") - k).alias("place")), ["id", "place"], "left_semi")
            found.append(rows.groupBy("id").agg(F.count("*").alias("n")).withColumn("phrase", F.lit(i)))
        every = reduce(DataFrame.unionByName, found)
        return every.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("phrase") == i, F.col("n"))), F.lit(0)).alias(f"f{i}") for i in range(len(phrases))])


def _scored(rows: DataFrame, have: list[float], n: int, mean_length: float) -> DataFrame:
    """(id, raw_score) of rows with length, f0, f1, ...; ``have``: how many symbols have each phrase."""
    score = F.lit(0.0)
    for i, h in enumerate(have):
        f = F.col(f"f{i}").cast("double")
        weight = math.log((n - h + 0.5) / (h + 0.5))
        weight = LEAST_WEIGHT if weight <= 0 else weight
        score = score - F.lit(weight) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(float(mean_length))))
    return rows.select("id", F.round(score, 9).alias("raw_score"))


def bm25(symbols: DataFrame, phrases: list[list[str]], kinds: list[str] | tuple[str, ...] = (), index: TextIndex | None = None) -> DataFrame:
    """(id, raw_score) of symbols with at least one of the phrases; lower is better.

    The statistics are those of all symbols, whatever the kinds. No phrases or no symbols give no rows.
    ``index``: that of the symbols, read instead of their texts.
    """
    hits = [F.col(f"f{i}") > 0 for i in range(len(phrases))]
    counted_hits = [F.sum(h.cast("long")).alias(f"n{i}") for i, h in enumerate(hits)]
    if index is not None and phrases:
        # A few numbers for each symbol that has a term of the query; used for the statistics and for the scores.
        counts = materialize(index.counts(phrases), "term-counts")
        stats = counts.agg(*counted_hits).first()
        rows = counts.join(index.lengths, "id")
        n, mean_length = index.totals
    else:
        text = F.col("text")
        occurring = [occurrences(text, p).alias(f"f{i}") for i, p in enumerate(phrases)]
        counted = materialize(indexed_text(symbols).select("id", "kind", F.regexp_count(text, F.lit(f"[{_LETTER}]+")).alias("length"), *occurring), "term-counts")
        # One row of statistics; as literals they need no join.
        stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *counted_hits).first()
        rows = counted.filter(reduce(lambda x, y: x | y, hits, F.lit(False)))
        n, mean_length = stats.n, stats.mean_length or 1.0
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    return _scored(rows, [float(stats[f"n{i}"] or 0) for i in range(len(phrases))], n, mean_length)
