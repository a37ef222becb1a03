"""Near-duplicate texts by rare-first prefix filtering.

Texts are sets of word runs. Exact copies of a set form one class; only one representative per class
is compared. The runs of a representative are put in one global order, rare ones first, and only the
first ``n - ceil(t n) + 1`` of ``n`` are posted: two sets with a Jaccard share of at least ``t`` have one
of these in common. Postings are joined on the run, under the length and positional filters; pairs then pass a positional filter over all their common prefix runs and a suffix filter, and
each remaining pair is verified once on whole sets.

The suffix filter is the usual one, a lower bound of the Hamming distance from how many runs each set
has in the parts of a partition, with parts that are fixed by hash instead of found by search: each set
carries the parities of at least two parts per run, so the bound is as sharp for long texts as for
short ones. It is taken over the whole set, which includes the suffix.

Rarity comes from one count per hashed bucket over *all* texts. There are about as many buckets as runs,
``2**MOST_BITS`` at most. Counts only order the runs: any order gives the same result, a good one gives
short posting lists. A run whose bucket counts one is in one text only and is not posted at all.

Scale: texts are read in three passes and never shuffled; what is shuffled is prefixes, and the sets
of the few texts that are verified. Copies are merged before they are posted (map-side first), so a
class that holds a third of all rows posts once. A run that many texts post is split by
bands of lengths, and of each band one side is dealt to ``count / HOT`` tasks, the other sent to each of them. What reaches the driver has a fixed bound: the
counters, and a bit table of ``MOST_WANTED`` bits at most that lets the third pass skip texts that are in
no candidate (a join keeps the exact ones); with more candidates than fit, that join comes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomindex.llm.shingles import by_bytes, run_hashes
from loomindex.session import materialize

_CHUNKS = 64
#: Buckets of the counters (as a power of two): their least and largest number.
LEAST_BITS, MOST_BITS = 16, 25
#: Bits (as a power of two) of the bit table of wanted ids at most; eight are used per id.
MOST_WANTED = 28
#: Postings of a run that one task joins.
HOT = 50_000


def needed_overlap(a: Column, b: Column, threshold: float) -> Column:
    """Least number of common runs of sets of ``a`` and ``b`` runs with that Jaccard share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - F.lit(1e-9))


def _prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _signatures(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, as two sums of independently mixed runs."""
    a = runs * np.uint64(0xC2B2AE3D27D4EB4F) ^ runs >> np.uint64(31)
    b = (runs ^ np.uint64(0x165667B19E3779F9)) * np.uint64(0x27D4EB2F165667C5)
    b = (b ^ b >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.add.reduceat(a, first).view(np.int64), np.add.reduceat(b, first).view(np.int64)


def _sets(texts: pa.Array, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, first, sizes, rows) of the rows with at least ``least`` runs."""
    runs, rows = run_hashes(texts, width)
    sizes = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    keep = sizes >= max(least, 1)
    runs = runs[keep[rows]]
    rows = np.flatnonzero(keep)
    sizes = sizes[rows]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    return runs, first, sizes, rows


def _sketches(runs: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """For each set, whether the number of its runs in each part of the run space is odd.

    A set of n runs has a power of two of 64-bit words, at least n / 32 and 4. Half as many parts are
    the two halves folded together, so sketches of unlike length can be compared.
    """
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64).clip(0))
    starts = np.concatenate([[0], np.cumsum(words)])
    part = runs * np.uint64(0x9FB21C651E98DF25) >> np.uint64(40)
    part &= np.repeat(words * 64 - 1, sizes).astype(np.uint64)
    bits = np.bincount(np.repeat(starts[:-1] * 64, sizes) + part.astype(np.int64), minlength=starts[-1] * 64) & 1
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(np.packbits(bits.astype(bool), bitorder="little").view(np.int64)))


def _folded(sketch: Column) -> Column:
    half = F.size(sketch) / 2
    return F.zip_with(F.slice(sketch, F.lit(1), half.cast("int")), F.slice(sketch, (half + 1).cast("int"), half.cast("int")), lambda x, y: x.bitwiseXOR(y))


def _apart(a: Column, b: Column) -> Column:
    """A lower bound of the Hamming distance of two sets from their sketches."""
    shorter = F.when(F.size(a) > F.size(b), _folded(a)).otherwise(a)
    other = F.when(F.size(b) > F.size(a), _folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(shorter, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _bands(n: np.ndarray, threshold: float) -> np.ndarray:
    """Bands of lengths: sets that may reach the threshold are in the same one or the next."""
    return np.floor(np.log(n) / -np.log(min(threshold, 0.999)) + 1e-9).astype(np.int32)


def _count(width: int, least: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members (id, identity, signature, n, sketch) and, at the end of the task, its counters in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = ["chunk", "counts", "id", "identity", "sig_a", "sig_b", "n", "sketch"]
        for batch in by_bytes(batches):
            runs, first, sizes, rows = _sets(batch["text"], width, least)
            if not len(rows):
                continue
            np.add.at(counts, (runs >> np.uint64(64 - bits)).astype(np.int64), np.int32(1))
            at = pa.array(rows)
            none = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
            new = [*_signatures(runs, first), sizes.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*none, batch["id"].take(at), batch["identity"].take(at), *map(pa.array, new), _sketches(runs, first, sizes)], names)
        if counts.any():
            parts = [zlib.compress(c.astype("<i4").tobytes(), 1) for c in np.split(counts, _CHUNKS)]
            rest = [*(pa.nulls(_CHUNKS, pa.int64()) for _ in range(5)), pa.nulls(_CHUNKS, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS), pa.int32()), pa.array(parts, pa.binary()), *rest], names)

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, one byte each."""
    return np.minimum(np.log2(counts + 1.0) * 5, 255).astype(np.uint8)


#: Up to this level a bucket counts one run of one text.
_ALONE = int(_levels(np.array([1]))[0])


def _parts(levels: np.ndarray, hot: int) -> np.ndarray:
    """Number of tasks that share a run of this level."""
    return np.ceil((2.0 ** ((levels + 1.0) / 5)) / hot).astype(np.int32)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the summed counters by chunk; holds no more than the fixed table."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"]):
            part = np.frombuffer(zlib.decompress(counts.as_buffer()), "<i4").astype(np.int64)
            held[chunk] = held[chunk] + part if chunk in held else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([_levels(c).tobytes() for c in held.values()], pa.binary())], ["chunk", "counts"]
    )


def _prefixes(width: int, least: int, bits: int, threshold: float, hot: int, counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, sig_a, sig_b, n, band, runs, places, parts) with the prefix in rare-first order, without runs that no other text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            runs, first, sizes, rows = _sets(batch["text"], width, least)
            if not len(rows):
                continue
            a, b = _signatures(runs, first)
            owner = np.repeat(np.arange(len(rows)), sizes)
            rarity = counts.value[(runs >> np.uint64(64 - bits)).astype(np.int64)]
            # Runs are sorted by hash within a row already; stable sorts keep that for equal counts.
            order = np.argsort(rarity, kind="stable")
            order = order[np.argsort(owner[order].astype(np.uint16 if len(rows) < 65536 else np.int64), kind="stable")]
            place = np.arange(len(runs)) - np.repeat(first, sizes)
            level = rarity[order]
            posted = (place < np.repeat(_prefix_length(sizes, threshold), sizes)) & (level > _ALONE)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(posted, first, dtype=np.int64))]).astype(np.int32))
            lists = [runs[order][posted].view(np.int64), place[posted].astype(np.int32), _parts(level[posted], hot)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows)), *map(pa.array, (a, b, sizes.astype(np.int32), _bands(sizes, threshold))), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)],
                ["id", "sig_a", "sig_b", "n", "band", "runs", "places", "parts"],
            )

    return run


def _whole(width: int, least: int, wanted, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, sig_a, sig_b, runs): all runs of the texts whose hashed id is in the bit table, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            if wanted is not None:
                at = batch["slot"].to_numpy() & (1 << bits) - 1
                batch = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            runs, first, sizes, rows = _sets(batch["text"], width, least)
            if not len(rows):
                continue
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), *map(pa.array, _signatures(runs, first)), lists], ["id", "sig_a", "sig_b", "runs"])

    return run


def _slot(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << MOST_WANTED)).cast("int")


def _wanted_bits(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit table (2**bits bits, which is bounded) of the hashed ids, merged in Spark range by range."""
    slot = _slot(F.col("id")).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    ranges = ids.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in ranges.toLocalIterator():  # at most 2**(bits - 15) rows of 4 KB
        table[row.at * 4096 : row.at * 4096 + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return table


class NearDuplicates:
    """The classes of equal run sets, and the pairs of classes whose share reaches the threshold.

    ``texts`` has columns id, identity, text; other columns are ignored. Null, empty and short texts
    (fewer than ``least`` distinct runs) take no part. Repeated rows (same id) count once. Of different
    texts of one id, the one with the least signature counts.
    """

    def __init__(self, texts: DataFrame, width: int = 5, threshold: float = 0.8, least: int = 1, count_bits: int | None = None, hot: int = HOT):
        """``hot``: postings of a run that one task joins. ``count_bits``: buckets of the counters as a power of two; by default about one per run (eight characters of text)."""
        self.threshold = threshold
        spark = texts.sparkSession
        lower = texts.filter("id is not null and text is not null").select("id", "identity", F.lower("text").alias("text"))
        if count_bits is None:
            length = lower.agg(F.sum(F.length("text"))).first()[0] or 1
            count_bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(length / 8 + 1))))
        counted = materialize(
            lower.mapInArrow(
                _count(width, least, count_bits), "chunk int, counts binary, id bigint, identity bigint, sig_a bigint, sig_b bigint, n bigint, sketch array<bigint>"
            ),
            "runs-counted",
        )
        chunks = counted.filter("chunk is not null").select("chunk", "counts")
        # 2**count_bits counters in _CHUNKS rows: at most 2**MOST_BITS bytes for any input.
        held = chunks.repartition(8, "chunk").mapInArrow(_add_chunks, "chunk int, counts binary").collect()
        total = np.zeros(1 << count_bits, np.uint8)
        size = len(total) // _CHUNKS
        for row in held:
            total[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.counts, np.uint8)
        counts = spark.sparkContext.broadcast(total)
        members = counted.filter("chunk is null")
        # Ids with several texts are rare; only where there are any does dropping them cost a join.
        kept = members.groupBy("id").agg(F.min(F.struct("sig_a", "sig_b")).alias("kept"), F.max(F.struct("sig_a", "sig_b")).alias("other"))
        several = kept.filter("kept <> other").select("id", "kept")
        self._several = None if several.limit(1).isEmpty() else materialize(several, "several")
        members = self._of_one_text(members)
        prefixed = lower.select("id", "text").mapInArrow(
            _prefixes(width, least, count_bits, threshold, hot, counts), "id bigint, sig_a bigint, sig_b bigint, n int, band int, runs array<bigint>, places array<int>, parts array<int>"
        )
        prefixed = self._of_one_text(prefixed)
        # A representative: the smallest id of a class. Copies merge before the shuffle.
        lists = ["runs", "places", "parts"]
        reps = prefixed.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "band", *lists)])
        postings = reps.filter(F.size("runs") > 0).select("rep", "n", "band", F.inline(F.arrays_zip(*lists))).toDF("rep", "n", "band", "run", "pos", "parts")
        # Where any run may be hot, postings are read by two joins.
        self._hot = bool(_parts(total.max(), hot) > 1)
        self._postings = materialize(postings, "postings") if self._hot else postings
        least_id = members.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
        self._sketches = least_id.select("rep", "sketch")
        self.members = members.select("id", "identity", "sig_a", "sig_b", "n").distinct().join(least_id.select("sig_a", "sig_b", "rep"), ["sig_a", "sig_b"]).select("id", "identity", "rep", "n")
        self._texts, self._width, self._least = lower.select("id", "text", _slot(F.col("id")).alias("slot")), width, least

    def _of_one_text(self, rows: DataFrame) -> DataFrame:
        if self._several is None:
            return rows
        mine = F.col("kept.sig_a").isNull() | ((F.col("kept.sig_a") == F.col("sig_a")) & (F.col("kept.sig_b") == F.col("sig_b")))
        return rows.join(self._several, "id", "left").filter(mine).drop("kept")

    def candidates(self) -> DataFrame:
        """(rep_a, rep_b, need): pairs that the length, positional and suffix filters leave; a is the shorter set."""
        def side(rows: DataFrame, x: str) -> DataFrame:
            return rows.withColumnsRenamed({c: f"{c}_{x}" for c in ("rep", "n", "pos")})

        cold = self._postings.filter("parts = 1").select("run", "rep", "n", "pos")
        met = side(cold, "a").join(side(cold, "b"), "run")
        if self._hot:
            # Hot runs meet by bands of lengths, the shorter set's being the longer one's or the one below, and one side is dealt to tasks.
            hot = self._postings.filter("parts > 1")
            dealt = hot.select("run", "band", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("salt"), "rep", "n", "pos")
            sent = hot.select("run", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "parts", "rep", "n", "pos")
            sent = sent.select("run", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "rep", "n", "pos")
            met = met.unionByName(side(dealt, "a").join(side(sent, "b"), ["run", "band", "salt"]).drop("band", "salt"))
        need = needed_overlap(F.col("n_a"), F.col("n_b"), self.threshold)
        after = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
        matches = met.filter(
            ((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b")))
            & (F.col("n_a") >= F.ceil(F.col("n_b") * F.lit(self.threshold) - F.lit(1e-9)))
            & (F.least("pos_a", "pos_b") + 1 + after >= need)
        )
        pairs = matches.groupBy("rep_a", "rep_b", "n_a", "n_b").agg(
            F.count("*").alias("common"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b")
        )
        rest = F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
        near = pairs.filter(F.col("common") + rest >= need).select("rep_a", "rep_b", (F.col("n_a") + F.col("n_b")).alias("size"), need.alias("need"))
        mine, other = (self._sketches.select(F.col("rep").alias(f"rep_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        both = near.join(mine, "rep_a").join(other, "rep_b")
        return both.filter(F.col("size") - _apart(F.col("sketch_a"), F.col("sketch_b")) >= 2 * F.col("need")).select("rep_a", "rep_b", "need")

    def pairs(self) -> DataFrame:
        """(rep_a, rep_b, share) of classes, each pair verified once on whole sets."""
        found = materialize(self.candidates(), "candidates")
        ids = found.select(F.col("rep_a").alias("id")).union(found.select(F.col("rep_b").alias("id")))
        ids = ids.distinct()
        bits, wanted, texts = max(16, math.ceil(math.log2(8 * ids.count() + 1))), None, self._texts
        if bits <= MOST_WANTED:
            wanted = found.sparkSession.sparkContext.broadcast(_wanted_bits(ids, bits))
        else:
            texts = texts.join(ids, "id", "left_semi")
        sets = texts.mapInArrow(_whole(self._width, self._least, wanted, bits), "id bigint, sig_a bigint, sig_b bigint, runs array<bigint>").join(ids, "id", "left_semi")
        sets = self._of_one_text(sets)
        sets = materialize(sets.groupBy("id").agg(F.first("runs").alias("runs")), "sets")
        a = sets.select(F.col("id").alias("rep_a"), F.col("runs").alias("runs_a"))
        b = sets.select(F.col("id").alias("rep_b"), F.col("runs").alias("runs_b"))
        common = F.size(F.array_intersect("runs_a", "runs_b"))
        sized = found.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", "need", common.alias("common"), (F.size("runs_a") + F.size("runs_b")).alias("size"))
        share = F.col("common") / (F.col("size") - F.col("common"))
        return sized.filter(F.col("common") >= F.col("need")).select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), share.alias("share"))


def identity_of(*columns: str) -> Column:
    """64 bits that are equal for rows that agree in these columns, nulls being equal."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
