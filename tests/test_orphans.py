import datetime as dt

from pyspark.sql import functions as F

from loomindex.functions import bitmaps
from loomindex.functions.paths import canonical_path
from loomindex.operators import orphans
from loomindex.operators.orphans import orphan_references, orphan_report
from tests.helpers import AT, changes, files, relations, rows, symbols


def _tables(spark):
    r = relations(
        spark,
        [
            {"source_symbol_id": 1, "target_path": "src/b.py"},
            {"source_symbol_id": 99, "target_path": " ./src//x/../b.py "},
            {"source_symbol_id": -1, "source_path": "src\\a.py", "target_path": "gone.py"},
            {"target_path": "  "},
            {"target_path": "SRC/b.py", "indexed_at": None},
            {"source_path": None, "target_path": "lost.py"},
            {"id": 6, "source_path": None, "target_path": "lost.py"},
        ],
    )
    f = files(spark, [("src/a.py", "python", 1, 1.0), ("src/b.py", "python", None, 0.0), ("gone.py", "python", 1, 1.0), (None, None, None, None)])
    c = changes(spark, [(1, "gone.py", "deleted", dt.datetime(2025, 1, 2)), (2, "gone.py", "new", dt.datetime(2025, 1, 1)), (3, None, "new", None)])
    return r, symbols(spark, [{"id": 1}]), f, c


def test_orphans_of_every_field(spark):
    got = rows(orphan_references(*_tables(spark)))
    assert got == [
        (2, "source_symbol_id", "2025-03"), (3, "source_symbol_id", "2025-03"), (3, "target_path", "2025-03"), (5, "target_path", "unknown"), (6, "target_path", "2025-03"),
    ]


def test_hashed_ids_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT", 7)
    r = spark.range(200).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.xxhash64("id")).alias("source_symbol_id"), F.lit("a").alias("source_path"), F.lit(None).cast("string").alias("target_path"), F.lit(AT).alias("indexed_at")
    )
    known = spark.range(200).filter("id % 2 = 0").select(F.xxhash64("id").alias("id"))
    f = files(spark, [("b", None, None, None)])
    got = rows(orphan_references(r, known, f, changes(spark, [])))
    ids = [(i, "source_symbol_id", "2025-03") for i in range(200) if i % 3 == 0 or i % 2]
    assert got == sorted(ids + [(i, "source_path", "2025-03") for i in range(200)])


def test_report_counts_per_table_and_month(spark):
    got = rows(orphan_report(orphan_references(*_tables(spark))), "referenced_table", "period", "orphans")
    assert got == [("files", "2025-03", 2), ("files", "unknown", 1), ("symbols", "2025-03", 2)]


def test_empty_tables_and_extra_columns(spark):
    r, s, f, c = _tables(spark)
    assert rows(orphan_references(r.limit(0), s, f, c)) == []
    r = r.withColumn("code", F.lit("x")).withColumn("key", F.lit(1)).withColumn("period", F.lit(None))
    everything = orphan_references(r, s.limit(0), f.limit(0), c.limit(0)).count()
    assert everything == 3 + 5 + 5  # ids, source paths, target paths of distinct relations


def test_canonical_path(spark):
    cases = {"a/b": "a/b", "./a\\b/": "a/b", " a//b ": "a/b", "a/../b": "b", "a/b/../../c": "c", "../a": "../a", "a/./b": "a/b", "": "", "A/b": "A/b"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", canonical_path(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == cases


def test_packed_bitmaps_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 100, 5000, bitmaps.RANGE):
        bits = np.zeros(bitmaps.RANGE, bool)
        bits[rng.choice(bitmaps.RANGE, n, replace=False)] = True
        packed = bitmaps.pack(np.flatnonzero(bits))
        assert (bitmaps.unpack([packed]) == bits).all()
        half = [bitmaps.pack(x) for x in np.array_split(np.flatnonzero(bits), 2)]
        assert (bitmaps.unpack(half) == bits).all()
        assert len(packed) <= 4097
