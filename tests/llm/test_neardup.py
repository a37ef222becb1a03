import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomindex.llm import neardup, neardup_queries
from loomindex.llm.neardup import NearDuplicates, _apart, _sketches, identity_of
from loomindex.llm.shingles import by_bytes, run_hashes, word_hashes


def runs(text, width):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab_ é.\n1", max_size=40)), max_size=8), st.integers(1, 4))
def test_run_hashes_agree_with_words(texts, width):
    array = pa.array([t.lower() if t is not None else None for t in texts], pa.string())
    _, rows = word_hashes(array)
    words = [len(re.findall("[a-z0-9_]+", t.lower())) if t else 0 for t in texts]
    assert np.bincount(rows, minlength=len(texts)).tolist()[: len(texts)] == words
    hashes, rows = run_hashes(array, width)
    sizes = np.bincount(rows, minlength=len(texts)).tolist()[: len(texts)]
    assert sizes == [len(runs(t, width)) for t in texts]
    seen = {}
    for h, r in zip(hashes.tolist(), rows.tolist()):
        seen.setdefault(r, set()).add(h)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(seen.get(i, set()) & seen.get(j, set())) == len(runs(a, width) & runs(b, width))


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 30, 60)))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        text = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 3, 8))):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, i % 7, " ".join(text)))
    return out + [(n, 0, None), (n + 1, 0, ""), (n + 2, 0, "x " * 200_000), (0, 0, out[0][2])]


def expected(rows, width, threshold, least):
    sets = {i: runs(t, width) for i, _, t in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def found(near):
    members = {r.id: r.rep for r in near.members.collect()}
    pairs = {(r.rep_a, r.rep_b) for r in near.pairs().collect()}
    return {(a, b) for a in members for b in members if a < b and (members[a] == members[b] or (min(members[a], members[b]), max(members[a], members[b])) in pairs)}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, identity bigint, text string").withColumn("rep", F.lit("clash")).repartition(5)
    for width, threshold, least in ((3, 0.6, 20), (5, 0.8, 1), (2, 0.5, 1)):
        # Few counters must not change the result, only the order.
        for bits in (6, 22):
            got = found(NearDuplicates(df, width, threshold, least, count_bits=bits))
            assert got == expected(rows, width, threshold, least)


def test_a_third_of_copies_is_one_class(spark):
    rows = [(i, i, "one two three four five six") for i in range(100)] + [(i, i, f"{i} b c d e f g {i}") for i in range(100, 300)]
    near = NearDuplicates(spark.createDataFrame(rows, "id bigint, identity bigint, text string"))
    assert near.members.filter("rep = 0").count() == 100
    assert near._postings.filter("rep = 0").select("rep").count() <= 2


def test_empty_table(spark):
    near = NearDuplicates(spark.createDataFrame([], "id bigint, identity bigint, text string"))
    assert near.members.count() == 0 and near.pairs().count() == 0


def test_identity_tells_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string").select(identity_of("x", "y").alias("i"))
    ids = [r.i for r in df.collect()]
    assert ids[0] == ids[2] != ids[1]


def test_an_id_with_two_texts_counts_once(spark):
    rows = [(1, 1, "a b c d e f g"), (1, 1, "p q r s t u v"), (2, 2, "a b c d e f g"), (3, 3, "p q r s t u v")]
    near = NearDuplicates(spark.createDataFrame(rows, "id bigint, identity bigint, text string"))
    assert sorted(r.id for r in near.members.collect()) == [1, 2, 3]
    assert len(found(near)) == 1


def test_texts_without_runs_have_classes(spark, monkeypatch):
    long = "one two three four five six"
    texts = [(1, long), (2, long), (3, "Import  os"), (4, "import os"), (5, ".a"), (6, None), (7, None), (8, " "), (9, ".b"), (4, "import os"), (1, "x")]
    rows = spark.createDataFrame([(i, i, t) for i, t in texts], "id bigint, identity bigint, text string")
    monkeypatch.setattr(neardup_queries, "_symbols", lambda spark, folder: rows)
    monkeypatch.setattr(neardup_queries, "_near", NearDuplicates)
    got = sorted(tuple(r) for r in neardup_queries.p1_classes(spark, "").collect())
    assert got == [(1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 2, 0), (4, 3, 2, 0), *[(i, i, 1, 0) for i in (5, 6, 7, 8, 9)]]
    assert {(r.symbol_id, r.group_id) for r in neardup_queries.p1_groups(spark, "").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_sketches_bound_the_distance(spark):
    rng = random.Random(8)
    sets = [rng.sample(range(1 << 40), n) for n in (1, 30, 100, 129, 300, 520, 900)]
    sets += [[*s[: len(s) * 4 // 5], *rng.sample(range(1 << 40), len(s) // 5)] for s in sets]
    values = np.concatenate([np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets])
    sizes = np.array([len(s) for s in sets])
    sketches = _sketches(values, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes).to_pylist()
    assert all(64 * len(k) >= 2 * n and len(k) & (len(k) - 1) == 0 for k, n in zip(sketches, sizes.tolist()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if 0.5 <= len(sketches[i]) / len(sketches[j]) <= 2]
    df = spark.createDataFrame([(i, j, sketches[i], sketches[j]) for i, j in pairs], "i int, j int, a array<bigint>, b array<bigint>")
    for r in df.select("i", "j", _apart(F.col("a"), F.col("b")).alias("apart")).collect():
        real = len(set(sets[r.i]) ^ set(sets[r.j]))
        assert r.apart <= real and (r.i != r.j or r.apart == 0)
        # Sharp for long sets too: unrelated ones are told apart.
        assert real < len(sets[r.i]) + len(sets[r.j]) or sizes[r.i] < 100 or r.apart > 0.6 * min(sizes[r.i], sizes[r.j])


def test_hot_runs_are_split(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, identity bigint, text string")
    near = NearDuplicates(df, 2, 0.5, 1, hot=10)
    assert near._postings.agg(F.max("parts")).first()[0] > 1
    assert found(near) == expected(rows, 2, 0.5, 1)
    monkeypatch.setattr(neardup, "MOST_WANTED", 4)  # too few bits: the semi join comes first
    assert found(NearDuplicates(df, 3, 0.6, 20)) == expected(rows, 3, 0.6, 20)


def test_batches_by_bytes_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 30, "", "c", "d" * 12], "id": list(range(6))})
    parts = list(by_bytes(iter([batch, batch.slice(0, 0)]), limit=10))
    assert [i for p in parts for i in p["id"].to_pylist()] == list(range(6)) and len(parts) >= 3
    a, b = run_hashes(batch["text"].slice(2), 1), run_hashes(pa.array(["b" * 30, "", "c", "d" * 12]), 1)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
