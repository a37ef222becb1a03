import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomindex.llm import tokens
from loomindex.llm.mixing import Mix, capped_mean, mean_for_rate
from loomindex.llm.packing import best_fit_decreasing, pack, pack_report


def plain_best_fit(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            _, b = min(fits)
        else:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        out[i] = b
    return rooms


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 20), max_size=40), st.integers(20, 33))
def test_best_fit_equals_the_plain_search(sizes, capacity):
    bins = best_fit_decreasing(np.array(sizes, np.int64), capacity)
    used = np.bincount(bins, weights=sizes) if sizes else np.zeros(0)
    assert (used <= capacity).all()
    assert sorted(capacity - used) == sorted(plain_best_fit(sizes, capacity))


def test_every_item_is_placed_once(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice((0, 1, 5, 30, 64, 65, 128, 1000)) for i in range(300)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint")
    limits = spark.createDataFrame([(1, 64), (2, 128), (3, None), (None, 5), (4, 0), (1, 64)], "limit_id int, capacity_tokens int")
    rows = pack(df, limits, shard_items=70).collect()
    for limit, capacity in ((1, 64), (2, 128)):
        mine = [r for r in rows if r.limit_id == limit]
        total, room = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            room[r.container_id] = room.get(r.container_id, 0) + r.tokens
        assert total == sizes and max(room.values()) <= capacity
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r)
        assert all(len(pieces[i]) == max(1, -(-sizes[i] // capacity)) for i in sizes)  # cut only where it must be
    assert {r.limit_id for r in rows} == {1, 2}
    report = {r.limit_id: r for r in pack_report(pack(df, limits)).collect()}
    assert report[1].containers <= 1.05 * report[1].least_containers + 2
    assert pack(df.limit(0), limits).count() == 0 and pack(df, limits.limit(0)).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world", "a", 1), (1, "Hello world", "a", 1), (2, "", None, 1), (3, None, "a", 1), (None, "x", "a", 1), (4, "word " * 100_000, "a", 1)], "doc_id bigint, text string, source string, tokens int")
    got = {r.doc_id: r.tokens for r in tokens.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == 0 and 100_000 <= got[4] <= 100_001 and set(got) == {1, 2, 4}
    encode = tokens.encoding(tokens.VOCABULARY)
    assert encode.decode(encode.encode_ordinary("Grüße, \n\n x")) == "Grüße, \n\n x"


@pytest.mark.parametrize("rate,most", [(0.1, 1), (0.9, 1), (1.5, 2), (2.9, 3), (3.999, 4)])
def test_capped_poisson_mean(rate, most):
    assert abs(capped_mean(mean_for_rate(rate, most), most) - rate) < 1e-6


def _mix(spark, **options):
    rng = random.Random(6)
    rows = [(i, s, rng.randrange(50, 400)) for i, s in enumerate(["big"] * 3000 + ["small"] * 400 + ["none"] * 50)] + [(9000, None, 10), (9001, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    return Mix(sizes, targets, **options), sizes, targets


def test_shares_are_reached(spark):
    mix, sizes, targets = _mix(spark)
    report = {r.source: r for r in mix.report().collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"].reached_share == 0
    for s in ("big", "small"):
        assert abs(report[s].reached_share - report[s].wanted_share) < 0.02
        assert report[s].most_copies <= report[s].max_repeats
    records = mix.shuffled().collect()
    assert records == mix.shuffled().collect()  # the same on every run
    assert len({(r.doc_id, r.copy) for r in records}) == len(records)
    assert [r.position for r in records] == sorted(r.position for r in records)
    third = [r.source for r in records][: len(records) // 3]
    whole = sum(r.source == "small" for r in records) / len(records)
    assert abs(third.count("small") / len(third) - whole) < 0.05  # mixed, not in blocks


def test_copies_of_a_record_do_not_depend_on_others(spark):
    mix, sizes, _ = _mix(spark, total_tokens=200_000)
    copies = {(r.doc_id, r.copy) for r in mix.records().collect()}
    mix.sizes = sizes.filter("doc_id % 2 = 0")  # the same rates, half of the records
    assert {(r.doc_id, r.copy) for r in mix.records().collect()} == {c for c in copies if c[0] % 2 == 0}


def test_a_given_size(spark):
    mix, sizes, _ = _mix(spark, total_tokens=10_000_000)
    report = {r.source: r for r in mix.report().collect()}
    assert report["small"].shortfall > 1_000_000 and report["absent"].shortfall == 0
    assert report["big"].repeats == 1.0 and report["small"].repeats == 3.0  # as much as is allowed
    empty, sizes, targets = _mix(spark)
    assert Mix(sizes.limit(0), targets).records().count() == 0
    assert Mix(sizes, targets.limit(0)).records().count() == 0
