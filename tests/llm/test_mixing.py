"""Mixing against a plain version, and what it promises of targets and copies."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from hopflux.llm import mixing
from hopflux.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Water is shared by weight and what flows over shared again, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in target]
        left = total - sum(target.values())
        over = [s for s in rest if Fraction(left * weight[s], sum(weight[x] for x in rest)) > most * sizes[s]]
        if not over:
            return target | {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        target |= {s: Fraction(most * sizes[s]) for s in over}


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got)) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    per, taken, by = defaultdict(int), defaultdict(int), defaultdict(list)
    for _, t, s in rows:
        per[s] += size(t)
    target = plain_targets(per)
    for r in got:
        s = r["source"]
        assert r["source_size"] == per[s] and r["target"] == pytest.approx(float(target[s]), rel=1e-12)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        by[s].append(r["size"])
    for s, sizes in by.items():
        fit = [x for x in sizes if x <= target[s]]
        if 3 * sum(fit) >= target[s]:
            assert abs(taken[s] - target[s]) <= max(fit)
        if max(sizes) * 64 <= target[s]:
            assert abs(taken[s] - target[s]) <= target[s] / 64
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "z", "é", "\U0001f600", "￿", "B"]
    rows = []
    for i in range(600):
        s = sources[0 if rng.random() < 0.4 else rng.randrange(len(sources))]
        rows.append((i, " ".join("w" * (1 + rng.randrange(3)) for _ in range(rng.choice([0, 3, 10, 40, 40, 90]) if rng.random() < 0.98 else 3000)), s))
    check(spark, rows + rows[:5])


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one two", None), (4, "one two", None), (None, "x", "c"), (None, "x", "c"), (None, None, None), (5, "w " * 50_000, "d")]
    got = check(spark, rows)
    assert {r["source"]: r["target"] for r in got}["a"] == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["taken"] for r in check(spark, [(1, None, None), (2, "", "a")])} == {0}


def test_targets_stop_at_three_times_the_words(spark):
    rows = [(i, "one two three", "big") for i in range(300)] + [(1000 + i, "one two", "small") for i in range(10)] + [(2000, "one", "tiny")]
    got = check(spark, rows)
    assert {r["source"]: (r["target"], r["copies"]) for r in got if r["source"] != "big"} == {"small": (60.0, 3), "tiny": (3.0, 3)}


def test_clashing_columns_and_emitted_rows(spark):
    frame = spark.createDataFrame([(i, "a b c", "s", 9, 9, 9) for i in range(40)] + [(99, "a", "t", 1, 1, 1)], SCHEMA + ", size long, _at long, target long")
    whole = mixing.mix(frame)
    copies = {r["doc_id"]: r["copies"] for r in whole.collect()}
    out = mixing.emit(frame).collect()
    assert len(out) == sum(copies.values()) and {(r["doc_id"], r["copy"]) for r in out} == {(i, c) for i, n in copies.items() for c in range(n)}
    with pytest.raises(ValueError, match="size"):
        mixing.mix(frame, carry=["size"])


def test_query_meets_targets(spark):
    per = defaultdict(int)
    rows = QUERIES["op12_source_mixing"](spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        per[r["target"], r["source_size"]] += r["taken"]
    assert len(per) == 20 and all(abs(t - target) <= 0.01 * target for (target, _), t in per.items())


def test_offsets_differ_by_source_and_seed(spark):
    frame = spark.createDataFrame([(i, "a b", "s") for i in range(30)] + [(100 + i, "a b", "t") for i in range(30)] + [(200 + i, "a b", "u") for i in range(30)], SCHEMA)
    picks = {seed: tuple(r["copies"] for r in mixing.mix(frame, seed=seed).orderBy("doc_id").collect()) for seed in (1, 2, 3)}
    assert len(set(picks.values())) > 1
