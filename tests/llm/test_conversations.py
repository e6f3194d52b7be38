"""Conversation repair against a search through all edits."""

import random

import pytest

from hopflux.llm import conversations
from hopflux.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == brute.conversation_repairs(rows)


def odd_rows(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "anna", "System"]
    texts = ["Yes.", "No", "", " \t\n", None, "Why?", "é!  \n", "a.b", ".", "line\nline.", "Yes."]
    ids = [None, *range(conversations)]
    return [(rng.choice(ids), rng.choice([None, -(2**63), 2**63 - 1, *range(9)]), rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)) for _ in range(6 * conversations)]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = odd_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute.conversation_repairs(rows)
    got = {r[0]: tuple(r[1:]) for r in conversations.repair_digests(conversations.damage(frame), frame).collect()}
    low, high = 0, (1 << 63) - 1
    assert got == {k: (max(low, min(v[0], high)), *v[1:]) for k, v in want.items()}


def test_signatures_are_solved_as_by_search():
    rng = random.Random(5)
    faults = conversations.FAULTS
    for _ in range(400):
        codes = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(12))]
        rows = [(("system", "user", "assistant", "x")[r], str(i), faults[f]) for i, (r, f) in enumerate(codes)]
        cost, edits, _ = brute._cheapest(rows)
        assert conversations.cheapest_edits("".join(chr(ord("A") + 4 * r + f) for r, f in codes)) == (cost, edits)


def test_long_signature_and_hot_conversation(spark):
    """A conversation with most of all rows, without recursion to its depth; its first fault letters are right."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(20_000)] + [(7, 20_000, "user", "text 0."), (8, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in conversations.repair_digests(frame).collect()}
    assert got[7]["audit"] == "K" * 20_000 + "D" and (got[7]["cost"], got[7]["duplicate"], got[7]["gaps"]) == (3, 1, 0)
    assert (got[8]["audit"], got[8]["cost"]) == ("KI", 2)


def test_repaired_rows(spark):
    """The rows themselves, with what was inserted and whose role changed; columns of other names do not matter."""
    rows = [(1, 0, "system", "S."), (1, 2, "assistant", "A."), (1, 3, "tool", "T."), (1, 4, "assistant", "A."), (2, None, "user", ""), (3, 5, "user", "Q?")]
    frame = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], SCHEMA + ", at long, place long, edit string")
    got = [tuple(r) for r in conversations.repair(frame).orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 0, 0, "system", "S.", "K"), (1, 1, 2, "user", "A.", "R"), (1, 2, 3, "assistant", "T.", "R"),
        (3, 0, 5, "user", "Q?", "K"), (3, 1, None, "assistant", "", "I"),
    ]
    want = brute.conversation_repairs(rows, damaged=False)
    assert {r[0]: tuple(r[1:]) for r in conversations.repair_digests(frame).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_digests(none).count() == 0 and conversations.repair(none).count() == 0
    gone = spark.createDataFrame([(4, 1, "user", "x.")], SCHEMA)
    row = conversations.repair_digests(none, gone).collect()
    assert [tuple(r)[:-1] for r in row] == [(4, 0, 0, 0, 0, 0, 0, "")] and row[0]["repaired_sha256"].startswith("e3b0c442")
