"""Rounds over the blocks of a layout.

In a round the blocks that have got messages work on them, each in one task, with what they remembered from before, until they
have no more to do on their own.  They send messages on to other blocks.  A round is written as one table of what its blocks remember and
send, which cuts the lineage; what a block remembers is read from the table of the round in which it last worked, so a round
reads and writes nothing of blocks that are at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hopflux.operators.blocks import PARTS, Layout
from hopflux.plans.work import save, save_at

#: What a row is: what a block remembers, a message to a block, a result, a fact for the driver, or an alarm that ends the rounds.
MEMORY, MESSAGE, RESULT, FACT, ALARM = range(5)
ROWS = "kind int, block int, source long, v long, d double, body binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("source", pa.int64()), ("v", pa.int64()), ("d", pa.float64()), ("body", pa.binary())])
#: Rounds' tables that are read side by side, at most, before what blocks remember is put together.
TABLES = 12
#: Blocks that are named one by one in a filter; more are joined.
_NAMED = 1000


def table(rows: Iterable[tuple]) -> pa.Table:
    """Rows of a round from tuples (kind, block, source, v, d, body)."""
    columns = list(zip(*rows)) or [[]] * len(SCHEMA)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


class Rounds:
    """``active`` are the blocks that have got messages; ``facts`` the facts of the last round."""

    def __init__(self, layout: Layout, messages: list[tuple]):
        self.layout, self.spark = layout, layout.table.sparkSession
        self.now = self.spark.createDataFrame(messages, ROWS)
        self.active = sorted({m[1] for m in messages})
        self.tables: list[DataFrame] = []
        self.paths: list[str] = []
        self.last: dict[int, int] = {}
        self.number = self.written = 0
        self.facts: list[Row] = []
        self.alarms = 0

    def _of(self, df: DataFrame, blocks: list[int]) -> DataFrame:
        if len(blocks) <= _NAMED:
            return df.where(F.col("block").isin(blocks))
        return df.join(F.broadcast(self.spark.createDataFrame([(b,) for b in blocks], "block int")), "block", "left_semi")

    def memory(self, blocks: Iterable[int] | None = None, kind: Column | None = None) -> DataFrame:
        """What these blocks (all that ever worked) remember now."""
        by: dict[int, list[int]] = {}
        for b in self.last if blocks is None else blocks:
            if b in self.last:
                by.setdefault(self.last[b], []).append(b)
        found = self.now.where("false")
        for i, own in by.items():
            found = found.union(self._of(self.tables[i].where(F.col("kind") == MEMORY), own))
        return found

    def results(self) -> DataFrame:
        """The results of all rounds, in one scan."""
        return self.spark.read.schema(ROWS).parquet(*self.paths).where(F.col("kind") == RESULT)

    def step(self, run: Callable[[pa.Table, pa.Table], pa.Table], everyone: bool = False) -> None:
        """The next round, over the blocks that have got messages, or over all of them."""
        blocks = self.layout.table
        inbox = self.now.where(F.col("kind") == MESSAGE)
        if not everyone and len(self.active) < self.layout.blocks:
            blocks, inbox = self._of(blocks, self.active), self._of(inbox, self.active)
        inbox = inbox.union(self.memory(None if everyone else self.active))
        made = blocks.groupBy("block").cogroup(inbox.groupBy("block")).applyInArrow(run, ROWS)
        self.now, path = save_at(made, "round")
        self.paths.append(path)
        self.tables.append(self.now)
        self.number += 1
        fact = F.when(F.col("kind") == FACT, F.struct("block", "source", "v", "d"))
        of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("block")))
        row = self.now.agg(of(MESSAGE).alias("to"), of(MEMORY).alias("worked"), F.count_if(F.col("kind") == ALARM).alias("alarms"), F.collect_list(fact).alias("facts"), F.sum(F.when(F.col("kind") == MEMORY, F.col("v"))).alias("written")).first()
        self.active, self.alarms, self.facts = sorted(row["to"]), row["alarms"], row["facts"]
        self.written += row["written"] or 0
        self.last |= dict.fromkeys(row["worked"], len(self.tables) - 1)

    def redirect(self, messages: DataFrame) -> None:
        """Put other messages, to the same blocks, in place of those under way."""
        self.now = save(messages, "messages")

    def send(self, messages: list[tuple]) -> None:
        """Messages from outside, once none are under way."""
        self.now = self.spark.createDataFrame(messages, ROWS)
        self.active = sorted({m[1] for m in messages})

    def dealt(self) -> DataFrame:
        """What all blocks remember, one block to a task as a round writes it: tasks that read small files side by side would
        write ever more blocks to a file, which are then read and written at once."""
        return self.memory().repartition(min(self.layout.blocks, PARTS), "block")

    def put_together(self) -> None:
        """What blocks remember in one table in place of all so far, once there are many."""
        if len(self.tables) >= TABLES:
            self.tables, self.last = [save(self.dealt(), "memory")], dict.fromkeys(self.last, 0)
