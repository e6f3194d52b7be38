"""Repair of conversations' structure: each distinct signature is solved once, and the edits are replayed on the rows.

A conversation is its rows by turn (nulls first; equal turns by role and a hash of the text).  A row's first fault counts: *blank* (nothing but
white space), *duplicate* (its role and text stand earlier in the conversation), *truncated* (it does not end in ``.``, ``!`` or ``?``).
A letter per row holds the initial of its role (s, u, a or another) and its fault; a conversation's letters are its signature.

The cheapest edits that leave role initials ``(s?(ua)+)?`` depend on the signature alone: Keep costs 0, Rerole (to user or assistant)
2, Delete 3 and is required of blank and duplicate rows, Insert (an empty row of user or assistant, anywhere) 2; a truncated row that is
not deleted costs 1 more.  Of edits that cost the same those count whose initials are least in ASCII order.  A stretch of letters is a
table of the best edits from each state of that pattern to each other one; a signature's table is made of those of its halves, by recursion
that remembers short stretches.  Distinct signatures are solved once, their audits joined back to their conversations, and the
edits replayed over the rows, which stream by in order; of a conversation only the audit is held, a letter per row.

Rows are put in order by one range shuffle, so that a very long conversation is split over tasks where its rows are judged.  Its signature
and its repaired text (for SHA-256) are needed in order in one place, but never held there as rows.

Null values of any column count as one space (null turns and ids stay null in results).  Rows alike are duplicates but for the first.  Roles are told by their
initial, with case.  A conversation all of whose rows are gone has an empty audit.  An empty table gives an empty result.  Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflux.llm.work import save

_SPACE = " \t\n\x0b\x0c\r"
#: Letters of a signature: "A" + 4 * role + fault.
ROLES, FAULTS = ("s", "u", "a", ""), ("", "blank", "duplicate", "truncated")
#: States of the pattern: nothing yet, after s, after u, after a.  The first and the last may end it.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STEPS = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}

# ---- solving signatures ----

#: The cheapest way (cost, edits) from a state to a state.
Table = dict[tuple[int, int], tuple[int, str]]


def _better(table: Table, at: tuple[int, int], way: tuple[int, str]) -> None:
    if at not in table or way < table[at]:
        table[at] = way


def _joined(one: Table, two: Table) -> Table:
    table: Table = {}
    for (a, b), (cost, edits) in one.items():
        for c in range(4):
            if (b, c) in two:
                _better(table, (a, c), (cost + two[b, c][0], edits + two[b, c][1]))
    return table


def _inserts() -> Table:
    """No row, one, or a user and an assistant: more would come back to a state."""
    one: Table = {(a, b): (2, "I") for role in "ua" for a, b in _STEPS[role].items()}
    none: Table = {(a, a): (0, "") for a in range(4)}
    table = dict(none)
    for more in (one, _joined(one, one)):
        for at, way in more.items():
            _better(table, at, way)
    return table


_INSERTS = _inserts()


def _letter(letter: str) -> Table:
    """What may come before a row, and the row itself."""
    role, fault = divmod(ord(letter) - ord("A"), 4)
    row: Table = {(a, a): (3, "D") for a in range(4)}
    if FAULTS[fault] not in ("blank", "duplicate"):
        more = 1 if FAULTS[fault] == "truncated" else 0
        for to in "ua":
            for at in _STEPS[to].items():
                _better(row, at, (2 + more, "R"))
        for at in _STEPS.get(ROLES[role], {}).items():
            _better(row, at, (more, "K"))
    return _joined(_INSERTS, row)


def _solved(letters: str, memory: dict[str, Table]) -> Table:
    """The table of a stretch of letters; short ones, which come back in many signatures, are remembered, as long as these are not too many."""
    if letters in memory:
        return memory[letters]
    middle = len(letters) // 2
    table = _letter(letters) if not middle else _joined(_solved(letters[:middle], memory), _solved(letters[middle:], memory))
    if len(letters) <= 32 and len(memory) < 1 << 14:
        memory[letters] = table
    return table


def cheapest_edits(signature: str, memory: dict[str, Table] | None = None) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a signature, the least initials of equal cost."""
    whole = _joined(_solved(signature, {} if memory is None else memory), _INSERTS) if signature else _INSERTS
    return min(whole[_START, end] for end in (_START, _ASSISTANT) if (_START, end) in whole)


_SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory: dict[str, Table] = {}
    for b in batches:
        rows = []
        for signature in b.column(0).to_pylist():
            codes = [divmod(ord(c) - ord("A"), 4) for c in signature]
            faults = [sum(f == k for _, f in codes) for k in (1, 2, 3)]
            illegal = sum((ROLES[x], ROLES[y]) not in _LEGAL for (x, _), (y, _) in zip(codes, codes[1:]))
            rows.append((signature, *faults, illegal, *cheapest_edits(signature, memory)))
        names = [c.split()[0] for c in _SOLVED.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


# ---- damage, faults and signatures ----


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with known faults: by crc32(``conv_id:turn``) % 20 a row is dropped (0), emptied (1), robbed of
    its ``.!?`` (2), repeated (3) or given to the user (4)."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def place(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, at, key) of all conversations, ``at`` rising in their order."""
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    rows = rows.withColumn("key", F.md5(F.col("text").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "key", "row"]
    # ranges rise with their number, which stands in the upper bits, and their rows are numbered in order
    return save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("row"), "placed")


def signatures(placed: DataFrame, every: DataFrame) -> DataFrame:
    """conv_id, gaps, signature of the conversations of ``every``; those without rows have an empty one."""
    first = placed.groupBy("conv_id", "role", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    end = F.rtrim("text", F.lit(_SPACE))
    judged = placed.select("conv_id", "at", F.substring("role", 1, 1).alias("initial"), (F.length(end) == 0).alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("whole"))
    judged = judged.join(first, "at", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("whole"), 3).otherwise(0)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    letter = F.char(F.lit(ord("A")) + role * 4 + fault)
    text = lambda rows, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows, c))), lambda x: x[c]), "")
    # in two steps: what a range holds of a conversation, then these parts
    parts = judged.select("conv_id", F.shiftright("at", 33).alias("range"), "at", letter.alias("letter")).groupBy("conv_id", "range").agg(text("at", "letter").alias("part"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce(whole("high") - whole("low") + 1 - F.col("turns"), F.lit(0))
    turns = placed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("turns"))
    none = F.lit(None).cast("long")
    rows = parts.select("conv_id", "range", "part", none.alias("gaps"))
    rows = rows.union(turns.select("conv_id", F.lit(-1).cast("long"), F.lit(""), F.least(gaps, F.lit((1 << 63) - 1)).cast("long")))
    rows = rows.union(every.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), F.lit(""), none))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"), text("range", "part").alias("signature"))


def audit(placed: DataFrame, every: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    found = save(signatures(placed, every), "signatures")
    solved = save(found.select("signature").distinct().mapInArrow(_solve_all, _SOLVED), "solved")
    return found.join(solved, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# ---- replaying edits ----

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id {}, place long, turn {}, role string, text string, edit string"


def _made(audit: str, system: bool, number: int) -> str:
    """The role that an insert or a rerole at this place of the repaired conversation gets."""
    return ("user", "assistant")[(number - system) % 2]


def _replayed(rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple | None]]:
    """(the conversation's own row, a repaired row or None) for each step of each conversation's edits.

    ``rows`` are tuples whose head is (place, counts and audit) for a conversation and (None, turn, role, text) for its rows.
    """
    head, edits, at, number, system = None, "", 0, 0, False

    def inserts():
        nonlocal at, number
        while at < len(edits) and edits[at] == "I":
            yield head, (number, None, _made(edits, system, number), "", "I")
            at, number = at + 1, number + 1

    for is_head, values in rows:
        if is_head:
            if head is not None:
                yield from inserts()
            head, edits, at, number, system = values, values[-1], 0, 0, False
            # s leads exactly the sequences of odd length
            system = sum(e != "D" for e in edits) % 2 == 1
            yield head, None
            continue
        yield from inserts()
        turn, role, text = values
        edit = edits[at]
        at += 1
        if edit == "D":
            continue
        yield head, (number, turn, role if edit == "K" else _made(edits, system, number), text, edit)
        number += 1
    if head is not None:
        yield from inserts()


def _in_order(audits: DataFrame, placed: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, all in one task, one after another."""
    none = lambda kind: F.lit(None).cast(kind)
    turn = placed.schema["turn"].dataType
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), *_COUNTS, "audit", none(turn).alias("turn"), none("string").alias("role"), none("string").alias("text"))
    rows = placed.select("conv_id", "at", *(none("long").alias(c) for c in _COUNTS), none("string").alias("audit"), "turn", "role", "text")
    return heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    for b in batches:
        for low in range(0, b.num_rows, 1024):
            columns = {n: b.column(n).slice(low, 1024).to_pylist() for n in b.schema.names}
            for i, at in enumerate(columns["at"]):
                if at < 0:
                    yield True, (columns["conv_id"][i], *(columns[c][i] for c in _COUNTS), columns["audit"][i])
                else:
                    yield False, (columns["turn"][i], columns["role"][i], columns["text"][i])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _schema(columns: str, *kinds: pa.DataType) -> pa.Schema:
    given = iter(kinds)
    plain = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, next(given) if kind == "{}" else plain[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _digests(steps: Iterator[tuple[tuple, tuple | None]]) -> Iterator[tuple]:
    """A conversation's own row and the SHA-256 of its repaired rows, ``role:text`` in lines."""
    head, digest = None, None
    for own, row in steps:
        if row is None:
            if head is not None:
                yield *head, digest.hexdigest()
            head, digest = own, hashlib.sha256()
        else:
            digest.update(("\n" * (row[0] > 0) + f"{row[2]}:{row[3]}").encode())
    if head is not None:
        yield *head, digest.hexdigest()


def repair_digests(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``every`` names the conversations, by default those of the rows.
    """
    placed = place(conversations)
    audits = audit(placed, conversations if every is None else every)
    kind = placed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            again = (b for part in ([first], batches) for b in part)
            yield from _flushed(_digests(_replayed(_stream(again))), _schema(SUMMARY, first.schema.field("conv_id").type))

    return _in_order(audits, placed).mapInArrow(run, SUMMARY.format(kind))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null for an insert), role, text, edit (K, R or I)."""
    placed = place(conversations)
    audits = audit(placed, conversations)
    kinds = [placed.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            again = (b for part in ([first], batches) for b in part)
            rows = ((own[0], *row) for own, row in _replayed(_stream(again)) if row is not None)
            yield from _flushed(rows, _schema(REPAIRED, *(first.schema.field(c).type for c in ("conv_id", "turn"))))

    return _in_order(audits, placed).mapInArrow(run, REPAIRED.format(*kinds))
