"""Mixing sources to target weights by systematic sampling.

A source's share of all words follows its weight, up to ``most`` times the words it has; what a source cannot take is shared anew by
weight among the others.  Of a source each document is expected ``target / words of the source`` times.  The documents of a source
stand in a row, the longest first and equals by a hash; their expected copies are summed up along it, one random offset per source is
added, and a document is taken once for every whole number that the sum passes at it.  So a document's copies differ from what is
expected by less than one.  Neighbours in the row have like sizes, so that what is taken too much at one is made good at the next.
So that a few very long ones do not matter, the row has classes (those of more than 1, 1/4, 1/16 and 1/64 of the target, and the rest), and
a class is expected as often as makes up the target with what the classes before it gave.  A document longer than the target is
taken only if the others do not suffice.  A source misses its target by about 1/64 at most, unless it has too few short documents.

Rows are put in order by one range shuffle.  A row's number in its source is its place in its range, counted from where the source begins
there, and the rows of the source in earlier ranges; no source meets in one place.  Sums are exact integers (expected copies in units
of 2 ** -30), so every run gives the same rows.

A null text has no words.  Null is a source of its own, the last one.  Sources without words get a target of 0.  Rows alike, with one id or with
a null id count as rows of their own.  An empty table gives an empty result.  Further columns are ignored unless they are
asked for by ``carry``; names that the result uses itself are refused there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.llm.work import save
from hopflux.operators.edges import numbered

_UNIT = 30
_ONE = 1 << _UNIT
#: A document belongs to the first class i with ``size * _CLASSES[i] > target``, else to the last.
_CLASSES = (1, 4, 16, 64)
RESULT = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bits(text: Column, count: int) -> Column:
    """The first bits (a multiple of 4, 60 at most) of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, count // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, weight, target of rows (source, size).

    Sources in the order of their names, null last, get the weights in turn.  Those that their weight would give more than ``most``
    times their words are set to that, and the level of the others rises, until none is above: two numbers come to the driver from each pass.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    per = save(numbered(per, ["_last", "source"], "_place").select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    words, full = F.col("source_size"), F.col("source_size") * most
    total, left, shared, capped = per.agg(F.sum(words)).first()[0] or 0, 0, 1, None
    while True:
        # a source is at its bound if its share of what is left would be above it
        above = F.lit(False) if capped is None else full * shared < F.col("weight") * left
        row = per.agg(F.sum(F.when(above, full)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w"), F.count_if(above).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, left, shared = row["n"], total - (row["full"] or 0), row["w"]
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(shared))
    return per.select("source", "source_size", "weight", F.when(full * shared < F.col("weight") * left, full.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 12, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) and the columns of ``carry`` for every row of ``docs``.

    ``copies`` says how often the mix takes the document, ``taken`` how many words that makes.
    """
    clash = sorted({*carry} & {*RESULT, "_row", "_draw", "_at", "_class", "_number"})
    if clash:
        raise ValueError(f"columns {clash} cannot be carried: the result has columns of these names")
    draw = _bits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 60)
    rows = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("_draw"), F.monotonically_increasing_id().alias("_row"), *carry), "sizes")
    sources = save(source_targets(rows, weights, most), "targets")
    order = ["source", F.desc("size"), "_draw", "_row"]
    # in a sorted range this number counts its rows from 0, with the number of the range in the bits above the 33rd
    placed = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    piece = F.shiftright("_at", 33).alias("_piece")
    runs = placed.groupBy("source", piece).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).alias("r").join(sources.alias("s"), _same("r", "s")).select("r.*", "source_size", "target")
    numbered_rows = placed.withColumn("_piece", piece).alias("p").join(runs.alias("q"), _same("p", "q") & (F.col("p._piece") == F.col("q._piece")))
    of_class = F.lit(len(_CLASSES))
    for i, part in reversed(list(enumerate(_CLASSES))):
        of_class = F.when(F.col("size") * part > F.col("target"), i).otherwise(of_class)
    number = F.col("_before") + F.col("_at") - F.col("_first")
    found = save(numbered_rows.select("p.doc_id", "p.source", "size", "source_size", "target", number.alias("_number"), of_class.alias("_class"), *(f"p.{c}" for c in carry)), "numbered")
    expected = _expected(found, sources, most, seed)
    i = F.col("_number") - F.col("_start")
    whole = found.alias("f").join(expected.alias("e"), _same("f", "e") & (F.col("f._class") == F.col("e._class"))).withColumn("copies", _passed(i + 1) - _passed(i))
    return whole.select("doc_id", "f.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def _expected(found: DataFrame, sources: DataFrame, most: int, seed: int) -> DataFrame:
    """source, _class, _start (rows of the source before the class), _each (copies expected of a row of it), _offset (of the class's sum)."""
    last = len(_CLASSES)
    classes = found.groupBy("source", "_class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per = classes.groupBy("source").pivot("_class", list(range(last + 1))).agg(F.first("n").alias("n"), F.first("words").alias("words"))
    per = per.na.fill(0).alias("c").join(sources.alias("s"), _same("c", "s")).select("c.*", "source_size", "target")
    offset = _bits(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 28) * 4
    state = save(per.select("source", *(f"{i}_{c}" for i in range(last + 1) for c in ("n", "words")), F.lit(0).cast("long").alias("_start"), F.col("target").alias("left"), F.col("source_size").alias("size"), offset.alias("_offset")), "state")
    long = found.where(F.col("_class") < last).select("source", "_class", "size", "_number")
    told = []
    for i in range(last + 1):
        n, words = F.col(f"{i}_n"), F.col(f"{i}_words")
        each = _units(F.col("left"), F.col("size"), most)
        each = each if i else F.when((F.col("size") - words) * most >= F.col("left"), 0).otherwise(each).cast("long")
        now = state.withColumn("_each", each)
        told.append(now.select("source", F.lit(i).alias("_class"), "_start", "_each", "_offset"))
        if i == last:
            break
        at = F.col("_number") - F.col("_start")
        rows = long.where(F.col("_class") == i).select("source", F.col("size").alias("words"), "_number")
        taken = rows.alias("r").join(now.alias("s"), _same("r", "s")).groupBy("r.source").agg(F.sum((_passed(at + 1) - _passed(at)) * F.col("words")).alias("taken"))
        state = now.alias("s").join(taken.alias("t"), _same("s", "t"), "left")
        state = state.select("s.source", *(f"{k}_{c}" for k in range(i + 1, last + 1) for c in ("n", "words")), (F.col("_start") + n).alias("_start"), (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), (F.col("size") - words).alias("size"), (n.bitwiseAND(_ONE - 1) * F.col("_each") + F.col("_offset")).bitwiseAND(_ONE - 1).alias("_offset"))
        state = save(state, "state")
    whole = told[0]
    for more in told[1:]:
        whole = whole.union(more)
    return save(whole, "expected")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _units(words: Column, size: Column, most: int) -> Column:
    """Copies expected of each document, in units of 2 ** -30."""
    ratio = F.greatest(F.least(words / size * F.lit(float(_ONE)), F.lit(float(most * _ONE))), F.lit(0.0))
    return F.when(size > 0, F.floor(ratio)).otherwise(0).cast("long")


def _passed(rows: Column) -> Column:
    """Whole numbers that the sum of so many rows' expected copies, with the offset, has passed.

    The product is kept in two parts, since a long does not hold it for a source of billions of documents.
    """
    return F.shiftright(rows, _UNIT) * F.col("_each") + F.shiftright(rows.bitwiseAND(_ONE - 1) * F.col("_each") + F.col("_offset"), _UNIT)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row (doc_id, source, text) as often as it is taken, numbered by ``copy``."""
    whole = mix(docs, carry=["text"], **how).where("copies > 0")
    return whole.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
