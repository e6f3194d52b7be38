"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, with DataFrame functions only.

A fingerprint has three parts of ``slots`` cells.  Each distinct paragraph (non-empty line) adds its digest to one cell of each
part; a cell holds how many digests fell in it, their exclusive-or, and the exclusive-or of their check values.  Two fingerprints
of a size subtract cell by cell, what both texts hold cancels, and peeling recovers the rest: a cell left with one digest
gives it away, which is then taken out of its other cells.  If that ends with full cells the difference was too large
for the table, and both sides are built anew, larger, until it ends well.

Tables of the first size and of four times that are arrays inside a row, without a shuffle.  Further retries are rows, one per
cell, so their cost is linear in the paragraphs of however long a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.llm.work import save

PARTS = 3
#: Peeling rounds before a table counts as stalled, retries at twice the size before arrays are compared instead, and rows of a task of array peeling.
ROUNDS, RETRIES, ROWS = 48, 12, 5000
_CELLS = "array<struct<c:int,d:bigint,k:bigint>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def check_value(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def slot(digest: Column, part: int, slots: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(part)), slots.cast("long")).cast("int")


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the non-empty lines of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != ""), lambda p: F.xxhash64(p)))


def table(digests: Column, slots: int) -> Column:
    """The cells of a set of digests, part after part."""
    entries = F.transform(digests, lambda d: F.struct(d.alias("d"), check_value(d).alias("k"), *(slot(d, p, F.lit(slots)).alias(f"j{p}") for p in range(PARTS))))
    empty = F.expr("named_struct('c', 0, 'd', 0L, 'k', 0L)")

    def add(cell: Column, e: Column) -> Column:
        return F.struct((cell["c"] + 1).alias("c"), cell["d"].bitwiseXOR(e["d"]).alias("d"), cell["k"].bitwiseXOR(e["k"]).alias("k"))

    def part(p: int, all_entries: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: F.aggregate(F.filter(all_entries, lambda e: e[f"j{p}"] == j), empty, add))

    return _let(entries, lambda e: F.concat(*(part(p, e) for p in range(PARTS))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def _is_pure(cell: Column) -> Column:
    return (F.abs(cell["c"]) == 1) & (check_value(cell["d"]) == cell["k"])


def peel(cells: Column, slots: int, rounds: int = 12) -> Column:
    """struct(ok, added, removed): digests on the left and on the right side alone; ok is false if cells stay full."""
    start = F.struct(cells.cast(_CELLS).alias("cells"), F.expr("cast(array() as array<struct<d:bigint,c:int>>)").alias("out"), F.lit(True).alias("more"))

    def take_out(state: Column, pure: Column) -> Column:
        def rest(cell: Column, i: Column) -> Column:
            def here(e: Column) -> Column:
                return F.when(i < slots, e["j0"] == i).when(i < 2 * slots, e["j1"] == i - slots).otherwise(e["j2"] == i - 2 * slots)

            def less(c: Column, e: Column) -> Column:
                return F.struct((c["c"] - e["c"]).alias("c"), c["d"].bitwiseXOR(e["d"]).alias("d"), c["k"].bitwiseXOR(e["k"]).alias("k"))

            return F.when(cell["c"] == 0, F.when(cell["d"] == 0, cell).otherwise(F.aggregate(F.filter(pure, here), cell, less))).otherwise(F.aggregate(F.filter(pure, here), cell, less))

        return F.struct(F.transform(state["cells"], rest).alias("cells"), F.concat(state["out"], F.transform(pure, lambda e: F.struct(e["d"].alias("d"), e["c"].alias("c")))).alias("out"), (F.size(pure) > 0).alias("more"))

    def step(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], _is_pure), lambda x: F.struct(x["d"].alias("d"), x["k"].alias("k"), x["c"].alias("c"), *(slot(x["d"], p, F.lit(slots)).alias(f"j{p}") for p in range(PARTS)))))
        return F.when(state["more"], _let(found, lambda pure: take_out(state, pure))).otherwise(state)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    side = lambda s, sign: F.transform(F.filter(s["out"], lambda e: e["c"] == sign), lambda e: e["d"])
    return _let(done, lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["c"] != 0) | (c["d"] != 0))).alias("ok"), side(s, 1).alias("added"), side(s, -1).alias("removed")))


def to_text(cells: Column) -> Column:
    """Cells as base64 text: 1 byte of count, 8 of digest, 4 of check value each."""
    packed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(F.pmod(c["c"], F.lit(256)).cast("long")), 2, "0"), F.lpad(F.hex(c["d"]), 16, "0"), F.lpad(F.hex(c["k"]), 8, "0")))
    return F.base64(F.unhex(F.array_join(packed, "")))


def peel_large(pairs: DataFrame) -> DataFrame:
    """Differences by tables of one row per cell: (id, a, b) with digest arrays to (id, d, c), c being 1 or -1.

    The first try has room for twice the digests of both sides; pairs that still stall are tried again at twice the size, up to
    ``RETRIES`` times.
    """
    pairs = pairs.withColumn("slots", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(16), F.size("a") + F.size("b"))))).cast("int"))
    pairs = save(pairs, "ibf-pairs")
    results = pairs.select("id", F.lit(0).cast("long").alias("d"), F.lit(0).alias("c")).limit(0)
    for _ in range(RETRIES):
        if pairs.isEmpty():
            return results
        entries = pairs.select("id", "slots", F.explode(F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(1).alias("c"))), F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("c"))))).alias("e")).select("id", "slots", "e.*")
        cells, got = save(_summed(_placed(entries)), "ibf-cells"), []
        for _ in range(ROUNDS):
            pure = save(cells.where(_is_pure(F.struct("c", "d", "k"))).select("id", "slots", "d", "c").distinct(), "ibf-pure")
            if pure.isEmpty():
                break
            got.append(pure.select("id", "d", "c"))
            cells = save(_summed(cells.union(_placed(pure.withColumn("c", -F.col("c"))))), "ibf-cells")
        stalled = save(cells.select("id").distinct(), "ibf-stalled")
        for found in got:
            results = results.union(found.join(stalled, "id", "left_anti"))
        pairs = save(pairs.join(stalled, "id").withColumn("slots", F.col("slots") * 2), "ibf-pairs")
    # digests that no table of any size tells apart: compared as they are

    def only(x: str, y: str, sign: int) -> Column:
        return F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("d"), F.lit(sign).alias("c")))

    rest = F.concat(only("a", "b", 1), only("b", "a", -1))
    return results.union(pairs.select("id", F.explode(rest).alias("e")).select("id", "e.*"))


def dealt(df: DataFrame) -> DataFrame:
    """A work table dealt to tasks by rows: peeling costs by the row, whatever its bytes."""
    return df.repartition(max(1, -(-df.count() // ROWS)), "id")


def _placed(entries: DataFrame) -> DataFrame:
    places = F.array(*(slot(F.col("d"), p, F.col("slots")) + p * F.col("slots") for p in range(PARTS)))
    return entries.select("id", "slots", F.explode(places).alias("j"), "c", "d", check_value(F.col("d")).alias("k"))


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("id", "slots", "j").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("d").alias("d"), F.bit_xor("k").alias("k")).where("c <> 0 or d <> 0 or k <> 0")


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared digests over all, from both sizes and the number that differ; 1 for two empty sets."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differing) / (a + b + differing))


def neighbours(keys: DataFrame, order: list[str]) -> DataFrame:
    """Each distinct key with the one that follows in ``order``, as ``next``; the last one with the first.

    Keys are dealt by ranges; only the first key of each range crosses to another.
    """
    dealt = save(keys.distinct().repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "ranges")
    whole = F.struct(*order)
    heads = dealt.groupBy("_piece").agg(F.min(whole).alias("head"))
    over = Window.orderBy("_piece")  # one row per range
    heads = heads.select("_piece", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("next", F.lead(whole).over(Window.partitionBy("_piece").orderBy(*order)))
    return inside.join(heads, "_piece").select(*keys.columns, F.coalesce("next", "after").alias("next"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = 16) -> DataFrame:
    """Fingerprints of every text and of its edit, and how far peeling finds them alike.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document, by
    ascending id; after the last comes the first.  Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs.

    Null text: empty, with an empty fingerprint; two empty ones are alike (1.0).  Null ids come first in the order.  Texts
    of one id are ordered by a hash, and rows alike in id and text are one document in the order and get a row each.  A single document
    is its own next one.  An empty table gives an empty result.  Only the two named columns are read.
    """
    body, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["named", "kid", "th"]
    rows = docs.select(F.col(id_col).isNotNull().alias("named"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("kid"), F.xxhash64(body).alias("th"), body.alias("text"))
    order = save(neighbours(rows.select(*key, F.length("text").alias("n")), key), "neighbours")
    after = order.select(*(F.col(f"next.{c}").alias(c) for c in key), F.struct(*key).alias("p"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    # both joins take the same columns of the texts, so that these are shuffled once
    heads = rows.join(after.hint("merge"), key).select("p.*", F.col("text").substr(F.lit(1), F.col("q")).alias("head"), paragraph_digests(F.col("text")).alias("b_next")).dropDuplicates(key)
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    read = rows.join(heads.hint("merge"), key).withColumn("edited", edited)
    read = read.select(F.when(F.col("named"), F.col("kid")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("edited")).alias("b_edited"), "b_next")
    read = save(read.withColumn("id", F.monotonically_increasing_id()), "digests")

    def differing(a: Column, b: str, slots: int) -> Column:
        return _let(peel(subtract(a, table(F.col(b), slots)), slots), lambda s: F.when(s["ok"], F.size(s["added"]) + F.size(s["removed"])))

    both = _let(table(F.col("a"), slots), lambda a: F.struct(differing(a, "b_edited", slots).alias("d_edited"), differing(a, "b_next", slots).alias("d_next")))
    first = save(dealt(read.select("id", "a", "b_edited", "b_next")).select("id", both.alias("d")).select("id", "d.*"), "ibf-first")
    again = first.where("d_edited is null or d_next is null").join(read.select("id", "a", "b_edited", "b_next"), "id")
    again = again.select("a", F.explode(F.array(F.when(F.col("d_edited").isNull(), F.struct((F.col("id") * 2).alias("id"), F.col("b_edited").alias("b"))), F.when(F.col("d_next").isNull(), F.struct((F.col("id") * 2 + 1).alias("id"), F.col("b_next").alias("b"))))).alias("x")).where("x is not null")
    again = save(again.select("x.id", "a", "x.b"), "ibf-again")
    second = save(dealt(again).select("id", differing(table(F.col("a"), 4 * slots), "b", 4 * slots).alias("d")), "ibf-second")
    large = peel_large(again.join(second.where("d is null").select("id"), "id")).groupBy("id").agg(F.count("*").cast("int").alias("d"))
    retried = second.where("d is not null").union(large)
    retried = retried.groupBy(F.shiftright("id", 1).alias("id")).agg(F.max(F.expr("if(id % 2 = 0, d, null)")).alias("l_edited"), F.max(F.expr("if(id % 2 = 1, d, null)")).alias("l_next"))
    size = lambda c: F.size(c).cast("double")
    return (
        read.join(first, "id").join(save(retried, "ibf-retried"), "id", "left")
        .select(
            "doc_id", "n_chars", "edited_sha256",
            to_text(table(F.col("a"), slots)).alias("fingerprint"), to_text(table(F.col("b_edited"), slots)).alias("edited_fingerprint"),
            likeness(size("a"), size("b_edited"), F.coalesce("d_edited", "l_edited", F.lit(0))).alias("near_edited"),
            likeness(size("a"), size("b_next"), F.coalesce("d_next", "l_next", F.lit(0))).alias("near_next"),
            F.size("a").alias("n_paragraphs"),
        )
    )
