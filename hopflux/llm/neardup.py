"""MinHash near-dedup with bottom-k sketches of one hash function.

Steps, all of them over whole texts:

1. Every document gets its set of word shingles, hashed by one function; the ``k`` smallest values are its sketch.
   Texts with the same words form a class, of which one member goes on.
2. The first ``probes`` sketch values are posted to inverted lists.  Lists of at most ``cold`` entries generate overlaps:
   pairs of classes with the number of lists they share.
3. Values with longer lists (a line that a third of the documents share, a large group of near copies) make no pairs.
   Two linked documents share nearly all their probes, so those that only meet in long lists hold many long-list values.
   They are keyed by neighbouring values and each key names one member to which the others are tied.
4. Pairs pass if the estimate from the sketch of the union is within six standard errors of the threshold.
5. Pairs and ties make candidate groups, which are dealt to blocks of about ``block`` documents.  In a block all whole sets meet,
   with those of a few pivots of the group; exact intersections are products of 0/1 matrices, and only a spanning forest of the
   confirmed links leaves a block.
6. Documents of a large group that are not yet linked with most of it (the largest part found so far) meet all others
   of a size that allows a link, as sketches.  Only those whose sketch allows a link with one of another part go on with their texts, and
   their whole sets meet.  So pairs inside a part that hangs together need no look, and no pair across parts is left out: with r
   such documents of n in reach of each other's size, about 2 * r * n / ``block`` sketches are sent, and texts only where parts are alike.
7. Components of the confirmed links.

A pair at the threshold is lost only if it shares too few of its probes (below ``RARE``) or no two neighbouring ones, or by step 4 or 6:
its estimate falls below six standard errors with a probability under 1e-6 (fewer than 38 of 64 values at 0.85), for sets of over 64 shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.components import components
from hopflux.llm.text import column_bytes, giving_back, in_parts, shingles, space_words, text_hash
from hopflux.llm.work import save

#: A linked pair shares fewer probes than asked for with at most this probability (9 of 24 are asked for at 0.85, 7 at 0.8).
RARE = 2e-8
#: Members of a large group that all others of it meet.
PIVOTS = 8
#: Values of the sketches that documents of large groups meet by; most sets are no larger.
WIDE = 256
_SIGNATURE = "doc_id long, text_hash long, h1 long, h2 long, n long, sketch array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _signatures(k: int, size: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            h1, h2, n, sketch = [], [], [], []
            for text in column_bytes(batch.column(2)):
                words = space_words(text)
                both = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8")
                s = shingles(words, size)
                h1.append(int(both[0]))
                h2.append(int(both[1]))
                n.append(len(s))
                sketch.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], schema=_ARROW)

    return run


def intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set, by products of 0/1 matrices."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    both = rows if rows is columns else [np.unique(np.concatenate(x)) for x in (rows, columns)]
    values, seen = np.unique(np.concatenate(both), return_counts=True)
    values = values[seen > 1]  # others add nothing to any intersection of two

    def dense(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(values, flat)
        at[at == len(values)] = 0
        hit = values[at] == flat if len(values) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return owner[hit][order], at[hit][order]

    (ro, ra), (co, ca), step = dense(rows), dense(columns), 2048
    for low in range(0, len(values), step):
        x, y = (np.zeros((len(sets), step), np.float32) for sets in (rows, columns))
        for m, o, a in ((x, ro, ra), (y, co, ca)):
            i, j = np.searchsorted(a, [low, low + step])
            m[o[i:j], a[i:j] - low] = 1
        out += x @ y.T
    return out


def _forest(ids: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Each linked id with the smallest one that these pairs reach."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        if i != j:
            low, high = (i, j) if ids[i] <= ids[j] else (j, i)
            root[high] = low
    return [(ids[find(i)], ids[i]) for i in range(len(ids)) if find(i) != i and ids[find(i)] != ids[i]]


def _links(percent: int, size: int):
    def confirmed(rows: list[tuple[int, bool, bytes]], same: bool) -> list[tuple[int, int]]:
        ids = [r[0] for r in rows]
        sets = [shingles(space_words(r[2]), size) for r in rows]
        first = [i for i, r in enumerate(rows) if same or r[1]]
        second = first if same else [i for i, r in enumerate(rows) if not r[1]]
        if not first or not second or len(ids) < 2:
            return []
        n = np.array([len(s) for s in sets])
        if len(ids) <= 6:
            common = np.array([[len(np.intersect1d(sets[i], sets[j], True)) if i != j else 0 for j in second] for i in first])
        else:
            mine = [sets[i] for i in first]
            common = intersections(mine, mine if same else [sets[i] for i in second])
        x, y = np.nonzero((100 + percent) * common >= percent * (n[first][:, None] + n[second][None, :]))
        pairs = np.stack([np.array(first)[x], np.array(second)[y]], 1)
        return _forest(ids, pairs[pairs[:, 0] != pairs[:, 1]])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, links = None, [], []
        for batch in in_parts(batches):
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, rep, first, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), column_bytes(batch.column(5)), strict=True):
                if key != now:
                    links += confirmed(rows, now is not None and now[1] == now[2])
                    now, rows = key, []
                rows.append((rep, first, text))
            a, b = [x[0] for x in links], [x[1] for x in links]
            links = []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        links = confirmed(rows, now is not None and now[1] == now[2])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _sift(percent: int):
    """Of sketches that meet in (component, p, q), those of documents that may be linked with one of another part.

    Values up to the least upper end of the sketches that are not whole sets are a sample of every union; a pair passes if its share of
    common values there is within six standard errors of the threshold.  If all are whole sets that is exact.
    """
    fraction = percent / 100

    def survivors(rows: list[tuple]) -> list[tuple[int, bool]]:
        sides = [[r for r in rows if r[1]], [r for r in rows if not r[1]]]
        if not all(sides):
            return []
        end = min((r[4][-1] for r in rows if r[3] > len(r[4])), default=None)
        sets = [[np.array(r[4], np.int64) for r in side] for side in sides]
        if end is not None:
            sets = [[x[x <= end] for x in side] for side in sets]
        shared = intersections(*sets)
        union = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]])[None, :] - shared
        error = 0.0 if end is None else 6 * np.sqrt(fraction * (1 - fraction) / np.maximum(union, 1))
        part = [np.array([r[2] for r in side], np.int64) for side in sides]
        may = (shared >= (fraction - error) * union - 1e-6) & (part[0][:, None] != part[1][None, :])
        return [(side[i][0], side[i][1]) for side, axis in zip(sides, (1, 0)) for i in np.flatnonzero(may.any(axis=axis))]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in in_parts(batches):
            for *key, node, first, part, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    out += [(*now, *r) for r in survivors(rows)] if now else []
                    now, rows = key, []
                rows.append((node, first, part, n, sketch))
            yield flush(out)
            out = []
        yield flush([(*now, *r) for r in survivors(rows)] if now else [])

    def flush(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 4, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["component", "p", "q", "node", "first"])

    return run


def least_shared(fraction: float, probes: int) -> int:
    """How many of its probes a pair at the threshold shares, but for a probability of ``RARE``."""
    below, n = 0.0, 0
    while n < probes and (below := below + math.comb(probes, n) * fraction**n * (1 - fraction) ** (probes - n)) <= RARE:
        n += 1
    return max(n, 1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5, k: int = 64, probes: int = 24, cold: int = 32, block: int = 512) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash, h1, h2.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles.

    Null, empty or blank text: no shingles, linked with nothing, component_id = doc_id, kept.  Repeated rows get the same
    result each (a document is kept if it carries the smallest id).  Several texts under one id count as one node.  A null
    id never names a component: such a row takes the component of equal texts that have an id; without any it is kept with
    a null component.  Only the two named columns are read, so further columns may have any name.  The last three columns tell
    rows of one id apart: a hash of the text, and 128 bits of a hash of its words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = save(rows.select("doc_id", text_hash(F.col("text")), "text").mapInArrow(_signatures(k, size), _SIGNATURE), "signatures")
    named = sig.where("n > 0 and doc_id is not null")
    classes = save(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    sketches = save(named.join(classes, ["h1", "h2"]).where("doc_id = rep").dropDuplicates(["h1", "h2"]).select("rep", "n", "sketch"), "sketches")

    postings = sketches.select("rep", "n", F.explode(F.slice("sketch", 1, probes)).alias("v"))
    lists = save(postings.join(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v"), "lists")
    long_ones = save(lists.where(F.col("c") > cold).groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("v")).alias("hot")), "long-lists")

    fraction = percent / 100
    least = least_shared(fraction, probes)
    need = lambda n: F.least(F.lit(least), F.ceil(n * fraction - 1e-9)).cast("int")
    short = lists.where(F.col("c") <= cold).join(long_ones.select("rep", F.size("hot").alias("nh")), "rep", "left").select("v", "rep", "n", F.coalesce("nh", F.lit(0)).alias("nh"))
    x, y = short.alias("x"), short.alias("y")
    fits = (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    pairs = (
        x.join(y, (F.col("x.v") == F.col("y.v")) & fits)
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.least("x.nh", "y.nh").alias("nh"), F.greatest("x.n", "y.n").alias("n"))
        .groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("nh").alias("nh"), F.max("n").alias("n"))
        .where(F.col("shared") + F.col("nh") >= need(F.col("n")))
    )

    low = fraction - 6 * math.sqrt(fraction * (1 - fraction) / k)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    pairs = (
        pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(estimate >= low)
        .select("a", "b")
    )

    tied = long_ones.where(F.size("hot") >= need(F.col("n")))
    beside = F.transform(F.sequence(F.lit(2), F.size("hot")), lambda i: F.struct(F.element_at("hot", i - 1).alias("v1"), F.element_at("hot", i).alias("v2")))
    alone = F.transform("hot", lambda v: F.struct(v.alias("v1"), v.alias("v2")))
    none = F.slice(alone, 1, 0)
    keys = save(tied.select("rep", F.explode(F.concat(F.when(F.size("hot") > 1, beside).otherwise(none), F.when(F.col("n") <= probes, alone).otherwise(none))).alias("key")).select("rep", "key.*"), "keys")
    stars = keys.join(save(keys.groupBy("v1", "v2").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z"), "stars"), ["v1", "v2"]).select("a", F.col("rep").alias("b")).where("a < b").distinct()

    groups = save(components(pairs.union(stars)), "groups")
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    # a table of its own, whose size is known: a small one is sent to the texts, for a large one both are shuffled
    members = save(groups.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "nb", mine.alias("p")), "members")
    texts = save(rows.join(members, "doc_id").withColumnRenamed("doc_id", "node"), "candidates")

    def links(dealt: DataFrame) -> DataFrame:
        """Confirmed links of texts dealt to (component, p, q); equal p and q: of all, else of those marked ``first`` with the others."""
        met = dealt.select("component", "p", "q", "node", "first", "text").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
        return save(met.mapInArrow(_links(percent, size), "a long, b long"), "links")

    large = texts.where("nb > 1")
    draws = F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("draw"), "node"))["node"] for i in range(PIVOTS)))
    pivots = large.groupBy("component").agg(F.array_distinct(draws).alias("pivots")).select(F.explode("pivots").alias("node"))
    visits = large.join(pivots, "node").select("node", "component", "text", F.col("p").alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("p")).where("p <> own")
    alike = lambda df: df.select("node", "component", "text", "p", F.col("p").alias("q"), F.lit(True).alias("first"))
    found = links(alike(texts).union(alike(visits)))
    if not large.isEmpty():
        # sizes that allow a link are in the same or in neighbouring ranges
        range_of = F.floor(F.log("n") / (-math.log(fraction) * (1 + 1e-9))).cast("int").alias("range")
        known = large.select("node", "component").distinct().join(sketches.select(F.col("rep").alias("node"), range_of), "node")
        parts = known.join(components(found).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        most = parts.groupBy("component", "part").agg(F.count("*").alias("c")).groupBy("component").agg(F.max(F.struct("c", "part"))["part"].alias("main"))
        parts = save(parts.join(most, "component").select("node", "component", "range", "part", (F.col("part") != F.col("main")).alias("apart")), "parts")
        away = parts.where("apart").select("node", "component", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range"))
        count = lambda df, name: df.groupBy("component", "range").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        cells = count(parts, "homes").join(count(away, "guests"), ["component", "range"])
        number = lambda seed, many: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        home = parts.join(cells, ["component", "range"]).select("node", "component", "range", number(1, "homes").alias("home"), every("guests").alias("guest"), F.lit(False).alias("first"))
        away = away.join(cells, ["component", "range"]).select("node", "component", "range", every("homes").alias("home"), number(2, "guests").alias("guest"), F.lit(True).alias("first"))
        # p and q differ in sign, so that they are never equal
        met = home.union(away).select("node", "component", (F.col("range") * F.lit(1 << 20).cast("long") + F.col("home")).alias("p"), (-1 - F.col("guest")).cast("long").alias("q"), "first")
        wide = large.select("node", text_hash(F.col("text")), "text").mapInArrow(_signatures(WIDE, size), _SIGNATURE)
        wide = save(wide.select(F.col("doc_id").alias("node"), "n", "sketch").where("n > 0").distinct(), "wide")
        shown = met.join(parts.select("node", "part"), "node").join(wide, "node")
        shown = shown.select("component", "p", "q", "node", "first", "part", "n", "sketch").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
        alive = save(shown.mapInArrow(_sift(percent), "component long, p long, q long, node long, first boolean"), "sifted").distinct()
        found = found.union(links(alive.join(large.select("node", "text"), "node")))
    found = save(components(found), "components")

    named = classes.join(found, classes.rep == found.node, "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    done = sig.select("doc_id", "text_hash", "h1", "h2", "n").join(named, ["h1", "h2"], "left")
    done = done.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")))
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "h1", "h2")
