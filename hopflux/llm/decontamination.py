"""Benchmark decontamination with a distributed positional inverted index, with DataFrame functions only.

The index has one row (term, document, position) per occurrence of a benchmark term in the training texts; terms of no
benchmark item can take part in no match and are not stored.  A phrase is looked up from its two rarest terms: their
lists, each position less the term's place in the item, are intersected to alignments of the item with the text.  Only at
alignments that both terms agree on are the lists of the other terms read, and runs of agreeing places as long as
the window are exact matches.  Proximity matches ask for the share of an item's terms that stand within reach of one of its rare
terms; the reach grows with the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.llm.text import text_hash
from hopflux.llm.work import save

#: Words are runs of these characters: letters, digits and all that is not ASCII.
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark terms are sent to all executors up to this many; beyond it the index is built by a shuffled join.
SENT_TERMS = 1_000_000
#: Texts with an alignment are known to the scan of the postings by a number below this, so at most so many numbers are sent.
BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and other characters as they are; null: none."""
    body = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, _UPPER, _LOWER))
    parts = F.split(low, _CUT, -1)
    return F.transform(F.array(parts), lambda w: F.slice(w, F.when(w[0] == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0))))[0]


def build_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (kid, th, doc_id, n_words) and postings (term, kid, th, pos) of the terms; both are work tables.

    Rows alike in id and text share a key, under which each of them gives its postings.
    """
    body = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("kid"), text_hash(body).alias("th"), words(body).alias("w"))
    sent = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    # position -1 stands for the document itself, so one pass over the texts gives both tables
    spread = rows.select("doc_id", "kid", "th", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word")).withColumn("pos", F.col("pos") - 1)
    both = spread.join(sent, "word", "left").where("pos < 0 or term is not null")
    both = save(both.select("kid", "th", "pos", "term", F.when(F.col("pos") < 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") < 0, F.col("n_words")).alias("n_words")), "index")
    return both.where("pos < 0").select("kid", "th", "doc_id", "n_words"), both.where("pos >= 0").select("term", "kid", "th", "pos")


def phrase_matches(postings: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Exact matches of item windows: (kid, th, item, start, length), start being the word position in the document.

    ``places`` has the items' terms: (item, n, off, term) with n words an item.  A window is ``window`` consecutive words,
    or the whole item if it has fewer.
    """
    length = F.least(F.col("n"), F.lit(window))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    spots = save(places.join(counts, "term"), "places")  # terms without a posting occur nowhere
    # the two rarest places of every window; a window with a missing term can't match.  A place lies in at most ``window`` of them
    in_windows = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - length + 1), F.least(F.col("off"), F.col("n") - length)))
    inside = spots.select("item", "off", "term", "df", length.alias("size"), in_windows.alias("s"))
    full = Window.partitionBy("item", "s")
    ranked = inside.withColumns({"r": F.row_number().over(full.orderBy("df", "off")), "have": F.count("*").over(full)}).where("have = size and r <= 2")
    rare = save(ranked.groupBy("item", "s", "size").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("two")), "rarest")
    probes = rare.select("item", "two", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.element_at("two", F.least(F.lit(i + 1), F.size("two"))).alias("x")) for i in range(2)))).alias("p"))
    probes = probes.select("item", F.col("two").getItem(0)["off"].alias("key"), F.element_at("two", -1)["off"].alias("key2"), "p.i", "p.x.term", "p.x.off").distinct()
    small = F.broadcast(probes) if probes.count() <= SENT_TERMS else probes
    found = postings.join(small, "term").select("item", "key", "key2", "i", "kid", "th", (F.col("pos") - F.col("off")).alias("delta"))
    aligned = found.groupBy("item", "key", "key2", "kid", "th", "delta").agg(F.count_distinct("i").alias("seen")).where("seen = 2").select("item", "kid", "th", "delta").distinct()
    aligned = save(aligned, "alignments")
    # read the other lists at the alignments only
    wanted = aligned.join(spots.select("item", "n", "off", "term"), "item").select("item", "n", "kid", "th", "delta", "off", "term", (F.col("delta") + F.col("off")).alias("pos"))
    # postings of texts without an alignment stay where they are: what is sent to sift them is bounded however many texts have one
    bucket = F.pmod("th", F.lit(BUCKETS)).cast("int").alias("bucket")
    sifted = postings.withColumn("bucket", bucket).join(F.broadcast(aligned.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    agree = wanted.join(sifted, ["kid", "th", "pos", "term"])
    run = Window.partitionBy("item", "kid", "th", "delta").orderBy("off")
    # rows alike in id and text give every place once each: equal places share a rank, and a run is counted by its ends
    runs = agree.select("item", "n", "kid", "th", "delta", "off", (F.col("off") - F.dense_rank().over(run)).alias("g")).groupBy("item", "n", "kid", "th", "delta", "g").agg(F.min("off").alias("from"), (F.max("off") - F.min("off") + 1).alias("len"))
    return runs.withColumn("size", length).where("len >= size").select("kid", "th", "item", (F.col("delta") + F.col("from")).alias("start"), F.col("len").alias("length"))


def item_places(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Terms (term, word) and places (item, item_id, n, off, term) of the items.

    Items without words or id are left out; repeated rows count once, and several texts of an id are items of one name.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where("item_id is not null and size(w) > 0").distinct()
    flat = items.select("item_id", F.xxhash64("item_id", "w").alias("item"), F.size("w").alias("n"), F.posexplode("w").alias("off", "word"))
    terms = save(flat.select("word").distinct().withColumn("term", F.xxhash64("word")), "terms")
    return terms, save(flat.join(terms, "word").select("item", "item_id", "n", "off", "term"), "items")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 20, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Items of which at least ``share`` of the distinct terms stand close to a place of one of the item's rare terms.

    Close is up to ``within`` words before or after, or one less than the item's words if it has more, so that a verbatim copy
    reaches from end to end.  With m terms of which k are asked for, any k of them hold one of the m - k + 1 rarest: these are the anchors,
    and terms that occur nowhere are the rarest of all.

    Rows, one for each such place: doc_id, item_id, pos (of the rare term) and terms (how many distinct ones stand there).  Nulls and empty
    texts match nothing.
    """
    terms, places = item_places(benchmark)
    papers, postings = build_index(docs, terms, id_col, text_col)
    own = places.select("item", "item_id", "n", "term").distinct()
    spots = own.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    item = Window.partitionBy("item", "item_id")
    need = F.ceil(F.col("many") * share - 1e-9)
    ranked = spots.withColumns({"many": F.count("*").over(item), "r": F.row_number().over(item.orderBy(F.coalesce("df", F.lit(0)), "term"))}).withColumn("need", need)
    anchors = save(ranked.where("r <= many - need + 1 and df is not null").select("item", "item_id", "need", F.greatest(F.lit(within), F.col("n") - 1).alias("reach"), "term"), "anchors")
    seeds = postings.join(F.broadcast(anchors) if anchors.count() <= SENT_TERMS else anchors, "term").select("item", "item_id", "need", "reach", "kid", "th", F.col("pos").alias("at")).distinct()
    near = seeds.join(own.select("item", "item_id", "term"), ["item", "item_id"]).join(postings, ["kid", "th", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= F.col("reach"))
    hits = near.groupBy("kid", "th", "item", "item_id", "at", "need").agg(F.count_distinct("term").alias("terms")).where("terms >= need")
    return papers.join(hits, ["kid", "th"]).select("doc_id", "item_id", F.col("at").alias("pos"), "terms")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, percent: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash (which tells texts of one id apart).

    A word is hit if it lies inside any occurrence of a window (``window`` consecutive words of an item, or all of a shorter
    one).  Contaminated: something is hit, and at least ``percent`` of 100 words are.

    Null or empty text: no words, nothing hit; an empty benchmark hits nothing.  Items without words or id are left out.
    Repeated rows and several texts of an id get a row each; a null id is kept as null.  An empty table gives an empty result.
    Only the named columns are read, so further columns may have any name.
    """
    terms, places = item_places(benchmark)
    papers, postings = build_index(docs, terms, id_col, text_col)
    hits = phrase_matches(postings, places.select("item", "n", "off", "term"), window)
    named = hits.join(places.select("item", "item_id").distinct(), "item")
    # runs of a document in order; each adds what lies beyond the furthest end so far
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("kid", "th").orderBy("start", "length", "item", "item_id").rowsBetween(Window.unboundedPreceding, -1))
    added = named.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.col("start")))))
    per = added.groupBy("kid", "th").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    got = papers.join(save(per, "hits"), ["kid", "th"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return got.select("doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"), F.col("th").alias("text_hash"))
