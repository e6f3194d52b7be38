"""Line dedup by winnowing over hashes of word grams.

Lines of prose hold whole paragraphs, and a repeated passage may begin anywhere inside one.  So texts are compared by their
words, whatever lines these stand in.

A gram is a run of ``least`` words, from every word on; of the grams in each window of ``window`` words the one with the smallest
hash is selected (the rightmost of equals).  Two equal runs of a window's length hold the same selected gram, wherever they begin.

Selected grams are joined with the first place (by doc_id, then position) where the same gram was selected.  Each match is
extended word by word both ways, and the later run is deleted.  What is deleted still stands in an earlier place.  A gram is as long as
the shortest run that is deleted, so a first place can't share less with a later one and hide an earlier place that shares more.

Later copies of a whole text are found by its digest and need no text of the first one beside them.  Of an earlier text only the words
that an extension can reach are sent to a later one, which is no more than that has itself for each place where they meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopflux.llm.text import column_bytes, giving_back, in_parts, mix
from hopflux.llm.work import save

#: Texts are winnowed together up to so many words.
TOGETHER = 1 << 16
_BASE = 0x9E3779B97F4A7C15
#: Bytes, of one text or of several, whose words are found and hashed as one array; a longer word is hashed by itself.
PIECE = 1 << 18
_SPACES = b" \t\n\v\f\r"
_IS_WORD = np.array([c not in _SPACES for c in range(256)])
_CUTS = [bytes([c]) for c in _SPACES]
_NEXT_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_power_table = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse modulo 2**64."""
    if len(_power_table[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _power_table[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(2 * n, 4096), b, np.uint64)]), dtype=np.uint64)
    return _power_table


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text and where they start and end, a piece of the text at a time.

    A word's hash is a polynomial in its bytes, the difference of two running sums.
    """
    found, at = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while at < len(text):
        end = len(text)
        if end - at >= PIECE:
            end = 1 + max(text.rfind(c, at, at + PIECE) for c in _CUTS)
            if end <= at:  # one long word, or the rest of the text
                space = _NEXT_SPACE.search(text, at + PIECE - 1)
                end = space.start() if space else len(text)
                found.append((np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64), np.array([at]), np.array([end])))
                at = end
                continue
        data = np.frombuffer(text, np.uint8, end - at, at)
        change = np.diff(_IS_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        up, down = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
            h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
        found.append((h, start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words_of_all(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`words_of` for each text, short ones being looked at together; null is the empty text."""
    now, size = [], 0
    for i, text in enumerate(texts):
        now.append(text or b"")
        size += len(now[-1]) + 1
        if i == len(texts) - 1 or size + len(texts[i + 1] or b"") >= PIECE:
            h, start, stop = words_of(b"\n".join(now))
            begin = np.cumsum([0, *(len(x) + 1 for x in now)])
            cut = np.searchsorted(start, begin).tolist()
            for j, low in enumerate(begin[:-1].tolist()):
                x, y = cut[j], cut[j + 1]
                yield h[x:y], start[x:y] - low, stop[x:y] - low
            now, size = [], 0


def winnow(words: np.ndarray, ends: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected grams (of ``size`` words) of some texts and the numbers of their first words.

    ``words`` are the word hashes of the texts, one after another, and ``ends`` says where each text ends.
    """
    many, wide = len(words) - size + 1, window - size + 1  # grams of the texts and of a window
    whole = ends[np.searchsorted(ends, np.arange(len(words)), side="right")] - np.arange(len(words)) >= window
    if not whole.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        h = mix((total[size:] - total[:many]) * down[:many] + np.uint64(size)).view(np.int64)
    # the smallest, the rightmost of equals, of ``span`` grams from each on; spans grow up to the window's
    best, span = np.arange(many), 1
    while span < wide:
        step = min(span, wide - span)
        best = np.where(h[best[step:]] <= h[best[:-step]], best[step:], best[:-step])
        span += step
    picked = best[whole[: len(best)]]
    picked = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
    return h[picked], picked


def _fingerprints(gram: int, window: int):
    def some(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes, numbers of the texts and places in them."""
        ends = np.cumsum([len(x) for x in texts])
        h, at = winnow(np.concatenate(texts), ends, gram, window)
        text = np.searchsorted(ends, at, side="right")
        return h, text, at - np.concatenate([[0], ends])[text]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            kid, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, now, first, size = column_bytes(batch.column(2)), [], 0, 0
            for i, (h, _, _) in enumerate(words_of_all(texts)):
                now.append(h)
                size += len(now[-1])
                if size >= TOGETHER or i == len(texts) - 1:
                    h, own, place = some(now)
                    columns = h, kid[first + own], (t[first + own] << 32) | place
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "kid", "tp"])
                    now, first, size = [], i + 1, 0

    return run


def later_runs(own: np.ndarray, first: np.ndarray, matches: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Word spans of ``own`` (ends exclusive) to which the matches (own position, first position) extend."""
    spans, done = [], {}
    for p, q in sorted(matches):
        if done.get(p - q, -1) >= p:
            continue  # inside a run that this diagonal has given already
        if spans and spans[-1][0] <= p < spans[-1][1]:
            # inside a run of another diagonal; adds something only if a word next to that run is equal too
            s, e = spans[-1]
            before, after = s - 1 - (p - q), e - (p - q)
            if not (s and 0 <= before < len(first) and own[s - 1] == first[before]) and not (e < len(own) and 0 <= after < len(first) and own[e] == first[after]):
                continue
        n = min(len(own) - p, len(first) - q)
        differ = np.flatnonzero(own[p : p + n] != first[q : q + n])
        end = p + (int(differ[0]) if len(differ) else n)
        n = min(p, q)
        differ = np.flatnonzero(own[p - n : p] != first[q - n : q])
        start = p - n + (int(differ[-1]) + 1 if len(differ) else 0)
        done[p - q] = end - 1
        if end - start >= least:
            spans.append((start, end))
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without(text: bytes, spans: list[tuple[int, int]], starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> bytes:
    """The text without these words; a span that begins a line takes the white space after it, another one that before it."""
    if starts is None or ends is None:
        _, starts, ends = words_of(text)
    out, at = [], 0
    for s, e in spans:
        low, before = int(starts[s]), int(ends[s - 1]) if s else -1
        if text.rfind(b"\n", 0, low) >= before:
            out.append(text[at:low])
            at = int(starts[e]) if e < len(starts) else len(text)
        else:
            out.append(text[at:before])
            at = int(ends[e - 1])
    out.append(text[at:])
    return b"".join(out)


def _slices(columns: list[str], text_col: str):
    """Rows of an earlier text and its matches with a later one of at most ``_most`` words: the stretches of words that these can reach."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, starts, ends = None, None, None
        for batch in in_parts(batches):
            name = {c: i for i, c in enumerate(batch.schema.names)}
            rows = []
            for i, (text, most, matches) in enumerate(zip(column_bytes(batch.column(name[text_col])), batch.column(name["_most"]).to_pylist(), batch.column(name["_matches"]).to_pylist(), strict=True)):
                if text != last:  # rows of one text stand together
                    last, (_, starts, ends) = text, words_of(text)
                found, at = sorted((x["q"] - x["p"], x["p"], x["q"]) for x in matches), 0
                for s, e in merge([(max(0, d), min(len(starts), d + most)) for d, _, _ in found]):
                    inside = []
                    while at < len(found) and max(0, found[at][0]) < e:
                        inside.append({"p": found[at][1], "q": found[at][2] - s})
                        at += 1
                    rows.append((i, inside, text[starts[s] : ends[e - 1]].decode()))
            kept = batch.take(pa.array([x[0] for x in rows], pa.int64()))
            new = {"_matches": pa.array([x[1] for x in rows], batch.schema.field("_matches").type), text_col: pa.array([x[2] for x in rows], batch.schema.field(text_col).type)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else kept.column(name[c]) for c in columns], columns)

    return run


def _rewrite(columns: list[str], text_col: str, least: int):
    """Rows come grouped by document: stretches of earlier texts and matches with them (kind 0; flag: with the document itself), then its own (kind 1)."""
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts = None, []
        for batch in in_parts(batches):
            name = {c: i for i, c in enumerate(batch.schema.names)}
            get = lambda c: batch.column(name[c]).to_pylist()  # noqa: E731, B023
            texts, keep, new, cuts = column_bytes(batch.column(name[text_col])), [], [], []
            for i, (k, t, kind, flag, matches, (own, starts, ends)) in enumerate(zip(get("_kid"), get("_t"), get("_kind"), get("_flag"), get("_matches"), words_of_all(texts), strict=True)):
                if (k, t) != now:
                    now, firsts = (k, t), []
                if kind == 0:
                    firsts.append((flag, own, [(x["p"], x["q"]) for x in matches]))
                    continue
                if flag:  # a copy of an earlier text
                    spans = [(0, len(own))] if len(own) >= least else []
                else:
                    spans = merge([s for same, first, m in firsts for s in later_runs(own, own if same else first, m, least)])
                keep.append(i)
                new.append(without(texts[i], spans, starts, ends) if spans else texts[i])
                cuts.append(spans)
            rows = batch.take(pa.array(keep, pa.int64()))
            kind = batch.schema.field(text_col).type
            out = [pa.array([x if x is None else x.decode() for x in new], kind) if c == text_col else rows.column(name[c]) for c in columns]
            out += [pa.array([sum(e - s for s, e in x) for x in cuts], pa.int32()), pa.array([[{"s": s, "e": e} for s, e in x] for x in cuts], spans_type)]
            yield pa.RecordBatch.from_arrays(out, [*columns, "cut_words", "cut_spans"])

    return run


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's place in the order: its id, nulls last, then 31 bits of a hash of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.shiftrightunsigned(F.xxhash64(text), 33)


def repeated_places(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """Pairs of a document and an earlier one (or itself): _kid, _t, fk, ft, _matches of word numbers (p, q), _same."""
    places = save(rows.mapInArrow(_fingerprints(gram, window), "h long, kid long, tp long"), "fingerprints")
    first = places.groupBy("h").agg(F.min(F.struct("kid", "tp")).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = places.join(save(first, "first").hint("merge"), "h").where(F.struct("kid", "tp") > F.col("f"))
    doc, pos = lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")
    pairs = found.select(F.col("kid").alias("_kid"), doc(F.col("tp")).alias("_t"), F.col("f.kid").alias("fk"), doc(F.col("f.tp")).alias("ft"), F.struct(pos(F.col("tp")).alias("p"), pos(F.col("f.tp")).alias("q")).alias("m"))
    return pairs.groupBy("_kid", "_t", "fk", "ft").agg(F.collect_set("m").alias("_matches")).withColumn("_same", F.expr("_kid = fk and _t = ft"))


def later_copies(rows: DataFrame) -> DataFrame:
    """_kid, _t of the documents whose whole text stands in an earlier one."""
    named = rows.select("kid", "t", F.md5(F.col("text").cast("binary")).alias("d"), F.octet_length("text").alias("n"))
    first = named.groupBy("d", "n").agg(F.min(F.struct("kid", "t")).alias("f"), F.max(F.struct("kid", "t")).alias("z")).where("f <> z").drop("z")
    return named.join(first, ["d", "n"]).where(F.struct("kid", "t") > F.col("f")).select(F.col("kid").alias("_kid"), F.col("t").alias("_t")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 30, window: int = 40) -> DataFrame:
    """``docs`` with later repeats deleted from the text column, plus ``cut_words`` (how many) and ``cut_spans`` (of words, ends exclusive).

    Every run of ``window`` or more equal words that stands earlier (in a document with a smaller id, or further up in the same one) is
    found, wherever it begins: of any ``window`` words of it, at least ``least`` are deleted.  Runs of ``least`` to ``window`` - 1 words are deleted if
    they hold a selected gram, shorter ones stay.

    Null text stays null and empty text empty.  A null id comes last in the order.  Rows alike in id and text are one document
    to this operator: all of them keep or lose the same words.  An empty table gives an empty result.  All columns of
    ``docs`` stay; ``cut_words`` and ``cut_spans`` replace columns of those names.
    """
    if not 0 < least <= window:
        raise ValueError("least must be positive and no more than window")
    kid, t = _keys(id_col, text_col)
    texts = docs.select(kid.alias("kid"), t.alias("t"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain, key = docs.drop("cut_words", "cut_spans"), ["_kid", "_t"]
    columns = plain.columns
    copies = save(later_copies(texts), "copies")
    pairs = save(repeated_places(texts, least, window).join(copies.hint("merge"), key, "left_anti"), "pairs")
    rows = plain.withColumns({"_kid": kid, "_t": t})
    # the three joins take the same columns of the documents, so that these are shuffled once
    touched = save(pairs.select(*key, F.lit(False).alias("_flag")).distinct().union(copies.withColumn("_flag", F.lit(True))), "touched").hint("merge")
    clean = rows.join(touched, key, "left_anti").select(*columns, F.lit(0).alias("cut_words"), F.array().cast("array<struct<s:int,e:int>>").alias("cut_spans"))
    empty = F.array().cast("array<struct<p:int,q:int>>")
    own = rows.join(touched, key).select(*key, F.lit(1).alias("_kind"), "_flag", empty.alias("_matches"), *columns)
    # a text of n bytes has at most (n + 1) / 2 words
    most = texts.select(F.col("kid").alias("_kid"), F.col("t").alias("_t"), ((F.octet_length("text") + 1) / 2).cast("int").alias("_most")).distinct()
    others = pairs.where(~F.col("_same")).join(most, key).select(F.col("fk").alias("_kid"), F.col("ft").alias("_t"), F.struct(*key).alias("_to"), "_matches", "_most").hint("merge")
    reached = rows.join(others, key).select("_to._kid", "_to._t", "_matches", "_most", *columns)
    cut = [f for f in reached.schema.fields if f.name != "_most"]
    reached = reached.mapInArrow(_slices([f.name for f in cut], text_col), T.StructType(cut))
    kind = lambda same: (F.lit(0).alias("_kind"), F.lit(same).alias("_flag"), "_matches")
    itself = pairs.where("_same").select(*key, *kind(True), *(F.lit(None).cast(t).alias(c) for c, t in plain.dtypes))
    first = reached.select(*key, *kind(False), *columns).union(itself)
    gathered = own.union(first).repartition(*key).sortWithinPartitions(*key, "_kind")
    done = gathered.mapInArrow(_rewrite(columns, text_col, least), clean.schema)
    return clean.union(done)
