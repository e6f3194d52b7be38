"""Language-model scoring with a weighted backoff automaton over words.

States are the n-gram contexts seen in training, the lowest one having no context.  A state has an arc for every word
that followed it, which leads to the longest known context that ends there, and one failure arc to the state of the context
without its first word:

    arc      P(x | h) = w(h) * c(h x) / c(h) + (1 - w(h)) * P(x | h')
    failure  1 - w(h),  with  w(h) = c(h)**power / (c(h)**power + kappa)

so the probabilities of a state sum to one over all words and one unknown word.  ``power`` and ``kappa`` belong to the length of
the context; a power above one distrusts contexts that stand in a single place.  The lowest state discounts every count by ``discount``
and gives what that frees to the unknown word.

A text is read once from left to right.  A walk carries a state; at a word without an arc it takes failure arcs and adds
their weights until there is one.  Long texts are cut into stretches that are walked side by side: as no context is longer than
the order, a walk that starts that many words early at the lowest state stands where the whole walk would.

How it is spread out: documents are dealt to chunks of a fixed size by a hash of their id and text.  Rows alike in both that are too
many for one chunk are read as one text that counts as often, and each of them gets its scores.  Each chunk counts its own
n-grams first, so a frequent word is one number per chunk, and sends its counts to ``fan`` ranges of hashes as compressed sorted
arrays, whose number is so in proportion to the input.  What goes to one range is summed, at once for up to ``direct`` chunks; beyond
that teams of ``fan`` chunks are summed and stand for their chunks one level higher, with ``fan`` times as many ranges.  Each chunk
gets back the sums of just the n-grams it holds: the part of the automaton that its texts can walk.  No model is held in one
place, and all of it grows with the input.

N-grams longer than a word are known by 50 bits of hash; of N distinct ones a share of about N / 2**50 meets another (a
thousandth at 1e12).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflux.llm.text import column_bytes, hashes, mix, space_words
from hopflux.llm.work import save

#: Hashes of the end token and of what stands before the first word; both differ from any word's in practice.
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MUL = np.uint64(0xD6E8FEB86659FD93)
#: Bits of an n-gram's hash that are kept: 63 for single words, whose counts are part of the contract, 50 for longer ones.
_BITS = {1: 63}
_LONGER = 50
#: Kappa and power for contexts of one word and of two.
CONTEXTS = ((500.0, 1.0), (8.0, 1.0))
#: Words of a stretch of a long text.
STRETCH = 256
#: Groups of equal rows that are broadcast at most, at about a hundred bytes.
_BROADCAST = 100_000
_BLOBS = "owner long, n int, bucket long, keys binary, counts binary"
_SUMS = "owner long, n int, bucket long, total long, distinct long, counts binary"


def is_held_out(id_col: Column, modulus: int = 5, remainder: int = 1) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def pack_array(values: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost about a byte each, random ones what they hold."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_array(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _blobs(owner: int, n: int, keys: np.ndarray, counts: np.ndarray, low: int, high: int, buckets: int) -> list[tuple]:
    """Sorted keys and their counts, cut at the borders of the buckets ``low`` to ``high`` - 1 of all ``buckets``.

    The bucket of a key is its place in the range of hashes, so sorted keys stay in order."""
    top = 1 << _BITS.get(n, _LONGER)
    cut = np.searchsorted(keys, np.array([-(-top * b // buckets) for b in range(low, high + 1)], np.uint64))
    cut[0], cut[-1] = 0, len(keys)
    return [(owner, n, low + i, pack_array(np.diff(keys[x:y], prepend=np.uint64(0))), pack_array(counts[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


class _Chunk:
    """Token hashes of a chunk's texts and the n-gram at each token: its number among the chunk's sorted distinct keys."""

    def __init__(self, table: pa.Table, order: int):
        self.ids, self.held = table.column("doc_id"), table.column("held_out").to_numpy()
        self.copies = table.column("copies").to_numpy() if "copies" in table.column_names else np.ones(table.num_rows, np.int64)
        words, sizes = [], []
        for batch in table.to_batches():
            for text in column_bytes(batch.column(batch.schema.get_field_index("text"))):
                h = hashes(space_words(text))
                words.append(np.append(h, _END))
                sizes.append(len(h) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        tokens = np.concatenate(words)
        self.ends = self.starts + self.sizes - 1
        keys, before, context = {1: tokens >> np.uint64(1)}, tokens, None
        for n in range(2, order + 1):
            before = np.roll(before, 1)
            before[self.starts] = _START  # further back than the start, the start again
            context = before if context is None else mix(before * _MUL + context)
            keys[n] = mix(context * _MUL + tokens + np.uint64(n)) >> np.uint64(64 - _LONGER)
        self.keys, self.at = {}, {}
        for n in list(keys):
            self.keys[n], self.at[n] = np.unique(keys.pop(n), return_inverse=True)

    def counts(self, n: int) -> np.ndarray:
        """How often each of the distinct n-grams stands in the chunk's training texts."""
        train = np.repeat(~self.held * self.copies, self.sizes)
        return np.bincount(self.at[n], train, len(self.keys[n])).astype(np.uint64)


def _count(order: int, fan: int):
    def run(table: pa.Table) -> pa.Table:
        owner, chunk, rows = table.column("chunk")[0].as_py(), _Chunk(table, order), []
        for n, keys in chunk.keys.items():
            rows += _blobs(owner, n, keys, chunk.counts(n), 0, fan, fan)
        return _table(_BLOBS, rows)

    return run


def _unpacked(table: pa.Table, name: str, running: bool = False) -> list[np.ndarray]:
    return [np.cumsum(unpack_array(x), dtype=np.uint64) if running else unpack_array(x) for x in table.column(name).to_pylist()]


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some owners' blobs, their summed counts, the place of every key in them, and where owners end."""
    keys = _unpacked(table, "keys", True)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(_unpacked(table, "counts")).astype(np.float64), len(distinct)).astype(np.uint64)
    return distinct, total, at, np.cumsum([len(k) for k in keys])[:-1]


def _key(table: pa.Table, *names: str) -> tuple[int, ...]:
    return tuple(table.column(x)[0].as_py() for x in names)


def _add_up(table: pa.Table) -> pa.Table:
    """Sums of a range; each owner gets them in the order of its keys, and the range's totals."""
    n, bucket = _key(table, "n", "bucket")
    _, total, at, ends = _added(table)
    sums = int(total.sum()), int((total > 0).sum())
    return _table(_SUMS, [(o, n, bucket, *sums, pack_array(x)) for o, x in zip(table.column("owner").to_pylist(), np.split(total[at], ends), strict=True)])


def _merge(fan: int, buckets: int):
    """One team's blobs of a range as the blobs of one owner, for ranges ``fan`` times as small; there are ``buckets`` of these."""

    def run(table: pa.Table) -> pa.Table:
        n, bucket, team = _key(table, "n", "bucket", "team")
        keys, total, _, _ = _added(table)
        return _table(_BLOBS, _blobs(team, n, keys, total, bucket * fan, bucket * fan + fan, buckets))

    return run


def _hand_down(table: pa.Table, sums: pa.Table) -> pa.Table:
    """The sums that a team got, for each of its owners."""
    if not table.num_rows:
        return _table(_SUMS, [])
    n, bucket = _key(table, "n", "bucket")
    _, _, at, ends = _added(table)
    sums = sums.sort_by("bucket")
    total = np.concatenate(_unpacked(sums, "counts"))
    parts = [sum(sums.column(x).to_pylist()) for x in ("total", "distinct")]
    return _table(_SUMS, [(o, n, bucket, *parts, pack_array(x)) for o, x in zip(table.column("owner").to_pylist(), np.split(total[at], ends), strict=True)])


def corpus_sums(blobs: DataFrame, owners: int, fan: int, direct: int, buckets: int | None = None) -> DataFrame:
    """The corpus counts of every owner's n-grams, range by range, with the totals of the range."""
    buckets = buckets or fan
    if owners <= direct:
        return blobs.groupBy("n", "bucket").applyInArrow(_add_up, _SUMS)
    key = ["n", "bucket", "team"]
    teamed = blobs.withColumn("team", F.floor(F.col("owner") / fan).cast("long"))
    merged = teamed.groupBy(*key).applyInArrow(_merge(fan, buckets * fan), _BLOBS)
    sums = corpus_sums(merged, -(-owners // fan), fan, direct, buckets * fan)
    back = sums.withColumnRenamed("owner", "team").select("n", F.floor(F.col("bucket") / fan).cast("long").alias("range"), "team", "bucket", "total", "distinct", "counts")
    return teamed.groupBy(*key).cogroup(back.groupBy("n", "range", "team")).applyInArrow(_hand_down, _SUMS)


class Automaton:
    """States, arcs and failure arcs for the n-grams of a chunk.

    State 0 has no context.  For each length of context there follows a block of states, one for each distinct n-gram of the
    chunk and a last one for the start of a text.  Arcs are sorted by (state, word).
    """

    def __init__(self, chunk: _Chunk, counts: dict[int, np.ndarray], total: int, distinct: int, contexts: tuple[tuple[float, float], ...], discount: float):
        first, n_docs = chunk.starts, counts[1][chunk.at[1][chunk.ends[:1]]]
        self.word, self.words = chunk.at[1], len(counts[1])
        known = counts[1] > 0
        unknown = (discount * distinct + 1) / (total + 1)
        p = np.where(known, (counts[1] - discount) / (total + 1), unknown)
        self.bottom = np.log10(p)
        # blocks of states by length of context
        base = 1 + np.cumsum([0] + [len(counts[n]) + 1 for n in range(1, len(contexts) + 1)])
        self.start = int(base[-1]) - 1 if contexts else 0
        self.bottom_next = np.where(known, 1 + np.arange(self.words), 0) if contexts else np.zeros(self.words, np.int64)
        self.fail = np.zeros(base[-1], np.int64)
        self.fail_log = np.zeros(base[-1])
        arcs, logs, nexts = [], [], []
        lower = p[self.word]  # at every token, its probability after the shorter context
        for m, (kappa, power) in enumerate(contexts, 1):
            seen = np.append(counts[m], n_docs)
            some = np.empty(len(counts[m]), np.int64)
            some[chunk.at[m]] = np.arange(len(self.word))  # a token at which each n-gram ends
            if m > 1:  # without its first word
                self.fail[base[m - 1] : base[m] - 1] = base[m - 2] + chunk.at[m - 1][some]
                self.fail[base[m] - 1] = base[m - 1] - 1
            trust, doubt = (x / (seen**power + kappa) for x in (seen**power, kappa))
            self.fail_log[base[m - 1] : base[m]] = np.log10(doubt)
            own = np.roll(chunk.at[m], 1)  # the context of each token, within its block
            own[first] = len(counts[m])
            follows = np.empty(len(counts[m + 1]), np.int64)
            follows[chunk.at[m + 1]] = np.arange(len(self.word))
            c = counts[m + 1]
            h = own[follows]
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.where(c > 0, trust[h] * c / seen[h], 0) + doubt[h] * lower[follows]
            lower = q[chunk.at[m + 1]]
            taken = c > 0
            arcs.append(((base[m - 1] + h) * self.words + self.word[follows])[taken])
            logs.append(np.log10(q[taken]))
            # the longest known context after this arc: the n-gram itself if it is short enough, else its last words
            nexts.append((base[m] + np.arange(len(c)) if m < len(contexts) else base[m - 1] + chunk.at[m][follows])[taken])
        arc = np.concatenate([np.empty(0, np.int64), *arcs])
        order = np.argsort(arc, kind="stable")
        self.arc, self.log, self.next = arc[order], np.concatenate([np.empty(0), *logs])[order], np.concatenate([np.empty(0, np.int64), *nexts])[order]
        self.depth = len(contexts)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one word each, and the log10 probabilities of the words."""
        state, log = state.copy(), np.zeros(len(state))
        out = np.empty(len(state), np.int64)
        left = np.arange(len(state))
        for _ in range(self.depth):
            key = state[left] * self.words + word[left]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1) if len(self.arc) else np.zeros(len(left), np.int64)
            hit = (self.arc[at] == key) & (state[left] > 0) if len(self.arc) else np.zeros(len(left), bool)
            log[left[hit]] += self.log[at[hit]]
            out[left[hit]] = self.next[at[hit]]
            left = left[~hit]
            log[left] += self.fail_log[state[left]]
            state[left] = self.fail[state[left]]
        log[left] += self.bottom[word[left]]
        out[left] = self.bottom_next[word[left]]
        return out, log

    def walk(self, starts: np.ndarray, sizes: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of every token, texts being walked in stretches side by side."""
        many = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), many)
        skip = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stretch
        early = np.minimum(skip, self.depth)  # words walked to get to the state
        long = np.minimum(sizes[text] - skip, stretch) + early
        order = np.argsort(-long, kind="stable")
        at, long, early = (starts[text] + skip - early)[order], long[order], early[order]
        state = np.where(early < self.depth, self.start, 0) if self.depth else np.zeros(len(at), np.int64)
        logs = np.empty(len(self.word))
        active = len(at)
        for k in range(int(long[0])):
            while long[active - 1] <= k:
                active -= 1
            state, log = self.step(state[:active], self.word[at[:active] + k])
            counts = k >= early[:active]
            logs[at[:active][counts] + k] = log[counts]
        return logs


def _walk(contexts: tuple[tuple[float, float], ...], discount: float, marked: bool = False):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names, kinds = names + ["mark"] * marked, kinds + [pa.string()] * marked

    def run(texts: pa.Table, sums: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        chunk = _Chunk(texts, len(contexts) + 1)
        got: dict[int, list] = {}
        total = distinct = 0
        for b, n, t, d, c in sorted(zip(*(sums.column(x).to_pylist() for x in ("bucket", "n", "total", "distinct", "counts")), strict=True)):
            got.setdefault(n, []).append(unpack_array(c))
            if n == 1:
                total, distinct = total + t, distinct + d
        counts = {n: np.concatenate(got.pop(n)).astype(np.float64) for n in list(got)}
        c = counts[1][chunk.at[1]]
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        logs = Automaton(chunk, counts, total, distinct, contexts, discount).walk(chunk.starts, chunk.sizes)
        add = lambda x: np.add.reduceat(x, chunk.starts)
        out = [chunk.ids.combine_chunks(), chunk.held, chunk.sizes, add((c > 0).astype(np.int64)), np.full(len(chunk.sizes), total), add(base), add(logs)]
        if marked:
            out.append(pa.array([md5(t.encode()).hexdigest() if c > 1 else None for t, c in zip(texts.column("text").to_pylist(), chunk.copies)], pa.string()))
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, contexts: tuple[tuple[float, float], ...] = CONTEXTS, discount: float = 0.5, chunk_bytes: int = 8 << 20, fan: int = 64, direct: int = 256) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Documents for which ``held_out`` (a column of ``docs``; by default :func:`is_held_out`) is false are learned from.
    ``contexts`` has (kappa, power) for contexts of one word and longer ones.  ``chunk_bytes`` is the text dealt to one chunk; a chunk's
    tokens must fit a Python worker.

    Null or empty text: the end token alone.  Repeated rows each count and each get a row, however many they are.  A null id is dealt and judged
    as the empty text and its row has a null doc_id.  Without any training text all counts are 0 and scores stay finite.
    An empty table gives an empty result.  Only the named columns are read, so further columns may have any name.
    """
    held = is_held_out(F.col(id_col)) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    known_by = F.xxhash64("doc_id", F.lit("chunk"), "text")
    alike = rows.groupBy(known_by.alias("known_by")).agg(F.count("*").alias("copies"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    size, most = alike.agg(F.sum("bytes"), F.max(F.when(F.col("copies") > 1, F.col("bytes")))).first()
    chunks = max(8, -(-(size or 0) // chunk_bytes))
    if (most or 0) * 8 <= chunk_bytes:
        return _scored(rows, chunks, contexts, discount, fan, direct)
    # at most eight such groups to a chunk's worth of text
    groups = save(alike.where((F.col("copies") > 1) & (F.col("bytes") * 8 > chunk_bytes)).select("known_by"), "alike")
    small = F.broadcast if groups.count() <= _BROADCAST else lambda table: table
    rows = rows.withColumn("known_by", known_by)
    many = rows.join(small(groups), "known_by", "left_semi").drop("known_by")
    once = many.groupBy("doc_id", "text", "held_out").agg(F.count("*").alias("copies"))
    single = rows.join(small(groups), "known_by", "left_anti").drop("known_by").withColumn("copies", F.lit(1).cast("long"))
    scored = save(_scored(single.union(once), chunks, contexts, discount, fan, direct, marked=True), "scores")
    own, names = scored.where("mark IS NULL").drop("mark"), scored.columns[:-1]
    shared = scored.where("mark IS NOT NULL").withColumnRenamed("doc_id", "id").withColumnRenamed("held_out", "held")
    each = many.select("doc_id", "held_out", F.md5("text").alias("text_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("held_out") == F.col("held")) & (F.col("text_mark") == F.col("mark"))
    return own.union(each.join(small(shared), same).select(*names))


def _scored(rows: DataFrame, chunks: int, contexts: tuple[tuple[float, float], ...], discount: float, fan: int, direct: int, marked: bool = False) -> DataFrame:
    """Scores of ``rows``; ``marked`` adds mark, the MD5 of the text of a row that stands for several and null for others."""
    deal = F.pmod(F.xxhash64("doc_id", F.lit("chunk"), "text"), F.lit(chunks)).cast("long")
    dealt = rows.withColumn("chunk", deal).repartition(chunks, "chunk")
    blobs = dealt.groupBy("chunk").applyInArrow(_count(len(contexts) + 1, fan), _BLOBS)
    sums = corpus_sums(blobs, chunks, fan, direct)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", mark string" * marked
    return dealt.groupBy("chunk").cogroup(sums.groupBy("owner")).applyInArrow(_walk(tuple(contexts), discount, marked), out)
