"""Toxicity: a factorization machine over hashed terms.

    logit(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

Terms are lower-cased words and their stems (first bytes), hashed into 2**bits slots; x_i is 1 if a slot occurs in the text.  The factors let two terms count
together that mean little alone, such as an insult and the mention of a group.  Slots whose presence tells nothing about the
label (likelihood ratio under ``least_g``) are left out, which keeps the pair terms of long texts quiet.

The model is fitted on the driver from a bounded sample: the ``sample`` labelled documents that come first in the order
of a hash of their id.  Scoring reads every text whole, and the model is a few thousand numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflux.llm.text import alnum_words, column_bytes, give_back, giving_back, hashes, in_parts

#: Lengths in bytes of the stems that count as terms beside whole words, so that unseen forms of a known word are caught.
STEMS = (3, 4, 5)


@dataclass
class Model:
    bits: int
    slots: np.ndarray  # sorted slot numbers
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, owner: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """owner, at: row and position in ``slots`` of each term that occurs, once a row."""
        out = self.bias + np.bincount(owner, self.weights[at], rows)
        for v in self.factors.T:
            x = v[at]
            out += 0.5 * (np.bincount(owner, x, rows) ** 2 - np.bincount(owner, x * x, rows))
        return out


def is_held_out(id_col: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _slots(text: bytes | None, bits: int) -> np.ndarray:
    """Slots of all terms of a text, repeats included: words, and what longer words begin with."""
    words = set(alnum_words(text))
    terms = [*words, *{w[:n] + b"*" for w in words for n in STEMS if len(w) > n}]
    return (hashes(terms) >> np.uint64(64 - bits)).astype(np.int64)


def _terms(text: bytes | None, bits: int) -> np.ndarray:
    return np.unique(_slots(text, bits))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [_terms(t, bits).astype("<i4").tobytes() for t in column_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary())], ["doc_id", "label", "terms"])

    return run


def train(y: np.ndarray, docs: Sequence[np.ndarray], bits: int, rank: int, least_g: float, rounds: int, seed: int = 7, miss: float = 3.0) -> Model:
    """Adam on the logistic loss over all documents at once; ``docs`` has the distinct slots of each.

    Slots are counted and chosen document by document, so only the chosen ones are ever held as one array.  A document labelled 1 weighs
    ``miss`` times as much as another: to miss it is that much worse than a false alarm.
    """
    rows, eps = len(y), 1e-9
    n, pos = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for label, terms in zip(y, docs, strict=True):
        n[terms] += 1
        if label > 0.5:
            pos[terms] += 1
    slots = np.flatnonzero(n >= 3)
    n, pos = n[slots].astype(float), pos[slots].astype(float)
    rate = y.mean() if rows else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)

    def g(k, n, p):
        k0 = n - k
        return 2 * (k * np.log((k + eps) / (n * p + eps)) + k0 * np.log((k0 + eps) / (n * (1 - p) + eps)))

    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = g(pos, n, rate) + g((y > 0.5).sum() - pos, rows - n, rate)
    slots = slots[ratio >= least_g]
    m = len(slots)
    place = np.full(1 << bits, -1, np.int32)
    place[slots] = np.arange(m)
    found = [x[x >= 0] for x in (place[terms] for terms in docs)]
    owner, at = np.repeat(np.arange(rows), [len(x) for x in found]), np.concatenate([np.empty(0, np.int32), *found])
    del place, n, pos, ratio, found
    rng = np.random.default_rng(seed)
    theta = [np.array([np.log(miss * rate / (1 - rate))]), np.zeros(m), rng.normal(0, 0.03, (m, rank))]
    first, second = ([np.zeros_like(x) for x in theta] for _ in range(2))
    shrink, step = (0.0, 3e-5, 3e-4), 0.05
    weight = np.where(y > 0.5, miss, 1.0)
    for t in range(1, rounds + 1 if rows and m else 1):
        model = Model(bits, slots, float(theta[0][0]), theta[1], theta[2])
        p = 1 / (1 + np.exp(-model.logits(owner, at, rows)))
        err = (p - y) * weight / rows
        gw = np.bincount(at, err[owner], m)
        gv = np.empty_like(theta[2])
        for f in range(rank):
            x = theta[2][at, f]
            s = np.bincount(owner, x, rows)
            gv[:, f] = np.bincount(at, err[owner] * (s[owner] - x), m)
        for i, grad in enumerate((np.array([err.sum()]), gw, gv)):
            grad = grad + shrink[i] * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            theta[i] = theta[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model(bits, slots.astype(np.int64), float(theta[0][0]), theta[1], theta[2])


def _in_place(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The slots of each document as they lie in what has been collected: the driver holds them once."""
    found = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        body = np.frombuffer(data or b"", np.uint8)
        found += [body[low:high].view("<i4") for low, high in zip(ends, ends[1:])]
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, sample: int = 20_000, bits: int = 22, rank: int = 4, least_g: float = 12.0, rounds: int = 300, miss: float = 3.0) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out (see :func:`is_held_out`).

    A document with several labels has the largest; null labels and ids are left out, as are labels without a document.
    Of several texts of an id the one with the least terms, in the order of their bytes, is used.  Without usable labels the score is 0.5 everywhere.
    """
    held = is_held_out(F.col("doc_id")) if held_out is None else held_out
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null").where(~held)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most ``sample`` pairs of numbers
    terms = rows.mapInArrow(_features(bits), "doc_id long, label double, terms binary")
    got = terms.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("terms").alias("terms")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    terms = _in_place(got.column("terms"))
    try:
        return train(got.column("label").to_numpy().astype(float)[order], [terms[i] for i in order], bits, rank, least_g, rounds, miss=miss)
    finally:
        del got, terms
        give_back()


def _scores(model: Model):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << model.bits, -1, np.int32)
        place[model.slots] = np.arange(len(model.slots))
        for batch in in_parts(batches):
            owner, at = [], []
            for i, text in enumerate(column_bytes(batch.column(1))):
                found = place[_slots(text, model.bits)]
                found = np.unique(found[found >= 0])
                owner.append(np.full(len(found), i))
                at.append(found)
            empty = np.empty(0, np.int64)
            z = model.logits(np.concatenate([empty, *owner]), np.concatenate([empty, *at]), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without known terms.  Repeated rows and null ids are scored like any other
    row; an empty table gives an empty result.  Only the two named columns are read.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _judge(model: Model, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts = itertools.tee(in_parts(batches))
        two = (pa.RecordBatch.from_arrays([b.column(text_at), b.column(text_at)], ["doc_id", "text"]) for b in texts)
        for batch, got in zip(rows, _scores(model)(two)):
            yield batch.filter(pa.array(got.column(1).to_numpy() < threshold))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, all columns unchanged, without a shuffle."""
    return docs.mapInArrow(_judge(model, threshold, docs.columns.index(text_col)), docs.schema)
