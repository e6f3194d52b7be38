"""Sequence packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: full pieces of ``longest`` ids, then the binary digits
of what is left, longest first.  Every piece is a sequence of its own and pieces of one length form a bucket, so a batch is
drawn from one bucket, no sequence holds two documents and nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.text import column_bytes, giving_back, in_parts

_encoders: dict[tuple[str, bool], object] = {}


def _byte_alphabet() -> dict[str, int]:
    """Printable characters that byte-level vocabularies write for bytes: themselves, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, plain_text: bool = False):
    """Function from texts to lists of ids for the tokenizer file at ``path``, the ids that ``tokenizers`` gives.

    A special token's string in a text gives that token's id, as there; with ``plain_text`` it is ordinary text.

    Byte-level BPE files with the common word pattern are run by tiktoken, which gives the same ids about five times as
    fast; any other file by tokenizers itself.
    """
    key = path, plain_text
    if key in _encoders:
        return _encoders[key]
    spec = json.load(open(path, encoding="utf-8"))
    before, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    exact = all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
    if level and exact and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout"):
        import tiktoken

        alphabet, vocab = _byte_alphabet(), model["vocab"]
        ranks = {bytes([alphabet[c]]): vocab[c] for c in alphabet}
        ordered = True
        last = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ordered &= vocab[a + b] > last  # ids stand in merge order
            last = vocab[a + b]
            ranks[bytes(alphabet[c] for c in a + b)] = last
        if ordered:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            special = {} if plain_text else {x["content"]: x["id"] for x in added}
            parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

            def encode(text: str) -> list[int]:
                if not any(x in text for x in special):
                    return fast(text)
                return [i for part in parts.split(text) for i in ([special[part]] if part in special else fast(part))]

            _encoders[key] = encode
            return encode
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = plain_text
    _encoders[key] = lambda text: slow.encode(text, add_special_tokens=False).ids
    return _encoders[key]


def piece_lengths(n: int, longest: int) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, end_id: int, longest: int, with_ids: bool, plain_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(path, plain_text), []
        for batch in in_parts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                ids = np.append(np.array(encode(text.decode()) if text else [], "<u4"), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in piece_lengths(len(ids), longest):
                    piece = ids[start : start + n]
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), n.bit_length() - 1, piece.astype(np.int32))[: len(schema)])
                    start += n
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, longest: int = 2048, with_ids: bool = True, plain_text: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket, [ids,] sequence_id, offset.

    ``bucket`` is the exponent of the length; ``longest`` must be a power of two.  ``sequence_id`` is unique and each sequence
    is one piece, so ``offset`` is 0.  ``tokenizer_path`` must be readable on the executors.  A special token's string in a text
    gives its id unless ``plain_text``.

    Null or empty text: the end id alone.  Repeated rows and null ids are packed like any other row.  A text of any length
    is tokenized whole; an empty table gives an empty result.  Only the two named columns are read, so further columns may
    have any name.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, end_id, longest, with_ids, plain_text), kinds).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
