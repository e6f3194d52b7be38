"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; tagged expressions are parsed.

The automaton runs over the words of a text (A-Z lower-cased, other characters cut), so line breaks and punctuation inside a
notice do not matter.  Where it finds an identifier tag, the rest of that line of the original text is read as a licence
expression by a shunting-yard parser with the operators ``with`` (binds tightest), ``and`` and ``or``, and evaluated: whether
permissive licences alone suffice to comply.  A comma ends an expression and begins another.  All steps are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.text import _ALNUM, column_bytes

#: Base phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases, as word sequences.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "cc0": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
#: Identifier tag, as words of the text.
TAG = "spdx license identifier"
_TOKEN = re.compile(r"[()]|[^\s()]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
#: What the names of known licences begin with, before a version.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "cc-by", "cc0", "mit", "mpl", "epl", "bsd", "bsl", "isc", "unlicense", "zlib", "0bsd", "artistic", "cddl", "eupl", "ofl", "wtfpl", "python", "psf", "postgresql", "openssl", "ms-pl")
#: Families whose licences ask for no more than a notice.
PERMISSIVE = frozenset({"apache", "cc-by", "cc0", "mit", "bsd", "bsl", "isc", "unlicense", "zlib", "0bsd", "wtfpl", "python", "psf", "postgresql", "openssl"})


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order, operators and names lower-cased; None if it is malformed.

    >>> parse_expression("MIT OR (Apache-2.0 AND GPL-2.0 WITH x)")
    ['mit', 'apache-2.0', 'gpl-2.0', 'x', 'with', 'and', 'or']
    """
    out, waiting, want_name = [], [], True
    for token in _TOKEN.findall(text.lower()):
        if token == "(" and want_name and not (waiting and waiting[-1] == "with"):
            waiting.append(token)
        elif token == ")" and not want_name:
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _STRENGTH and not want_name:
            while waiting and _STRENGTH.get(waiting[-1], 0) >= _STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            want_name = True
        elif token not in _STRENGTH and token not in ("(", ")") and want_name:
            out.append(token)
            want_name = False
        else:
            return None
    if want_name or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[str, list[str], bool]:
    """Normal form of a parsed expression, the licences that it names, and whether permissive ones alone suffice to comply.

    Work is linear in the expression: nothing is multiplied out.
    """
    names, truth, trees = [], [], []
    for token in postfix:
        if token not in _STRENGTH:
            trees.append(token)
            truth.append(family(token) in PERMISSIVE)
            names.append(token)
            continue
        b, a = trees.pop(), trees.pop()
        y, x = truth.pop(), truth.pop()
        trees.append((token, a, b))
        if token == "with":  # an exception belongs to its licence and is none itself
            names.pop()
        truth.append(x if token == "with" else x and y if token == "and" else x or y)
    out, todo = [], [trees[0]]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node[0] == "with":
            todo += [node[2], " with ", node[1]]
        else:
            todo += [")", node[2], f" {node[0]} ", node[1], "("]
    return "".join(out), names, truth[0]


def family(name: str) -> str | None:
    """Label of a licence identifier, e.g. gpl for GPL-2.0-only; None for a name of no known family."""
    for start in FAMILIES:
        if name == start or name.startswith(start + "-"):
            return re.match(r"cc-by(-nc|-sa|-nd)*", name)[0] if start == "cc-by" else start
    return None


def _tagged(raw: str) -> str:
    """The expression on a tag's line: what follows the colon, without comment ends."""
    return re.sub(r"(\*/|-->|#}|\"|;)\s*$", "", raw.strip()).strip()


_TAG_LINE = re.compile(r"spdx[^0-9a-z\n\x80-\U0010ffff]+license[^0-9a-z\n\x80-\U0010ffff]+identifier[^\S\n]*:?([^\n]*)", re.I | re.A)


def scan_text(text: bytes | None, automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions, permissive, score of a UTF-8 text."""
    words = (text or b"").translate(_ALNUM).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last, base, labels, tags = 0, None, None, set(), set(), 0
    at = word = 0
    for end, (kind, label, size) in automaton.iter(line):
        begin = end - size + 1
        if kind == "tag":
            tags += 1
        else:
            labels.add(label)
        if kind == "base":
            # ends come in order, starts nearly so: count the words between
            word += line.count(" ", at, begin) if begin >= at else -line.count(" ", begin, at)
            at = begin
            n_base += 1
            first, last = word if first is None else min(first, word), word if last is None else max(last, word)
            base.add(label)
    expressions, verdicts = [], []
    if tags:
        for part in (x for raw in _TAG_LINE.findall(text.decode()) for x in _tagged(raw).split(",")):
            parsed = parse_expression(part)
            if parsed:
                normal, names, permissive = evaluate(parsed)
                expressions.append(normal)
                verdicts.append(permissive)
                labels |= {family(name) or "other" for name in names}
    score = 1 - 0.1 ** len(expressions) * 0.5 ** (n_base > 0) * 0.6 ** (len(labels - base))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), sorted(set(expressions)), all(verdicts) if verdicts else None, float(score)


def build_automaton():
    automaton = ahocorasick.Automaton()
    for phrases, kind in ((MORE, "more"), (BASE, "base"), ({TAG: ""}, "tag")):
        for phrase, label in phrases.items():
            automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    automaton.make_automaton()
    return automaton


_FIELDS: Mapping[str, pa.DataType] = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "expressions": pa.list_(pa.string()), "permissive": pa.bool_(), "score": pa.float64()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = build_automaton()
    for batch in batches:
        rows = [scan_text(text, automaton) for text in column_bytes(batch.column(1))]
        columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True))], ["doc_id", *_FIELDS])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, permissive, score.

    Base columns count every place of a :data:`BASE` phrase, overlapping ones too; word positions start at 0.  ``labels`` adds
    those of :data:`MORE` and of tagged expressions (a licence of no family in :data:`FAMILIES`: other); ``expressions`` has their normal
    forms and ``permissive`` says whether permissive licences suffice for all of them (null without any).  What is no expression
    after a tag gives nothing.  ``score`` grows from 0 (nothing found) towards 1 with well-formed tags, notices and further labels.

    Null or empty text: no words, empty labels, null positions, score 0.  Repeated rows and null ids are scanned like any
    other row; an empty table gives an empty result.  Only the two named columns are read, so further columns may have any
    name.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permissive boolean, score double")
