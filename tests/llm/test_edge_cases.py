"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopflux.llm import decontamination, fingerprints, language_model, licenses, line_dedup, mixing, neardup, packing, sharding, toxicity, warc
from hopflux.llm.queries import tokenizer_path
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept boolean, a long, b long, v long, component long, th long, kid long, id long, term long, pos int, word string, score double, shard int, chunk int"
LONG = " ".join(f"w{i % 997}x{i % 1009}" for i in range(30_000))
NOTE = "The Apache License and the MIT-License, apache license.\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n"
TEXTS = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  TWO"), (6, "é É ÀÉ a"), (7, LONG), (8, LONG), (8, LONG), (None, "one two"), (None, None), (9, NOTE), (10, "line one\n\nline two\n")]
EMPTY: list = []


def frame(spark, rows):
    width = len(SCHEMA.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - 2)) for r in rows], SCHEMA)


BENCH = [(1, "one two"), (2, None), (3, ""), (None, "w1x1"), (4, "w5x5 w6x6 w7x7"), (4, "apache license")]
OPERATORS = {
    "neardup": lambda d, s: neardup.near_duplicates(d),
    "pack": lambda d, s: packing.pack(d, tokenizer_path()),
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "lines": lambda d, s: line_dedup.dedup_lines(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(4, 1), (6, 0), (9, None), (None, 1), (4, 0)], "doc_id long, toxic int"))),
    "fingerprints": lambda d, s: fingerprints.fingerprint_edits(d),
    "shards": lambda d, s: sharding.shard(d, {0: 1.0, 1: 2.0}, more={0: 1.0, 1: 2.0, 2: 1.0}),
    "warc": lambda d, s: warc.derivatives(d, "doc_id", "source", "text"),
    "decontamination": lambda d, s: decontamination.contamination(d, s.createDataFrame(BENCH, "item_id long, text string")),
    "language_model": lambda d, s: language_model.score_texts(d),
    "mixing": lambda d, s: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [TEXTS, EMPTY, [(None, None)]], ids=["odd", "empty", "null"])
def test_no_row_is_lost(spark, name, rows):
    got = OPERATORS[name](frame(spark, rows), spark)
    ids = [r[0] for r in got.select("page_id" if name == "warc" else "doc_id").collect()]
    if name == "pack":
        assert set(ids) == {i for i, _ in rows}
    else:
        times = 3 if name == "warc" else 1
        assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows for _ in range(times))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_near_duplicates_of_odd_rows(spark):
    got = rows_of(neardup.near_duplicates(frame(spark, TEXTS)), "doc_id", "n_shingles", "component_id", "kept")
    w = brute.space_words(LONG)
    n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (7, n, 7, True), (8, n, 7, False), (8, n, 7, False), (None, 1, 4, False), (None, 0, None, True)]
    assert [r for r in got if r[0] not in (6, 9, 10)] == sorted(want, key=str)


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


def test_long_lists_lose_no_link(spark):
    """A large group of near copies, a line in half of all documents, short texts; lists turn long early."""
    rng = random.Random(3)
    word = lambda: f"t{rng.randrange(4000)}"
    line = " ".join(word() for _ in range(12))
    texts = near_copies(rng, [word() for _ in range(120)], 150, 6) + near_copies(rng, [word() for _ in range(60)], 40, 3)
    texts += [" ".join([line, *(word() for _ in range(rng.randint(3, 60)))]) for _ in range(120)]
    texts += [" ".join("abcdefgh"[: rng.randint(1, 8)]) for _ in range(60)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r[0]: (r[1], r[2]) for r in rows_of(neardup.near_duplicates(frame(spark, docs), cold=8, block=40), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("edits, block", [(6, 16), (14, 16), (14, 40)])
def test_large_groups_lose_no_link(spark, edits, block):
    """Groups of many blocks: tight ones, and loose ones that fall into many parts."""
    rng = random.Random(edits)
    word = lambda: f"t{rng.randrange(4000)}"
    texts = near_copies(rng, [word() for _ in range(100)], 220, edits) + near_copies(rng, [word() for _ in range(70)], 60, edits)
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r[0]: (r[1], r[2]) for r in rows_of(neardup.near_duplicates(frame(spark, docs), cold=4, block=block), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(docs)


def test_intersections_match_sets():
    import numpy as np

    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(5000), rng.randint(1, 900)))) for _ in range(12)]
    got = neardup.intersections(sets[:5], sets[5:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[5:]] for a in sets[:5]]
    both = neardup.intersections(sets, sets)
    assert all(both[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(12) for j in range(12) if i != j)


def test_components_of_chains_and_hubs(spark):
    from hopflux.llm.components import components

    rng = random.Random(2)
    order = list(range(40))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_workers_give_back_what_they_have_freed(monkeypatch):
    import pyarrow as pa

    from hopflux.llm import text

    page = os.sysconf("SC_PAGE_SIZE")
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * page
    last = []

    @text.giving_back
    def run(batches):
        many = [bytes(3000) for _ in range(60_000)]
        last.append(bytes(3000))  # keeps the end of the heap in use
        yield len(many)

    before = resident()
    assert list(run(iter([]))) == [60_000]
    assert resident() - before < 60_000_000, "180 MB were freed"

    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1))
    texts = [f"word{i} " * 50 for i in range(3000)]
    two = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": texts})
    three = pa.RecordBatch.from_pydict({"doc_id": range(3000), "t": range(3000), "text": texts})
    model = toxicity.train(np.array([0.0, 1.0] * 20), [np.array([i % 2], "<i4") for i in range(40)], 22, 4, 0.0, 10)
    for step, batch in ((neardup._signatures(64, 5), three), (line_dedup._fingerprints(30, 40), three), (toxicity._scores(model), two), (toxicity._judge(model, 2.0, 1), two), (packing._pieces(tokenizer_path(), 1, 2048, True, False), two)):
        calls.clear()
        assert sum(b.num_rows for b in step(iter([batch]))) > 0
        assert calls == [1]
    judged = list(toxicity._judge(model, 2.0, 1)(iter([two])))
    assert max(b.num_rows for b in judged) <= 1024 and [i for b in judged for i in b.column(0).to_pylist()] == list(range(3000))


def test_piece_lengths():
    for n in [1, 2, 3, 100, 2047, 2048, 2049, 5000]:
        parts = packing.piece_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
    with pytest.raises(ValueError):
        packing.pack(None, "x", longest=100)


def test_license_labels_and_expressions(spark):
    r = licenses.scan_licenses(frame(spark, TEXTS)).where("doc_id = 9").first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 1, 7, "apache,mit")
    assert r["labels"] == "apache,gpl,mit" and r["expressions"] == ["((mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0)"]
    assert licenses.parse_expression("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    for bad in ("", "and a", "a b", "(a", "a)", "a or", "()"):
        assert licenses.parse_expression(bad) is None
    assert licenses.evaluate(licenses.parse_expression("(mit or gpl-3.0) and isc with x")) == ("((mit or gpl-3.0) and isc with x)", ["mit", "gpl-3.0", "isc"], True)
    assert not licenses.evaluate(licenses.parse_expression("mit and gpl-3.0"))[2] and licenses.parse_expression("a with (b)") is None
    automaton = licenses.build_automaton()
    for text in ("mit license mit license", "gnu general public license apache license cc by", "MIT\nLICENSE", "smit license", "Cc-By-NC and cc by"):
        assert licenses.scan_text(text.encode(), automaton)[:5] == brute.licenses(text)


@pytest.mark.parametrize("rest, labels, expressions", [("MIT,Apache-2.0", "apache,mit", ["apache-2.0", "mit"]), ("see the file", "", []), ("MIT or Nobody-1.0", "mit,other", ["(mit or nobody-1.0)"]), ("isc */", "isc", ["isc"])])
def test_what_follows_a_license_tag(rest, labels, expressions):
    got = licenses.scan_text(f"// SPDX-License-Identifier: {rest}\nMIT".encode(), licenses.build_automaton())
    assert got[5:7] == (labels, expressions)


def seconds(run, *args):
    import time

    start = time.process_time()
    run(*args)
    return time.process_time() - start


@pytest.mark.parametrize("text", [" and ".join(["(mit or b)"] * 80_000), "(" * 500_000 + "mit" + ")" * 500_000, "SPDX-License-" * 80_000, '" ' * 500_000, "spdx" + " " * 1_000_000 + "license", "," * 1_000_000], ids=range(6))
def test_license_scan_is_linear(text):
    automaton = licenses.build_automaton()
    assert seconds(licenses.scan_text, b"SPDX-License-Identifier: " + text.encode(), automaton) < 10


@pytest.mark.parametrize("unit", ["<p ", "<a x ", "<title>", "<!--", "<script>", "</script", '<a href="x', "<a '>\" ", '<a ">" ', '<a b="', "<", " \n", "&#x;", "<a b=c", "<![CDATA["])
def test_page_scan_is_linear(unit):
    assert seconds(warc.scan, unit * (1_000_000 // len(unit))) < 10 and seconds(warc.scan, "<a " + unit * (1_000_000 // len(unit)) + ">") < 10


def test_passages_inside_lines_are_found(spark):
    """Passages that begin and end inside lines of differing length, in chains and within one text."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(5000)}" + "." * (rng.random() < 0.1)
    passages = [" ".join(word() for _ in range(rng.choice([55, 70, 200]))) for _ in range(8)]
    docs = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((i, "".join(x + rng.choice([" ", "\n", "\n\n"]) for x in parts)))
    docs += [(90, docs[3][1]), (91, "\n".join([passages[0]] * 5)), (92, "so " * 300), (93, "and so " * 200)]
    after = sorted((r[0], r[1]) for r in line_dedup.dedup_lines(frame(spark, docs)).select("doc_id", "text").collect())
    assert brute.repeated_left(docs) and not brute.repeated_left(after, 40)
    assert {x for _, t in docs for x in t.split()} == {x for _, t in after for x in t.split()}
    had = brute.repeated_left(docs, 30, overlap=True)
    assert all(a == b for (i, a), (_, b) in zip(docs, after) if i not in had)


@pytest.mark.parametrize("words", [40, 45, 60, 80, 120])
def test_line_dedup_finds_passages_from_any_word_on(spark, words):
    """No sentence ends, no line ends: only the words tell where a passage begins.  Alone, and with earlier texts that share parts of it."""
    rng = random.Random(words)
    some = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    docs, later = [], {}
    for hidden in (False, True):
        for _ in range(100):
            passage, i = some(words), len(docs)
            parts = [passage[k : k + 29] for k in range(0, words - 10, 10)] if hidden else []
            texts = [*parts, passage, passage]
            docs += [(i + j, " ".join(some(rng.randrange(1, 60)) + x + some(rng.randrange(1, 60)))) for j, x in enumerate(texts)]
            later[docs[-1][0]] = set(passage)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert all(got[i] == t for i, t in docs if i not in later)
    assert all(not set(got[i].split()) & x for i, x in later.items())


@pytest.mark.parametrize("piece", [4, 16, 1 << 20])
def test_words_in_pieces(monkeypatch, piece):
    """Words, places and equal hashes of equal words, however the text is cut; words longer than a piece too."""
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    rng = random.Random(piece)
    known, texts = {}, [None, b""]
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t ", "longword", "x" * 20]) for _ in range(rng.randrange(40))).encode()
        texts.append(text)
        h, starts, ends = line_dedup.words_of(text)
        assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
        for w, x in zip(text.split(), h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    for text, (h, starts, ends) in zip(texts, line_dedup.words_of_all(texts), strict=True):
        assert [text[a:b] for a, b in zip(starts, ends)] == (text or b"").split() and h.tolist() == [known[w] for w in (text or b"").split()]


def test_line_dedup_sends_what_a_match_can_reach():
    """A long first text and short later ones: only stretches as long as these, and with them the same words are cut."""
    import pyarrow as pa

    rng = random.Random(8)
    first = [f"x{rng.randrange(40)}" for _ in range(3000)]
    kinds = pa.schema([("_kid", pa.int64()), ("_matches", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())]))), ("_most", pa.int32()), ("text", pa.string())])
    for _ in range(40):
        n = rng.randrange(5, 60)
        own = [f"y{i}" for i in range(n)]
        matches = []
        for _ in range(rng.randrange(1, 5)):
            p, q, size = rng.randrange(n), rng.randrange(2900), rng.randrange(1, 30)
            own[p : p + size] = first[q : q + size][: n - p]
            matches.append({"p": p, "q": q})
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([matches], kinds.field(1).type), pa.array([n + 3], pa.int32()), pa.array([" ".join(first)])], schema=kinds)
        rows = [r for b in line_dedup._slices(["_kid", "_matches", "text"], "text")(iter([batch])) for r in b.to_pylist()]
        h = lambda w: line_dedup.words_of(" ".join(w).encode())[0]
        runs = lambda f, m: line_dedup.later_runs(h(own), h(f), [(x["p"], x["q"]) for x in m], 3)
        got = line_dedup.merge([s for r in rows for s in runs(r["text"].split(), r["_matches"])])
        assert got == line_dedup.merge(runs(first, matches)) and sum(len(r["text"].split()) for r in rows) <= len(matches) * (n + 3)


def test_line_dedup_of_copies(spark):
    """Copies of whole texts, with ids in any order; repeated rows are one document."""
    rng = random.Random(12)
    some = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    long, short = some(50), some(20)
    docs = [(5, long), (5, long), (3, long), (9, long), (None, long), (4, short), (6, short), (7, "new " + long)]
    got = rows_of(line_dedup.dedup_lines(frame(spark, docs)), "doc_id", "text", "cut_words")
    assert got == sorted([(3, long, 0), (5, "", 50), (5, "", 50), (9, "", 50), (None, "", 50), (4, short, 0), (6, short, 0), (7, "new", 50)], key=str)


def test_line_dedup_of_one_word(spark):
    """Matches on very many diagonals: each but the first lies inside the first one's run."""
    docs = [(1, "a " * 20_000), (2, "b " + "a " * 70 + "c")]
    assert {r["doc_id"]: r["cut_words"] for r in line_dedup.dedup_lines(frame(spark, docs)).collect()} == {1: 19_999, 2: 70}


def test_cutting_words_keeps_the_lines_around():
    text = b"a b\nc d e\n\nf g\nh"
    for spans, want in (([(2, 5)], b"a b\nf g\nh"), ([(3, 5)], b"a b\nc\n\nf g\nh"), ([(0, 2)], b"c d e\n\nf g\nh"), ([(7, 8)], b"a b\nc d e\n\nf g\n"), ([(0, 8)], b""), ([(1, 3)], b"a d e\n\nf g\nh"), ([(0, 1), (4, 6)], b"b\nc d g\nh")):
        assert line_dedup.without(text, spans) == want
    assert line_dedup.merge([(5, 9), (1, 2), (8, 10), (2, 3)]) == [(1, 3), (5, 10)]


def test_line_dedup_keeps_columns_and_clean_texts(spark):
    got = line_dedup.dedup_lines(frame(spark, TEXTS))
    assert got.columns == [*frame(spark, []).columns, "cut_words", "cut_spans"]
    texts = {r["doc_id"]: r["text"] for r in got.where("doc_id is not null and doc_id <> 8").collect()}
    assert texts == {i: t for i, t in TEXTS if i not in (None, 8)}


def test_factors_learn_a_pair(spark):
    """Two terms that mean nothing alone: only their product tells."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.sample(["red", "blue", "green"], 2) + ["insult"] * a + ["group"] * b)))
        labels.append((i, int(a and b)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, rounds=400)
    truth = dict(labels)
    got = toxicity.score(docs, model).where(toxicity.is_held_out(F.col("doc_id"))).collect()
    assert len(got) > 300 and all(r["predicted"] == truth[r["doc_id"]] for r in got)


def test_fingerprints_retry_and_peel(spark):
    """Small tables stall on large differences; the answers stay those of plain sets."""
    rng = random.Random(7)
    docs = [(i, "\n".join(f"p{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(30)]
    want = brute.edits(docs)
    for r in fingerprints.fingerprint_edits(frame(spark, docs), slots=4).collect():
        n, sha, edited, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert math.isclose(r["near_edited"], edited) and math.isclose(r["near_next"], after)
    pair = spark.createDataFrame([([1, 2, 3], [2, 3, 9])], "a array<long>, b array<long>")
    s = pair.select(fingerprints.peel(fingerprints.subtract(fingerprints.table(F.col("a"), 16), fingerprints.table(F.col("b"), 16)), 16).alias("s")).first()["s"]
    assert (s["ok"], s["added"], s["removed"]) == (True, [1], [9])


def test_warc_records(spark):
    page = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><script>var t='</p>';</script><p>x <b>y</b>&nbsp;z<br>2 < 3</p><a href=\"/u?a=1&amp;b=2\">l</a></body>"
    docs = spark.createDataFrame([(1, "http://h/\r\nX: y", page), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(docs, compress=True).collect()
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    for (_, kind), r in by.items():
        headers, block = warc.parse(r["record"])
        assert (headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To")) == (kind, r["record_id"], r["refers_to"])
        assert len(block) == r["content_length"] and headers["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"]
    source, meta, text = (by[1, k] for k in ("response", "metadata", "conversion"))
    assert source["refers_to"] is None and meta["refers_to"] == text["refers_to"] == source["record_id"]
    assert text["source_payload_digest"] == meta["source_payload_digest"] == warc.digest(page.encode())
    assert warc.parse(text["record"])[1].decode() == "A & B\nx y z\n2 < 3\nl"
    fields = warc.parse(meta["record"])[1].decode()
    assert "outlink: /u?a=1&b=2\r\n" in fields and "title: A & B\r\n" in fields and "source-Content-Type: text/html" in fields
    assert rows == warc.derivatives(docs, compress=True).collect()


def test_warc_ids_tell_rows_apart(spark):
    """Rows alike in all columns repeat their records, others have ids of their own."""
    rows = [(1, "http://h/", "<p>a"), (1, "http://h/", "<p>b"), (1, "http://h/", "<p>b"), (1, "http://i/", "<p>a"), (2, "http://h/", "<p>a"), (None, None, None)]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 18 and len({r["record_id"] for r in got}) == 15


def test_warc_text_against_another_parser(spark):
    """Title, links and text of whole pages as the standard library's parser finds them."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.text, self.links, self.title, self.skip, self.inside = [], [], None, 0, False

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "template", "noscript")
            self.inside = tag == "title"
            self.title = "" if tag == "title" else self.title
            if tag == "a" and dict(attrs).get("href") is not None and not self.skip:
                self.links.append(dict(attrs)["href"])

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "template", "noscript")
            self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.title += data
            if not self.skip:
                self.text.append(data)

    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in pages:
        reader = Reader()
        reader.feed(page or "")
        reader.close()
        text, title, links = warc.scan(page or "")
        assert text.split() == " ".join(reader.text).split() or "".join(text.split()) == "".join("".join(reader.text).split())
        assert links == reader.links and (title or "").split() == (reader.title or "").split()


def test_contamination_of_odd_rows(spark):
    rng = random.Random(9)
    vocab = [f"q{i}" for i in range(12)] + ["É", "é"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)] + [(25, None), (26, "--")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += ", " + (rng.choice(bench)[1] or "").replace(" ", "; ").upper().replace("É", "é") + " -- " + rng.choice(vocab)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "...")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(frame(spark, docs), items).collect()}
    assert got == brute.contamination(docs, bench)


def test_index_beyond_the_sent_terms(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SENT_TERMS", 0)
    docs, bench = [(1, "a b one two c"), (2, "two one")], [(7, "One two")]
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {1: 2, 2: 0}


def test_decontamination_of_repeated_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, item), (1, item), (1, item), (2, f"a b {item} c"), (None, item), (None, item), (3, " ".join(f"q{i}" for i in range(12)))]
    bench = [(5, item), (6, "q3 q4 q5")]
    got = rows_of(decontamination.contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(docs, bench)
    assert got == sorted(((i, *want[i]) for i, _ in docs), key=str) and sum(r[-1] for r in got) == 7


def test_proximity_matches(spark):
    docs = [(1, "alpha x beta y gamma delta"), (2, "alpha " + "x " * 50 + "beta gamma delta"), (3, "none")]
    got = decontamination.proximity_matches(frame(spark, docs), spark.createDataFrame([(5, "gamma beta alpha delta")], "item_id long, text string"), within=10)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, "5")}


def test_proximity_matches_of_long_items(spark):
    """Copied verbatim, with the rarest word (at an edge, or anywhere) changed, and with too many words changed."""
    item = [f"q{i}" for i in range(60)]
    common = [(100 + i, " ".join(item[1:30])) for i in range(3)] + [(200 + i, " ".join(item[30:])) for i in range(3)]
    docs = [(1, "x y " + " ".join(item) + " z"), (2, "x " + " ".join(["other", *item[1:]])), (3, " ".join([*item[:13], *["o"] * 12, *item[25:]])), (4, " ".join([*item[:13], *["o"] * 13, *item[26:]])), *common]
    got = decontamination.proximity_matches(frame(spark, docs), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["terms"]) for r in got} == {(1, 60), (2, 59), (3, 48)}


def test_language_model_orders(spark):
    docs = [(i, f"a b c d{i % 3}" * (i % 4)) for i in range(30)]
    sums = []
    for contexts in ((), ((2.0, 1.0),), ((2.0, 1.0), (1.0, 1.0)), ((2.0, 1.0), (1.0, 1.0), (1.0, 2.0))):
        got = {r["doc_id"]: r["score"] for r in language_model.score_texts(frame(spark, docs), contexts=contexts).collect()}
        want = brute.automaton_scores(docs, contexts)
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
        sums.append(sum(got.values()))
    assert sums == sorted(sums)


def test_language_model_in_teams(spark):
    """Sums through several levels of teams are those of one level, and stretches do not change a walk."""
    rng = random.Random(21)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.choice([0, 1, 5, 40, 700])))) for i in range(120)]
    want = brute.automaton_scores(docs, language_model.CONTEXTS)
    base = brute.base_scores(docs)
    for fan, direct in ((64, 256), (3, 4), (2, 1)):
        rows = language_model.score_texts(frame(spark, docs), chunk_bytes=4000, fan=fan, direct=direct).collect()
        got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows}
        assert got == {i: x[:4] for i, x in base.items()}
        assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) and math.isclose(r["base_score"], base[r["doc_id"]][4], rel_tol=1e-9) for r in rows)


def test_language_model_of_very_many_equal_rows(spark):
    """Rows alike in id and text, or without ids, are read as one that counts as often, and each has its row."""
    rng = random.Random(22)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 90}" for _ in range(rng.choice([0, 3, 40])))) for i in range(60)]
    docs += [(7, "w1 w2 w3 again")] * 400 + [(11, "w5 held out w6")] * 300 + [(None, "w2 w3 w9")] * 500 + [(None, "w3 alone")] + [(None, "")] * 1100 + [(None, None)] * 900
    rows = language_model.score_texts(frame(spark, docs), chunk_bytes=4000).collect()
    # the plain version knows texts by id: further ids for the same texts, learned from or held out like the first
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    free = {h: iter([i for i in range(1000, 40_000) if held(i) == h]) for h in (False, True)}
    apart = [(next(free[held(i)]), t or "") for i, t in docs]
    scores, base = brute.automaton_scores(apart, language_model.CONTEXTS), brute.base_scores(apart)
    seven = lambda *x: tuple(round(v, 7) if isinstance(v, float) else v for v in x)
    want = Counter(seven(i, *base[j], scores[j]) for (i, _), (j, _) in zip(docs, apart, strict=True))
    assert Counter(seven(*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in rows) == want
    assert held(7) and not held(11)


def test_language_model_sends_blobs_in_proportion():
    import numpy as np
    import pyarrow as pa

    def blobs(chunks):
        tables = [pa.table({"chunk": pa.array([c] * 2, pa.int64()), "doc_id": [1, 2], "held_out": [False, True], "text": ["a b c " * 50, "b c d"]}) for c in range(chunks)]
        return sum(language_model._count(3, 64)(t).num_rows for t in tables)

    assert blobs(8) == 4 * blobs(2) == 8 * 3 * 64
    keys = np.sort(np.array([0, 1, 2**49, 2**50 - 1], np.uint64))
    parts = language_model._blobs(0, 2, keys, np.ones(4, np.uint64), 0, 4, 4)
    assert [len(language_model.unpack_array(p[3])) for p in parts] == [2, 0, 1, 1]


def test_packed_arrays_come_back():
    import numpy as np

    for x in ([], [0], [5, 2**63, 1]):
        assert language_model.unpack_array(language_model.pack_array(np.array(x, np.uint64))).tolist() == x


def test_slots_are_gapless_with_repeats(spark):
    got = sharding.shard(frame(spark, TEXTS * 3), {0: 1.0, 1: 1.0}).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == 3 * len(TEXTS)
    for r in got:
        text = dict(TEXTS).get(r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("x"), {0: 0.0})


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: f"m{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(60))
    item = " ".join(word() for _ in range(30))
    base = [word() for _ in range(36)]  # too short for line dedup
    docs = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))) for i in range(200)]
    docs += [(i, t + "\nfoul foul vile") for i, t in ((i, " ".join(word() for _ in range(50))) for i in range(200, 260))]
    docs += [(300, f"start here\n{passage}\nend here"), (301, f"other text\n{passage}\nmore words")]
    docs += [(400, " ".join(base)), (401, " ".join(base[:-1] + ["new"]))]
    docs += [(500, item + " " + word()), (600, None), (601, ""), (602, "tiny")]
    frame(spark, docs).withColumn("n_chars", F.length("text").cast("long")).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 260)) for i in range(260)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
            kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    clean = {i for i, _ in docs if i < 200} | {300, 600, 601, 602}
    assert clean <= set(kept[3]) and not {i for i in range(200, 260)} & set(kept[0])
    assert {300, 301} <= set(kept[1]) and passage in kept[1][300] and passage not in kept[1][301]
    assert 400 in kept[2] and 401 in kept[1] and 401 not in kept[2]
    assert 500 in kept[2] and 500 not in kept[3]
    assert set(r[0] for r in now.select("doc_id").distinct().collect()) == set(kept[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert rows_of(whole, "doc_id", "start", "length", "ids_crc32") == rows_of(now, "doc_id", "start", "length", "ids_crc32")
    ids = whole.where("doc_id = 602").orderBy("start").select("ids").collect()
    assert [x for r in ids for x in r[0]][-1] == 1


def test_pipeline_with_null_and_clashing_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d = (" ".join(f"x{rng.randrange(10**9)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (2, c), (3, c), (4, None), (5, ""), (None, None), (None, ""), (6, a.upper())]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert rows_of(got, "doc_id", "text") == sorted([(1, a), (None, b), (2, c), (2, d), (4, None), (5, ""), (None, None)], key=str) or rows_of(got, "doc_id", "text") == sorted([(1, a), (None, b), (2, c), (2, d), (4, None), (5, ""), (None, "")], key=str)
    docs = [(1, a), (1, b), (None, a), (None, b), (None, None), (2, b)]
    frame(spark, docs)
    import tempfile

    with tempfile.TemporaryDirectory() as place:
        spark.createDataFrame([(7, a)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        kept = rows_of(corpus_pipeline.decontaminate(spark, frame(spark, docs), place), "doc_id", "text")
    assert kept == sorted([(1, b), (None, b), (None, None), (2, b)], key=str)


def test_pipeline_leaves_results_of_others(spark):
    """A result that is still unread when the pipeline's stages run reads its own work tables afterwards."""
    import corpus_pipeline

    docs = frame(spark, [(i, f"a b c d e f {i} x{i}") for i in range(20)])
    unread = neardup.near_duplicates(docs)
    for step in (corpus_pipeline.dedup_lines, corpus_pipeline.near_dedup):
        assert step(spark, docs, "").count() == 20
    assert unread.count() == 20


def test_pipeline_stages_do_not_end_each_other(spark):
    import corpus_pipeline

    docs = frame(spark, [(i, f"a b c d e f {i} x{i}") for i in range(20)])
    results = [step(spark, docs, "") for step in (corpus_pipeline.near_dedup, corpus_pipeline.dedup_lines, corpus_pipeline.near_dedup)]
    assert [r.count() for r in results] == [20, 20, 20]


def test_long_items_and_windows(spark):
    """Of an item of thousands of words each place is met only with the windows that hold it."""
    rng = random.Random(17)
    item = [f"w{rng.randrange(400)}" for _ in range(3000)]
    docs = [(1, " ".join(item[100:160])), (2, " ".join(item)), (3, " ".join(item[5:17])), (4, " ".join(rng.sample(item, 200)))]
    bench = [(1, " ".join(item)), (2, " ".join(item[:5]))]
    got = decontamination.contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()} == {i: brute.contamination(docs, bench)[i][:3] + brute.contamination(docs, bench)[i][-1:] for i, _ in docs}


def test_pipeline_drops_near_copies_from_080(spark):
    """Changed tails: pairs with a similarity of 0.80 to 0.85, and pairs under 0.80."""
    import corpus_pipeline

    rng = random.Random(13)
    rows, gone = [], set()
    for k, tail in enumerate([20, 18, 22, 19, 30] * 4):
        words, other = ([f"x{rng.randrange(10**9)}" for _ in range(204)] for _ in range(2))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-tail] + other[:tail]))]
        if 100 * (200 - tail) >= 80 * (200 + tail):
            gone.add(2 * k + 1)
    kept = {r[0] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").select("doc_id").collect()}
    assert len(gone) == 16 and kept == {i for i, _ in rows} - gone


@pytest.mark.parametrize("retries", [0, 1, 12])
def test_large_differences_end(spark, monkeypatch, retries):
    """Tables that stall to the end are replaced by the digests themselves."""
    monkeypatch.setattr(fingerprints, "RETRIES", retries)
    rng = random.Random(retries)
    sets = [([rng.randrange(50) for _ in range(rng.randrange(40))], [rng.randrange(50) for _ in range(rng.randrange(40))]) for _ in range(12)]
    pairs = [(i, sorted(set(a)), sorted(set(b))) for i, (a, b) in enumerate(sets)] + [(99, [7], [7])]
    got = {tuple(r) for r in fingerprints.peel_large(spark.createDataFrame(pairs, "id long, a array<long>, b array<long>")).collect()}
    assert got == {(i, d, c) for i, a, b in pairs for c, x in ((1, set(a) - set(b)), (-1, set(b) - set(a))) for d in x}


def test_edited_digest_by_hand(spark):
    got = fingerprints.fingerprint_edits(frame(spark, [(1, "abcdefgh"), (2, "X")])).orderBy("doc_id").collect()
    assert got[0]["edited_sha256"] == hashlib.sha256(b"abcdefX").hexdigest() and got[1]["edited_sha256"] == hashlib.sha256(b"X").hexdigest()


def test_fitting_leaves_little_on_the_driver(spark, monkeypatch):
    """The driver holds the collected terms once, where Arrow has put them, and gives back what fitting took."""
    import pyarrow as pa

    from hopflux.llm import toxicity

    column = pa.chunked_array([[np.arange(3, dtype="<i4").tobytes(), b""], [np.arange(5, dtype="<i4").tobytes()]], pa.binary())
    given = toxicity._in_place(column)
    assert [len(x) for x in given] == [3, 0, 5]
    assert np.shares_memory(given[0], np.frombuffer(column.chunk(0).buffers()[2], np.uint8))
    back = []
    monkeypatch.setattr(toxicity, "give_back", lambda: back.append(1), raising=False)
    docs = spark.createDataFrame([(i, ("vile words " if i % 3 else "kind words ") * 3 + f"w{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 3 > 0)) for i in range(40)], "doc_id long, toxic double")
    model = toxicity.fit(docs, labels, held_out=F.lit(False), least_g=1.0, rounds=20)
    again = toxicity.fit(docs.repartition(3), labels.repartition(2), held_out=F.lit(False), least_g=1.0, rounds=20)
    assert len(model.slots) and np.array_equal(model.slots, again.slots)
    assert len(back) == 2
