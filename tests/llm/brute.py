"""Plain Python versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(UPPER)


def crc(x):
    return zlib.crc32(x.encode())


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def near_duplicates(docs):
    """(doc_id, text) rows with distinct ids -> {doc_id: (n_shingles, component)}"""
    sets = {}
    for i, t in docs:
        w = space_words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = Counter()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                seen[a, b] += 1
    for (a, b), n in seen.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, benchmark):
    windows = {}
    for item, text in benchmark:
        w = alnum_words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs:
        w = alnum_words(text)
        hit, items = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    items |= found
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def base_scores(docs):
    tokens = {i: [*space_words(t), None] for i, t in docs}
    held = {i: crc(str(i)) % 5 == 1 for i in tokens}
    counts = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    total, distinct = sum(counts.values()), len(counts)
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    return {i: (held[i], len(w), sum(counts[x] > 0 for x in w), total, sum(p(counts[x]) for x in w)) for i, w in tokens.items()}


def automaton_scores(docs, contexts, discount=0.5):
    """The automaton of the whole corpus as dictionaries, walked word by word along arcs and failure arcs."""
    tokens = {i: [*space_words(t), "\0end"] for i, t in docs}
    depth = len(contexts)
    seen, grams = Counter(), Counter()
    for i, w in tokens.items():
        if crc(str(i)) % 5 != 1:
            w = ["\0start"] * depth + w
            for j in range(depth, len(w)):
                for n in range(depth + 1):
                    seen[tuple(w[j - n : j])] += 1
                    grams[tuple(w[j - n : j]), w[j]] += 1
    total, distinct = seen[()], sum(h == () for h, _ in grams)
    unknown = (discount * distinct + 1) / (total + 1)

    def trust(h):
        kappa, power = contexts[len(h) - 1]
        return seen[h] ** power / (seen[h] ** power + kappa)

    def p(h, x):
        if not h:
            return (grams[h, x] - discount) / (total + 1) if grams[h, x] else unknown
        own = trust(h) * grams[h, x] / seen[h] if seen[h] else 0
        return own + (1 - trust(h)) * p(h[1:], x)

    arcs = {}
    for h, x in grams:
        to = (*h, x)[-depth:] if depth else ()
        while to not in seen and to:
            to = to[1:]
        arcs.setdefault(h, {})[x] = (math.log10(p(h, x)), to)
    scores = {}
    for i, w in tokens.items():
        state, score = ("\0start",) * depth, 0.0
        for x in w:
            while state and x not in arcs.get(state, ()):
                score += math.log10(1 - trust(state))
                state = state[1:]
            log, state = arcs.get(state, {}).get(x, (math.log10(unknown), ()))
            score += log
        scores[i] = score
    return scores


def licenses(text):
    w = alnum_words(text)
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(s, label) for phrase, label in base.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
    at = [s for s, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def paragraphs(text):
    return {x for x in (text or "").split("\n") if x}


def edits(docs):
    docs = sorted(docs)
    out = {}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]

        def like(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(paragraphs(t), paragraphs(edited)), like(paragraphs(t), paragraphs(after)))
    return out


def repeated_left(texts, size=50, overlap=False):
    """Keys of texts with ``size`` words in a row that stand earlier, in another text or (with or without overlap) in the same one."""
    seen, found = {}, set()
    for key, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - size + 1):
            run = tuple(w[i : i + size])
            k, at = seen.setdefault(run, (key, i))
            if k != key or i >= at + (1 if overlap else size):
                found.add(key)
    return found


def _damaged(rows):
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = crc(f"{one(conv)}:{one(turn)}") % 20
        role, text = one(role), one(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, role, text


def _cheapest(rows):
    """rows: (role, text, fault) -> (cost, audit, repaired rows), by search through all prefixes of edits, cheapest and then least first."""
    import heapq

    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, at, roles, kept = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits, kept
        state = (at, "" if not roles else "s" if roles == "s" else roles[-1])
        if state in done:
            continue
        done.add(state)
        could = lambda r: re.fullmatch("(s(ua)*u?)?|(ua)*u?", roles + r)
        for role in ("user", "assistant"):
            if could(role[0]):
                heapq.heappush(queue, (cost + 2, edits + "I", at, roles + role[0], (*kept, (role, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(queue, (cost + 3, edits + "D", at + 1, roles, kept))
        if fault in ("blank", "duplicate"):
            continue
        more = fault == "truncated"
        if role[:1] in ("s", "u", "a") and could(role[:1]):
            heapq.heappush(queue, (cost + more, edits + "K", at + 1, roles + role[:1], (*kept, (role, text))))
        for new in ("user", "assistant"):
            if could(new[0]):
                heapq.heappush(queue, (cost + 2 + more, edits + "R", at + 1, roles + new[0], (*kept, (new, text))))


def conversation_repairs(rows, damaged=True):
    """(conv_id, turn, role, text) rows -> {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}"""
    by = {r[0]: [] for r in rows}
    for r in _damaged(rows) if damaged else rows:
        by[r[0]].append(r[1:])
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, edits, kept = _cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)
    return out
