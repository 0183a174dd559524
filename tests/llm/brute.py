"""Brute-force versions of the operators' contracts, for small fixtures."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def sample_docs(n=60, seed=5):
    """Documents with copies, near copies, shared passages, periodic texts, nulls, empties and odd white space."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéfß漢") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, docs = text(60), []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = text(r.randint(1, 120))
        elif kind == 1:
            t = text(30) + "\n" + passage + " " + text(r.randint(0, 30))
        elif kind == 2 and docs:
            t = r.choice(docs)
        elif kind == 3 and docs:
            ws = (r.choice(docs) or "x").split(" ")
            for _ in range(max(1, len(ws) // 60)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        elif kind == 4:
            t = (text(r.randint(1, 3)) + " ") * 90
        elif kind == 5:
            t = [None, "", " \n\t ", "one", "漢" * 300][(i // 10) % 5]
        elif kind == 6:
            t = passage[r.randint(0, 80) :]
        elif kind == 7:
            t = text(80).replace(" ", "\t\x0b ", 9) + " x y  "
        else:
            t = text(r.randint(100, 300))
        docs.append(t)
    return list(enumerate(docs))


def passages(docs, window=35):
    seen, tokens = Counter(), {}
    for i, t in docs:
        tokens[i] = w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] += 1
    out = {}
    for i, w in tokens.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    return out


def byte_repeats(docs, window=200):
    seen, raw = Counter(), {}
    for i, t in docs:
        raw[i] = b = (t or "").encode()
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] += 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near_duplicates(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(docs):
    out = {}
    for i, t in docs:
        t, spans = t or "", []
        spans += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(s[2] for s in spans)
        out[i] = (n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()))
    return out


def line_rules(docs):
    out = {}
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        out[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
    return out


def secret_spans(docs, wide=5, narrow=2):
    """(doc_id, text, owner, repository) rows: doc_id to all spans, verdicts included, as text."""
    values = {}
    for i, t, owner, repo in docs:
        for *_, value in spans_with_values(t or ""):
            values.setdefault(value, set()).add((owner, repo))
    out = {}
    for i, t, owner, repo in docs:
        spans = []
        for start, rank, kind, end, value in spans_with_values(t or ""):
            spans.append((start, rank, kind, end))
            owners, repos = len({o for o, _ in values[value]}), len(values[value])
            random_looking = len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and not re.search(r"(?i)example|changeme|placeholder|(.)\1{5}", value)
            if owners >= wide or repos >= 2 * wide:
                spans.append((start, 4, "example", end))
            elif owners == 1 and repos <= narrow and random_looking:
                spans.append((start, 3, "live", end))
        out[i] = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(set(spans)))
    return out


def spans_with_values(t):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        out += [(m.start(), rank, kind, m.end(), m.group(group)) for m in pattern.finditer(t) if len(m.group(group)) >= least]
    return sorted(out)
