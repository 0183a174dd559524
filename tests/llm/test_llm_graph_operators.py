"""Operators 11 to 13 against brute force: odd rows, copies, long conversations, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.llm import embedding_dedup, filter_audit, prefix_trie
from barloom.llm.queries import SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_links(rows, cosine=0.93):
    """rows (vec_id, vector, label) of distinct ids."""
    fine = {i: (np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = set()
    for (a, (x, l)), (b, (y, m)) in itertools.permutations(fine.items(), 2):
        if l == m and len(x) == len(y):
            x, y = x / abs(x).max(), y / abs(y).max()
            if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= cosine:
                links.add((a, b))
    ids = [i for i, _, _ in rows]
    of = smallest(ids, links)
    return {i: (sum(a == i for a, _ in links), of[i], of[i] == i) for i in ids}


def vectors(n=150, width=6):
    rng, rows = np.random.default_rng(11), []
    for i in range(n):
        v = rng.normal(size=width)
        if i % 3 and rows:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=width) * [0.0, 0.02, 0.3][i % 3]
        rows.append((i, v.tolist(), int(rng.integers(3))))
    return rows


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(200 + i, v, 1) for i, v in enumerate([None, [], [0.0] * 6, [1.0, nan] * 3, [1.0, None] * 3, [inf] * 6, [1e300] * 6, [2e300] * 6, [1e-300] * 6, [1.0] * 4, [2.0] * 4, [3.0], [4.0], [-1.0]])] + [(300, [1.0] * 6, None)]


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def by_id(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_embedding_links(spark, block):
    rows = vectors() + odd_vectors()
    assert by_id(embedding_dedup.near_duplicates(embedded(spark, rows), block=block, codes=5)) == brute_links(rows)


def test_embedding_recall_stop(spark):
    rows = vectors()
    got, want = by_id(embedding_dedup.near_duplicates(embedded(spark, rows), block=3, codes=5, recall=0.9)), brute_links(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_embedding_bounds_hold():
    """No vector lies nearer than the bound of its cell says."""
    rng = np.random.default_rng(2)
    book, q, v = rng.normal(size=(12, 4)), rng.normal(size=(60, 4)), rng.normal(size=(200, 4))
    cell = embedding_dedup.distances(v, book).argmin(1)
    away = ((q[:, None] - v[None]) ** 2).sum(2)
    assert (embedding_dedup.bounds(q, book)[:, cell] <= away + 1e-9).all()


def test_staircase_is_all_cells_under_the_stop():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b, stop = rng.random(7), rng.random(5), rng.random() * 1.5
        want = {i * 5 + j for i in range(7) for j in range(5) if a[i] + b[j] <= stop}
        assert set(embedding_dedup.staircase(a, b, stop).tolist()) == want


def test_embedding_rows_stay(spark):
    """Repeated rows, two vectors under one id, rows without an id: each row is returned."""
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, cell int, class string, `block` int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(frame).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_embedding_copies(spark):
    """Copies are one class, near copies one block and more: counts are whole."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=6)
    rows = [(i, base.tolist(), 0) for i in range(40)] + [(40 + i, (base + rng.normal(size=6) * 0.03).tolist(), 0) for i in range(40)]
    got = by_id(embedding_dedup.near_duplicates(embedded(spark, rows), block=4, codes=3))
    assert got == brute_links(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(7, [1.0, 2.0], 3)]])
def test_embedding_few(spark, rows):
    assert by_id(embedding_dedup.near_duplicates(embedded(spark, rows))) == {i: (0, i, True) for i, _, _ in rows}


# --- 12


def brute_trie(rows, every=100, heads=6):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    # Every path adds itself to each of its prefixes.
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, members in nodes.items():
        ends = sha(",".join(map(str, sorted(c for c in members if len(full[c]) == len(k)))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], ends))
    return sorted(out, key=repr)


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def chats(seed=1, n=60):
    r, rows = random.Random(seed), []
    for c in [*range(0, n), *range(100, 100 + n // 2), *range(205, 215), -3, -100, -104]:
        for t in range(r.randint(1, 8)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hé", "", "漢字", "x y"])))
    return rows


def trie(spark, rows):
    return sorted(map(tuple, prefix_trie.prefix_trie(talk(spark, rows)).collect()), key=repr)


def test_trie_of_chats(spark):
    rows = chats()
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 2, None, "b"), (7, 1, "user", None), (7, 1, "user", None), (7, 1, "a", "z"), (8, 1, "u", "only"), (100, 1, "u", "v" * 3000), (9, -5, "user", "first"), (9, 0, "", "b")]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_long_conversations(spark):
    """A conversation of most rows lies in several parts; nested prefixes and copies beside it."""
    long = [("u", f"t{i % 7}") for i in range(400)]
    rows = [(0, i, *x) for i, x in enumerate(long)]
    for c, n in [(1, 350), (2, 400), (3, 40), (4, 39), (5, 2), (600, 30)]:
        rows += [(c, i, *x) for i, x in enumerate(long[:n])]
    rows += [(3, 41, "u", "off"), (4, 41, "u", "off")]
    random.Random(2).shuffle(rows)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_nested_minima(spark):
    """Each deeper branch has a larger smallest member: a round of peeling for each."""
    deep = [("u", f"{i}") for i in range(9)]
    rows = [(100 * c, i, *x) for c in range(1, 9) for i, x in enumerate([*deep[:c], ("u", "end")])]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_many_ends(spark):
    """Ids that end at one node fill more than one block."""
    rows = [(100 * i, 0, "u", "same") for i in range(-3, 400)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_empty(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []


def test_trie_other_columns(spark):
    from pyspark.sql import functions as F

    rows = chats(3, 10)
    frame = talk(spark, rows).withColumns({"conv": F.lit("x"), "part": F.lit(1), "node": F.lit(2), "h": F.lit(None).cast("int"), "depth": F.lit(0)})
    assert sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()), key=repr) == brute_trie(rows)


# --- 13


def brute_audit(docs, labels):
    """docs (doc_id, text, source), labels (doc_id, quality, toxic)."""
    first, fails = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails.append({x for x, bad in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), i is not None and i > first[t]], strict=True) if bad})
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out = []
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                here = [i for i, f in mine if x in f and not f & set(order[:k])]
                shapley[x] += len(here)
                steps.append((order, k + 1, x, sum(not f & set(order[: k + 1]) for _, f in mine), len(here), sum(x in f and bool(f & set(order[:k])) for _, f in mine), sum(f == {x} for _, f in mine), sum(i in good for i in here), sum(i in toxic for i in here)))
        out += [(part, o, k, *rest, shapley[x]) for o, k, x, *rest in steps]
    return sorted(out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, mask int, part int")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")  # noqa: E741
    return sorted(map(tuple, filter_audit.audit(d, l).collect()))


def texts(seed=4, n=90):
    r, out = random.Random(seed), []
    for i in range(n):
        k = r.choice([0, 3, 49, 50, 51, 80])
        words = [r.choice(["a", "b", "É", "Xy", "UP", "w%d"]) if r.random() < 0.4 else f"w{j}" for j in range(k)]
        t = r.choice([" ", "\n", "\x0b\x0c", "  "]).join(words) + r.choice(["", "", "#", " |", "\r"])
        out.append((i, r.choice([t, t, None, "", "same text"]), r.choice(["s0", "s1", "s1", None, ""])))
    return out


def test_audit(spark):
    docs = texts()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 3)] + [(3, 1, 1), (None, 1, 1), (4, None, None), (999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_odd_rows(spark):
    docs = [(1, "x", "s"), (1, "x", "s"), (None, "x", None), (2, "x", "s"), (None, None, "s"), (0, "", "s"), (5, "W" * 100_000 + " ", "s"), (6, ("a b " * 50_000), "t")]
    assert audited(spark, docs, []) == brute_audit(docs, [])
    assert audited(spark, [], []) == []


def test_lattice_has_all_edges():
    edges = filter_audit.lattice()
    assert len(edges) == 80 and len(filter_audit.ORDERS) == 120
    assert sum(k for _, _, k in edges) == 600


# --- SQL


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_prefix_trie", "op13_filter_audit"])
def test_sql(spark, tmp_path, name):
    rows = [(i, [float(x) for x in v], l) for i, v, l in vectors()]
    embedded(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    talk(spark, chats()).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(texts(), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    from barloom.llm.queries import queries

    got, want = queries()[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted((tuple(None if pd.isna(v) else v for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=repr)
    assert [tuple(map(str, r)) for r in plain(got)] == [tuple(map(str, r)) for r in plain(want)] or plain(got) == plain(want)
