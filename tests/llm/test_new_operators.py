"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import centroids, repair, topk

SPACE = " \t\n\x0b\x0c\r"


# --- conversation repair ----------------------------------------------------------------------------------------


def least_repair(rows):
    """(cost, audit, repaired) of rows (role, text, fault): every edit of every row tried, from the last row back."""

    @cache
    def go(i, state, inserted):
        """From row i on, with `inserted` turns just put in front of it; state: the last initial."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[nexts]

        def add(cost, letter, out, to, j, k=0):
            rest = go(j, to, k)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], out + rest[2]))

        if inserted < 3:
            add(5, "I", ((name, ""),), nexts, i, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            add(2, "D", (), state, i + 1)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] == nexts or role[:1] == "s" and state == "":
                    add(extra, "K", ((role, text),), role[0], i + 1)
                add(1 + extra, "R", ((name, text),), nexts, i + 1)
        return min(ways) if ways else None

    for i in range(len(rows), -1, -1):  # from the end, so that calls do not nest deeply
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def enumerated(rows):
    """The same by trying all edit sequences with at most two insertions in a place, and the pattern on their roles."""
    best = None
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]

    def go(i, cost, audit, roles):
        nonlocal best
        if best and cost > best[0]:
            return
        for ins in inserts:
            c, a, r = cost + 5 * len(ins), audit + "I" * len(ins), roles + list(ins)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in r)):
                    best = min(best, (c, a)) if best else (c, a)
                continue
            role, _, fault = rows[i]
            go(i + 1, c + 2, a + "D", r)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(i + 1, c + extra, a + "K", r + [role])
                for to in ("user", "assistant"):
                    go(i + 1, c + 1 + extra, a + "R", r + [to])

    go(0, 0, "", [])
    return best


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def by_hand(rows):
    """Contract's row for each conversation, from the rows as they are after damage (sorted by turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged_by_hand(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:16], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns, seen, faulty, counts = {r[1] for r in own if r[1] is not None}, set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in own:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                counts[fault] += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, turns_out = least_repair(tuple(faulty))
        if len(faulty) <= 2 and all(r[0] for r in faulty):
            assert (cost, audit) == enumerated(faulty)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_out).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, sha)
    return out


def test_repair(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "maybe", "", " \n", None, "what?", "é.\t", "x" * 4000, "end. \x0b"]
    rows = []
    for conv in list(range(150)) + [None, -7, 1 << 40]:
        turn = rng.choice([0, -3, 5])
        for _ in range(rng.choice([1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uber", "User"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 4])
    rows += [(900, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(700)]  # one long conversation
    rows += [(901, i, "user", "same.") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", False) for r in rows], "conv_id long, turn long, role string, text string, audit string, present boolean").repartition(5)
    turns = repair.damaged(df)
    found = repair.audit(turns)
    want = by_hand(rows)
    got = {r.conv_id: r for r in found.collect()}
    shas = {r.conv_id: r.repaired_sha256 for r in repair.digests(repair.repaired(turns, found)).collect()}
    assert set(got) == set(shas) == set(want)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    assert {c: (*(r[n] for n in names), shas[c]) for c, r in got.items()} == want
    assert any(r.audit == "" and r.cost == 0 for r in got.values())
    # The repaired turns themselves, and solving a few conversations at a time.
    out = repair.repaired(turns, found).where("place >= 0 AND conv_id = 900").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out)) and [r.place for r in out] == list(range(len(out)))
    monkeypatch.setattr(repair, "ROWS", 10)
    assert {r.conv_id: r for r in repair.audit(turns).collect()} == got
    assert repair.audit(turns.where("false")).count() == 0


def test_least_paths_are_least():
    """Any acyclic graph whose arcs of a node differ in their letter."""
    rng = random.Random(1)
    for _ in range(30):
        n = rng.choice([2, 5, 12])
        arcs = [(s, letter, rng.randrange(s + 1, n)) for s in range(n - 1) for letter in rng.sample(range(4), rng.choice([1, 2, 3]))]

        @cache
        def least(node):
            ways = [(letter, *least(d)) for s, letter, d in arcs if s == node]
            return min(ways) if ways else ()

        src, letter, dst = (np.array(c) for c in zip(*arcs))
        starts = np.arange(n)
        letters, cut = repair.least_paths(src, letter, dst, starts)
        assert [tuple(letters[cut[i] : cut[i + 1]]) for i in starts] == [least(i) for i in starts]


# --- exact top k ------------------------------------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 420)]  # a large group of copies
    rows += [(420 + i, [float(x) for x in rng.normal(size=6) * 40]) for i in range(30)]
    rows += [(500, rows[3][1]), (500, rows[9][1]), (500, rows[9][1])]  # one id, several vectors
    rows += [(550, None), (551, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (600, [math.nan] * 6), (601, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(650, [1.0, 2.0]), (651, [0.5, -2.0]), (700, []), (701, []), (750, [0.0] * 6), (800, [9.0] * 11)]
    return rows


def best_by_hand(rows, k=5):
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a) in enumerate(q):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(q) if m != n and len(b) == len(a))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # many annuli, slices, blocks, packs and rounds
        for name, value in dict(ANNULUS=16, SLICE_BYTES=200, BLOCK_BYTES=256, PACK_BYTES=128, FIRST=16, GROWTH=3, VISITS=2).items():
            monkeypatch.setattr(topk, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, x string").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == best_by_hand(rows)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e12, -3e11]), (1, [2e12, 5.5]), (2, [-1e13, 7e12]), (50, [1e300, 1.0]), (51, [-1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    q = [(i, [held(math.floor(256 * x)) for x in v]) for i, v in rows]
    assert got == {(i, j): held(sum(x * y for x, y in zip(a, b))) for i, a in q for j, b in q if i != j and i % 50 == 0}


def test_bounds_hold_and_prune():
    """No score is above its annulus's bound, and far annuli of well separated vectors are below the best scores."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 12)) * 900
    x = np.floor(centers[rng.integers(0, 6, 600)] + rng.normal(size=(600, 12)) * 9).astype(np.int64)
    p = topk.Pivots.fit(list(x), 100_000)
    annulus, at, norm = p.place(x)
    q = x[:40]
    d, own = p.to_pivots(q), np.unique(annulus)
    first = p.by_width[12][2]
    scores, pruned = q @ x.T, 0
    for a in own:
        inside = annulus == a
        top = topk.bound(norm[:40], d[:, a - first], at[inside].min(), at[inside].max(), norm[inside].max())
        assert (scores[:, inside].max(1) <= top).all()
        pruned += (top < np.sort(scores, axis=1)[:, -6]).sum()
    assert pruned > 0.3 * 40 * len(own)


# --- centroids --------------------------------------------------------------------------------------------------


def clusters_by_hand(rows, k=8, rounds=10, width=64):
    q = [(i, [math.floor(max(-1.5e9, min(1.5e9, 1024 * x))) for x in v]) for i, v in rows
         if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in q)[:k]
    cents = [v for _, v in first]
    far = lambda v, c: min((1 << 63) - 1, sum((a - b) ** 2 for a, b in zip(v, c)))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in q:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in q]
    per = {j: sum(d for _, c, d in out if c == j) for j in range(len(cents))}
    fits = lambda n: n if n < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, fits(per[c]), fits(sum(per.values())), shas[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("case", ["mixed", "few", "copies", "huge"])
def test_centroids(spark, case):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(60)]
    if case == "mixed":
        rows += [(70, None), (71, [1.0] * 63), (72, [None] + [0.0] * 63), (73, [math.nan] * 64), (74, [math.inf] * 64), (75, []), (None, [0.25] * 64), (5, rows[9][1]), (5, rows[5][1])]
    if case == "few":
        rows = rows[:3]
    if case == "copies":  # a third of all rows equal, and first centroids that are equal
        rows += [(100 + i, rows[0][1]) for i in range(40)]
    if case == "huge":
        rows += [(200, [1e6] * 64), (201, [-2e30] * 64), (202, [1.2e6] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, cluster int, q int").repartition(4)
    got = sorted((tuple(r) for r in centroids.with_inertia(centroids.cluster(df)).collect()), key=str)
    assert got == clusters_by_hand(rows)
    assert centroids.with_inertia(centroids.cluster(df.where("false"))).count() == 0


def test_centroids_stay_in_the_jvm(spark, sf):
    found = centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = centroids.integer_vectors(rows).select(centroids.nearest(found.centroids))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.assigned.count() == rows.count()
