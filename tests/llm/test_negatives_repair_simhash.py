"""Hard negatives, conversation repair and SimHash groups against brute force, with odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallylens.llm import graph, negatives, repair, simhash
from tallylens.llm.tables import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- connected groups

def brute_groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_groups_of_chain_star_and_pairs(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1400)]
    odd = [(2000, 2001), (2001, 2000), (2001, 2001), (3000, 3000), (2001, 2002)]
    links = chain + star + odd
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = brute_groups(nodes, [k for k in links if set(k) <= nodes])
    assert set(got) == nodes
    assert len({(got[n], want[n]) for n in nodes}) == len(set(want.values())) == len(set(got.values()))
    assert graph.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_stars_take_two_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, name, real=graph.staged: written.append(name) or real(df, name))
    links = [(100 * s, 100 * s + i) for s in range(20) for i in range(1, 60)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert len(got) == 1200 and all(got[n] == got[n // 100 * 100] for n in got) and len(set(got.values())) == 20
    assert written.count("joined") <= 2


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, every=100, positives=5, top=10):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 8192 for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        held[i] = min(held.get(i, row), row)
    out = set()
    for a, (label, v) in held.items():
        if a % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v))
        for minus, p, _ in [n for n in near if n[2] == label][:positives]:
            fits = [n for n in near if n[2] != label and -30 * minus <= -100 * n[0] <= -90 * minus][:top]
            out |= {(a, p, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(fits, 1)}
    return out


VECTORS = "vec_id bigint, label int, embedding array<float>, planes string, v int"


def test_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    hot = [rng.choice([-0.5, 0.25, 0.75]) for _ in range(11)]
    rows = [(i, rng.randrange(4), [rng.choice([-1.5, -0.25, 0.001, 0.5, 3.0]) for _ in range(11)]) for i in range(0, 3000, 10)]
    rows += [(i, rng.randrange(4), hot) for i in range(5, 2000, 10)]  # ties
    rows += rows[:40]
    rows += [(100, 3, hot), (7, None, hot), (8, 1, None), (9, 1, [*hot[:-1], None]), (11, 1, [*hot[:-1], math.nan]),
             (12, 1, [*hot[:-1], math.inf]), (None, 1, hot), (300, 1, [0.0] * 11), (400, 2, [1.0, 2.0]), (401, 2, [3.0, 1.0]),
             (402, 1, [1.0, 1.0]), (500, 1, []), (13, 2, [5000.0] * 11), (14, 1, [-8000.0] * 11), (15, 1, [9000.0] * 11)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = {tuple(r) for r in negatives.mine(frame).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    assert got == brute_negatives(rows)
    assert len({g[0] for g in got}) > 20


def test_negatives_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_ROWS", 3)
    monkeypatch.setattr(negatives, "STRIPE_ROWS", 100)
    monkeypatch.setattr(negatives, "TILE_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(900)]
    got = {tuple(r) for r in negatives.mine(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)).collect()}
    assert got == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0], "", 0)], VECTORS)).count() == 0


@pytest.mark.parametrize("dim", [1, 8, 13, 64])
def test_lookups_give_inner_products(dim):
    rng = np.random.default_rng(dim)
    v, w = rng.integers(-5000, 5000, (40, dim)), rng.integers(-300, 301, (30, dim))
    planes = negatives.planes_of(w)
    assert (negatives.numbers_of(planes, dim) == w).all()
    assert (negatives.scores(negatives.subset_sums(v, np.int64), planes) == w @ v.T).all()


# ---------------------------------------------------------------- conversation repair

def brute_repair(rows):
    """Cost, audit and lines of rows (role, text, first fault) by trying all edits, cheapest first."""
    need = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in best.items():
            for inserts in range(3):
                c, e, out, now = cost + 5 * inserts, audit + "I" * inserts, list(lines), state
                for _ in range(inserts):
                    out.append(need[now] + ":")
                    now = need[now][0]
                options = [(2, "D", now, None)]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    options.append((1 + more, "R", need[now][0], f"{need[now]}:{text}"))
                    if role[:1] == need[now][0] or role[:1] == "s" and now == "":
                        options.append((more, "K", role[:1], f"{role}:{text}"))
                for price, edit, to, line in options:
                    found = (c + price, e + edit, (*out, *([line] if line else [])))
                    after[to] = min(after.get(to, found), found)
        best = after
    ends = {"": [], "s": ["user:", "assistant:"], "u": ["assistant:"], "a": []}
    return min((c + 5 * len(ends[s]), a + "I" * len(ends[s]), (*lines, *ends[s])) for s, (c, a, lines) in best.items())


def brute_reports(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        numbers = [t[0] for t in turns if t[0] is not None]
        initials = [t[1][:1] for t in turns]
        cost, audit, lines = brute_repair([(r, t, f) for (_, r, t), f in zip(turns, faults, strict=True)])
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, cost int, part string"


def reports(frame):
    return {r.conv_id: tuple(r)[1:] for r in repair.digests(frame, repair.repair(frame)).collect()}


def random_turns(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randrange(1, longest)):
            rows.append((
                None if conv == 3 else conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]),
                rng.choice(["Yes.", "No!", "cut", "cut off", "Why?  \n", " \t", "", None, "Good. ", "日本。", "a.b", "A.", "B."])))
    return rows


def test_repair_equals_brute_force(spark):
    rows = random_turns(1, 60, 14)
    rows += [(77, 1, "user", "again.")] * 5 + [(78, None, None, None)] + [(79, 5, "assistant", "x " * 50_000 + ".")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(4)
    assert reports(frame) == brute_reports(rows)


def test_repair_of_conversations_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(repair, "RUN_BITS", 1)
    rows = random_turns(2, 25, 40)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(4)
    assert reports(frame) == brute_reports(rows)


def test_repair_of_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i}" + "." * (i % 5 > 0)) for i in range(3000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    assert reports(frame) == brute_reports(rows)


def test_repair_of_nothing(spark):
    frame = spark.createDataFrame([], TURNS)
    assert reports(frame) == {}
    row = next((c, t) for c, t in product(range(100), range(5)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(*row, "user", "x", 1, "")], TURNS)
    got = repair.digests(gone, repair.repair(repair.damaged(gone))).collect()
    assert [tuple(r) for r in got] == [(row[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_readable(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 2, "user", "Why?"), (1, 3, "user", "Cut of")]
    done = repair.repair(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS))
    kept = [(r.role, r.text) for r in done.rows().orderBy("id", "step").collect()]
    assert kept[0] == ("system", "Be brief.") and re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in kept))
    assert done.edits.where("edit = 'D'").agg(F.sum("times")).first()[0] == 2


# ---------------------------------------------------------------- SimHash

def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    every = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in every]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    prints = sorted({brute_print(t) for _, t in rows})
    label = brute_groups(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            least.setdefault(label[brute_print(t)], []).append(i)
    return sorted(((i, f"{brute_print(t):016x}", min(least.get(label[brute_print(t)], [None]))) for i, t in rows), key=str)


def found_groups(frame):
    return sorted((tuple(r) for r in simhash.groups(frame).collect()), key=str)


PRINTED = "doc_id bigint, text string, print string, cell int"


def test_simhash_of_the_corpus_equals_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    assert found_groups(docs) == brute_simhash([tuple(r) for r in docs.collect()])


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "One two\tthree  four"), (2, "one TWO three\nfour"), (2, "other words stand here"), (3, None), (4, ""), (5, " \n"),
            (None, "one two three four"), (None, "alone in here, no id at all"), (6, long), (7, long + " end"), (8, "one"), (9, "one two"),
            (10, "É é 日本 😀 x y z"), (11, "one one one one one one"), (12, "ONE one one one")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], PRINTED).repartition(3)
    assert found_groups(frame) == brute_simhash(rows)
    assert found_groups(spark.createDataFrame([], PRINTED)) == []


def test_close_pairs_lose_no_link(spark):
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(6):
            prints.add(p ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))}))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    for bits in (1, 2, 3):
        want = {(signed(a), signed(b)) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= bits}
        assert {tuple(r) for r in simhash.close_pairs(frame, bits).collect()} == want


def test_many_hashes_equal_the_library():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in range(150)]
    sizes = np.array([len(t) for t in texts])
    got = simhash.xxh64(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]
