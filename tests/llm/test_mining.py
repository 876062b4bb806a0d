"""Hard negatives, license scans and conversation repair against brute force and edge cases."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.llm import conversation_repair, hard_negatives, license_scan
from ethoflow.llm._common import Scratch

# 11. Hard negatives


def brute_negatives(rows, anchor, k=5, m=10):
    fit = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in fit:
        if not anchor(a):
            continue
        others = [(sum(x * y for x, y in zip(v, w)), i, tag) for i, tag, w in fit if i != a and len(w) == len(v)]
        others.sort(key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in others if t[2] == label][:k]:
            band = [t for t in others if t[2] != label and 30 * p <= 100 * t[0] <= 90 * p][:m]
            out += [(a, pid, rank, n, clamp(p), clamp(s)) for rank, (s, n, _) in enumerate(band, 1)]
    return sorted(out)


def clamp(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], "vec_id long, label int, embedding array<double>, cell string, dims int").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect())


def test_negatives_with_ties_clusters_and_unfit_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 4
    rows = [(i, i % 3, (centres[i % 6] + rng.integers(-2, 3, 5) / 4).tolist()) for i in range(240)]
    rows += [(1000, None, [1.0] * 5), (1010, 1, None), (1020, 1, []), (1030, 1, [float("nan")] * 5), (1040, 1, [None] * 5), (None, 1, [1.0] * 5), (1050, 2, [1.0, 2.0]), (1051, 2, [1.0, 2.0]), (1052, 1, [0.6, 0.5])]
    rows += [(2000 + i, i % 2, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(60)]  # many equal rows
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows, pivot_rows=30, block_rows=16, group_least=3) == want
    assert mined(spark, rows) == want


def test_negatives_of_huge_and_negative_scores(spark):
    rows = [(0, 0, [1e30, -1e30]), (1, 0, [2e30, 1.0]), (2, 1, [1e30, 3.0]), (3, 1, [8e29, 1.0]), (4, 1, [-1e30, 0.5]), (10, 0, [-1e-3, 0.0]), (11, 0, [1.0, 1.0]), (12, 1, [1.0, 0.0]), (20, 2, [0.0, 0.0]), (21, 2, [1.0, 1.0])]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []


def test_bounds_leave_blocks_out_and_lose_nothing(spark, monkeypatch):
    """Far clusters are not sent to each other's anchors."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (np.eye(4)[i % 4] * 50 + rng.integers(-4, 5, 4) / 8).tolist()) for i in range(400)]
    names = []
    keep = Scratch.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        names.append((name, out))
        return out

    monkeypatch.setattr(Scratch, "keep", spy)
    assert mined(spark, rows, pivot_rows=20, block_rows=8, group_least=1) == brute_negatives(rows, lambda i: i % 10 == 0)
    bounds = next(df for name, df in names if name == "positives-bounds")
    blocks = next(df for name, df in names if name == "blocks")
    sent = blocks.join(bounds, ["dims", "cell"]).where("high >= near and low <= wide and high >= out").count()
    assert 0 < sent < 0.5 * blocks.count() * bounds.select("team").distinct().count()


# 12. Licenses

TEXTS = [
    None, "", "  \n", "MIT License", "the mit\n-- LICENSE! the Mit license mit", "Apache license and general public license, general public",
    "released under the MIT license.", "Released under MIT license", "licensed under cc by-nc 4.0", "é€😀 mit license é", "general license public",
    "x " * 30_000 + license_scan.TEXTS[5].text + " y" * 100,
]


def brute_spans(text, templates):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    out = []
    for t, template in enumerate(templates):
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.text.lower().encode())
        k = template.gram
        at = defaultdict(list)
        for q in range(len(own) - k + 1):
            at[tuple(own[q : q + k])].append(q)
        hits = sorted((p - q, p, q) for p in range(len(words) - k + 1) for q in at[tuple(words[p : p + k])])
        groups = []
        for d, p, q in hits:
            if not groups or d - groups[-1][-1][0] > template.step:
                groups.append([])
            groups[-1].append((d, p, q))
        for g in groups:
            share = len({q + i for _, _, q in g for i in range(k)}) / len(own)
            if share >= template.least:
                out.append((t, min(p for _, p, _ in g), max(p for _, p, _ in g) + k - 1, share))
    return len(words), sorted(out)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    texts = list(TEXTS)
    for t in license_scan.TEXTS:
        words = t.text.split()
        for changes in (0, 1, 3, 8):
            edited = list(words)
            for _ in range(min(changes, len(words) // 3)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], ["changed"], [edited[at], "put in"]])
            texts.append(" ".join(["before"] * rng.randrange(5) + edited + ["after"] + (edited if changes == 1 else [])))
    rows = [(i, t, "en", -5) for i, t in enumerate(texts)] + [(None, texts[6], "en", 0), (3, texts[3], "en", 1), (3, texts[6], "en", 1), (3, texts[3], "en", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")
    got = sorted(((r.doc_id, r.n_words, sorted((s.template, s.first_word, s.last_word, s.similarity) for s in r.spans)) for r in license_scan.scan_licenses(df).collect()), key=repr)
    assert got == sorted(((r[0], *brute_spans(r[1], license_scan.TEMPLATES)) for r in rows), key=repr)
    for r in license_scan.scan_licenses(df.where("doc_id = 9")).collect():
        assert [texts[9][s.start : s.end] for s in r.spans] == ["mit license"]


def test_license_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, TEXTS[4]), (2, TEXTS[8]), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.labelled(license_scan.scan_licenses(df)).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels, rows[1].labels, rows[1].score) == (2, 1, 4, "mit", "mit", 1.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].base_labels, rows[2].labels) == (0, None, "", "cc-by-nc")
    assert (rows[3].n_words, rows[3].labels, rows[3].score) == (0, "", 0.0)
    assert license_scan.scan_licenses(df.where("false")).count() == 0
    assert [r.spans for r in license_scan.scan_licenses(df, ()).collect()] == [[], [], []]


def test_grams_are_alike_where_their_words_are():
    words = [b"a", b"bb", b"a", b"bb", b"ab", b"b", b"a", b"bb"]
    h = license_scan._hashes(words, 2).tolist()
    assert h[0] == h[2] == h[6] and len(set(h)) == len({(a, b) for a, b in zip(words, words[1:])})


# 13. Conversations


def brute_repair(rows):
    """(cost, audit, roles and texts): a shortest path over all edits, by plain search."""
    turns = list(rows)
    heap, done = [(0, "", 0, "0", ())], set()
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        if at == len(turns) and state in "0a":
            return cost, audit, out
        done.add((at, state))
        for x, name in (("u", "user"), ("a", "assistant")):
            if (state, x) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", at, step[state, x], (*out, (name, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, step[state, role[:1]], (*out, (role, text))))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, step[state, x], (*out, (name, text))))


def brute_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for turn, role, text in turns:
            solid = text.rstrip(" \t\n\v\f\r")
            faulty.append((role, text, "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, result = brute_repair(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count("b"), count("d"), count("t"), illegal, cost, audit, sha)
    return out


def conversations(seed, sizes):
    rng = random.Random(seed)
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "User"])
            yield conv, rng.choice([turn, turn, turn, None, turn - 1]), role, rng.choice(["Yes.", "no", "", " \t", None, f"t{turn}?", f"é{turn}. \n", "What!", "x\u0085"])


@pytest.mark.parametrize("bits", [8, 2])
def test_conversations_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = [*conversations(bits, [1, 2, 3, 4, 5, 6, 7, 8, 20, 90, 0, 11]), (None, 1, "user", "Hm."), (None, None, None, None), (77, None, "user", None), *[(78, 3, "user", "Again.")] * 70]
    dropped = next(c for c in range(500, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "conv_id long, turn long, role string, text string, cost int, key string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repaired(df).collect()}
    assert got == brute_conversations(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(df).count() == 0


def test_repaired_turns_fit_the_grammar(spark):
    rows = list(conversations(3, [30, 1, 12]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    letters = defaultdict(str)
    for r in conversation_repair.repair(conversation_repair.damaged(df)).turns.orderBy("conv_id", "at").collect():
        letters[r.conv_id] += r.role[:1]
    assert letters and all(re.fullmatch("(s?(ua)+)?", x) for x in letters.values())
