"""The numbered operators against brute force, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ethoflow.llm import _arrays, _common, automaton, bpe, components, decontaminate, feistel, line_dedup, ngram_lm, quality_crf, queries, simhash, substring_dedup, topk_bsi, url_filter
from ethoflow.llm._common import OWN, Scratch, crc_of_id

LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "É È ñ 字 😀 x\u00a0y", LONG, "LINE one\nline TWO\n\nline three", "\x00\x1f'\"\\"]


def docs(spark, texts, **more):
    """Documents with awkward extra columns."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), 1.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")


def words_of(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


# 1. Top-k


def brute_top(rows, queries_, k=10):
    out = {}
    q = {i: np.floor(np.array(v, dtype=float) * 1024).astype(int) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v}
    for i in q:
        if queries_(i):
            found = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def test_topk_with_ties_and_unfit_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.choice([-0.5, 0.25, 0.0, 0.3], 6).tolist()) for i in range(230)]
    rows += [(300, None), (400, [float("nan")] * 6), (500, [float("inf")] + [0.0] * 5), (600, [None] + [0.0] * 5), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in topk_bsi.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(f32, lambda i: i % 100 == 0)


def test_topk_of_ragged_and_large_vectors(spark):
    rows = [(0, [5e13, 0.0]), (1, [1e30, 0.0]), (2, [3e9, 1.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0, 3.0]), (5, [0.5, 0.5, 0.5]), (6, [-5e13, 5.0]), (7, [2.0]), (8, [-1e300, 1.0]), (9, [1e17, -0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk_bsi.top_k(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fit = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for i, q in fit.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit.items() if j != i and len(v) == len(q))
        assert got[i] == [(j, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, j in scores]


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, -0.4])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in topk_bsi.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert topk_bsi.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bit_slices_add_up():
    rng = np.random.default_rng(1)
    m, q = rng.integers(-600, 600, (100, 8)), rng.integers(-600, 600, 8)
    bitmaps, low = topk_bsi.slices_of(m)
    found = topk_bsi.search(bitmaps, low.tolist(), np.arange(100), -1, q.tolist(), 100)
    assert dict(found) == {i: int(v) for i, v in enumerate(m @ q)}


# 2. Decontamination

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words2(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    w, hit, names = words2(text), set(), set()
    for item, t in items:
        iw = words2(t)
        n = min(10, len(iw))
        for p in range(len(iw) - n + 1 if iw else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == iw[p : p + n]:
                    hit.update(range(at, at + n))
                    names.add(item)
    return len(w), len(hit), sorted(names, key=lambda i: (i is not None, i or 0))


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"k{i}" for i in range(30)] + ["É1", "字"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((25, 10, 11, 3, 1, 40))] + [(6, None), (7, "!!"), (1, "k1 k2"), (10, "K3, k4-K5")]
    texts = TEXTS + [f"{' '.join(rng.choice(vocab) for _ in range(20))}!? {items[i % 6][1].upper()} / {' '.join(rng.choice(vocab) for _ in range(5))}" for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts) if t is not LONG}
    got = {r.doc_id: r for r in decontaminate.scan_documents(docs(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    for i, w in want.items():
        assert (got[i].n_words, got[i].n_hit, list(got[i].items)) == w
        for s in got[i].spans:
            assert words2(texts[i][s.start : s.end]) == words2(texts[i])[s.first_word : s.last_word + 1]
    odd = docs(spark, texts).withColumn(OWN + "spans", F.lit("mine"))
    assert {r[OWN + "spans"] for r in decontaminate.drop_contaminated(odd, bench).collect()} == {"mine"}
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} - {texts.index(LONG)} == {i for i, w in want.items() if not w[1]}
    assert decontaminate.scan_documents(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan_documents(docs(spark, texts).limit(0), bench).count() == 0


def test_automaton_cuts_runs_anywhere(tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    rng = random.Random(5)
    for case in range(12):
        vocab = [f"k{i}" for i in range(2 + case % 4)]
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 4, 9, 10, 11, 25))))) for i in range(4)]
        items += [(9, items[0][1]), (None, items[1][1]), (11, items[2][1] + " unseen")]
        texts = [" ".join(rng.choice(vocab + ["other"]) for _ in range(rng.randrange(90))) + "! " + items[3][1] for _ in range(6)] + [None, "", "?"]
        root = f"{tmp_path}/{case}"
        automaton.build(root, ((i, decontaminate.normalise(t).split()) for i, t in items), decontaminate.WINDOW)
        for lane in (1, 3, 256):
            monkeypatch.setattr(automaton, "LANE", lane)
            for text, (n, names, spans) in zip(texts, decontaminate.Scanner(root).scan(texts)):
                want = brute_hits(text, items)
                assert (n, sum(s[1] - s[0] + 1 for s in spans), names) == (want[0], want[1], sorted(x for x in want[2] if x is not None))


def test_decontamination_with_a_large_benchmark(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(1 << 20)}" for _ in range(40))) for i in range(20_000)]  # 6 MB
    chosen = rng.sample(range(20_000), 30)
    texts = ["nothing of it", *(f"Before {' '.join(items[i][1].split()[5:25]).upper()}, after" for i in chosen), items[7][1][:60]]
    found = {r.doc_id: r for r in decontaminate.scan_documents(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [(found[i].n_hit, list(found[i]["items"])) for i in range(len(texts))] == [(0, []), *((20, [i]) for i in chosen), (0, [])]


# 3. BPE


@pytest.fixture(scope="module")
def tokenizers():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return bpe.Tokenizer(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), path, P.PATTERN


def test_a_worker_keeps_the_tables_of_one_operator(tokenizers, tmp_path):
    """The automaton and the tokenizer are not held together."""
    import gc
    import weakref

    def gone(ref):
        gc.collect()
        return ref() is None

    automaton.build(f"file://{tmp_path}/a", [(1, b"a b c d e f g h i j k l m n".split())], decontaminate.WINDOW)
    scanner = weakref.ref(decontaminate._scanner(f"file://{tmp_path}/a"))
    tok = weakref.ref(bpe._tokenizer("k", tokenizers[0]._ranks, tokenizers[3]))
    assert gone(scanner) and tok() is bpe._tokenizer("k", {}, "")
    decontaminate._scanner(f"file://{tmp_path}/a")
    assert gone(tok)
    tok = weakref.ref(bpe._tokenizer("k", tokenizers[0]._ranks, tokenizers[3]))
    _common.let_go()
    assert gone(tok)


def test_bpe_equals_the_library(tokenizers):
    own, ref, _, _ = tokenizers
    rng = random.Random(1)
    for k in range(3000):
        if k % 3:
            pool = [chr(rng.randrange(0x20, 0x7F)) for _ in range(5)] + [" ", "\n", "'s", "\x1c", "\x85", "\xa0", "\u3000", "é", "1", "字", "😀", chr(rng.randrange(0xD7FF)), chr(rng.randrange(0xE000, 0x110000))]
        else:
            pool = list("abcdeinorst ")
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert list(struct.unpack(f"<{len(own.encode(text)) // 4}I", own.encode(text))) == ref.encode_ordinary(text)
    for n in (1023, 1024, 1025, 5000):  # long pieces: emission before the end
        text = "".join(rng.choice("abcdeéinorst") for _ in range(n))
        assert list(np.frombuffer(own.encode(text), "<u4")) == ref.encode_ordinary(text)
    assert own.decode(own.encode("x" * 50_000)) == "x" * 50_000


def test_bpe_with_full_tables(tokenizers, monkeypatch):
    _, ref, path, pattern = tokenizers
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "PAIR_BITS", 5)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1000)
    own = bpe.Tokenizer(bpe.read_ranks(path), pattern)
    for seed in range(50):
        text = " ".join(words_of(20, seed)) + "xyzzyq"
        assert list(np.frombuffer(own.encode(text), "<u4")) == ref.encode_ordinary(text)


def test_utf8_stream_in_any_blocks():
    data = "aé字😀\u07ff\uffff".encode()
    for n in range(1, 6):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + n]) for i in range(0, len(data), n)) + s.end() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe5\xad") == "" and s.end() == "\ufffd"


def test_bpe_frames(spark, tokenizers):
    own, ref, path, pattern = tokenizers
    df = docs(spark, TEXTS).withColumn("ids", F.lit("old"))
    back = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    rows = {r.doc_id: r for r in back.collect()}
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(df, path, pattern).collect()} == {i: (r.ids, r.decoded) for i, r in rows.items()}
    assert len(rows) == len(TEXTS) and all(rows[i].decoded == (t or "") for i, t in enumerate(TEXTS))
    assert bytes(rows[0].ids) == bytes(rows[1].ids) == b""
    assert bpe.encode(df.limit(0), path, pattern).count() == 0


# 4. SimHash


def brute_fp(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    base = words_of(300, 5)
    texts = TEXTS + [" ".join(base)] * 3 + [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (10, 100, 290)] + [" ".join(words_of(80, s)) for s in range(6)]
    fps = [brute_fp(t) for t in texts]
    want = closure(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = {r.doc_id: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == set(want)
    assert simhash.simhash_groups(docs(spark, texts).limit(0)).count() == 0
    nulls = docs(spark, texts[10:13]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {r.component_id for r in simhash.simhash_groups(nulls).collect()} == {1}
    nameless = docs(spark, [" ".join(base), " ".join(base[:10] + ["changed"] + base[11:]), "other words that stay here"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert len({r.text for r in simhash.keep_one(nameless).collect()}) == simhash.keep_one(nameless).count() == 2


def test_links_lose_none(spark):
    rng = random.Random(2)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        for d in range(7):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    want = closure(len(values), [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if near(a, b)])
    linked = [i for i, a in enumerate(values) if any(near(a, b) for b in values if b != a)]
    got = {r.fp: r.root for r in simhash.value_groups(spark.createDataFrame([(v,) for v in values], "fp long"), Scratch(spark, "t")).collect()}
    assert set(got) == {values[i] for i in linked}
    root = {}
    for i in linked:
        assert root.setdefault(want[i], got[values[i]]) == got[values[i]]
    assert len(set(root.values())) == len(root)


def test_components(spark):
    rng = random.Random(4)
    for pairs in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]):
        df = spark.createDataFrame(pairs, "a long, b long")
        got = {r.node: r.root for r in components.connected_components(df, Scratch(spark, "t")).collect()}
        want = closure(100, pairs)
        assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


# 5. Passages


def brute_windows(ranks, width):
    n, out = len(ranks), set()
    for c in range(n):
        lo = c
        while lo and ranks[lo - 1] > ranks[c]:
            lo -= 1
        hi = c
        while hi + 1 < n and ranks[hi + 1] >= ranks[c]:
            hi += 1
        if hi - lo + 1 >= width:
            out.add((lo, c, hi))
    return out


def test_packed_ids_are_decoded_as_arrays():
    """Packed ids become text without a Python number for each; gaps and ends of the vocabulary raise as for single ids."""
    tok = bpe.Tokenizer({b"a": 0, b"b": 1, "é".encode()[:1]: 2, "é".encode()[1:]: 3, b"ab": 7}, r"(?s:.+)")
    ids = np.array([7, 2, 3, 1] * 3000, dtype="<u4")
    assert "".join(tok.decode_stream(ids)) == tok.decode(ids.tobytes()) == "".join(tok.decode_stream(iter(ids.tolist()))) == "abéb" * 3000
    for bad in ([5], [8], [1 << 31]):
        with pytest.raises(KeyError):
            tok.decode(np.array(bad, dtype="<u4").tobytes())
    for bad in ([-1], [1 << 70], [5]):
        with pytest.raises(KeyError):
            list(tok.decode_stream(bad))
    assert isinstance(tok._words[0], np.ndarray) and tok.decode(None) == ""


def test_compact_windows():
    rng = np.random.default_rng(0)
    for n in (0, 3, 7, 8, 50, 400):
        ranks = rng.integers(0, 1 << 62, (3, n), dtype=np.uint64)
        o, l, c, r = substring_dedup.compact_windows(ranks, 8)
        for k in range(3):
            assert {(a, b, d) for x, a, b, d in zip(o.tolist(), l.tolist(), c.tolist(), r.tolist()) if x == k} == brute_windows([int(x) >> 9 << 9 for x in ranks[k]], 8)


def test_passages(spark):
    passage, other = words_of(60, 100), words_of(80, 101)
    near = other[:40] + ["changed"] + other[41:]
    fill = lambda s, n=90: words_of(n, s, 100_000)
    texts = [fill(1) + passage + fill(2), passage + fill(3), fill(4) + passage, fill(5) + other + fill(6), fill(7) + near, fill(8) + passage[:40] + fill(9), fill(10), fill(10)]
    texts = [" ".join(t) for t in texts] + TEXTS
    got = {r.doc_id: r for r in substring_dedup.passages(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].class_id for i in range(8)] == [0, 0, 0, 3, 3, 5, 6, 6]
    for i, at in ((0, 90), (1, 0), (2, 90)):
        assert any(abs(s.first - at) <= 2 and abs(s.last - at - 59) <= 2 for s in got[i].spans)
    assert got[5].n_links == 0 and got[7].n_words == 90
    assert all(got[8 + i].class_id == 8 + i for i in range(len(TEXTS)))
    assert substring_dedup.passages(docs(spark, texts).limit(0)).count() == 0


def brute_agreed(orders, left, right, offsets):
    out = []
    for offset in sorted(set(offsets)):
        for i in range(len(orders)):
            if offsets[i] == offset:
                near = {orders[j] for j in range(len(orders)) if abs(offsets[j] - offset) <= substring_dedup.GAP and min(right[i], right[j]) - max(left[i], left[j]) + 1 >= substring_dedup.WIDTH}
                if len(near) >= substring_dedup.AGREE:
                    out.append(offset)
                    break
    return out


def test_agreed_offsets():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6, 40):
        for _ in range(30):
            orders, left, offsets = rng.integers(0, 4, n), rng.integers(0, 200, n), rng.integers(-40, 40, n)
            right = left + rng.integers(substring_dedup.WIDTH - 1, 90, n)
            assert sorted(o for o, _, _ in substring_dedup.agreed_offsets(orders, left, right, offsets, left)) == brute_agreed(*(x.tolist() for x in (orders, left, right, offsets)))


def test_recall_of_edited_passages(spark):
    """Pairs of documents with a passage of fifty words, equal or with one word changed, against a comparison of all of them."""
    texts, edited = [], []
    for k in range(120):
        passage = words_of(50, 20_000 + k, 100_000)
        other = passage[:]
        if k % 2:
            other[(k * 7) % 50] = "changed"
        for side, p in enumerate((passage, other)):
            texts.append(" ".join(words_of(40 + k % 17, 30_000 + 2 * k + side, 100_000) + p + words_of(45, 40_000 + 2 * k + side, 100_000)))
        edited.append(k % 2 == 1)
    shingles = [substring_dedup.shingles_of(t) for t in texts]
    brute = {(i, j) for i in range(len(texts)) for j in range(i) if len(np.intersect1d(shingles[i], shingles[j])) and substring_dedup.matched_ranges(shingles[i], shingles[j])}
    assert {(2 * k + 1, 2 * k) for k in range(120) if not edited[k]} <= brute <= {(2 * k + 1, 2 * k) for k in range(120)}
    got = {r.doc_id: r.class_id for r in substring_dedup.passages(docs(spark, texts)).collect()}
    found = {p for p in brute if got[p[0]] == got[p[1]]}
    assert all(got[i] == i or (i, got[i]) in brute for i in range(len(texts)))  # no false links
    assert {p for p in brute if not edited[p[1] // 2]} <= found
    assert len(found) >= 0.9 * len(brute) and sum(edited[p[1] // 2] for p in found) >= 0.9 * sum(edited[p[1] // 2] for p in brute)


def test_equal_passages_behind_partial_copies(spark):
    """Forty documents share sixty words, of which two earlier documents hold forty-seven each."""
    passage = words_of(60, 777, 100_000)
    texts = [" ".join(words_of(70, 50_000 + i, 100_000) + p + words_of(70, 51_000 + i, 100_000)) for i, p in enumerate([passage[:47], passage[13:], *([passage] * 40)])]
    got = {r.doc_id: r.class_id for r in substring_dedup.passages(docs(spark, texts)).collect()}
    assert {got[i] for i in range(2, 42)} == {2} and got[0] == 0 and got[1] == 1


def test_passages_with_repeated_lines(spark):
    line, before, after = words_of(16, 20), words_of(25, 21), words_of(25, 22)
    passage = before + line + after
    fill = lambda s, n=60: words_of(n, s, 100_000)
    texts = [line + fill(23) + passage + fill(24), fill(25) + passage + fill(26)]
    again = words_of(12, 27) * 6  # repeats inside
    texts += [fill(28) + again + fill(29), fill(30, 70) + again + fill(31)]
    texts = [" ".join(t) for t in texts]
    a, b, c, d = map(substring_dedup.shingles_of, texts)
    assert substring_dedup.matched_ranges(a, b) == []
    assert (76, 76 + 61, 60, 60 + 61) in substring_dedup.matched_ranges(a, b, [(16, 0, 1000)])
    assert (60, 60 + 67, 70, 70 + 67) in substring_dedup.matched_ranges(c, d, [(-10, 0, 1000)])
    got = {r.doc_id: r for r in substring_dedup.passages(docs(spark, texts[:2])).collect()}
    assert got[0].class_id == got[1].class_id and any(s.first == 76 and s.last == 141 for s in got[0].spans)


def test_equal_passages_behind_edited_first_documents(spark):
    texts, last = [], []
    for trial in range(12):
        passage = words_of(50, 300 + trial)
        for k in range(3):  # earlier documents with a part each, too short to match
            part = passage[:]
            part[:10 + 5 * k] = words_of(10 + 5 * k, 4000 + 10 * trial + k, 100_000)
            part[36 + 5 * k :] = words_of(14 - 5 * k, 5000 + 10 * trial + k, 100_000) if k < 2 else part[36 + 5 * k :]
            texts.append(words_of(60, 6000 + 10 * trial + k, 100_000) + part + words_of(60, 7000 + 10 * trial + k, 100_000))
        last.append(len(texts))
        texts += [words_of(30, 8000 + 2 * trial + k, 100_000) + passage + words_of(40, 9000 + 2 * trial + k, 100_000) for k in (0, 1)]
    got = {r.doc_id: r for r in substring_dedup.passages(docs(spark, [" ".join(t) for t in texts])).collect()}
    for i in last:
        assert got[i].class_id == got[i + 1].class_id
        for j in (i, i + 1):
            assert any(s.first <= 30 and s.last >= 79 for s in got[j].spans)


def test_edited_passages_behind_first_documents_that_match_neither(spark):
    """Two edited forms of sixty words; earlier documents hold the parts of them, each too short to match."""
    texts, last = [], []
    for trial in range(12):
        passage = words_of(60, 1300 + trial, 100_000)
        for k, part in enumerate((passage[:40], passage[20:])):
            texts.append(words_of(60, 16_000 + 10 * trial + k, 100_000) + part + words_of(60, 17_000 + 10 * trial + k, 100_000))
        last.append(len(texts))
        for k in (0, 1):
            own = passage[:]
            own[30] = f"edit{k}"
            texts.append(words_of(30, 18_000 + 2 * trial + k, 100_000) + own + words_of(40, 19_000 + 2 * trial + k, 100_000))
    got = {r.doc_id: r for r in substring_dedup.passages(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert sum(got[i].class_id == got[i + 1].class_id == i for i in last) == 12
    for i in last:
        assert got[i - 1].class_id == i - 1 and got[i].n_links == got[i + 1].n_links == 1
        assert any(s.first <= 31 and s.last >= 88 for s in got[i].spans) and any(s.first <= 31 and s.last >= 88 for s in got[i + 1].spans)


def test_anchor_pairs_of_matching_ranges():
    """Two texts with 46 common shingles but for one changed word share a pair of anchors, wherever the word is."""
    for k in range(50):
        passage = words_of(50, 600 + k, 100_000)
        keys = []
        for side in (0, 1):
            own = passage[:]
            own[k] = f"edit{side}"
            s = substring_dedup.shingles_of(" ".join(words_of(30, 800 + 2 * k + side, 100_000) + own + words_of(30, 900 + 2 * k + side, 100_000)))
            pairs, first, last = substring_dedup.anchor_pairs(s, np.ones(len(s), dtype=bool))
            assert ((last - first >= substring_dedup.APART[0]) & (last - first <= substring_dedup.APART[1])).all()
            keys.append(set(pairs.tolist()))
        assert keys[0] & keys[1]


def test_only_shared_anchors_are_paired():
    """Pairs of anchors that no other text holds are not dealt out; of the shared ones none is lost."""
    passage = words_of(60, 610, 100_000)
    made, all_pairs = [], []
    for side in (0, 1):
        s = substring_dedup.shingles_of(" ".join(words_of(200, 620 + side, 100_000) + passage + words_of(200, 630 + side, 100_000)))
        keys, at, marked = substring_dedup.anchors_near(s, np.array([225], dtype=np.uint32).tobytes())
        made.append((s, keys, at, marked))
        all_pairs.append(substring_dedup.anchor_pairs(s, marked)[0])
    left = [substring_dedup.anchor_pairs(s, marked, at[np.isin(keys, made[1 - k][1])])[0] for k, (s, keys, at, marked) in enumerate(made)]
    shared = np.intersect1d(*all_pairs)
    assert len(shared) and all(np.isin(shared, x).all() for x in left)
    assert all(len(x) < len(y) / 3 for x, y in zip(left, all_pairs))


def test_verification_in_parts_is_whole(spark):
    passage = words_of(60, 650)
    texts = [" ".join(words_of(20, 660 + i, 100_000) + passage) for i in range(6)]
    pairs = spark.createDataFrame([(i, j, texts[i], [0, 0, 1000]) for i in range(6) for j in range(i)], "a long, b long, text_a string, offsets array<int>")
    rows = docs(spark, texts).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = substring_dedup.verified_in_parts(pairs, rows, 3000, Scratch(spark, "parts"))
    assert len(got.inputFiles()) and sorted((r.a, r.b) for r in got.collect()) == [(i, j) for i in range(6) for j in range(i)]


def plain_cuts(a, b):
    """Runs of first places of common shingles, cut at the widest gap one by one; every count is taken from the texts."""
    first_a, first_b = ({x: k for k, x in reversed(list(enumerate(t)))} for t in (a, b))
    places, out = sorted((first_a[x], first_b[x]) for x in first_a if x in first_b), set()
    todo = [places] if places else []
    while todo:
        run = todo.pop()
        gaps = [max(y[0] - x[0], y[1] - x[1] if y[1] > x[1] else 1 << 40) for x, y in zip(run, run[1:])]
        if gaps and max(gaps) > substring_dedup.GAP:
            cut = gaps.index(max(gaps)) + 1
            todo += [run[:cut], run[cut:]]
            continue
        in_a, in_b = a[run[0][0] : run[-1][0] + 1], b[run[0][1] : run[-1][1] + 1]
        n, many = len(run), len(set(in_a)) + len(set(in_b))
        if n >= substring_dedup.SIMILARITY * (many - n) and min(len(in_a), len(in_b)) >= substring_dedup.WIDTH - 1 and max(len(in_a), len(in_b)) >= substring_dedup.WIDTH:
            out.add((run[0][0], run[-1][0], run[0][1], run[-1][1]))
        elif gaps and max(gaps) > 1:
            cut = gaps.index(max(gaps)) + 1
            todo += [run[:cut], run[cut:]]
    return sorted(out)


def test_texts_given_up_early_match_nowhere():
    """The bounds by which pairs are given up lose no range, in texts with and without repeats."""
    rng, found = np.random.default_rng(11), 0
    for _ in range(400):
        a = rng.integers(0, rng.integers(20, 2000), rng.integers(46, 160))
        b = a[rng.integers(0, 12) :].copy()
        b[rng.integers(0, len(b), rng.integers(0, 16))] = rng.integers(5000, 5100)
        a, b = np.concatenate([a, a[: rng.integers(1, 40)]]).astype(np.uint64), np.concatenate([rng.integers(3000, 4000, rng.integers(1, 40)), b]).astype(np.uint64)
        x, y = substring_dedup._Text(a), substring_dedup._Text(b)
        for t in (x, y):
            spans = [len(set(t.shingles[k : k + substring_dedup.WIDTH - 1].tolist())) for k in range(len(t.shingles) - substring_dedup.WIDTH + 2)]
            assert t.least <= min(spans, default=substring_dedup.WIDTH - 1)
        got = substring_dedup._matched(x, y, [])
        assert got == plain_cuts(a.tolist(), b.tolist())
        found += bool(got)
    assert 50 < found < 390


def test_pairs_are_verified_without_texts(spark):
    """Pairs carry the places of shingles in files; a worker that holds two texts only finds the same."""
    passage = words_of(60, 670)
    texts = [" ".join(words_of(20, 680 + i, 100_000) + passage) for i in range(12)] + [" ".join(words_of(90, 700, 100_000))]
    root = f"{Scratch(spark, 'placed').root}/shingles"
    places = substring_dedup.placed(docs(spark, texts).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), root).cache()
    files = _arrays.AppendedFiles(root)
    for r in places.collect():
        assert files.read(r.file, r["at"], r.n).tolist() == substring_dedup.shingles_of(texts[r.doc_id]).tolist()
    pairs = places.withColumnRenamed("doc_id", "a").crossJoin(places.select(F.col("doc_id").alias("b"))).where("a > b").withColumn("offsets", F.expr("array(0, 0, 1000)"))
    found = substring_dedup.verified(pairs, places, root)
    assert "text" not in "".join(pairs.columns)
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, j) for i in range(12) for j in range(i)]
    places.unpersist()
    held = substring_dedup._Texts(root)
    held._held["other"] = substring_dedup._Text(np.zeros(1, dtype=np.uint64))
    held._size = 1 << 40
    r = places.first()
    assert held.get(r.file, r["at"], r.n) is held.get(r.file, r["at"], r.n)


def test_shuffle_files_go_with_their_job(spark):
    import time

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, had = spark.conf.get(key, "false"), files()
    with _common.shuffles_freed(spark):
        _common.Scratch(spark, "freed").keep(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(7, "k"), "rows")
        end = time.time() + 20
        while files() > had and time.time() < end:
            time.sleep(0.2)
        assert files() <= had
    assert spark.conf.get(key, "false") == before


def test_windows_of_many_texts_at_once():
    texts = [" ".join(words_of(n, 640 + n, 300)) for n in (3, 50, 61, 400, 0, 120)] + [None, "a " * 90]
    for text, got in zip(texts, substring_dedup._windows(texts)):
        s = substring_dedup.shingles_of(text)
        if len(s) < substring_dedup.WIDTH:
            assert got is None
            continue
        orders, left, centres, right = substring_dedup.compact_windows(substring_dedup.ordered(s, substring_dedup._ALL))
        inner = (centres >= substring_dedup.CONTEXT) & (centres < len(s) - substring_dedup.CONTEXT)
        assert all(np.array_equal(x, y[inner]) for x, y in zip(got[1:5], (orders, left, centres, right))) and np.array_equal(got[5], s)
        alone = substring_dedup._windows([text])[0]
        assert np.array_equal(got[0], alone[0])


# 6. Quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    u, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    good, pair, log_z = quality_crf.marginals(u, np.array([0]), np.array([4]), moves)
    z, p, t = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = math.exp(sum(u[i] * y[i] for i in range(4)) + sum(moves[y[i], y[i + 1]] for i in range(3)))
        z += w
        p += w * np.array(y)
        for i in range(3):
            t[y[i], y[i + 1]] += w
    assert good == pytest.approx(p / z) and pair == pytest.approx(t / z) and log_z == pytest.approx(math.log(z))


def test_score_equals_enumeration():
    """A fitted model's scores against sums over all labellings of each document's lines."""
    rng = np.random.default_rng(1)
    texts = ["\n".join(" ".join(words_of(int(rng.integers(1, 9)), 50 * i + k)) + "." * (i % 2) for k in range(1 + i % 5)) for i in range(30)]
    model = quality_crf.fit([quality_crf.line_features(t) for t in texts], np.arange(30) % 2)
    got = model.scores(texts + [None, "", "\n \n"])
    for t, score in zip(texts, got):
        own, length = quality_crf.line_features(t)
        n = len(length)
        assert n == len(t.split("\n")) and length.tolist() == [len(line) for line in t.split("\n")]
        zero = np.zeros(own.shape[1])
        x = [np.concatenate([own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < n else zero, [i == 0, i == n - 1]]) for i in range(n)]
        unary = [float((v - model.mean) / model.scale @ model.weights + model.bias) for v in x]
        z, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(u for u, label in zip(unary, y) if label) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            z += w
            good += w * np.array(y)
        share = float(good / z @ length)
        odds = math.log(share + 1e-6) - math.log(length.sum() - share + 1e-6)
        assert score == pytest.approx(1 / (1 + math.exp(-(model.slope * odds + model.shift))), abs=1e-6)
    assert got[30:].tolist() == [0.5] * 3


def test_blocks_of_long_chains_sum_as_whole_chains():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 0, 7, 600, 2, 257, 1100, 256])
    starts, u, moves = np.cumsum(sizes) - sizes, 3 * rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, pair, log_z = np.zeros(len(u)), np.zeros((2, 2)), 0.0
    for s, n in zip(starts, sizes):
        if not n:
            continue
        phi = np.array([[0.0, x] for x in u[s : s + n]])
        f, b = [phi[0]], [np.zeros(2)]
        for t in range(1, n):
            f.append(phi[t] + [np.logaddexp(f[-1][0] + moves[0, y], f[-1][1] + moves[1, y]) for y in (0, 1)])
        for t in range(n - 2, -1, -1):
            b.insert(0, np.array([np.logaddexp(moves[y, 0] + phi[t + 1, 0] + b[0][0], moves[y, 1] + phi[t + 1, 1] + b[0][1]) for y in (0, 1)]))
        z = np.logaddexp(*f[-1])
        log_z += z
        good[s : s + n] = [np.exp(f[t][1] + b[t][1] - z) for t in range(n)]
        for t in range(1, n):
            pair += np.exp(f[t - 1][:, None] + moves + (phi[t] + b[t])[None, :] - z)
    for block in (1, 2, 3, 256, 5000):
        got = quality_crf.marginals(u, starts, sizes, moves, block)
        assert np.allclose(got[0], good) and np.allclose(got[1], pair) and got[2] == pytest.approx(log_z)


def test_lines_change_over():
    good, document = np.array([0.9, 0.05, 0.1, 0.9, 0.95, 0.5]), np.array([0, 0, 0, 1, 1, 1])
    label = np.array([1, 1, 1, 0, 0, 0])
    # Of two unlikely lines in each document, half of the length leaves room for the more unlikely one only.
    assert quality_crf.changed_over(good, document, label, np.array([2.0, 2, 2, 2, 2, 2])).tolist() == [1, 0, 1, 0, 1, 0]
    # Mixed documents teach the chain moves between labels: good prose with junk lines, and junk with lines of prose.
    prose = lambda s: " ".join(words_of(12, s)) + "."
    junk = lambda s: " ".join(f"{w.upper()}$$#" for w in words_of(8, s))
    texts = ["\n".join((junk if (k % 4 == 3) == (i % 2 == 0) else prose)(100 * i + k) for k in range(8)) for i in range(60)]
    model = quality_crf.fit([quality_crf.line_features(t) for t in texts], np.arange(60) % 2 == 0)
    alone = model.scores([prose(9000), junk(9001)])
    assert alone[0] > 0.9 and alone[1] < 0.1
    assert ((model.scores(texts) >= 0.5) == (np.arange(60) % 2 == 0)).all()


def test_quality(spark):
    good = ["\n".join(" ".join(words_of(12, 10 * i + k)) + "." for k in range(4)) for i in range(60)]
    bad = ["\n".join(" ".join(f"{w.upper()}$$#" for w in words_of(8, 10 * i + k)) for k in range(4)) for i in range(60)]
    df = docs(spark, [t for p in zip(good, bad) for t in p] + TEXTS)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    usable = crc_of_id() % 4 != 2
    model = quality_crf.train(df, labels, usable)
    got = {r.doc_id: r for r in quality_crf.score(df, model).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i][OWN + "quality"] >= 0.7) == (i % 2 == 0) for i in held)
    assert len(got) == 120 + len(TEXTS) and all(0 <= r[OWN + "quality"] <= 1 for r in got.values())
    flat = quality_crf.train(df, labels.limit(0), usable)
    assert {r[OWN + "quality"] for r in quality_crf.score(df, flat).collect()} == {0.5}
    assert quality_crf.score(df.limit(0), model).count() == 0


# 7. Language model


def test_packed_columns_and_buckets(tmp_path):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        rows = np.sort(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(33)), rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
        keys, counts = _arrays.unpacked_columns(_arrays.packed_columns(rows, [rows[2], np.ones(n, dtype=np.uint64)]))
        assert all((a == b).all() for a, b in zip(keys, rows)) and (counts[0] == rows[2]).all() and (counts[1] == 1).all()
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        common = np.stack([rng.integers(0, 5, len(own)), rng.integers(0, 2, len(own)) * 70_000], axis=1).astype(np.uint64)
        wide = rng.integers(0, 1 << 40, (len(own), 1)).astype(np.uint64)
        common[: len(own) // 9, 0] = wide[: len(own) // 9, 0]
        _arrays.write_bucket(f"{tmp_path}/{n}", {"few": (own, common), "wide": (own, wide), "dense": (None, wide)})
        b = _arrays.Bucket(f"{tmp_path}/{n}")
        asked = np.concatenate([own, own ^ np.uint64(1 << 40)])[:: 2 if n > 7 else 1]
        for name, columns in (("few", common), ("wide", wide), ("none", wide)):
            out = np.zeros((len(asked), columns.shape[1]), dtype=np.uint64)
            b.find(name, asked, out, np.arange(len(asked)))
            held = dict(zip(own.tolist(), columns.tolist())) if name != "none" else {}
            assert out.tolist() == [held.get(k, [0] * columns.shape[1]) for k in asked.tolist()]
        assert (b.column("dense", np.arange(len(own))) == wide[:, 0]).all()
    assert not _arrays.Bucket(f"{tmp_path}/absent").arrays


def chen_goodman(n1, n2, n3, n4):
    """The three discounts, within (0.05, 0.95), (0.05, 1.95) and (0.05, 2.95); halves of the counts where there are too few to tell."""
    if n1 == 0 or n2 == 0:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95)))


@pytest.mark.parametrize("order, split", [(2, 40), (3, 1_000_000), (3, 20), (4, 20)])
def test_language_model(spark, order, split):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(60))).upper() for _ in range(40)] + TEXTS
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    df = docs(spark, texts)
    model = ngram_lm.train(df, crc_of_id() % 5 != 1, order, split_tokens=split)
    got = {r.doc_id: r for r in ngram_lm.score(df, model).collect()}
    split = lambda t: (t or "").encode().lower().split() + ["</s>"]
    levels = {order: Counter()}
    uni = Counter()
    for t in train:
        w = ["<s>"] * (order - 1) + split(t)
        levels[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        uni.update(w[order - 1 :])
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    context, cuts = {}, {}
    for k, c in levels.items():
        cuts[k] = chen_goodman(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))
        context[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, n in c.items():
            context[k][g[:-1]][0] += n
            context[k][g[:-1]][min(n, 3)] += 1

    def p(g):
        if not g:
            return 1 / (len(uni) + 1)
        k, low = len(g), p(g[1:])
        if g[:-1] not in context[k]:
            return low
        e, c, d = context[k][g[:-1]], levels[k][g], (0, *cuts[k])
        return (max(c - d[min(c, 3)], 0) + sum(d[i] * e[i] for i in (1, 2, 3)) * low) / e[0]

    total = sum(uni.values())
    for i, t in enumerate(texts):
        if t is LONG:
            continue
        w = ["<s>"] * (order - 1) + split(t)
        assert got[i].n_tokens == len(w) - order + 1 and got[i].train_tokens == total
        assert got[i].n_known == sum(x in uni for x in w[order - 1 :])
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(w[j : j + order]))) for j in range(len(w) - order + 1)))
        assert got[i].base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (len(uni) + 1))) for x in w[order - 1 :]))
    # Probabilities of all words and one unknown add up to one.
    seen = [x for x in uni if x != "</s>"]
    ids = model.words.ids(ngram_lm.hashes_of([b"a", *seen]))
    assert len(set(ids.tolist())) == len(seen) and int(ids.max()) < int(ngram_lm.UNKNOWN)
    own = model.words.local(np.unique(np.concatenate([ids, [ngram_lm.END, ngram_lm.UNKNOWN]])))
    first = int(np.searchsorted(own.ids, ids[0]))
    rows = np.array([[first] * (order - 1) + [i] for i in range(len(own.ids))])
    assert model.probabilities(own, rows).sum() == pytest.approx(1)


def test_language_model_without_training_rows(spark):
    model = ngram_lm.train(docs(spark, ["a b"]), F.lit(False))
    r = ngram_lm.score(docs(spark, ["a b"]), model).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0)


# 8. Line dedup


def brute_lines(texts):
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:8], 16) & 2147483647

    chunks, place = {}, defaultdict(list)
    for i, t in enumerate(texts):
        if t is None:
            continue
        lines = t.split("\n")
        rolled = [(h(line) * 1_000_003 + (h(lines[k - 1]) if k else 0)) % 2147483647 for k, line in enumerate(lines)]
        out, now = [], []
        for k, line in enumerate(lines):
            now.append(line)
            if k == len(lines) - 1 or 1 <= k <= len(lines) - 3 and rolled[k - 1] > rolled[k] <= rolled[k + 1]:
                out.append(now)
                now = []
        chunks[i] = out
        for k, c in enumerate(chunks[i]):
            if len(c) > 1:
                place["\n".join(c)].append((i, k))
    gone = {p for ps in place.values() for p in ps[1:]}
    return {i: "\n".join("\n".join(c) for k, c in enumerate(cs) if (i, k) not in gone) for i, cs in chunks.items()}


def test_line_dedup(spark):
    shared = [" ".join(words_of(6, s)) for s in range(30)]
    texts = [None, "", "one", "\n\n\n", "\n".join(shared), "new\n" + "\n".join(shared), "\n".join(shared[3:20] + ["x"] + shared[20:]), "a\nb", "\n".join(shared), LONG]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want = brute_lines(texts)
    assert len(got) == len(texts) and got[0].text is None
    assert {i: got[i].text for i in want} == want
    assert got[5][OWN + "removed_lines"] > 20 and got[4][OWN + "removed_lines"] == 0
    assert got[8].text == ""  # a copy goes whole
    twice = docs(spark, ["p\nq\nr\ns"]).union(docs(spark, ["p\nq\nr\ns"]))
    assert [r.text for r in line_dedup.dedup_lines(twice).collect()] == ["p\nq\nr\ns"] * 2
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0
    plan = line_dedup.dedup_lines(docs(spark, texts).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 9. URLs


def brute_url(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, "allow"
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "x", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/1?x://y", "http://example.com/de/", "https://www.example.com/de/a#b", "http://notexample.com/de/", "http://b.org/fr/", "http://b.org/fr",
            "http://net/x", "http:///de/", "ftp://example.net/en", "http://x.org?/fr/", "http://a\nb.net/c\nd", "http://u@h.net:80/x", "http://..net/"] * 2
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "<p>", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    rows = spark.createDataFrame(pd.DataFrame({"h": keys}))
    bloom = url_filter.built_filter(rows)
    assert bloom.may_hold(keys).all()
    assert bloom.may_hold(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)).mean() < 0.05
    small = url_filter.built_filter(rows, 3200)  # too small for the list: nothing is lost
    assert len(small.words) == 100 and small.may_hold(keys).all()


# 10. Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    out = feistel.permute(np.arange(n), n, 3)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 17 or out.tolist() != list(range(n))


def plain_permute(number, n, seed):
    """A balanced Feistel network over plain integers, walked until it lands below n."""
    full = (1 << 64) - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    half = 1
    while 1 << 2 * half < n:
        half += 1
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(6):
            left, right = right, left ^ mix(right, seed * 6 + r + 1) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 255, 256, 257, 5000])
def test_permutation_is_the_plain_one(n):
    for seed in (0, 7):
        want = [plain_permute(i, n, seed) for i in range(n)]
        assert feistel.permute(np.arange(n), n, seed).tolist() == want and sorted(want) == list(range(n))


def test_shards(spark):
    texts = TEXTS * 20
    df = docs(spark, texts)
    rows = feistel.shard_documents(df).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        p = plain_permute(r.number, len(rows), 0)
        assert feistel.locate(r.number, len(rows), 16) == (r.shard, r.slot) == (p % 16, p // 16)
    again = {r.doc_id: (r.shard, r.slot) for r in feistel.shard_documents(df.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    assert feistel.shard_documents(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, None)] * 25_000 + [(1, "b")], "doc_id long, text string")
    rows = feistel.shard_documents(same, 2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in (0, 1) for i in range(12_501 - s)]


def test_query_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
