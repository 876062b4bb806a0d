"""The pipeline on a small corpus with known cases, each stage against a brute-force version of it."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ethoflow.llm import quality_crf
from test_llm import brute_fp, brute_hits, brute_lines, closure

P = pytest.importorskip("public_tokenizers")


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.choice('bdklmnrst')}{rng.randrange(300)}" for _ in range(n)]


def prose(seed, lines=6):
    return "\n".join(" ".join(words(25, seed * 100 + k)).capitalize() + "." for k in range(lines))


ITEM = " ".join(words(14, 777))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts = [prose(i) for i in range(80)]
    texts += ["\n".join(" ".join(w.upper() + "$$#" for w in words(20, 9000 + i * 10 + k)) for k in range(5)) for i in range(40)]  # junk, 80-119
    texts += [prose(200) + "\n" + ITEM + ".", prose(201)]  # 120 leaks, 121 is clean
    texts += [prose(3), prose(5).replace(prose(5).split()[30], "changed", 1)]  # 122 repeats 3, 123 is near 5
    texts += [prose(400, 1), prose(400, 1).replace(" ", "  ", 1), None, ""]  # 125 has the words of 124, but no lines to cut
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 80 <= i < 120), 0) for i in range(124)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts


def brute_quality(texts):
    ids = [i for i in range(124) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = quality_crf.fit([quality_crf.line_features(texts[i]) for i in ids], np.array([int(not 80 <= i < 120) for i in ids]))
    return {i: t for i, t in enumerate(texts) if model.scores([t])[0] >= 0.7}


def brute_dedup(docs):
    left = brute_lines([docs.get(i) for i in range(max(docs) + 1)])
    return {i: left.get(i) for i in docs if docs[i] is None or left[i] != "" or docs[i] == ""}


def brute_near(docs):
    ids = sorted(docs)
    fps = [brute_fp(docs[i]) for i in ids]
    root = closure(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    return {i: docs[i] for k, i in enumerate(ids) if root[k] == k}


def brute_clean(docs):
    return {i: t for i, t in docs.items() if not brute_hits(t, [(0, ITEM)])[1]}


def brute_ids(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: library.encode_ordinary(t or "") for i, t in docs.items()}


BRUTE = (brute_quality, brute_dedup, brute_near, brute_clean)


def test_every_stage_equals_brute_force(spark, corpus):
    d, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, want = docs.columns, texts
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "bpe"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        out, want = stage(spark, docs, d), brute(want)
        assert out.columns == columns
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want, name
        assert len(rows) == len(want) and all(r.lang == "en" and r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    # Junk goes, then the exact copy, the copy with another blank, and the leak.
    assert not set(want) & {*range(80, 120), 120, 122, 125} and set(range(80)) | {121, 124} <= set(want)
    ids = brute_ids(want)
    for rows in (corpus_pipeline.STAGES[-1][1](spark, docs, d).collect(), corpus_pipeline.run(spark, d).collect()):
        assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in rows} == ids
        assert all(r.decodes for r in rows)


def test_stages_on_odd_tables(spark, corpus):
    """Null ids, repeated rows, empty tables and extra columns with clashing names, in every stage."""
    d, texts = corpus
    rows = [(None, texts[0], "en", "s", 9), (None, texts[0], "en", "s", 9), (None, None, None, None, None), (7, texts[7], "en", "s", 9), (7, texts[7], "en", "s", 9), (8, "", "", "", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({"__ethoflow_quality": F.lit("mine"), "__ethoflow_gone": F.lit(1), "id": F.lit("x"), "hash": F.lit(2), "fp": F.lit(3), "component_id": F.lit(4), "ids": F.lit("i"), "spans": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, d)
        got = out.collect()
        if name != "bpe":
            assert out.columns == odd.columns
            assert {r.text for r in got} <= {r[1] for r in rows}
            kept = [r.doc_id for r in got]
            assert kept.count(7) == 2 and kept.count(None) >= 1
            assert all(r["hash"] == 2 and r["__ethoflow_quality"] == "mine" for r in got)
        else:
            assert len(got) == len(rows) and all(r.decodes for r in got)
        assert stage(spark, odd.limit(0), d).count() == 0


def test_tables_of_a_written_stage_go(spark, tmp_path):
    """Only the last stage's input stays of what a run wrote; the result can be read, and read again."""
    from ethoflow.llm._common import Scratch, _delete

    made = len(Scratch.made())
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == out.count() > 0
    roots = Scratch.made()[made:]
    left = [r for r in roots if not r.rsplit("/", 1)[1].startswith("bpe")]
    assert len(left) == 1 and left[0].rsplit("/", 1)[1].startswith("pipeline")
    path = left[0].removeprefix("file:").replace("///", "/")
    assert [p.split("-", 1)[1] for p in sorted(os.listdir(path)) if not p.startswith(".")] == ["decontaminate"]
    for r in roots:
        _delete(spark, r)
    del Scratch.made()[made:]
