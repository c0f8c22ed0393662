import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kindred.llm.byte_bpe import read_ranks
from kindred.llm.mixing import BLOCK
from kindred.llm.queries import SOURCE_WEIGHTS
from kindred.llm.toxicity import toxicity
from tests.llm.brute import edf_order

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def codec():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(None, corpus_pipeline.VOCABULARY), special_tokens={})


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(n))


def test_last_stage_returns_token_ids(spark):
    texts = ["some words, some more", "zwei Wörter", "", None]
    docs = spark.createDataFrame([(i, t, "xx", "web", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert sorted(codec().decode(r.ids) for r in got) == sorted(t or "" for t in texts)
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)


def near(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def shingles(text):
    w = WORD.findall((text or "").encode())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    base, passage = prose(rng, 300), prose(rng, 80)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(90)]
    texts += [base, base, base.replace(base.split()[40], "zz", 1), passage + " " + prose(rng, 60), prose(rng, 50) + "\n" + passage, passage, "", None]
    texts += [prose(rng, 40) + " you idiot, pathetic clown you " + prose(rng, 10) for _ in range(20)]
    rows = [(i, t, "en", f"src{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 0, int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r.doc_id for r in toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).where("tox_predicted = 1").collect()}
    assert toxic == {i for i, _, y in marks if y}
    left = {r[0]: r[1] for r in rows if r[0] not in toxic}
    sets = {i: shingles(t) for i, t in left.items()}
    group = {i: i for i in left}
    for a, b in itertools.combinations(left, 2):
        if near(sets[a], sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if g == old else g for k, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    words = {i: WORD.findall((t or "").encode()) for i, t in left.items()}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            owner.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if owner[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        if not all(keep):
            left[i] = b" ".join(itertools.compress(w, keep)).decode()
    order = edf_order([(i, rows[i][3]) for i in left], SOURCE_WEIGHTS, BLOCK)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.mix_position for r in got} == {i: p for p, (i, *_) in enumerate(order)}
    enc = codec()
    assert {r.doc_id: list(r.ids) for r in got} == {i: enc.encode_ordinary(t or "") for i, t in left.items()}
    assert all((r.source, r.lang, r.n_chars) == (rows[r.doc_id][3], "en", len(left[r.doc_id] or "")) for r in got)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
