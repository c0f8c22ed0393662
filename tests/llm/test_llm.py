import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from kindred.llm import flac
from kindred.llm.byte_bpe import Transducer, Utf8, compile_merges, encode_decode, read_ranks
from kindred.llm.embedding_join import embedding_links
from kindred.llm.mixing import mix_sources, one_period, whole_weights
from kindred.llm.ngram_jaccard import near_duplicates
from kindred.llm.pitman_yor import perplexity_scores
from kindred.llm.sharding import assign_shards
from kindred.llm.substring_dedup import remove_repeats
from kindred.llm.toxicity import toxicity
from kindred.llm.url_filter import filter_urls

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base, passage = prose(rng, 400), prose(rng, 70)
    near = [base.replace(base.split()[k], "xx", 1) for k in range(5, 30, 5)]
    texts = [base, base, *near, prose(rng, 90) + " " + passage, passage + "\n" + prose(rng, 60), passage, "two words", "two words", "", None, " \t\n ", prose(rng, 3000)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no id here", 1), (3, texts[3], 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, rid int")


def test_substring_dedup_against_brute_force(docs):
    rows = docs.collect()
    words = [WORD.findall((r.text or "").encode()) for r in rows]
    owner = {}
    last = 1 << 62
    for r, w in zip(rows, words):
        i = last if r.doc_id is None else r.doc_id
        for k in range(len(w) - 49):
            owner[tuple(w[k : k + 50])] = min(owner.get(tuple(w[k : k + 50]), last), i)
    want = []
    for r, w in zip(rows, words):
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if owner[tuple(w[k : k + 50])] < (last if r.doc_id is None else r.doc_id):
                keep[k : k + 50] = [False] * 50
        want.append((r.doc_id, len(w), keep.count(False), hashlib.sha256(b" ".join(itertools.compress(w, keep))).hexdigest()))
    got = remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert remove_repeats(docs.where("false")).count() == 0


def test_near_duplicates_against_brute_force(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {}
    for r in unique.collect():
        w = WORD.findall((r.text or "").encode())
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    link = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    got = {r.doc_id: r for r in near_duplicates(unique).collect()}
    assert set(got) == set(sets)
    for a in sets:
        near = [b for b in sets if b != a and link(a, b)]
        assert got[a].n_links == len(near)
        assert got[a].class_id == min([a, *near])
    assert near_duplicates(docs).count() == docs.count()
    assert near_duplicates(docs.where("false")).count() == 0


def test_bpe_matches_tiktoken():
    ranks = read_ranks(None, PATH)
    own = compile_merges(ranks)
    machine, utf8, split = Transducer(own), Utf8(own["tokens"]), regex.compile(public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    parts = ["a", "th", "the ", "é", "ß", "中", "😀", "  ", "\n", "12", "'s", "!!", " idiot", "aaaa", "́"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 15)))
        ids = machine.encode(s, split)
        assert ids == known.encode_ordinary(s)
        assert utf8.decode(ids, np.array(ids, "<u4")) == s.encode()
        assert "".join(utf8.stream(ids)) == s


def test_bpe_query_columns(docs):
    got = encode_decode(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.n_tokens == 0]
    assert empty and all(r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)


def test_flac_round_trip_and_checks():
    rng = random.Random(2)
    cases = [flac.padded(bytes(rng.choices(b"abc etaoin", k=n))) for n in (0, 1, 64, 4096, 4097, 9000)] + [rng.randbytes(5000), b"\0" * 128, b"a" * 5000]
    streams = flac.encode_many(cases)
    assert [p for p, _ in flac.decode_many(streams)] == cases
    for payload, s in zip(cases, streams):
        at, samples = flac.read_metadata(s)["begin"], []
        while at < len(s):
            part, at = flac.decode_frame(s, at)
            samples += part
        assert bytes(v + 128 for v in samples) == payload
    broken = bytearray(streams[4])
    broken[-9] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode_many([bytes(broken)])


def test_flac_blocks(docs):
    media = flac.flac_column(docs, with_media=True)
    blocks = flac.pcm_blocks(media).where("doc_id = 0").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [4096 * k for k in range(len(blocks))]
    text = docs.where("doc_id = 0").first().text.encode()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.padded(text)


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 16))
    x[50:100] = x[:50] + 0.12 * rng.standard_normal((50, 16))
    x[100:110] = x[0]
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 2) for i in range(150)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None, 1.0], 1), (204, rows[0][1], None), (None, rows[0][1], 0), (205, [], 0)]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.array([r[1] for r in rows])
    u = u / np.linalg.norm(u, axis=1)[:, None]
    for i in range(150):
        near = [j for j in range(150) if j != i and j % 2 == i % 2 and u[i] @ u[j] >= 0.93]
        assert got[i].n_links == len(near)
    assert all(got[k].n_links == 0 and got[k].kept for k in (200, 201, 202, 203, 204, 205, None))


def test_url_aliases(spark):
    rules = [("allow", "org", "/"), ("block", "com", "/de/")]
    rows = [(1, "http://A.org/x#f", '<link rel="canonical" href="https://B.com/de/y">'), (2, "https://b.com/de/y", None), (3, "http://c.net/q", '<meta http-equiv="refresh" content="0; url=/r">'), (4, "http://c.net/r", "<LINK href=http://b.com/de/y rel=canonical>"), (5, None, None), (6, "nourl", "x"), (7, "http://c.net/z", "")]
    got = {r.page_id: (r.url_rule, r.url_verdict) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("org/", "allow"), 2: ("com/de/", "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}


def test_shards_are_even_and_gapless(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"))
    got = assign_shards(rows, F.col("doc_id"), 8).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sum(r.shard == r.ring_shard for r in got) > 0.8 * len(got)
    assert assign_shards(rows.where("false"), F.col("doc_id"), 8).count() == 0


def test_pfair(spark):
    share = whole_weights({"a": 5, "b": 3, "c": 1, "d": 1})
    seen = dict.fromkeys(share, 0)
    table = one_period(share) * 3
    for t, s in enumerate(table, 1):
        seen[s] += 1
        assert all(abs(seen[k] - t * share[k] / sum(share.values())) < 1 for k in share)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 1, "y").otherwise("x").alias("source"))
    got = mix_sources(rows, block=8).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(2000))
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert mix_sources(rows.where("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + (" you idiot zorgplex" + rng.choice("abc") if i % 5 == 0 else "") + " " + prose(rng, 20), i % 5 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 300] + [(None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert all(got[i].tox_predicted == int(y) for i, _, y in rows)
    assert got[900].tox_score == got[901].tox_score < 0.5
    none = toxicity(docs, labels.where("false")).where("tox_predicted = 1").count()
    assert none == 0 or none == 80


def test_pitman_yor(spark):
    rng = random.Random(6)
    words = [prose(rng, 1) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(120)] + [(200, None), (201, "")]
    got = perplexity_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 0).collect()
    assert len(got) == 122 and len({r.train_tokens for r in got}) == 1
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in got)
    held = [r for r in got if not r.trained and r.n_tokens > 1]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -4


def test_pitman_yor_keeps_rare_ngrams(spark, monkeypatch):
    """What is broadcast and what is joined must not change the model."""
    from kindred.llm import pitman_yor

    rng = random.Random(8)
    words = [prose(rng, 1) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)] + [(3, "again the same id"), (100, None), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for kept in (1 << 22, 1 << 6):
        monkeypatch.setattr(pitman_yor, "KEPT", kept)
        found = perplexity_scores(docs, F.col("doc_id") % 4 != 0).collect()
        got.append(sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in found))
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]]
    assert [r[3] for r in got[0]] == pytest.approx([r[3] for r in got[1]], abs=1e-6)


def test_pitman_yor_driver_holds_arrays(spark):
    """Collected n-grams and words take a few numbers each on the driver, no object for a row."""
    import tracemalloc

    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=500))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = len({t[k : k + 7] for _, t in rows for k in range(len(t) - 6)})
    tracemalloc.start()
    try:
        found = perplexity_scores(docs, F.lit(True))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100 * grams
    assert found.count() == 200


def test_pitman_yor_distribution():
    """The probabilities of all bytes after a context add up to one, seen or not, in head and branches."""
    from kindred.llm import pitman_yor as py

    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 40, dtype=np.uint64))
    counts = rng.integers(1, 9, len(keys))
    low3, n3 = np.unique(np.unique(keys & py._low(4)) & py._low(3), return_counts=True)
    head = py.sample_model(py._levels(low3, n3, 1, 3), rng)
    levels = py._levels(keys, counts, 4, 6)
    branch = py.sample_model(levels, rng, py._base(head, levels))
    for context in (keys[0] >> np.uint64(8), keys[7] >> np.uint64(8) & py._low(3), np.uint64(12345)):
        every = ((context << np.uint64(8)) | np.arange(256, dtype=np.uint64)).byteswap()
        p = py.probabilities(branch, every, py.probabilities(head, every))
        assert [x.sum() for x in p] == pytest.approx([1.0] * py.SAMPLES, abs=1e-5)
