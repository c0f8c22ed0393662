"""The queries' columns against plain versions, and the defined cases of every operator."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kindred.llm import embedding_join, pitman_yor, queries
from kindred.llm.byte_bpe import encode_decode, read_ranks
from kindred.llm.embedding_join import embedding_links
from kindred.llm.flac import flac_column, padded
from kindred.llm.mixing import BLOCK, mix_sources, whole_weights
from kindred.llm.ngram_jaccard import near_duplicates
from kindred.llm.pitman_yor import perplexity_scores
from kindred.llm.sharding import assign_shards
from kindred.llm.substring_dedup import remove_repeats
from kindred.llm.toxicity import label_model, toxicity
from kindred.llm.url_filter import filter_urls
from tests.llm.brute import edf_order, ring_slots

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))


def texts(rng):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return ["", None, " \t", "one", "one", "naïve café 中文 😀", long, "x" * 60_000, *(prose(rng, rng.randint(1, 90)) for _ in range(20))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 3}", 7, "kept") for i, t in enumerate(texts(random.Random(1)))] + [(3, "one", "src0", 7, "kept"), (None, "no id", None, 7, "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, shard string")


def wide(df, *names):
    """``df`` with more columns of those names."""
    return df.withColumns({n: F.lit("mine") for n in names})


# --- op2 and op6 -------------------------------------------------------------------------------------------------


def test_bpe_columns(docs):
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(None, PATH), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = codec.encode_ordinary(r.text or "") if len(r.text or "") < 50_000 or " " in r.text else None
        want.append((r.doc_id, None if ids is None else len(ids), None if ids is None else sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    got = encode_decode(wide(docs, "ids", "n_tokens"), PATH, public_tokenizers.PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[3] == w[3] and (w[1] is None or g[1:3] == w[1:3])
    assert encode_decode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_flac_columns(docs):
    got = flac_column(wide(docs, "media", "feature")).collect()
    want = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        p = padded(raw)
        want[r.doc_id] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == docs.count()
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in got)
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert flac_column(docs.where("false")).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------------------


def plain_urls(rows, rules):
    rest = lambda u: u.split("://", 1)[1] if u and "://" in u else ""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def cut(u):
        r = rest(u)
        host = re.match(r"[^/?#]*", r)[0]
        path = re.match(r"[^?#]*", r[len(host) :])[0]
        query = re.match(r"[^#]*", r[len(host) :])[0]
        return host.translate(lower), path, host.translate(lower) + query if host else None

    def rule(host, path):
        fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    group = {}

    def find(a):
        while group.setdefault(a, a) != a:
            a = group[a]
        return a

    named = {}
    for _, url, _, target in rows:
        ends = [cut(u) for u in (url, target) if u]
        for host, path, address in ends:
            if address:
                named[address] = (host, path)
                find(address)
        if len(ends) == 2 and ends[0][2] and ends[1][2]:
            group[find(ends[0][2])] = find(ends[1][2])
    blocked = {find(a) for a, (h, p) in named.items() if rule(h, p)[1] == "block"}
    out = {}
    for page, url, _, _ in rows:
        host, path, address = cut(url)
        name, verdict = rule(host, path) if address else (None, None)
        out[page] = (host, path, name, verdict or ("block" if address and find(address) in blocked else "allow"))
    return out


def test_urls_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.org", "x.example.org", "example.org", "shop.com", "b.shop.com", "c.net", "a.b.c.d.e.f.net", "UP.Org"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/q", "/de/x", "/de", "/deep?x=1", "/fr/?a#b"]
    urls = [f"http{'s' * (k % 2)}://{h}{p}" for k, (h, p) in enumerate(itertools.product(hosts, paths))] + ["no url", "://", "ftp:///de/x"]
    rows = []
    for i in range(160):
        url = rng.choice(urls)
        target = rng.choice(urls[:60]) if rng.random() < 0.5 else None
        html = None if target is None else (f'<link rel="canonical" href="{target}">' if i % 2 else f'<META content="3; URL={target}" http-equiv=refresh>')
        rows.append((i, url, html, target))
    rows.append((200, None, "<p>", None))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = plain_urls(rows, queries.URL_RULES)
    got = filter_urls(wide(pages, "source", "address", "url_rule", "host"), queries.URL_RULES).collect()
    assert {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in got} == want
    assert len(got) == len(rows) and all(r.source == "mine" for r in got)
    assert filter_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_url_targets(spark):
    from kindred.llm.url_filter import declared_targets

    page = "https://H.org/a/b/c.html?q=1"
    cases = {"x.html": "http://h.org/a/b/x.html", "../y": "http://h.org/a/y", "./z/": "http://h.org/a/b/z/", "?k=2": "http://h.org/a/b/c.html?k=2", "/r": "http://h.org/r", "//o.net/p": "http://o.net/p", "https://q.net/?u=http://w": "https://q.net/?u=http://w", "a/..": "http://h.org/a/b/", "mailto:x@y": None}
    rows = spark.createDataFrame([(page, f'<link rel=canonical href="{t}">', "") for t in cases], "source string, link string, meta string")
    got = [r.target for r in declared_targets(rows).collect()]
    assert got == list(cases.values())
    both = spark.createDataFrame([(page, '<link rel=canonical href="/one">', '<meta content="0; url=/two">')], "source string, link string, meta string")
    assert sorted(r.target for r in declared_targets(both).collect()) == ["http://h.org/one", "http://h.org/two"]


# --- op5 ---------------------------------------------------------------------------------------------------------


def test_shards_against_brute_force(spark):
    rng = random.Random(2)
    rows = {i: (rng.choice([None, 7, i, i, i]), rng.randrange(50), i % 4) for i in range(700)}
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "row long, key long, a int, b int")
    got = assign_shards(wide(df, "slot", "hops"), F.col("key"), 5, tie=(F.col("a"), F.col("b"))).collect()
    want = ring_slots(rows, 5)
    by = {}
    for r in got:
        by.setdefault((r.key, r.a, r.b), []).append((r.shard, r.slot, r.ring_shard, r.hops))
    plain = {}
    for i, r in rows.items():
        plain.setdefault(r, []).append(want[i])
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in plain.items()}
    assert assign_shards(df.where("false"), F.col("key"), 5).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        assign_shards(wide(df, "__ring_h"), F.col("key"), 5)


def test_one_more_shard_moves_little(spark):
    df = spark.range(4000).select(F.col("id").alias("key"))
    a, b = ({r.key: r.shard for r in assign_shards(df, F.col("key"), n).collect()} for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


# --- op10 --------------------------------------------------------------------------------------------------------


def test_mix_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices([None, "a", "b", "c"], [1, 8, 3, 2])[0]) for i in range(900)] + [(1000, "tiny")]
    weights = {"a": 3.5, "b": 0.7, "c": Fraction(1, 3), "tiny": 0.05}
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted(mix_sources(wide(df, "mix_slot", "k", "share"), weights).collect(), key=lambda r: r.mix_position)
    want = edf_order(rows, weights, BLOCK)
    assert [(r.doc_id, r.source, r.mix_slot, r.mix_block) for r in got] == want
    assert [r.mix_position for r in got] == list(range(len(rows)))
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    first = [r for r in got if r.mix_phase == 0]
    share = whole_weights({s: weights.get(s, 1) for s in {r[1] for r in rows}})
    slots = dict(sorted({r.mix_slot: r.source for r in first}.items()))
    taken = dict.fromkeys(share, 0)
    for t, s in slots.items():
        taken[s] += 1
        assert all(abs(taken[k] - Fraction((t + 1) * share[k], sum(share.values()))) < 1 for k in share)


def test_mix_cases(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None)], "doc_id long, source string")
    got = mix_sources(df, {"a": 2}, block=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(5))
    assert mix_sources(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="period"):
        mix_sources(df, {"a": 1 / 3})
    with pytest.raises(ValueError, match="positive"):
        mix_sources(df, {"a": 0})
    assert whole_weights({"a": 0.7, "b": 0.3}) == {"a": 7, "b": 3}


# --- op1, op7 and op9: repeated rows, long texts, other columns ----------------------------------------------------


def test_embedding_cases(spark, monkeypatch):
    v, w = [1.0, 2.0, 0.5, 1.0], [1.0, 2.0, 0.5, 1.01]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (3, w, 0), (4, [-1.0, 2.0, 0.5, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_links(wide(df, "rep", "weight", "k1")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
    assert embedding_links(df.where("false")).count() == 0
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.12 * rng.standard_normal((200, 16))
    df = spark.createDataFrame([(i, [float(a) for a in x[i]], "l") for i in range(400)], "vec_id long, embedding array<double>, label string")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & ~np.eye(400, dtype=bool)
    for tile in (16, 150):  # small tiles: several coordinates, cells in pieces
        monkeypatch.setattr(embedding_join, "TILE", tile)
        assert {r.vec_id: r.n_links for r in embedding_links(df, blocks=4).collect()} == dict(enumerate(near.sum(1).tolist()))


def test_near_duplicate_cases(docs, spark):
    got = near_duplicates(wide(docs, "rep", "band", "class_id"))
    assert got.count() == docs.count()
    one = {(r.doc_id, r.n_links, r.class_id) for r in got.where("doc_id in (3, 4)").collect()}
    assert one == {(3, 1, 3), (4, 1, 3)}  # 3 is there twice
    rng = random.Random(7)
    base = prose(rng, 20_000)
    rows = [(1, base), (2, base + " more"), (3, base), (3, base)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id, r.n_copies) for r in got) == [(1, 2, 1, 1), (2, 2, 1, 0), (3, 2, 1, 1), (3, 2, 1, 1)]


def test_repeat_cases(spark):
    same = "a " * 70_000
    rows = [(5, same), (9, same + "b"), (None, "q " * 60), (None, "q " * 60), (2, "z " * 60), (2, "z " * 60)]
    got = remove_repeats(wide(spark.createDataFrame(rows, "doc_id long, text string"), "a", "b", "runs")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 60, 0), (0, 60, 0), (2, 60, 0), (2, 60, 0), (5, 70_000, 0), (9, 70_001, 70_000)]
    last = next(r for r in got if r.doc_id == 9)
    assert last.kept_sha256 == hashlib.sha256(b"b").hexdigest()


# --- op4 ---------------------------------------------------------------------------------------------------------


def test_baseline_columns(docs):
    got = perplexity_scores(wide(docs, "trained", "rid", "score"), F.col("doc_id") % 3 != 0).collect()
    tokens = lambda t: [*(w.lower() for w in WORD.findall((t or "").encode())), None]
    rows = docs.collect()
    count = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id % 3 != 0:
            for w in tokens(r.text):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = {}
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id] = (len(t), sum(w in count for w in t), sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.score < 0


def test_model_of_empty_tables(docs):
    none = perplexity_scores(docs.where("false"), F.lit(True))
    assert none.count() == 0
    flat = perplexity_scores(docs.where("doc_id = 3"), F.lit(False)).collect()
    assert all(r.score == pytest.approx(-5 * math.log10(256)) for r in flat)  # "one", a space and an end


def _exact_tables(c, base, d, theta):
    """Expected number of tables of each dish of one restaurant, by going through every seating's numbers."""
    s = pitman_yor.log_stirling(d, 12)
    total, mean = 0.0, np.zeros(len(c))
    for t in itertools.product(*(range(1, n + 1) for n in c)):
        w = math.lgamma(sum(t) + theta / d) + sum(t) * math.log(d) + sum(s[n, k] + k * math.log(b) for n, k, b in zip(c, t, base, strict=True))
        total += math.exp(w)
        mean += math.exp(w) * np.array(t)
    return mean / total


def test_gibbs_against_enumeration():
    c, base, d = np.array([1, 2, 5, 7]), np.array([0.1, 0.3, 0.4, 0.2]), 0.4
    level = pitman_yor.Level(np.arange(4, dtype=np.uint64), 1, None, c, d)
    level.outer = base
    level.refresh()
    rng, s, seen = np.random.default_rng(0), pitman_yor.log_stirling(d, 64), []
    for step in range(30_000):
        pitman_yor.reseat(level, s, rng)
        if step > 100:
            seen.append(level.t.copy())
    assert np.mean(seen, axis=0) == pytest.approx(_exact_tables(c, base, d, pitman_yor.STRENGTH), rel=0.02)


@pytest.mark.parametrize("rate", [0.2, 3.0, 30.0, 400.0])
def test_tables_of_many_customers(rate):
    d, c = 0.6, 300
    s = pitman_yor.log_stirling(d, c)
    t = np.arange(1, c + 1)
    w = s[c, 1:] + t * math.log(d * rate)
    w = np.exp(w - w.max())
    exact = (w @ t) / w.sum()
    got = pitman_yor.draw_tables(np.full(20_000, float(c)), np.full(20_000, rate), d, pitman_yor.log_stirling(d, 64), np.random.default_rng(1))
    assert got.mean() == pytest.approx(exact, rel=0.05)
    assert got.std() == pytest.approx(math.sqrt((w @ (t - exact) ** 2) / w.sum()), rel=0.2, abs=0.1)


def test_stirling_numbers_count_seatings():
    s = pitman_yor.log_stirling(0.3, 6)
    d = 0.3
    assert math.exp(s[3, 1]) == pytest.approx((1 - d) * (2 - d)) and math.exp(s[3, 2]) == pytest.approx(3 * (1 - d)) and math.exp(s[3, 3]) == pytest.approx(1)


# --- op8 ---------------------------------------------------------------------------------------------------------


def test_label_model_without_labels():
    rng = np.random.default_rng(8)
    y = rng.random(6000) < 0.15
    hit, false = np.array([0.7, 0.6, 0.5, 0.5, 0.4, 0.6]), np.array([0.02, 0.05, 0.01, 0.04, 0.03, 0.02])
    votes = np.where(y[:, None], rng.random((6000, 6)) < hit, rng.random((6000, 6)) < false)
    copy = votes[:, 1] ^ (rng.random(6000) < 0.03)  # follows the second voter
    votes = np.concatenate([votes, copy[:, None]], axis=1)
    q, model = label_model(votes, np.ones(7))
    assert ((q > 0.5) == y).mean() > 0.95
    assert model["hit"][:6] == pytest.approx(hit, abs=0.08) and model["false"][:6] == pytest.approx(false, abs=0.05)
    assert model["correlation"][1, 6] > 0.6 and abs(model["correlation"][0, 2]) < 0.3
    assert model["weight"][[1, 6]].max() < 0.8 < model["weight"][[0, 2, 3, 4, 5]].min()


def test_toxicity_cases(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(wide(docs, "tox_score", "toxic", "half"), labels)
    assert got.count() == docs.count() and got.columns.count("tox_score") == 1
    assert toxicity(docs.where("false"), labels).count() == 0
    said = spark.createDataFrame([(1, "you stupid idiot, moron"), (2, "a quiet day")], "doc_id long, text string")
    assert {r.doc_id: r.tox_predicted for r in toxicity(said, labels).collect()} == {1: 1, 2: 0}
