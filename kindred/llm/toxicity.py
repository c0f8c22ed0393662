"""Toxicity by weak supervision.

Voters are the words of a list of insults, patterns (an insult near a word of address, several insults,
a threat to the reader) and stems induced from one half of the labelled rows. What doesn't fire abstains, and
speaks for clean only by how often it would have fired. A generative label model with one firing rate per
class and voter and the correlations of voters within a class is fitted by expectation maximisation on the
votes alone: the rates are the voters' accuracies, and voters that repeat each other share one vote. Given
labels enter it only as an anchor: ANCHOR in log odds for rows that have one. A logistic regression is then
trained on the posterior labels over word and stem features and scores every whole text.

Labels are read only in learning, from at most ``fit_rows`` labelled rows outside the held-out fold
(taken in the order of a hash of the id); so VOTERS and MOST_FEATURES bound tables of that sample, not
of the corpus. Neither labels nor other columns are inputs of a score.

Defined cases: null and empty texts score as a text without features; rows of labels with a null id
or label are ignored, repeated ones count by their mean; without labels of both kinds the insult list
alone scores; columns tox_score and tox_predicted of the input are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import U, Words, mix, runs, signed, spans
from kindred.plans.stage import release, staged

FIT_ROWS = 16384
STEMS = (4, 5, 6)
#: Mined features: at least so many rows with it, and so many standard errors from no association.
LEAST_ROWS, LEAST_Z, MOST_FEATURES = 4, 4.5, 8192
#: Induced stems that vote, at most.
VOTERS = 192
ANCHOR = 2.0
FOLDS = 5
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "ugly", "imbecile", "filthy", "crap", "jerk", "bastard",
    "dumm", "dummkopf", "blöd", "trottel", "arschloch", "scheiße", "abschaum", "idioten", "versager", "ekelhaft",
    "imbécile", "connard", "salaud", "ordure", "débile", "crétin", "abruti", "stupide", "minable", "raté",
    "idiota", "imbécil", "estúpido", "basura", "inútil", "payaso", "asqueroso", "patético", "mierda", "tonto",
)
ADDRESS = ("you", "your", "youre", "du", "dich", "dein", "ihr", "tu", "ton", "toi", "vous", "usted", "te", "tus")
THREATS = ("hate", "kill", "shut", "hasse", "töte", "déteste", "tuer", "odio", "matar")
_PATTERNS = 3


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every whole word and stem, repeated as often as it occurs."""
    length = w.ends - w.starts
    doc = w.doc_of_word()
    out, docs = [w.hashes()], [doc]
    for n in STEMS:
        has = np.flatnonzero(length > n)
        h = spans(w.data, w.starts[has], w.starts[has] + n, 0x9FB21C651E98DF25)
        out.append(mix(h + U(n * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        docs.append(doc[has])
    return np.concatenate(out), np.concatenate(docs)


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.concatenate([x.hashes() for x in runs(pa.array(list(words)), lower=True, letters=True)]))


def _inside(h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in the sorted table, and where there."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coarse = np.zeros(1 << 20, bool)
    coarse[table >> U(44)] = True
    at = np.flatnonzero(coarse[h >> U(44)])
    pos = np.searchsorted(table, h[at])
    pos[pos == len(table)] = 0
    ok = table[pos] == h[at]
    return at[ok], pos[ok]


def _near(at: np.ndarray, to: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Documents where a word of ``at`` has one of ``to`` within three words."""
    if not len(to) or not len(at):
        return np.zeros(0, np.int64)
    next_ = np.minimum(np.searchsorted(to, at - 3), len(to) - 1)
    near = (np.abs(to[next_] - at) <= 3) & (doc[to[next_]] == doc[at])
    return doc[at[near]]


def _lexicon(w: Words, lists: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The insults found as (document, number) codes, and per document the patterns: an insult near a word of
    address, two or more insults, a threat near a word of address."""
    insults, address, threats = lists
    h, doc = w.hashes(), w.doc_of_word()
    at, which = _inside(h, insults)
    to, harm = _inside(h, address)[0], _inside(h, threats)[0]
    out = np.zeros((w.n_docs, _PATTERNS), bool)
    out[_near(at, to, doc), 0] = True
    out[:, 1] = np.bincount(doc[at], minlength=w.n_docs) > 1
    out[_near(harm, to, doc), 2] = True
    return np.unique(doc[at] * len(insults) + which), out


def _count(batches):
    """(feature, rows, toxic rows, and both in the half that induces) of the labelled sample, summed over the partition."""
    feature, toxic, half = [], [], []
    for batch in batches:
        y, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "half"))
        for w in runs(batch.column("text"), lower=True, letters=True):
            h, doc = _once(*_features(w))
            feature.append(h)
            toxic.append(y[w.lo + doc])
            half.append(a[w.lo + doc])
    if feature:
        h, y, a = np.concatenate(feature), np.concatenate(toxic), np.concatenate(half).astype(float)
        u, code, n = np.unique(h, return_inverse=True, return_counts=True)
        total = lambda x: pa.array(np.bincount(code, weights=x))
        yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n.astype(float)), total(y), total(a), total(a * y)], names=["feature", "n", "k", "n0", "k0"])


def _once(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _rows(table: np.ndarray, lists: tuple[np.ndarray, ...]):
    """Each sample row's selected features, insults and patterns."""

    def parts(code: np.ndarray, size: int, n: int) -> pa.Array:
        cut = np.searchsorted(code, np.arange(n + 1) * max(1, size))
        return pa.array([(code[cut[k] : cut[k + 1]] % max(1, size)).astype("<u2").tobytes() for k in range(n)], pa.binary())

    def scan(batches):
        for batch in batches:
            for w in runs(batch.column("text"), lower=True, letters=True):
                h, doc = _features(w)
                at, pos = _inside(h, table)
                key = np.unique(doc[at] * len(table) + pos) if len(at) else np.zeros(0, np.int64)
                said, patterns = _lexicon(w, lists)
                part = batch.slice(w.lo, w.n_docs)
                bits = pa.array(patterns @ (1 << np.arange(_PATTERNS)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("toxic"), bits, parts(said, len(lists[0]), w.n_docs), parts(key, len(table), w.n_docs)], names=["toxic", "patterns", "insults", "features"])

    return scan


def label_model(votes: np.ndarray, sign: np.ndarray, anchor: np.ndarray | None = None, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of ``votes`` (rows x voters, true where a voter fires), and the model.

    ``sign``: 1 for voters that speak for class 1, -1 for those against it. The model holds the prior, each
    voter's firing rate in either class, the correlations of voters within a class, and the weights that follow:
    a voter's log odds count by one over the sum of its squared correlations (less what chance gives), so
    copies share one vote. It starts from the balance of the votes; ``anchor`` (labels, NaN where none)
    adds ANCHOR log odds in each E-step.
    """
    x = votes.astype(float)
    lean = np.zeros(len(x)) if anchor is None else ANCHOR * np.nan_to_num(2 * anchor - 1)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    q = squash(2.0 * np.clip(x @ sign, 0, 3) - 3 + lean)
    rate = x.mean(0)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        hit, false = (np.clip((w @ x + 0.5 * rate) / (w.sum() + 0.5), 1e-4, 1 - 1e-4) for w in (q, 1 - q))
        d1, d0 = x - hit, x - false
        cov = ((d1 * q[:, None]).T @ d1 + (d0 * (1 - q)[:, None]).T @ d0) / len(q)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        alike = cov / np.outer(spread, spread)
        weight = 1 / np.maximum(1.0, np.maximum(alike**2 - 1 / len(x), 0).sum(axis=1))
        fires, silent = np.log(hit / false), np.log((1 - hit) / (1 - false))
        z = x @ (weight * (fires - silent)) + (weight * silent).sum() + np.log(prior / (1 - prior))
        q = squash(z + lean)
    return q, {"prior": float(q.mean()), "hit": hit, "false": false, "correlation": alike, "weight": weight}


def train_linear(rows: list[np.ndarray], size: int, q: np.ndarray, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on sets of features, by Adam on the whole sample."""
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size), float(np.log(q.mean() / (1 - q.mean())))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / len(rows)
        g = np.append(np.bincount(col, weights=e[row], minlength=size) + ridge * w / max(1, len(rows)) ** 0.5, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, their weights, intercept) from labelled rows outside the held-out fold."""
    lists = tuple(_hash_words(x) for x in (INSULTS, ADDRESS, THREATS))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna()
    given = given.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    given = given.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    half = (F.shiftright("h", 7).bitwiseAND(F.lit(1))).cast("int").alias("half")
    sample = texts.join(F.broadcast(given), "doc_id").select("toxic", half, "text")  # at most fit_rows ids and labels
    sample = staged(sample.repartition(16), "sample")
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum("half").alias("n0"), F.sum(F.col("half") * F.col("toxic")).alias("t0")).first()
    n, t = total["n"], total["t"] or 0.0
    if n < 2 or t <= 0 or t >= n:
        release(sample)
        return lists[0], np.full(len(lists[0]), 3.0), -2.0
    counted = sample.mapInArrow(_count, "feature long, n double, k double, n0 double, k0 double").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "k", "n0", "k0")))

    def association(k: str, m: str, rows: float, toxic: float):
        """Standard errors between the toxic rows of a feature and what its rows would have by chance."""
        p = min(max(toxic / max(rows, 1), 1e-6), 1 - 1e-6)
        return (F.col(k) - F.col(m) * p) / F.sqrt(F.col(m) * p * (1 - p) * (1 - F.col(m) / F.lit(rows + 1.0)) + 0.25)

    z, z0 = association("k", "n", n, t).alias("z"), association("k0", "n0", total["n0"], total["t0"] or 0.0).alias("z0")
    best = counted.where(F.col("n") >= LEAST_ROWS).select("feature", z, z0).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(MOST_FEATURES).collect()
    table = np.array([r["feature"] for r in best], np.int64).view(U)
    order = np.argsort(table)
    table = table[order]
    induced = np.array([r["z0"] for r in best])[order]
    got = sample.mapInArrow(_rows(table, lists), "toxic double, patterns int, insults binary, features binary").collect()  # at most fit_rows
    release(sample)
    rows = [np.frombuffer(r["features"], "<u2") for r in got]
    chosen = np.argsort(-induced, kind="stable")[:VOTERS]
    chosen = chosen[induced[chosen] >= LEAST_Z / 2**0.5]
    number = np.full(len(table) + 1, -1)
    number[chosen] = np.arange(len(chosen))
    stems, said = np.zeros((len(got), len(chosen)), bool), np.zeros((len(got), len(lists[0])), bool)
    for k, r in enumerate(got):
        v = number[rows[k]]
        stems[k, v[v >= 0]] = True
        said[k, np.frombuffer(r["insults"], "<u2")] = True
    pattern = np.array([[r["patterns"] >> k & 1 for k in range(_PATTERNS)] for r in got], bool).reshape(len(got), _PATTERNS)
    votes = np.concatenate([said, pattern, stems], axis=1)
    votes = votes[:, votes.any(axis=0)]
    q, _ = label_model(votes, np.ones(votes.shape[1]), np.array([r["toxic"] for r in got]))
    w, b = train_linear(rows, len(table), q)
    return table, w, b


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` with tox_score (0 to 1) and tox_predicted (1 from 0.5 on)."""
    table, weight, bias = fit(docs, labels, fit_rows)

    def score(batches):
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for w in runs(batch.column("text"), lower=True, letters=True):
                h, doc = _features(w)
                at, pos = _inside(h, table)
                if len(at):
                    key = np.unique(doc[at] * len(table) + pos)
                    np.add.at(z, w.lo + key // len(table), weight[key % len(table)])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            drop = [c for c in batch.schema.names if c not in ("tox_score", "tox_predicted")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in drop), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*drop, "tox_score", "tox_predicted"])

    kept = [f for f in docs.schema if f.name not in ("tox_score", "tox_predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(score, schema + ", tox_score double, tox_predicted int")
