"""Hierarchical Pitman-Yor language model over the letters of the token stream.

A text is the sequence of its words, lower-cased, each closed by a space, then one end. The model
predicts each byte of that stream from the last ORDER - 1 bytes: a restaurant for each context,
whose parent is the restaurant of the context without its oldest byte; the root's base is uniform. The discount
of a length is estimated from its counts of counts; the strength is STRENGTH.

Seating is kept as customers and tables per restaurant and dish, and sampled by Gibbs in blocks: all dishes
of one length at once. Within a restaurant their numbers of tables are coupled only by the number of
tables in all, and a Gamma variable drawn for it makes them independent; each is then drawn from its
exact distribution (generalised Stirling numbers; beyond 64 customers its saddle-point form). So a step
leaves the distribution of a restaurant's tables, given the probabilities of the length below, as it is,
however many customers there are. Lengths follow in turn: tables become customers of the length below, and
its predictive probabilities the base of the one above. Predictive probabilities are averaged
over SAMPLES seatings.

Size. Every byte n-gram of the training texts is seated, however rare and however large the corpus. The
restaurants of the first HEAD lengths (contexts of up to HEAD - 1 bytes: at most 256**HEAD dishes) are
sampled on the driver; those of longer contexts are dealt over the cluster by the HEAD bytes of context
next to the predicted one, so a partition holds whole branches of the tree. Blocks are sampled in turn:
branches given the head's probabilities, the head given the tables that the branches send it, branches again.
The last turn writes one table with the averaged log10 probability of each n-gram of the corpus. Texts are
scored by joining it. Only n-grams with a share of at least 1 / KEPT of all positions (and words with 1 /
KEPT_WORDS of all tokens) are broadcast, all others are joined; word counts for the baseline are exact.

Defined cases: null and empty texts are one end; a null id is trained on or not as ``trained`` says, null is no;
rows are scored one by one, equal ids may repeat; without training texts every byte has probability
1 / 256; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import U, Words, runs, signed
from kindred.plans.stage import release, staged

ORDER = 7
HEAD = 3
KEPT = 1 << 22
BRANCH_ROWS = 1 << 19
KEPT_WORDS = 1 << 20
STRENGTH = 1.0
BURN_IN, SAMPLES = 6, 3
_EXACT = 64
_SPACE, _END = 0x20, 0x0A


def letters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The byte stream of a run of documents and where each document starts in it."""
    size = w.ends - w.starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    doc_at = total[w.first] + np.arange(w.n_docs + 1)
    out = np.full(int(doc_at[-1]), _SPACE, np.uint8)
    out[doc_at[1:] - 1] = _END
    lead = total[:-1] + w.doc_of_word()
    flat = np.arange(int((size - 1).sum())) - np.repeat(np.concatenate([[0], np.cumsum(size - 1)])[:-1], size - 1)
    out[np.repeat(lead, size - 1) + flat] = w.data[np.repeat(w.starts, size - 1) + flat]
    return out, doc_at


def ngrams(stream: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to each position as one integer; before a document there are only ends."""
    place = np.arange(len(stream)) - np.repeat(doc_at[:-1], np.diff(doc_at))
    key = stream.astype(U)
    for back in range(1, ORDER):
        prior = np.full(len(stream), _END, U)
        prior[back:] = stream[: max(0, len(stream) - back)]
        prior[place < back] = _END
        key |= prior << U(8 * back)
    return key


def _count_ngrams(batches):
    """n-grams of ORDER bytes with counts; the bit above them marks those of training texts."""
    held, counts, size = [], [], 0
    for batch in batches:
        trained = batch.column("trained").to_numpy(zero_copy_only=False).astype(U)
        for w in runs(batch.column("text"), lower=True):
            stream, doc_at = letters(w)
            mark = np.repeat(trained[w.lo : w.lo + w.n_docs] << U(8 * ORDER), np.diff(doc_at))
            u, n = np.unique(ngrams(stream, doc_at) | mark, return_counts=True)
            held.append(u)
            counts.append(n)
            size += len(u)
            if size > 3_000_000:
                u, code = np.unique(np.concatenate(held), return_inverse=True)
                held, counts, size = [u], [np.bincount(code, weights=np.concatenate(counts)).astype(np.int64)], len(u)
                if size > 2_000_000:
                    yield _key_counts(held[0], counts[0])
                    held, counts, size = [], [], 0
    if held:
        u, code = np.unique(np.concatenate(held), return_inverse=True)
        yield _key_counts(u, np.bincount(code, weights=np.concatenate(counts)).astype(np.int64))


def _key_counts(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], names=["key", "n"])


def _count_words(batches):
    held, counts, size = [], [], 0

    def flush():
        u, code = np.unique(np.concatenate(held), return_inverse=True)
        return _key_counts(u, np.bincount(code, weights=np.concatenate(counts)).astype(np.int64))

    for batch in batches:
        for w in runs(batch.column("text"), lower=True):
            u, n = np.unique(w.hashes(), return_counts=True)
            held.append(u)
            counts.append(n)
            size += len(u)
        if size > 4_000_000:
            yield flush()
            held, counts, size = [], [], 0
    if held:
        yield flush()


class Level:
    """All restaurants of one context length: dishes sorted by context and byte.

    The customers of a dish are the tables of its longer n-grams, or ``fixed`` where no level is above. The
    lowest level here takes its base probabilities from ``outer``. ``d`` is the discount; without one it is
    estimated from how many dishes start with one and with two customers.
    """

    def __init__(self, keys: np.ndarray, width: int, below: Level | None, fixed: np.ndarray | None = None, d: float | None = None):
        self.keys, self.width, self.d, self.fixed = keys, width, d, fixed
        self.contexts, self.ctx = np.unique(keys >> U(8), return_inverse=True)
        self.below, self.above, self.outer = below, None, np.full(len(keys), 1 / 256)
        self.t = np.ones(len(keys))
        if below is not None:
            self.parent = np.searchsorted(below.keys, keys & _low(below.width))
            below.above = self

    def customers(self) -> np.ndarray:
        if self.above is None:
            return self.fixed.astype(np.float64)
        return np.bincount(self.above.parent, weights=self.above.t, minlength=len(self.keys))

    def refresh(self) -> None:
        """Counts, tables by restaurant, back-off weights and probabilities of the current seating."""
        self.c = np.maximum(self.customers(), 1)
        self.t = np.minimum(self.t, self.c)
        n = len(self.contexts)
        self.tables = np.bincount(self.ctx, weights=self.t, minlength=n)
        total = STRENGTH + np.bincount(self.ctx, weights=self.c, minlength=n)
        self.gamma = (STRENGTH + self.d * self.tables) / total
        self.base = self.outer if self.below is None else self.below.p[self.parent]
        self.p = (self.c - self.d * self.t) / total[self.ctx] + self.gamma[self.ctx] * self.base


def _low(n: int) -> np.uint64:
    return U((1 << 8 * n) - 1)


def _levels(keys: np.ndarray, counts: np.ndarray, lo: int, hi: int, discounts: dict[int, float] | None = None) -> list[Level]:
    """Levels lo to hi of distinct n-grams of hi bytes with customers."""
    levels: list[Level] = []
    for n in range(lo, hi + 1):
        levels.append(Level(np.unique(keys & _low(n)), n, levels[-1] if levels else None))
    order = np.argsort(keys)
    levels[-1].fixed = counts[order]
    for lv in levels:
        lv.d = (discounts or {}).get(lv.width) or discount(*once_and_twice(lv))
    return levels


def once_and_twice(level: Level) -> tuple[int, int]:
    """How many dishes have one customer, and two, before any seating."""
    c = level.customers()
    return int((c == 1).sum()), int((c == 2).sum())


def discount(once: int, twice: int) -> float:
    """The usual estimate from counts of counts, kept inside (0, 1)."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def log_stirling(d: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) with discount d for c, t <= most: seatings of c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, most + 1):
        with np.errstate(divide="ignore"):
            stay = s[c - 1, 1:] + np.log(np.maximum(c - 1 - d * np.arange(1, most + 1), 0))
        s[c, 1:] = np.logaddexp(s[c - 1, :-1], stay)
    return s


def draw_tables(c: np.ndarray, rate: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, drawn with weights S(c, t) (d rate)**t.

    Up to _EXACT customers by the table of those numbers. Beyond, the weights are those of c customers split over a
    Poisson number of tables with sizes of generating function 1 - (1 - z)**d: where ``rate`` is small, t - 1
    is Poisson in the limit of many customers, else t is normal around the saddle point.
    """
    t = np.ones(len(c))
    some = np.flatnonzero((c > 1) & (c <= _EXACT))
    order = some[np.argsort(c[some], kind="stable")]
    cut = np.searchsorted(c[order], np.arange(2, _EXACT + 2))
    for k in range(2, _EXACT + 1):
        at = order[cut[k - 2] : cut[k - 1]]
        if len(at):
            with np.errstate(divide="ignore"):
                w = stirling[k, 1 : k + 1][None, :] + np.log(d * rate[at])[:, None] * np.arange(1, k + 1)[None, :]
            w = np.exp(w - w.max(axis=1, keepdims=True))
            total = np.cumsum(w, axis=1)
            t[at] = 1 + (total < rng.random(len(at))[:, None] * total[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > _EXACT)
    if len(many):
        n, r = c[many], rate[many]
        low, high = np.full(len(n), -700.0), np.zeros(len(n))  # log of 1 - z at the saddle point
        for _ in range(60):
            mid = (low + high) / 2
            up = np.log(d * r) + np.log(-np.expm1(mid)) + (d - 1) * mid > np.log(n)
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        y = np.exp((low + high) / 2)
        part = -np.expm1(d * np.log(y))
        mean = r * part
        size = n / mean
        second = (1 - y) ** 2 * d * (1 - d) * y ** (d - 2) / part + size
        spread = np.sqrt(np.maximum(mean * (1 - size * size / second), 0))
        few = 1 + rng.poisson(np.minimum(r, 50) * (1 - n**-d))
        t[many] = np.where(r < 8, few, np.rint(mean + spread * rng.standard_normal(len(n))))
    return np.clip(t, 1, c)


def reseat(level: Level, stirling: np.ndarray, rng: np.random.Generator) -> None:
    """One Gibbs step of all dishes of a level, given the probabilities of the level below.

    The tables of a restaurant are coupled by Gamma(T + strength / d) alone. Given a draw x of that Gamma
    distribution they are independent, and each dish's number has weights S(c, t) (d x base)**t.
    """
    x = rng.standard_gamma(level.tables + STRENGTH / level.d)
    level.t = draw_tables(level.c, np.maximum(x[level.ctx] * level.base, 1e-300), level.d, stirling, rng)
    level.tables = np.bincount(level.ctx, weights=level.t, minlength=len(level.contexts))


def _sweeps(levels: list[Level], outer: list[np.ndarray] | None, n_sweeps: int, rng: np.random.Generator):
    """Gibbs sampling, longest contexts first: yields the number of each sweep after it; ``outer`` are the base's samples."""
    if outer is not None:
        levels[0].outer = outer[0]
    for lv in levels:
        lv.refresh()
    stirling = [log_stirling(lv.d, _EXACT) for lv in levels]
    for sweep in range(n_sweeps):
        if outer is not None:
            levels[0].outer = outer[max(0, sweep - BURN_IN)]
        for lv in levels:
            lv.refresh()
        for lv, s in zip(reversed(levels), reversed(stirling), strict=True):
            lv.c = np.maximum(lv.customers(), 1)
            lv.t = np.minimum(lv.t, lv.c)
            reseat(lv, s, rng)
        for lv in levels:
            lv.refresh()
        yield sweep


def sample_model(levels: list[Level], rng: np.random.Generator, outer: list[np.ndarray] | None = None) -> list[dict]:
    """Per level the keys with probabilities, and contexts with back-off weights, by sample."""
    kept: list[list] = [[] for _ in levels]
    for sweep in _sweeps(levels, outer, BURN_IN + SAMPLES, rng):
        if sweep >= BURN_IN:
            for i, lv in enumerate(levels):
                kept[i].append((lv.p, lv.gamma))
    out = []
    for lv, k in zip(levels, kept, strict=True):
        keys, contexts = lv.keys.byteswap(), lv.contexts.byteswap()
        by_key, by_ctx = np.argsort(keys), np.argsort(contexts)
        p, gamma = ([x[0][by_key].astype(np.float32) for x in k], [x[1][by_ctx].astype(np.float32) for x in k])
        out.append({"width": lv.width, "keys": keys[by_key], "p": p, "contexts": contexts[by_ctx], "gamma": gamma})
    return out


def _first_bytes(n: int) -> np.uint64:
    return U(((1 << 8 * n) - 1) << 8 * (8 - n))


def probabilities(model: list[dict], keys: np.ndarray, p: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """By sample, the predictive probability of the last byte of each n-gram after the others.

    ``keys`` are byte-swapped, as in the model: the predicted byte comes first, then its context from the
    nearest byte on, so sorted keys walk through the tables in order. A context (or dish) that one
    level lacks is missing in all longer ones; it is not searched there. ``p`` are the probabilities
    by the levels below those of ``model``.
    """
    p = [np.full(len(keys), 1 / 256) for _ in range(SAMPLES)] if p is None else [x.copy() for x in p]
    alive, seen = np.arange(len(keys)), np.ones(len(keys), bool)
    here = keys
    for lv in model:
        n = lv["width"]
        if not len(lv["keys"]):
            break
        ctx = (here << U(8)) & _first_bytes(n - 1)
        at = np.minimum(np.searchsorted(lv["contexts"], ctx), len(lv["contexts"]) - 1)
        known = np.flatnonzero(lv["contexts"][at] == ctx)
        alive, seen, here, at = alive[known], seen[known], here[known], at[known]
        some = np.flatnonzero(seen)
        own = here[some] & _first_bytes(n)
        dish = np.minimum(np.searchsorted(lv["keys"], own), len(lv["keys"]) - 1)
        hit = lv["keys"][dish] == own
        seen[some[~hit]] = False
        target, dish = alive[some[hit]], dish[hit]
        away = np.flatnonzero(~seen)
        missed, at = alive[away], at[away]
        for each, of_dish, back_off in zip(p, lv["p"], lv["gamma"], strict=True):
            each[target] = of_dish[dish]
            each[missed] *= back_off[at]
    return p


def _branch(batches, discounts: dict[int, float] | None = None):
    """The n-grams of a partition in order, and its levels above the head (none without training texts)."""
    held = [(b.column("key").to_numpy().astype(U), b.column("n").to_numpy(), b.column("k").to_numpy()) for b in batches]
    if not held:
        return None
    keys, n, k = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)  # the same rows give the same seating, in whatever order they come
    keys, n, k = keys[order], n[order], k[order]
    own = k > 0
    levels = _levels(keys[own], k[own], HEAD + 1, ORDER, discounts) if own.any() else []
    return keys, n, levels, np.random.default_rng(int(keys[0]))


def _base(head: list[dict], levels: list[Level]) -> list[np.ndarray]:
    return probabilities(head, (levels[0].keys & _low(HEAD)).byteswap())


def _sorted_columns(table: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table in the order of the first, by Arrow: the driver makes no object for a row."""
    got = table.toArrow()
    columns = [c.to_numpy() for c in got.columns]
    del got
    order = np.argsort(columns[0])
    for k, c in enumerate(columns):
        columns[k] = c[order]
    return columns


def _head(dishes: DataFrame, seed: int, discounts: dict[int, float]) -> list[dict]:
    """The sampled head from (key, n): its longest dishes and their customers, at most 256**HEAD rows.

    ``discounts`` gets those of the head's lengths at the first call.
    """
    key, n = _sorted_columns(dishes)
    if not len(key):
        return []
    levels = _levels(key.astype(U), n, 1, HEAD, discounts)
    discounts.update({lv.width: lv.d for lv in levels})
    return sample_model(levels, np.random.default_rng(seed))


def log_probabilities(docs: DataFrame) -> DataFrame:
    """(key, n, lp): each distinct n-gram of ``docs`` (text, trained) with its count and log10 probability."""
    spark = docs.sparkSession
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key")
    marked = docs.select("text", "trained").mapInArrow(_count_ngrams, "key long, n long")
    trained = F.when(F.shiftright("key", 8 * ORDER) == 1, F.col("n")).otherwise(0)
    grams = staged(marked.select(low(ORDER), "n", trained.alias("k")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "ngrams")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // BRANCH_ROWS))
    branches = grams.repartition(parts, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * HEAD) - 1)))

    def counts_of_counts(batches):
        found = _branch(batches)
        for lv in found[2] if found else []:
            once, twice = once_and_twice(lv)
            yield pa.RecordBatch.from_arrays([pa.array([lv.width]), pa.array([once]), pa.array([twice])], names=["width", "once", "twice"])

    seen = branches.mapInArrow(counts_of_counts, "width long, once long, twice long").groupBy("width").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"))
    discounts = {r["width"]: discount(r["once"], r["twice"]) for r in seen.collect()}  # a row a length

    first = grams.where("k > 0").select(low(HEAD + 1)).distinct()  # one table for each dish above the head
    shared = spark.sparkContext.broadcast(_head(first.select(low(HEAD)).groupBy("key").agg(F.count("*").alias("n")), 42, discounts))

    def tables(batches):
        found = _branch(batches, discounts)
        if found and found[2]:
            levels, rng = found[2:]
            for _ in _sweeps(levels, _base(shared.value, levels), BURN_IN, rng):
                pass
            u, code = np.unique(levels[0].keys & _low(HEAD), return_inverse=True)
            yield _key_counts(u, np.bincount(code, weights=levels[0].t).astype(np.int64))

    sent = branches.mapInArrow(tables, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    final = spark.sparkContext.broadcast(_head(sent, 43, discounts))

    def write(batches):
        found = _branch(batches, discounts)
        if found:
            keys, n, levels, rng = found
            head, swapped = final.value, keys.byteswap()
            order = np.argsort(swapped)
            p = probabilities(head, swapped[order])
            if levels:
                p = probabilities(sample_model(levels, rng, _base(head, levels)), swapped[order], p)
            lp = np.empty(len(keys))
            lp[order] = np.log10(sum(p) / SAMPLES)
            for at in range(0, len(keys), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[cut])), pa.array(n[cut]), pa.array(lp[cut])], names=["key", "n", "lp"])

    out = staged(branches.mapInArrow(write, "key long, n long, lp double"), "ngram-scores")
    release(grams)
    return out


def perplexity_scores(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    ``trained`` marks the rows to learn from. Scores are log10 probabilities of whole texts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    base = base.withColumn("rid", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    learn = base.where("trained").select("text")

    words = staged(learn.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    ends = learn.count()
    stats = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n_all, v_all = (stats["n"] or 0) + ends, stats["v"] + (ends > 0)
    least = max(1, -(-n_all // KEPT_WORDS))
    often = _sorted_columns(words.where(F.col("n") >= least).select("key", "n"))  # at most KEPT_WORDS rows
    grams = log_probabilities(base)
    least_grams = max(1, -(-(grams.agg(F.sum("n")).first()[0] or 0) // KEPT))
    head = _sorted_columns(grams.where(F.col("n") >= least_grams).select("key", "lp"))  # at most KEPT rows
    shared = spark.sparkContext.broadcast({"grams": tuple(head), "words": tuple(often)})
    del head, often
    norm = float(np.log10(n_all + v_all + 1.0))

    def find(known, keys):
        """Where sorted or unsorted ``keys`` are in the sorted ``known``, and which are there."""
        if not len(known):
            return np.zeros(len(keys), int), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def score(batches):
        here = shared.value
        (grams_known, lp), (known, count) = here["grams"], here["words"]
        log_count = np.log10(count + 1.0)
        for batch in batches:
            for w in runs(batch.column("text"), lower=True):
                stream, doc_at = letters(w)
                u, code = np.unique(ngrams(stream, doc_at), return_inverse=True)
                at, hit = find(grams_known, signed(u))
                logs = (np.where(hit, lp[at], 0.0) if len(lp) else np.zeros(len(u)))[code]
                h, doc = signed(w.hashes()), w.doc_of_word()
                at, hit = find(known, h)
                part = batch.slice(w.lo, w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "rid", "trained")),
                        pa.array(w.counts + 1),
                        pa.array(np.bincount(doc[hit], minlength=w.n_docs).astype(np.int64) + (ends > 0)),
                        pa.array(np.bincount(doc[hit], weights=log_count[at[hit]], minlength=w.n_docs) + np.log10(ends + 1.0) - norm * (w.counts + 1)),
                        pa.array(np.add.reduceat(logs, doc_at[:-1])),
                    ],
                    names=["doc_id", "rid", "trained", "n_tokens", "n_known", "base_score", "score"],
                )

    def rare(batches):
        """Words (kind 0) and n-grams (kind 1) that are not broadcast, counted by text."""
        here = shared.value
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for w in runs(batch.column("text"), lower=True):
                stream, doc_at = letters(w)
                u, code = np.unique(ngrams(stream, doc_at), return_inverse=True)
                away = np.flatnonzero(~find(here["grams"][0], signed(u))[1][code])
                h, doc = signed(w.hashes()), w.doc_of_word()
                left = np.flatnonzero(~find(here["words"][0], h)[1])
                sides = ((0, h[left], doc[left]), (1, signed(u)[code[away]], np.searchsorted(doc_at, away, "right") - 1))
                for kind, key, of in sides:
                    order = np.lexsort((key, of))
                    key, of = key[order], of[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    first = np.flatnonzero(new)
                    m = np.diff(np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int8)), pa.array(key[first]), pa.array(rid[w.lo + of[first]]), pa.array(m, pa.int32())], names=["kind", "key", "rid", "m"])

    kind = base.schema["doc_id"].dataType.simpleString()
    scored = base.mapInArrow(score, f"doc_id {kind}, rid long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    values = words.where(F.col("n") < least).select(F.lit(0).cast("byte").alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("x"))
    values = values.unionByName(grams.where(F.col("n") < least_grams).select(F.lit(1).cast("byte").alias("kind"), "key", F.col("lp").alias("x")))
    found = base.select("rid", "text").mapInArrow(rare, "kind byte, key long, rid long, m int").join(values, ["kind", "key"])
    word, sums = F.col("kind") == 0, F.col("m") * F.col("x")
    extra = found.groupBy("rid").agg(F.sum(F.when(word, F.col("m"))).alias("k"), F.sum(F.when(word, sums)).alias("b"), F.sum(F.when(~word, sums)).alias("s"))
    copies = base.groupBy("rid").agg(F.count("*").alias("copies"))
    share = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0)).alias(c)
    extra = extra.join(copies, "rid").select("rid", *map(share, ("k", "b", "s")))
    more = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.join(extra, "rid", "left").select(
        "doc_id", "trained", "n_tokens", (F.col("n_known") + more("k").cast("long")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + more("b")).alias("base_score"), (F.col("score") + more("s")).alias("score")
    )
