"""Near-duplicate join on word shingles with Bayesian candidate pruning.

A document is the set of its runs of five consecutive words; a shorter one is the one run of all its
words. Two documents link if the Jaccard similarity of their sets is at least the threshold.

1. Documents with equal sets form a class (grouped by a 128-bit hash of the set); only the one with
   the smallest id goes on, with the class's size.
2. Each representative's MinHash values are cut into BANDS bands of ROWS values; sharing a band makes
   a candidate. At similarity 0.8 a pair shares none of them with probability 4e-8.
3. Pairs of small buckets compare their MinHash values BLOCK at a time and are dropped as soon as the
   posterior probability (uniform prior) that the similarity reaches the threshold is below
   TOLERANCE. Buckets over SMALL are not expanded: all their members stay, tied to the smallest.
4. The components of what is left are cut into tiles of at most TILE documents, or several small
   components into one tile; two tiles of one component meet in a task. There the pairs that share a
   band are pruned in the same way, and the rest is verified exactly on the shingle sets. A tile
   returns the number of links of each document and a spanning forest, never its pairs, so a group
   of near copies with a third of all rows needs many tasks but no large one.
5. Components over the verified forest give the classes.

Defined cases: null and empty texts have no shingles and link with nothing; repeated rows of one id are
one document and don't count each other (an id that occurs with other texts has the links of all of them); a
null id links with nothing; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import U, Words, grams, mix, runs, signed, spans
from kindred.operators.components import connected_components
from kindred.plans.stage import Stages

SHINGLE = 5
BANDS, ROWS = 32, 4
BLOCK = 16
TOLERANCE = 1e-6
SMALL = 12
TILE = 256
_HASHES = BANDS * ROWS


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * _HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (seed[:_HASHES] >> U(32)).astype(np.uint32) | np.uint32(1), (seed[_HASHES:] >> U(32)).astype(np.uint32)


def shingle_sets(w: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    h = w.hashes()
    g, at = grams(w, h, SHINGLE)
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        g = np.concatenate([g, mix(spans(h, w.first[short], w.first[short + 1], 0xA24BAED4963EE407) + w.counts[short].astype(U))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return [g[cut[k] : cut[k + 1]] for k in range(w.n_docs)]


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    a, b = _multipliers()
    x = (s >> U(32)).astype(np.uint32)
    low = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        part = a[:, None] * x[None, i : i + 512]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for a matrix of signatures."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(U)
    k = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93), v.shape[:2]).copy()
    for j in range(ROWS):
        k = mix(k ^ (v[:, :, j] + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    return k


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(values compared, smallest number of equal ones that keeps a pair).

    After m equal values of n the posterior of the similarity under a uniform prior is
    Beta(m + 1, n - m + 1); its mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BLOCK, _HASHES + 1, BLOCK):
        p, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            total += p
            if total >= TOLERANCE:
                break
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((n, m))
    return out


def plausible(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the pairs of signature rows that survive the incremental comparison."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for n, least in least_matches(threshold):
        equal += (left[alive, n - BLOCK : n] == right[alive, n - BLOCK : n]).sum(axis=1)
        ok = equal >= least
        alive, equal = alive[ok], equal[ok]
    return alive


def _key(s: np.ndarray) -> list[int]:
    """128 bits that equal sets share."""
    return signed(np.array([s.sum(dtype=U), mix(s ^ U(0x8EBC6AF09C88C6E3)).sum(dtype=U) + U(len(s))], U)).tolist()


def _documents(batches):
    """Class key, number of shingles and signature of every document that has shingles."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        rows = []
        for w in runs(batch.column("text")):
            for k, s in enumerate(shingle_sets(w)):
                if len(s):
                    rows.append((ids[w.lo + k], *_key(s), len(s), signature(s).astype("<u4").tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "k1", "k2", "n_shingles", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, _HASHES)


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS))], names=["band", "rep"])


def _pruned(threshold: float):
    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                alive = plausible(_matrix(batch.column("sig1")), _matrix(batch.column("sig2")), threshold)
                yield batch.select(["id1", "id2"]).take(pa.array(alive))

    return scan


def _sets(batches):
    names = ["rep", "k1", "weight", "piece", "comp", "pieces"]
    for batch in batches:
        sets = [s for w in runs(batch.column("text")) for s in shingle_sets(w)]
        mine = np.array([_key(s)[0] for s in sets], np.int64) == batch.column("k1").to_numpy()
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
        yield out.filter(pa.array(mine))


def _links(sets: list[np.ndarray], apart: np.ndarray, two: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i < j) of a tile; ``apart``: the piece of each document; a tile of two pieces
    judges only pairs across them, so each pair is judged in one tile."""
    n = len(sets)
    sig = np.array([signature(s) for s in sets])
    keys = band_keys(sig)
    share = np.zeros((n, n), bool)
    for k in range(BANDS):
        share |= keys[:, k, None] == keys[None, :, k]
    share &= np.triu(np.ones((n, n), bool), 1)
    if two:
        share &= apart[:, None] != apart[None, :]
    i, j = np.nonzero(share)
    keep = []
    for a in range(0, len(i), 1 << 16):
        keep.append(a + plausible(sig[i[a : a + (1 << 16)]], sig[j[a : a + (1 << 16)]], threshold))
    keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * n:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        number = np.cumsum(many > 1) - 1
        kept = many[code] > 1
        row, code = row[kept], number[code[kept]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        both = np.zeros((n, n), np.float32)
        for a in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [a, a + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[row[lo:hi], code[lo:hi] - a] = 1
            both += part @ part.T
        common = both[i, j].astype(np.int64)
    ok = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[ok], j[ok]


def _forest(root: list[int], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees; ``root`` holds the trees and is carried on."""
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = a, b
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _tile(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        rep, weight, piece = (table.column(c).to_numpy() for c in ("rep", "weight", "piece"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        two = table.column("p")[0].as_py() != table.column("q")[0].as_py()
        i, j = _links(sets, piece, two, threshold)
        n = len(rep)
        links, texts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        np.add.at(texts, i, 1)
        np.add.at(texts, j, 1)
        some = np.flatnonzero(texts)
        forest = _forest(list(range(n)), i, j)
        none = np.full(len(forest), 0)
        return pa.table(
            {
                "rep": pa.array(np.concatenate([rep[some], rep[[a for a, _ in forest]] if forest else none]).astype(np.int64)),
                "other": pa.array([None] * len(some) + [int(rep[b]) for _, b in forest], pa.int64()),
                "links": pa.array(np.concatenate([links[some], none]).astype(np.int64)),
                "texts": pa.array(np.concatenate([texts[some], none]).astype(np.int64)),
            }
        )

    return verify


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links, n_linked_texts, n_copies, kept): one row per row of ``docs``.

    class_id: the smallest id reachable by links; n_links: documents linked directly, copies
    included; n_linked_texts: different shingle sets linked directly; n_copies: other documents with
    the same set; kept: doc_id = class_id.
    """
    stage = Stages()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = base.where(F.col("doc_id").isNotNull())
    sigs = stage(known.mapInArrow(_documents, "doc_id long, k1 long, k2 long, n_shingles int, sig binary"), "sigs")
    rows = sigs.count()
    weights = sigs.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("weight"))
    classes = sigs.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")).join(weights, ["k1", "k2"])
    classes = stage(classes, "classes", rows)

    bands = classes.select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("hub"), F.max("rep").alias("top")).where("n > 1")
    members = stage(bands.join(shared.select("band", "n", "hub"), "band"), "members")
    few = members.where(F.col("n") <= SMALL).select("band", "rep")
    pairs = few.select("band", F.col("rep").alias("id1")).join(few.select("band", F.col("rep").alias("id2")), "band").where("id1 < id2").select("id1", "id2").distinct()
    sig = classes.select("rep", "sig")
    pairs = (
        pairs.join(sig.select(F.col("rep").alias("id1"), F.col("sig").alias("sig1")), "id1")
        .join(sig.select(F.col("rep").alias("id2"), F.col("sig").alias("sig2")), "id2")
        .mapInArrow(_pruned(threshold), "id1 long, id2 long")
    )
    tied = members.where(F.col("n") > SMALL).select(F.col("hub").alias("id1"), F.col("rep").alias("id2")).where("id1 < id2").distinct()
    comps = connected_components(pairs.union(tied), stages=stage).select(F.col("id").alias("rep"), F.col("component_id").alias("comp"))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    total = comps.count()
    packs = max(1, total // TILE)
    placed = comps.join(sizes, "comp").withColumn("pieces", F.ceil(F.col("size") / TILE).cast("int"))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).withColumn(
        "comp", F.when(F.col("pieces") == 1, -1 - F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.col("comp"))
    )
    placed = placed.join(classes.select("rep", "weight", "k1", "k2"), "rep").select("rep", "k1", "weight", "comp", "pieces", "piece")
    texts = known.withColumnRenamed("doc_id", "rep").join(placed, "rep").dropDuplicates(["rep", "k1", "text"])
    sets = texts.select("rep", "k1", "weight", "piece", "comp", "pieces", "text").mapInArrow(_sets, "rep long, k1 long, weight long, piece int, comp long, pieces int, shingles binary")
    sets = sets.drop("k1")
    meet = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda x: F.struct(F.least(x, F.col("piece")).alias("p"), F.greatest(x, F.col("piece")).alias("q")))
    tiles = sets.withColumn("tile", F.explode(meet)).select("rep", "weight", "piece", "comp", F.col("tile.p").alias("p"), F.col("tile.q").alias("q"), "shingles")
    found = stage(tiles.groupBy("comp", "p", "q").applyInArrow(_tile(threshold), "rep long, other long, links long, texts long"), "links")

    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    grouped = connected_components(found.where("other is not null"), "rep", "other", stages=stage).select(F.col("id").alias("rep"), F.col("component_id").alias("class_id"))
    per_class = classes.select("k1", "k2", "rep", "weight").join(counts, "rep", "left").join(grouped, "rep", "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"), (F.col("weight") - 1).alias("n_copies"), F.coalesce("class_id", "rep").alias("class_id"))
    with_class = sigs.select("doc_id", "k1", "k2").join(per_class, ["k1", "k2"]).drop("k1", "k2")
    alone = base.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    zero = F.lit(0).cast("long")
    alone = alone.select("doc_id", zero.alias("n_links"), zero.alias("n_linked_texts"), zero.alias("n_copies"), F.col("doc_id").alias("class_id"))
    result = with_class.unionByName(alone).select("doc_id", "class_id", "n_links", "n_linked_texts", "n_copies", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
    return stage.finish(result, "near", rows)
