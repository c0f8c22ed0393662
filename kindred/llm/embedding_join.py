"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. Vectors are rotated by one fixed
orthogonal matrix, which spreads every difference evenly, and split into BLOCKS blocks; each
block gets the share of the budget that its dimensions are of all. Some block of a linked pair is
within its budget, so the union over blocks of range joins at those budgets holds every link.

The range join of a block sorts vectors into a grid over its first coordinates, with cells twice the
range wide: a vector is at home in one cell and probes, in each of these coordinates, the next cell if
that is in range. Two vectors in range meet in the cell that is the larger of their homes in every
coordinate, and are judged there only. The more vectors a label has, the more coordinates the grid
takes, so that cells are expected to hold no more than a tile; each one costs about 1.4 times the
rows, and a label of a few thousand vectors needs one. Fuller cells are cut into pieces of at most TILE
vectors, and two pieces meet in a task; there block distances are computed, and a pair within budget is
taken in the first block where it is. Such pairs are verified by their cosine in double precision. Tiles
return numbers of links and a spanning forest, never pairs.

Only vectors of equal, non-null labels and equal length are compared. Exact copies are searched as one
vector with a weight, the number of their ids.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null id, link with nothing; repeated rows of one id are one vector and don't count each other; an id
that occurs with several vectors has the links of all of them; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.ngram_jaccard import _forest
from kindred.operators.components import connected_components
from kindred.plans.stage import Stages

BLOCKS = 8
TILE = 4096
#: Rows of a tile compared at once, and the share of vectors expected in the fullest cell of a coordinate.
STRIP, FULLEST = 512, 0.65
#: Pairs verified at once.
PAIRS = 1 << 16
_SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, d, min(blocks, d) + 1).astype(int).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their rotated coordinates; each row's result depends on that row only."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return u, np.einsum("ij,jk->ik", u, rotation(x.shape[1]))


def _matrix(vecs: list[bytes], d: int) -> np.ndarray:
    """Packed vectors as rows of doubles; one stored in single precision has no more digits."""
    kinds = {len(v) for v in vecs}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(vecs), "<f4" if kinds == {4 * d} else "<f8").reshape(-1, d).astype(np.float64)
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * d else "<f8") for v in vecs], np.float64)


def _coordinates(n: int) -> int:
    """Coordinates of the grid for a label of n vectors."""
    return min(5, max(1, int(np.ceil(np.log(max(n, 1) / TILE) / np.log(1 / FULLEST)))))


def _spread(threshold: float, blocks: int):
    """A row per block and cell: at home, and the probes of the next cells (``shift`` has a bit for each coordinate)."""

    def scan(batches):
        for batch in batches:
            dims, size = batch.column("dim").to_numpy(), batch.column("size").to_numpy()
            grid = np.array([_coordinates(n) for n in size.tolist()], np.int64)
            for d, j in sorted(set(zip(dims.tolist(), grid.tolist(), strict=True))):
                part = batch.filter(pa.array((dims == d) & (grid == j)))
                _, r = _unit(_matrix(part.column("vec").to_pylist(), d))
                rep = part.column("rep").to_numpy(zero_copy_only=False)
                for b, (lo, hi) in enumerate(_blocks(d, blocks)):
                    reach = float(np.sqrt((2 - 2 * threshold) * (hi - lo) / d + _SLACK))
                    x = r[:, lo : lo + min(j, hi - lo)]
                    home = np.floor(x / (2 * reach)).astype(np.int64)
                    probes = np.floor((x + reach) / (2 * reach)).astype(np.int64) > home
                    for shift in range(1 << x.shape[1]):
                        step = np.array([shift >> k & 1 for k in range(x.shape[1])])
                        at = np.flatnonzero((probes | (step == 0)).all(axis=1))
                        if not len(at):
                            continue
                        cell = (((home[at] + step) & 0xFFF) << (12 * np.arange(x.shape[1]))).sum(axis=1)
                        m = pa.array(at)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label").take(m), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(np.full(len(at), shift, np.int32)), pa.array(rep[at]), part.column("weight").take(m), part.column("vec").take(m)],
                            names=["label", "dim", "block", "cell", "shift", "rep", "weight", "vec"],
                        )

    return scan


def _tile(threshold: float, blocks: int):
    def verify(table: pa.Table) -> pa.Table:
        d, b, p, q = (table.column(c)[0].as_py() for c in ("dim", "block", "p", "q"))
        rep, weight, shift, piece = (table.column(c).to_numpy() for c in ("rep", "weight", "shift", "piece"))
        u, r = _unit(_matrix(table.column("vec").to_pylist(), d))
        cuts = _blocks(d, blocks)
        budget = [(2 - 2 * threshold) * (hi - lo) / d + _SLACK for lo, hi in cuts]
        left = np.flatnonzero(piece == p)
        right = left if p == q else np.flatnonzero(piece == q)
        lo, hi = cuts[b]
        c = r[right, lo:hi]
        norm = (c * c).sum(1)
        n = len(rep)
        links, forest, root = np.zeros(n, np.int64), [], list(range(n))
        for start in range(0, len(left), STRIP):
            strip = left[start : start + STRIP]
            a = r[strip, lo:hi]
            near = (a * a).sum(1)[:, None] + norm[None, :] - 2 * (a @ c.T) <= budget[b] + 1e-7
            near &= (shift[strip][:, None] & shift[right][None, :]) == 0
            if p == q:
                near &= np.arange(start, start + len(strip))[:, None] < np.arange(len(right))[None, :]
            rows, cols = np.nonzero(near)
            for at in range(0, len(rows), PAIRS):
                i, j = strip[rows[at : at + PAIRS]], right[cols[at : at + PAIRS]]
                for k in range(b + 1):
                    x, y = cuts[k]
                    gap = r[i, x:y] - r[j, x:y]
                    within = np.einsum("ij,ij->i", gap, gap) <= budget[k]
                    keep = within if k == b else ~within
                    i, j = i[keep], j[keep]
                ok = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
                i, j = i[ok], j[ok]
                links += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64)
                links += np.bincount(j, weights=weight[i], minlength=n).astype(np.int64)
                tree = np.array(root)
                while (up := tree[tree]).tolist() != tree.tolist():
                    tree = up
                apart = tree[i] != tree[j]  # the others are joined already
                forest += _forest(root, i[apart], j[apart])
        some = np.flatnonzero(links)
        return pa.table(
            {
                "rep": pa.array([*rep[some].tolist(), *(int(rep[k]) for k, _ in forest)], pa.int64()),
                "other": pa.array([None] * len(some) + [int(rep[k]) for _, k in forest], pa.int64()),
                "links": pa.array([*links[some].tolist(), *([0] * len(forest))], pa.int64()),
            }
        )

    return verify


def _pack(batches):
    """Vectors as bytes, in single precision where that loses nothing."""
    for batch in batches:
        vec = []
        for v in batch.column("embedding").to_pylist():
            x = np.array(v, np.float64)
            with np.errstate(over="ignore"):
                short = x.astype("<f4")
            vec.append((short if (short == x).all() else x).tobytes())
        dims = pa.array([len(v) for v in batch.column("embedding").to_pylist()], pa.int32())
        names = ["label", "size", "rep", "weight", "dim", "vec"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), dims, pa.array(vec, pa.binary())], names=names)


def embedding_links(vectors: DataFrame, threshold: float = 0.93, blocks: int = BLOCKS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    stage = Stages()
    v = F.col("embedding")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0)
    sound &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = base.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("k1", F.xxhash64(F.lit(1), "label", "embedding")).withColumn("k2", F.xxhash64(F.lit(2), "label", "embedding"))
    good = base.where("ok")
    weights = good.select("k1", "k2", "vec_id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("weight"))
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).join(weights, ["k1", "k2"])
    classes = stage(classes, "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("size"))
    rows = classes.select("label", "rep", "weight", "embedding").join(sizes, "label").select("label", "size", "rep", "weight", "embedding")
    rows = rows.mapInArrow(_pack, "label string, size long, rep long, weight long, dim int, vec binary").mapInArrow(
        _spread(threshold, blocks), "label string, dim int, block int, cell long, shift int, rep long, weight long, vec binary"
    )
    rows = stage(rows, "spread")
    cells = rows.groupBy("label", "dim", "block", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    cut = rows.join(cells, ["label", "dim", "block", "cell"]).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(F.least(k, F.col("piece")).alias("p"), F.greatest(k, F.col("piece")).alias("q")))
    tiles = cut.withColumn("tile", F.explode(meet)).select("label", "dim", "block", "cell", "shift", "rep", "weight", "vec", "piece", F.col("tile.p").alias("p"), F.col("tile.q").alias("q"))
    found = stage(tiles.groupBy("label", "dim", "block", "cell", "p", "q").applyInArrow(_tile(threshold, blocks), "rep long, other long, links long"), "links")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other is not null"), "rep", "other", stages=stage).withColumnRenamed("id", "rep")
    per_class = classes.select("k1", "k2", "rep", "weight").join(counts, "rep", "left").join(groups, "rep", "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = base.select("vec_id", "ok", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    comp = F.when(F.col("ok"), F.coalesce("c", "vec_id")).otherwise(F.col("vec_id"))
    result = out.select("vec_id", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
    return stage.finish(result, "linked")
