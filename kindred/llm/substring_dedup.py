"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document. Each word that lies in a window whose word
sequence also starts in a document with a smaller id is removed; windows are judged on the input.

1. Every window is represented by the smallest hash among its ``ANCHOR``-word grams. Equal windows
   have equal anchors, so an anchor occurs in at least as many documents as each of its windows.
2. First pass: each partition counts its anchors (once a document) in a count-min sketch, sparse and
   cut into segments; the partition sketches of a segment are added. A segment is chosen by hash
   bits and holds ``DEPTH`` rows of CELLS saturating counters, so the sketch grows with the corpus
   as more segments of one size, and no task or driver ever holds it all.
3. Second pass: each run of windows with one anchor meets its segment's sketch in a join; runs whose
   estimate is below two are dropped. The estimate never falls short, so no repeated window is lost.
4. What is left is grouped exactly by a 96-bit hash of the whole word sequence.

Whole copies are settled beforehand by SHA-256 of their words; only the first of them is searched.

Rows are told apart by two columns, 96 bits at least: the id (a hash of the text where it is null) and a hash
of the text. Repeated rows share them and have one result.

Defined cases: null and empty texts have no words and nothing removed; rows with equal ids are one
document's, neither is smaller; a null id is larger than all others; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import U, Words, mix, runs, signed, spans
from kindred.plans.stage import Stages

ANCHOR = 20
CELLS = 4096
DEPTH = 2
#: Counters for each expected anchor.
ROOM = 4
_LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _address(anchor: np.ndarray, segments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment and a cell in each row of the sketch."""
    a = mix(anchor ^ U(0xA0761D6478BD642F))
    b = mix(anchor ^ U(0xE7037ED1A0B428DB))
    seg = ((a >> U(32)) * U(segments)) >> U(32)
    return seg.astype(np.int64), [((a & U(0xFFFF)) % U(CELLS)).astype(np.int64), ((b & U(0xFFFF)) % U(CELLS)).astype(np.int64)]


def _anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor, first window's first word, number of windows)."""
    k = min(ANCHOR, width)
    h = w.hashes()
    n = len(h) - width + 1
    none = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0 or not (w.counts >= width).any():
        return none
    g = mix(spans(h, np.arange(len(h) - k + 1), np.arange(k, len(h) + 1), 0x9E6C63D0876A9A63))
    span = width - k + 1
    low, have = g, 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    doc = w.doc_of_word()
    fits = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(fits)
    if not len(at):
        return none
    low = low[:n][at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    return low[first], at[first], np.diff(np.append(first, len(at)))


def _facts(batches):
    """(doc_id, a, b, n_words, all_sha) of every row."""
    for batch in batches:
        n, sha = [], []
        for w in runs(batch.column("text")):
            n.append(w.counts)
            sha += [hashlib.sha256(w.joined(k)).hexdigest() for k in range(w.n_docs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("a"), batch.column("b"), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "a", "b", "n_words", "all_sha"],
        )


def _sketch(width: int, segments: int):
    """Each partition's sketch, segment by segment, sparse: cell numbers (row * CELLS + cell) and counts of 1 or 2."""

    def emit(keys: np.ndarray):
        cell, count = np.unique(keys, return_counts=True)
        seg, cell = cell // (CELLS * DEPTH), (cell % (CELLS * DEPTH)).astype(np.uint16)
        code = (cell | (np.minimum(count, 2) == 2).astype(np.uint16) << np.uint16(15)).astype("<u2")
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(seg)).tolist(), strict=True):
            yield int(seg[a]), code[a:b].tobytes()

    def batch_of(pairs):
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["segment", "part"])

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for w in runs(batch.column("text")):
                anchor, at, _ = _anchors(w, width)
                if not len(anchor):
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                once = _distinct(doc, anchor)
                seg, cells = _address(anchor[once], segments)
                for row, c in enumerate(cells):
                    held.append(seg * (CELLS * DEPTH) + row * CELLS + c)
                    size += len(c)
            if size > 4_000_000:
                yield batch_of(emit(np.concatenate(held)))
                held, size = [], 0
        if held:
            yield batch_of(emit(np.concatenate(held)))

    return scan


def _distinct(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Index of one row of each distinct (doc, anchor)."""
    order = np.lexsort((anchor, doc))
    d, a = doc[order], anchor[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
    return order[new]


def _merge(table: pa.Table) -> pa.Table:
    """One segment's sketch: the saturating sum of the partitions' sketches."""
    total = np.zeros(CELLS * DEPTH, np.int64)
    for part in table.column("part").to_pylist():
        code = np.frombuffer(part, "<u2")
        total[code & 0x7FFF] += 1 + (code >> 15)
    return pa.table({"segment": table.column("segment").slice(0, 1), "sketch": pa.array([np.minimum(total, 2).astype(np.uint8).tobytes()], pa.binary())})


def _occurrences(width: int, segments: int):
    """Runs with their segment, both cells in one number, the document, and place: first window << 32 | windows."""

    def scan(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for w in runs(batch.column("text")):
                anchor, at, length = _anchors(w, width)
                if not len(anchor):
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                seg, cells = _address(anchor, segments)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in ((seg, pa.int64()), (cells[0] | cells[1] << 12, pa.int32()), (a[w.lo + doc], pa.int64()), (b[w.lo + doc], pa.int32()), ((at - w.first[doc]) << 32 | length, pa.int64()))],
                    names=["segment", "cells", "a", "b", "place"],
                )

    return scan


def _windows(width: int):
    """96-bit hashes of the windows in each document's flagged runs."""

    def scan(batches):
        for batch in batches:
            a, b, owner = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "owner"))
            flagged = batch.column("runs")
            for w in runs(batch.column("text")):
                h, h2 = w.hashes(), w.hashes(1)
                for k in range(w.n_docs):
                    lo, hi = int(w.first[k]), int(w.first[k + 1])
                    own = flagged[w.lo + k].values.to_pylist()
                    at = np.concatenate([np.arange(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in own])
                    one = signed(mix(spans(h[lo:hi], at, at + width, 0xC2B2AE3D27D4EB4F)))
                    two = (mix(spans(h2[lo:hi], at, at + width, 0x165667B19E3779F9)) >> U(32)).astype(np.uint32).view(np.int32)
                    m = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one), pa.array(two), *(pa.array(np.full(m, x[w.lo + k])) for x in (owner, a, b)), pa.array(at, pa.int32())],
                        names=["h1", "h2", "doc", "a", "b", "at"],
                    )

    return scan


def _cut(width: int):
    """n_removed, kept_sha256 and the kept text of documents with windows to remove."""

    def scan(batches):
        for batch in batches:
            gone = batch.column("gone")
            removed, sha, kept = [], [], []
            for w in runs(batch.column("text")):
                for k in range(w.n_docs):
                    edge = np.zeros(int(w.counts[k]) + 1, np.int64)
                    at = gone[w.lo + k].values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    text = w.joined(k, keep)
                    removed.append(int((~keep).sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["a", "b", "n_removed", "kept_sha256", "kept"])

    return scan


def row_key(doc_id, text) -> tuple:
    """The two columns that tell rows apart in the result of ``remove_repeats``."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text)).alias("a"), F.hash(F.lit(31), text).alias("b")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, a, b, n_words, n_removed, kept_sha256, kept): one row per row of ``docs``.

    ``kept`` holds the words that stay, joined by one space, for documents that lost some but not all
    words; it is null where nothing was removed (the text stands) and empty where all words went.
    ``a`` and ``b`` are ``row_key`` of id and text: they join the result with its documents.
    """
    stage = Stages()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    key = ["a", "b"]

    facts = stage(base.mapInArrow(_facts, "doc_id long, a long, b int, n_words long, all_sha string"), "facts")
    order = F.coalesce("doc_id", F.lit(_LAST))
    size = facts.agg(F.sum("n_words")).first()[0] or 0
    long_enough = facts.where(F.col("n_words") >= width).select(*key, "all_sha", order.alias("doc"))
    owners = long_enough.groupBy("all_sha").agg(F.min("doc").alias("owner"))
    ranked = long_enough.distinct().join(owners, "all_sha")
    copies = ranked.where(F.col("doc") > F.col("owner")).select(*key).distinct()
    first = ranked.where(F.col("doc") == F.col("owner")).select(*key, "owner").distinct()

    expected = 2 * size / (width - min(ANCHOR, width) + 2)
    segments = max(1, math.ceil(expected * ROOM / CELLS))
    texts = base.where(F.octet_length("text") >= 2 * width - 1)
    sketch = texts.select("text").mapInArrow(_sketch(width, segments), "segment long, part binary").groupBy("segment").applyInArrow(_merge, "segment long, sketch binary")
    sketch = stage(sketch, "sketch")
    seen = texts.select(*key, "text").mapInArrow(_occurrences(width, segments), "segment long, cells int, a long, b int, place long")
    often = lambda row, c: F.expr(f"substring(sketch, {c} + {row * CELLS + 1}, 1)") == F.lit(b"\x02")
    runs_ = seen.join(sketch, "segment").where(often(0, "(cells & 4095)") & often(1, "shiftright(cells, 12)")).groupBy(*key).agg(F.collect_set("place").alias("runs"))
    # Each step is written before the next, so that the shuffles of only one are on disk.
    marked = stage(runs_.join(first, key), "marked")
    suspects = stage(base.join(marked, key).dropDuplicates(key), "suspects")

    windows = suspects.mapInArrow(_windows(width), "h1 long, h2 int, doc long, a long, b int, at int")
    shared = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h1", "h2", "low")
    # Owners of repeated windows are written: the join then reads plain exchanges, and adaptive execution splits a hot window.
    shared = stage(shared, "shared")
    gone = windows.join(shared, ["h1", "h2"]).where("doc > low").groupBy(*key).agg(F.collect_list("at").alias("gone"))
    gone = stage(gone, "gone")
    cut = suspects.select(*key, "text").join(gone, key).mapInArrow(_cut(width), "a long, b int, n_removed long, kept_sha256 string, kept string")
    cut = stage(cut, "cut")

    whole = copies.select(*key, F.lit(True).alias("copy"))
    result = (
        facts.join(whole, key, "left")
        .join(cut, key, "left")
        .select(
            "doc_id",
            *key,
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "all_sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
        )
    )
    return stage.finish(result, "repeats")
