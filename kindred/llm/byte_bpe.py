"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Merging by rank has one result for each string, and a token sequence is that result exactly if each
token is a result by itself and each two neighbours are the result of their concatenation. So the
non-deterministic transducer has states (last token written, place in the trie of tokens): a byte
moves down the trie, and at the end of a token that may follow the last one it may return to the root
and write it. Determinising keeps the set of these states with the tokens each of them has pending;
what all of them share is written at once, so output lags by a bounded number of bytes: that of
the tokens still possible. Sets and transitions are made when first met and kept while they fit.

Decoding joins the tokens' bytes; characters come out of an incremental UTF-8 state machine whose
steps over whole tokens are tabulated as they are met.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries kept of the piece cache, and states kept of the transducer, in one worker.
PIECES, STATES = 1_000_000, 500_000
#: Pieces of more bytes are not cached.
LONG = 4096


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def compile_merges(ranks: dict[bytes, int]) -> dict:
    """Tokens by rank and the two parts that each was merged from (-1: a byte, -2: never made by merging)."""
    n = max(ranks.values(), default=-1) + 1
    tokens = [b""] * n
    for t, r in ranks.items():
        tokens[r] = t
    left, right = [-1] * n, [-1] * n
    for t, r in ranks.items():
        if len(t) < 2:
            continue
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best, at = r, -1
            for i in range(len(parts) - 1):
                k = ranks.get(parts[i] + parts[i + 1], r)
                if k < best:
                    best, at = k, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
        else:
            left[r] = right[r] = -2
    return {"ranks": ranks, "tokens": tokens, "left": left, "right": right}


class Transducer:
    """The lazily determinised transducer over one vocabulary."""

    def __init__(self, merges: dict):
        self.ranks, self.tokens, self.left, self.right = (merges[k] for k in ("ranks", "tokens", "left", "right"))
        self.down: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for r, t in enumerate(self.tokens):
            if t and self.left[r] != -2:
                node = 0
                for b in t:
                    below = self.down[node].get(b)
                    if below is None:
                        below = self.down[node][b] = len(self.down)
                        self.down.append({})
                        self.token_at.append(-1)
                    node = below
                self.token_at[node] = r
        self.may: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.ids = {start: 0}
        self.sets = [start]
        self.moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]
        self.may.clear()

    def _forget(self, state: int) -> int:
        """Drop all states but one; its new number."""
        key = self.sets[state]
        self._reset()
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank gives a, b again.

        The later of the two merges is undone, again and again; at each point the pair that then met
        at the border must not have been merged earlier. Equal ranks go from left to right.
        """
        ranks, tokens, limit = self.ranks, self.tokens, 1 << 60
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            if a > b:
                if self.right[a] < 0:
                    return True
                limit, a = a, self.right[a]
            else:
                if self.left[b] < 0:
                    return True
                limit, b = b + 1, self.left[b]

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        after, down, token_at, may = [], self.down, self.token_at, self.may
        for node, last, pending in self.sets[state]:
            below = down[node].get(byte)
            if below is None:
                continue
            if down[below]:
                after.append((below, last, pending))
            t = token_at[below]
            if t >= 0:
                ok = last < 0 or may.get((last, t))
                if ok is None:
                    ok = may[last, t] = self._follows(last, t)
                if ok:
                    after.append((0, t, (*pending, t)))
        out = after[0][2]
        if len(after) == 1:
            if out:
                after = [(after[0][0], after[0][1], ())]
        elif out:
            shared = len(out)
            for x in after:
                r = x[2]
                if r[:shared] != out[:shared]:
                    shared = next(k for k in range(shared) if k >= len(r) or r[k] != out[k])
                    if not shared:
                        break
            out = out[:shared]
            if shared:
                after = [(n, p, r[shared:]) for n, p, r in after]
        key = tuple(after)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        self.moves[state][byte] = got = out, to
        return got

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The tokens of one piece, each as soon as no other reading of the bytes is left."""
        state = 0
        for b in data:
            got = self.moves[state].get(b) or self._step(state, b)
            state = got[1]
            yield from got[0]
        yield from self._last(state)

    def _last(self, state: int) -> tuple[int, ...]:
        """What is pending where the input may end."""
        for node, _, pending in self.sets[state]:
            if node == 0:
                return pending
        return ()

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern; a piece that is a token stands for itself."""
        data = text.encode()
        own = self.ranks.get(data)
        if own is not None:
            got = (own,)
        else:
            if len(self.sets) > STATES:
                self._reset()
            moves, state, parts = self.moves, 0, []
            for b in data:
                out, state = moves[state].get(b) or self._step(state, b)
                if out:
                    parts.extend(out)
                if len(moves) > STATES:
                    state = self._forget(state)
                    moves = self.moves
            got = (*parts, *self._last(state))
        if len(data) > LONG:
            return got
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        self.pieces[text] = got
        return got

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        out: list[int] = []
        known, more = self.pieces.get, out.extend
        for p in pattern.findall(text):
            more(known(p) or self.piece(p))
        return out


class Utf8:
    """Incremental UTF-8 decoding over tokens: what is complete comes out, the rest waits.

    The state is the bytes of an unfinished character (at most three). Steps over a token from a
    state are kept in a table; tokens that are whole characters leave the empty state as it is.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.steps: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        self.whole = np.array([self._whole(t) for t in tokens], bool)

    @staticmethod
    def _whole(t: bytes) -> bool:
        try:
            t.decode()
        except UnicodeDecodeError:
            return False
        return True

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the incomplete character that data ends with."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return k if need > k else 0
            if b < 0x80:
                return 0
        return 0

    def step(self, state: bytes, token: int) -> tuple[bytes, bytes]:
        """(complete bytes, next state)"""
        got = self.steps.get((state, token))
        if got is None:
            data = state + self.tokens[token]
            k = self._unfinished(data)
            got = self.steps[state, token] = (data[: len(data) - k], data[len(data) - k :])
        return got

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = b""
        for t in ids:
            done, state = self.step(state, t)
            if done:
                yield done.decode("utf-8", "replace")
        if state:
            yield state.decode("utf-8", "replace")

    def decode(self, ids: list[int], array: np.ndarray) -> bytes:
        """All bytes; runs of whole-character tokens are joined, the rest goes through the states."""
        odd = np.flatnonzero(~self.whole[array])
        if not len(odd):
            return b"".join([self.tokens[t] for t in ids])
        out, at, state = [], 0, b""
        for k in odd.tolist():
            if k < at:
                continue
            out += [self.tokens[t] for t in ids[at:k]]
            at = k
            while at < len(ids):
                done, state = self.step(state, ids[at])
                out.append(done)
                at += 1
                if not state:
                    break
        out.append(state)
        out += [self.tokens[t] for t in ids[at:]]
        return b"".join(out)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids: the ``keep`` columns, then n_tokens, ids_sha256,
    decoded_sha256, and the ids themselves if asked for.

    The vocabulary is one file of fixed size, read by the driver and broadcast with its merge tables (a few MB).

    Defined cases: null and empty texts have no ids; texts and pieces may be of any length; repeated rows are
    encoded alike; columns that aren't kept are ignored, and a kept one may not have a result's name; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    if taken := {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "__text"} & set(keep):
        raise ValueError(f"names of results: {', '.join(sorted(taken))}")
    shared = spark.sparkContext.broadcast(compile_merges(read_ranks(spark, vocabulary)))
    keep = (id_col, *keep)

    def scan(batches):
        gc.disable()  # the tables hold no cycles and millions of tuples
        here = shared.value
        if "machine" not in here:
            here["machine"], here["utf8"], here["pattern"] = Transducer(here), Utf8(here["tokens"]), regex.compile(pattern)
        machine, utf8, split = here["machine"], here["utf8"], here["pattern"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, sha, back, all_ids = [], [], [], []
                for text in part.column("__text"):
                    ids = machine.encode(text.as_py() or "", split)
                    array = np.array(ids, "<u4")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(array.tobytes()).hexdigest())
                    back.append(hashlib.sha256(utf8.decode(ids, array)).hexdigest())
                    if with_ids:
                        all_ids.append(array.astype(np.int32))
                cols = [*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    source = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(scan, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
