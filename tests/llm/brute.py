"""Plain versions of the schedules, for small tables."""

import hashlib
from fractions import Fraction


def edf_order(rows, weights, block, default=1):
    """[(id, source, slot, block of the source)] in the order of the mix, slot by slot."""
    by = {}
    for i, s in rows:
        by.setdefault(s, []).append(i)
    digest = lambda i: hashlib.md5(("mix" if i is None else f"mix/{i}").encode()).hexdigest()
    for ids in by.values():
        ids.sort(key=lambda i: (digest(i), i))
    name = lambda s: "n" if s is None else "s" + s
    left = {s: [ids[k : k + block] for k in range(0, len(ids), block)] for s, ids in by.items()}
    total = {s: len(v) for s, v in left.items()}
    out, t = [], 0
    while left:
        share = {s: Fraction(str(weights.get(s, default))) for s in left}
        whole, start, taken = sum(share.values()), t, dict.fromkeys(left, 0)
        while True:
            free = [s for s in left if taken[s] * whole // share[s] <= t - start]
            s = min(free, key=lambda s: (-(-(taken[s] + 1) * whole // share[s]), name(s)))
            rows_of = left[s].pop(0)
            out += [(i, s, t, total[s] - len(left[s]) - 1) for i in rows_of]
            taken[s] += 1
            t += 1
            if not left[s]:
                del left[s]
                break
    return out


def ring_slots(rows, shards, vnodes=64):
    """{row: (shard, slot, ring shard, hops)} for rows (key, tie hash order) by walking the ring."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    nodes = sorted((int(md5(f"{s}/{v}")[:4], 16), s) for s in range(shards) for v in range(vnodes))
    waiting = []
    for row, (key, *ties) in rows.items():
        tie = "/".join(["tie", *(str(t) for t in ties if t is not None)])
        h = md5(str(key) if key is not None else tie)
        cell = int(h[:4], 16)
        waiting.append(((cell, md5(tie)[:2], h, "" if key is None else str(key), md5(tie)), row))
    waiting.sort(key=lambda x: x[0])
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out, hop = [0] * shards, {}, 0
    clock = {}
    for (cell, *_), _row in waiting:
        if cell not in clock:
            around = [s for p, s in nodes if p >= cell] + [s for p, s in nodes if p < cell]
            clock[cell] = list(dict.fromkeys(around))
    while waiting:
        over = []
        for key, row in waiting:
            s = clock[key[0]][hop]
            if used[s] < room[s]:
                out[row] = (s, used[s], clock[key[0]][0], hop)
                used[s] += 1
            else:
                over.append((key, row))
        waiting, hop = over, hop + 1
    return out
