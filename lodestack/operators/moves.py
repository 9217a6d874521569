"""Rounds of Louvain's moves over links in blocks: what a block's task does, as array arithmetic, and the rows that pass between tasks.

Links are sorted by (graph, node) and parted into blocks of about `LINKS` links, a node's links in one block. A node's id is its block and
its place in it, so ids are in the order of nodes. A row is addressed to a block (`dest`) and holds arrays as bytes (`body`). A round is five
steps, each a mapInArrow after the rows went to their blocks: clusters' totals are added up where a cluster's first node lives and sent
back; each block tells the blocks that link to its nodes where these are; moves are weighed; the loads that want to come are added up and
sent back; nodes move. Blocks send sums for each cluster, so a large cluster is one entry for each block. Only what a block's nodes and links
need is held by its task. A graph of one block runs all its rounds in its task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Links of a block, both ways: about 50 MB of arrays where they are weighed.
LINKS = 2_000_000
#: A move must gain more than this; gains are compared in steps of it, so that no order of additions decides.
STEP = 1e-9
#: Rows between blocks: n and wanting are told by weighed states, turn by those of a single block.
ROWS = "dest int, src int, kind string, n long, wanting long, turn int, body array<binary>"
ARROW = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("wanting", pa.int64()), ("turn", pa.int32()), ("body", pa.list_(pa.binary()))])
#: Arrays of a row of each kind, in order.
FIELDS = {
    "block": {"node": "i8", "k": "f8", "m2": "f8", "loop": "f8", "part": "i4", "ends": "i8", "slot": "i4", "w": "f8"},
    "route": {"to": "i4", "ends": "i8", "at": "i4", "slot": "i4"},
    "state": {"node": "i8", "k": "f8", "c": "i8", "tot": "f8", "size": "i8", "goer": "i8", "goal": "i8", "room": "f8", "draw": "i8", "up": "i8"},
    "sums": {"c": "i8", "k": "f8", "size": "f8"},
    "totals": {"c": "i8", "tot": "f8", "size": "i8", "name": "i8"},
    "near": {"slot": "i4", "c": "i8", "tot": "f8", "size": "i8"},
    "loads": {"c": "i8", "k": "f8"},
    "load": {"c": "i8", "k": "f8"},
}

Row = dict
Rows = dict[str, list[Row]]


def row(dest: int, src: int, kind: str, **arrays) -> Row:
    return {"dest": int(dest), "src": int(src), "kind": kind, **arrays}


def read(batches: Iterator[pa.RecordBatch]) -> dict[int, Rows]:
    """The rows of each block by kind, in the order of who sent them."""
    out: dict[int, Rows] = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        for r in batch.to_pylist():
            arrays = {name: None if b is None else np.frombuffer(b, dtype) for (name, dtype), b in zip(FIELDS[r["kind"]].items(), r["body"], strict=True)}
            out[r["dest"]][r["kind"]].append({k: v for k, v in r.items() if k != "body"} | arrays)
    for rows in out.values():
        for kind in rows:
            rows[kind].sort(key=lambda r: r["src"])
    return out


def written(rows: list[Row]) -> Iterator[pa.RecordBatch]:
    for r in rows:
        body = [None if r.get(name) is None else np.ascontiguousarray(r[name], dtype).tobytes() for name, dtype in FIELDS[r["kind"]].items()]
        yield pa.RecordBatch.from_pylist([{"dest": r["dest"], "src": r["src"], "kind": r["kind"], "n": r.get("n"), "wanting": r.get("wanting"), "turn": r.get("turn"), "body": body}], ARROW)


def stepping(*steps: Callable[[int, Rows], list[Row]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """These steps one after the other for each block, the later ones on the rows that the earlier ones give."""

    def run(batches):
        for dest, rows in read(batches).items():
            for step in steps:
                out = step(dest, rows)
                rows = by_kind(out)
            yield from written(out)

    return run


def by_kind(rows: list[Row]) -> Rows:
    out: Rows = defaultdict(list)
    for r in rows:
        out[r["kind"]].append(r)
    return out


def home(ids: np.ndarray) -> np.ndarray:
    return ids >> 32


def ids(dest: int, n: int) -> np.ndarray:
    return (np.int64(dest) << 32) + np.arange(n, dtype=np.int64)


def to_homes(src: int, kind: str, c: np.ndarray, **arrays: np.ndarray) -> list[Row]:
    """Rows of these ascending clusters, one for each block where some of them live."""
    if not len(c):
        return []
    starts = np.flatnonzero(np.diff(home(c), prepend=-1))
    return [row(home(c[s]), src, kind, c=c[s:e], **{name: a[s:e] for name, a in arrays.items()}) for s, e in zip(starts, [*starts[1:], len(c)], strict=True)]


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark does it: halves away from zero."""
    whole = np.trunc(x)
    return (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)).astype(np.int64)


def xxhash(node: np.ndarray, turn: int) -> np.ndarray:
    """Spark's xxhash64 of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(node.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = mixed(turned(h, 27) * p1 + p4)
        h = (h + p5 + np.uint64(4)) ^ (np.uint64(turn & 0xFFFFFFFF) * p1)
        return mixed(turned(h, 23) * p2 + p3).view(np.int64)


# -- steps of a round ------------------------------------------------------------------------------------------------------------


def summed(dest: int, rows: Rows) -> list[Row]:
    """The state, and for each cluster of the block's nodes their degrees and number, to the cluster's home."""
    (state,) = rows["state"]
    c, inverse = np.unique(state["c"], return_inverse=True)
    sums = to_homes(dest, "sums", c, k=np.bincount(inverse, state["k"], len(c)), size=np.bincount(inverse, minlength=len(c)))
    return [row(dest, dest, "state", node=state["node"], k=state["k"], c=state["c"]), *sums]


def totalled(dest: int, rows: Rows) -> list[Row]:
    """Clusters' total degrees, sizes and first nodes, back to the blocks that asked."""
    (state,), asked = rows["state"], rows["sums"]
    if not asked:
        return [state]
    c, inverse = np.unique(np.concatenate([r["c"] for r in asked]), return_inverse=True)
    tot = np.bincount(inverse, np.concatenate([r["k"] for r in asked]), len(c))
    size = np.bincount(inverse, np.concatenate([r["size"] for r in asked]), len(c)).astype(np.int64)
    name = state["node"][c & 0xFFFFFFFF]
    parts = np.split(inverse, np.cumsum([len(r["c"]) for r in asked])[:-1])
    return [state, *(row(r["src"], dest, "totals", c=r["c"], tot=tot[at], size=size[at], name=name[at]) for r, at in zip(asked, parts, strict=True))]


def told(dest: int, rows: Rows, named: bool = False) -> list[Row]:
    """The state with its clusters' totals, and where the nodes are (by the cluster's first node, if named) to the blocks that have links to them."""
    (state,), totals = rows["state"], rows["totals"]
    c = np.concatenate([r["c"] for r in totals])  # ascending, since rows come by their homes
    at = np.searchsorted(c, state["c"])
    tot, size, up = (np.concatenate([r[name] for r in totals])[at] for name in ("tot", "size", "name"))
    out, where = [row(dest, dest, "state", node=state["node"], k=state["k"], c=state["c"], tot=tot, size=size, up=up)], up if named else state["c"]
    for route in rows["route"]:
        for to, s, e in zip(route["to"], route["ends"][:-1], route["ends"][1:], strict=True):
            at = route["at"][s:e]
            out.append(row(to, dest, "near", slot=route["slot"][s:e], c=where[at], **({} if named else {"tot": tot[at], "size": size[at]})))
    return out


def gathered(rows: Rows, name: str, dtype: str) -> np.ndarray:
    """What the neighbours' blocks told, by slot."""
    near = rows["near"]
    out = np.empty(sum(len(r["slot"]) for r in near), dtype)
    for r in near:
        out[r["slot"]] = r[name]
    return out


def pairs(own: np.ndarray, block: Row, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, cluster (as a place in the last array), weight: what links each of the values `own` (a place for each node) with clusters; and the slots' clusters, ascending."""
    u, rank = np.unique(near, return_inverse=True)
    key = np.repeat(own, np.diff(block["ends"])) * np.int64(max(len(u), 1)) + rank[block["slot"]]
    if block["w"] is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    w = np.diff(starts, append=len(key)).astype(float) if block["w"] is None else np.add.reduceat(block["w"][order], starts) if len(starts) else np.zeros(0)
    return key[starts] // max(len(u), 1), key[starts] % max(len(u), 1), w, u


def best(state: Row, block: Row, rows: Rows) -> tuple[np.ndarray, ...]:
    """What staying is worth for each node (in steps) and its links' weight inside; and of each node linked elsewhere its best move: node, cluster, value, and the cluster's size."""
    k, m2, own = state["k"], block["m2"], state["c"]
    near = gathered(rows, "c", "i8")
    node, place, w, u = pairs(np.arange(len(k)), block, near)
    tot, size = np.zeros(len(u)), np.zeros(len(u), np.int64)
    at = np.searchsorted(u, near)
    tot[at], size[at] = gathered(rows, "tot", "f8"), gathered(rows, "size", "i8")
    here = u[place] == own[node]
    inside = np.zeros(len(k))
    inside[node[here]] = w[here]
    stay = half_up((inside - k * (state["tot"] - k) / m2) / STEP)
    node, place, w = node[~here], place[~here], w[~here]
    value = half_up((w - k[node] * tot[place] / m2[node]) / STEP)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    most = np.maximum.reduceat(value, starts) if len(starts) else value
    first = np.flatnonzero(value == np.repeat(most, np.diff(starts, append=len(node))))
    first = first[np.flatnonzero(np.diff(node[first], prepend=-1))]  # of equal ones the smallest cluster
    return stay, inside, node[first], u[place[first]], value[first], size[place[first]]


def weighed(turn: int) -> Callable[[int, Rows], list[Row]]:
    """The best moves of nodes; the state with those that want to go, and their loads to the goals' homes.

    Of two single nodes the smaller waits for the larger to come.
    """

    def step(dest, rows):
        (state,), (block,) = rows["state"], rows["block"]
        k, own = state["k"], state["c"]
        stay, _, node, goal, value, size = best(state, block, rows)
        wants = value > stay[node] + 1
        goes = wants & ~((state["size"][node] == 1) & (size == 1) & (goal > own[node]))
        goer, goal = node[goes], goal[goes]
        room = (value[goes] - stay[goer]) * STEP * block["m2"][goer] / k[goer] + k[goer]
        draw = xxhash(state["node"][goer], turn) & ((1 << 20) - 1)
        to, inverse = np.unique(goal, return_inverse=True)
        out = row(dest, dest, "state", node=state["node"], k=k, c=own, goer=goer, goal=goal, room=room, draw=draw, n=len(k), wanting=int(wants.sum()))
        return [out, *to_homes(dest, "loads", to, k=np.bincount(inverse, k[goer], len(to)))]

    return step


def loaded(dest: int, rows: Rows) -> list[Row]:
    """The degrees of all that want to join a cluster, back to the blocks that asked."""
    asked = rows["loads"]
    if not asked:
        return rows["state"]
    c, inverse = np.unique(np.concatenate([r["c"] for r in asked]), return_inverse=True)
    load = np.bincount(inverse, np.concatenate([r["k"] for r in asked]), len(c))
    parts = np.split(inverse, np.cumsum([len(r["c"]) for r in asked])[:-1])
    return [*rows["state"], *(row(r["src"], dest, "load", c=r["c"], k=load[at]) for r, at in zip(asked, parts, strict=True))]


def moved(dest: int, rows: Rows) -> list[Row]:
    """The state after the moves of one round.

    A cluster that many want to join would grow beyond what each of them gains by. So a node moves with the chance that its own room
    (the degrees that the cluster may still take before the gain is gone) has in the degrees of all that want to come, one half at most.
    """
    (state,), loads = rows["state"], rows["load"]
    c = state["c"].copy()
    if loads:
        goals = np.concatenate([r["c"] for r in loads])  # ascending, since rows come by their homes
        load = np.concatenate([r["k"] for r in loads])[np.searchsorted(goals, state["goal"])]
        drawn = state["draw"] < np.minimum(0.5, state["room"] / load) * (1 << 20)
        c[state["goer"][drawn]] = state["goal"][drawn]
    return [row(dest, dest, "state", node=state["node"], k=state["k"], c=c)]


def alone(first: int, most: int, rest: float) -> Callable[[int, Rows], list[Row]]:
    """All rounds of a graph of one block."""

    def step(dest, rows):
        fixed = {"block": rows["block"], "route": rows["route"]}
        (state,) = rows["state"]
        for turn in range(most):
            for one in (summed, totalled, told, weighed(first + turn)):
                rows = by_kind(one(dest, rows)) | fixed
            (state,) = rows["state"]
            if state["wanting"] <= rest * state["n"]:
                return [state | {"turn": turn}]
            (state,) = moved(dest, by_kind(loaded(dest, rows)))
            rows = {"state": [state], "sums": [], **fixed}
        return [state | {"turn": most}]

    return step


# -- blocks ----------------------------------------------------------------------------------------------------------------------


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links (g, a, b, w; sorted by g and a) as one block: its row, the graphs of its parts (gs), and the neighbours that have slots (their nodes and parts)."""
    links = [batch for batch in batches if batch.num_rows]
    if links:
        links = pa.Table.from_batches(links)
        dest = TaskContext.get().partitionId()
        g = links["g"].combine_chunks().dictionary_encode()
        code, (a, b, w) = g.indices.to_numpy(zero_copy_only=False).astype(np.int64), (links[name].to_numpy() for name in ("a", "b", "w"))
        part = np.cumsum(np.diff(code, prepend=code[0]) != 0)
        first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(a, prepend=a[0]) != 0))
        n, k = len(first), np.add.reduceat(w, first)
        loops, at = a == b, np.repeat(np.arange(len(first)), np.diff(first, append=len(a)))
        loop = np.bincount(at[loops], w[loops], n)
        at, b, w, of = at[~loops], b[~loops], w[~loops], part[~loops]
        order = np.lexsort((b, of))
        new = (np.diff(of[order], prepend=-1) != 0) | (np.diff(b[order], prepend=0) != 0)
        slot = np.empty(len(b), np.int32)
        slot[order] = np.cumsum(new) - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
        whole = row(dest, dest, "block", node=a[first], k=k, loop=loop, part=part[first], ends=ends, slot=slot, w=None if (w == 1).all() else w)
        (batch,) = written([whole])
        gs = g.dictionary.take(pa.array(code[np.flatnonzero(np.diff(part, prepend=-1))]))
        columns = {"gs": pa.ListArray.from_arrays(pa.array([0, len(gs)], pa.int32()), gs), "need": pa.array([[b[order][new].astype("i8").tobytes(), of[order][new].astype("i4").tobytes()]], pa.list_(pa.binary()))}
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Rows, pa.Array]]:
    """The blocks with their graphs."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            ((dest, rows),) = read([one.select(ARROW.names)]).items()
            yield dest, rows, one["gs"].flatten()


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, g, node, k, part of a block's nodes."""
    for dest, rows, gs in by_place(batches):
        (block,) = rows["block"]
        part = pa.array(block["part"])
        yield pa.RecordBatch.from_arrays([pa.array(ids(dest, len(block["k"]))), gs.take(part), pa.array(block["node"]), pa.array(block["k"]), part], names=["i", "g", "node", "k", "part"])


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """to, slot, g, node: the neighbours of a block's nodes."""
    for batch in batches:
        for i in range(batch.num_rows):
            b, part = batch["need"][i].as_py()
            b, part = np.frombuffer(b, "i8"), np.frombuffer(part, "i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), batch["dest"][i].as_py(), np.int32)), pa.array(np.arange(len(b), dtype=np.int32)), batch["gs"][i].values.take(pa.array(part)), pa.array(b)], names=["to", "slot", "g", "node"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: with its graphs' sums of degrees (x by place at, kind m2), and its routes (at, to, slot; kind way) in one row."""
    whole, m2, ways = [], [], []
    for batch in batches:
        kind = batch["kind"].to_numpy(zero_copy_only=False)
        for name, into, columns in (("m2", m2, ("at", "x")), ("way", ways, ("at", "to", "slot"))):
            picked = np.flatnonzero(kind == name)
            if len(picked):
                some = batch.take(pa.array(picked))
                into.append([some[c].to_numpy(zero_copy_only=False) for c in columns])
        if (kind == "block").any():
            whole.append(batch.take(pa.array(np.flatnonzero(kind == "block"))))
    for one in whole:
        ((dest, rows),) = read([one.select(ARROW.names)]).items()
        (block,) = rows["block"]
        at, x = (np.concatenate(c) for c in zip(*m2, strict=True))
        of = np.empty(len(at))
        of[at] = x
        out = [block | {"m2": of[block["part"]]}]
        if ways:
            at, to, slot = (np.concatenate(c) for c in zip(*ways, strict=True))
            order = np.lexsort((slot, to))
            at, to, slot = at[order], to[order], slot[order]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            out.append(row(dest, dest, "route", to=to[starts], ends=[*starts, len(to)], at=at, slot=slot))
        for batch, gs in zip(written(out), (one["gs"], pa.nulls(1, one.schema.field("gs").type)), strict=False):
            yield pa.RecordBatch.from_arrays([*batch.columns, gs], names=[*batch.schema.names, "gs"])


def singles(dest: int, rows: Rows) -> list[Row]:
    """The state in which each node is its own cluster."""
    (block,) = rows["block"]
    return [row(dest, dest, "state", node=block["node"], k=block["k"], c=ids(dest, len(block["k"])))]


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of blocks in which the nodes i are in the clusters c (rows of kind at)."""
    block, at, c = None, [], []
    for batch in batches:
        kind = batch["kind"].to_numpy(zero_copy_only=False)
        if (kind == "block").any():
            block = batch.take(pa.array(np.flatnonzero(kind == "block")))
        some = batch.take(pa.array(np.flatnonzero(kind == "at")))
        at.append(some["i"].to_numpy(zero_copy_only=False) & 0xFFFFFFFF)
        c.append(some["c"].to_numpy(zero_copy_only=False))
    if block is not None:
        ((dest, rows),) = read([block.select(ARROW.names)]).items()
        (state,) = singles(dest, rows)
        state["c"][np.concatenate(at)] = np.concatenate(c)
        yield from written([state])


def with_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, pa.Array]]:
    """The rows of a block and its graphs."""
    gs, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            if batch["kind"][i].as_py() == "block":
                gs = batch.slice(i, 1)["gs"].flatten()
        parts.append(batch.select(ARROW.names))
    for rows in read(parts).values():
        yield rows, gs


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, a, b, w: the links between clusters by a block's links (a and b are the clusters' first nodes); and with w null, each node a and its cluster b."""
    for rows, gs in with_graphs(batches):
        (state,), (block,) = rows["state"], rows["block"]
        up, part, n = state["up"], block["part"].astype(np.int64), len(state["k"])
        # One value for each cluster and part.
        order = np.lexsort((up, part))
        new = (np.diff(part[order], prepend=-1) != 0) | (np.diff(up[order], prepend=0) != 0)
        own = np.empty(n, np.int64)
        own[order] = np.cumsum(new) - 1
        of, first = part[order][new], up[order][new]
        a, b, w, u = pairs(own, block, gathered(rows, "c", "i8"))
        loop = np.bincount(own, block["loop"], len(of))
        inner = np.flatnonzero(loop)
        for g, x, y, z in ((of[a], first[a], u[b], pa.array(w)), (of[inner], first[inner], first[inner], pa.array(loop[inner])), (part, state["node"], up, pa.nulls(n, pa.float64()))):
            yield pa.RecordBatch.from_arrays([gs.take(pa.array(g)), pa.array(x), pa.array(y), z], names=["g", "a", "b", "w"])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, k, inside, apart, share, gainers: for each graph the degrees of a block's nodes, their links inside clusters, degrees times the clusters' totals
    (all nodes of a cluster: its total squared), their shares in their clusters (1 for all of a cluster), and how many would gain by moving alone."""
    for rows, gs in with_graphs(batches):
        (state,), (block,) = rows["state"], rows["block"]
        stay, inside, node, _, value, _ = best(state, block, rows)
        part, k = block["part"], state["k"]
        sums = [np.bincount(part, x, len(gs)) for x in (k, inside + block["loop"], k * state["tot"], 1 / state["size"])]
        gainers = np.bincount(part[node[value > stay[node] + 1]], minlength=len(gs))
        yield pa.RecordBatch.from_arrays([gs, *map(pa.array, [*sums, gainers])], names=["g", "k", "inside", "apart", "share", "gainers"])


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, c of the states' nodes."""
    for dest, rows in read(batches).items():
        for state in rows["state"]:
            yield pa.RecordBatch.from_arrays([pa.array(ids(dest, len(state["c"]))), pa.array(state["c"])], names=["i", "c"])
