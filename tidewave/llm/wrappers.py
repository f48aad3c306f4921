"""Wrappers of hosts: block trees of many pages laid on each other by simple tree matching.

A wrapper is a tree of nodes that counts, for the pages that have a node, its text, its links and how often
it stands there in a row. Child lists of matching nodes are aligned so that the most nodes below match (dynamic
programming over rows; long lists by halves, in memory linear in their length). No step is recursive, so
depth costs nothing but its nodes.
"""

from __future__ import annotations

import json

import numpy as np
import xxhash

from .dom import Node

#: Different pages that must show a text before it is taken for constant.
WITNESSES = 3
#: Nodes that fewer than one page in RARE has are no template; they are left out as pages are counted.
RARE = 200
#: Cells of an alignment table that plain loops fill.
CELLS = 4096


class W:
    """A wrapper's node: key, pages that have it, hashes of up to WITNESSES of them, hash of its text (None: it varies), letters, letters in links, pages that have it several times in a row."""

    __slots__ = ("chars", "dress", "key", "kids", "links", "n", "nodes", "rows", "seen", "shape", "text")

    def __init__(self, key: str, seen: list[int], text: int | None, chars: int = 0, links: int = 0, rows: int = 0, n: int = 1, dress: int = 0):
        self.key, self.seen, self.text, self.chars, self.links, self.rows, self.n, self.dress = key, seen, text, chars, links, rows, n, dress
        self.kids: list[W] = []
        self.nodes: list[Node] = []
        self.shape = 0


def digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> 16


def post_order(root, kids) -> list:
    """All nodes, children before their parents."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += kids(x)
    return out[::-1]


def shaped(root: W) -> W:
    """shape: a hash of the keys below, so that like subtrees are compared once."""
    for w in post_order(root, lambda x: x.kids):
        w.shape = digest(f"{w.key}({','.join(str(k.shape) for k in w.kids)})")
    return root


def _alike(a: W, b: W) -> bool:
    """Neighbours that are one repeated node: equal keys, and the same kind of children."""
    if a.key != b.key or bool(a.kids) != bool(b.kids):
        return False
    x, y = {k.key for k in a.kids}, {k.key for k in b.kids}
    return 2 * len(x & y) >= len(x | y)


def skeleton(root: Node, page: int) -> W:
    """The wrapper of one page; its nodes know the page's own. Like neighbours are one repeated node."""
    made: dict[int, W] = {}
    for node in post_order(root, lambda x: x.children):
        w = W(node.key, [page], digest("\n".join(node.texts)), node.chars, node.links, dress=2 if node.dead else int(bool(node.dressed)))
        w.nodes = [node]
        for c in node.children:
            k = made.pop(id(c))
            if w.kids and _alike(w.kids[-1], k):
                absorb(w.kids[-1], k, within=True)
            else:
                w.kids.append(k)
        made[id(node)] = w
    return made[id(root)]


def absorb(a: W, b: W, within: bool = False) -> W:
    """a becomes the wrapper of the pages of both; within: both are parts of one page, whose texts are one."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.chars, x.links, x.nodes = x.chars + y.chars, x.links + y.links, x.nodes + y.nodes
        if within:
            x.text, x.rows = digest(f"{x.text} {y.text}"), 1
        else:
            x.text, x.rows, x.n = x.text if x.text == y.text else None, x.rows + y.rows, x.n + y.n
            x.seen = sorted({*x.seen, *y.seen})[:WITNESSES]
        x.dress = min(x.dress, y.dress)
        kids = []
        for p, q in aligned(x.kids, y.kids):
            kids.append(p or q)
            if p and q:
                todo.append((p, q))
        x.kids = kids
    return a


def sizes(x: W, y: W, memo: dict[tuple[int, int], int]) -> int:
    """Nodes that match when tree y is laid on tree x: simple tree matching. Both are shaped."""
    todo = [(x, y)]
    while todo:
        a, b = todo[-1]
        at = (a.shape, b.shape)
        if at in memo:
            todo.pop()
            continue
        if a.key != b.key:
            memo[at] = 0
            continue
        need = [(p, q) for p in {k.shape: k for k in a.kids}.values() for q in {k.shape: k for k in b.kids}.values() if p.key == q.key and (p.shape, q.shape) not in memo]
        if need:
            todo += need
        else:
            pairs = _pairs(a.kids, b.kids, memo)
            memo[at] = 1 + sum(memo[a.kids[i].shape, b.kids[j].shape] for i, j in pairs)
    return memo[x.shape, y.shape]


def _pairs(xs: list[W], ys: list[W], memo: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The in-order alignment of two child lists with the most matching nodes, from the sizes in memo."""
    same = lambda p, q: p.shape == q.shape
    n, head, tail = min(len(xs), len(ys)), 0, 0
    while head < n and same(xs[head], ys[head]):
        head += 1
    while tail < n - head and same(xs[-1 - tail], ys[-1 - tail]):
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(xs) - t, len(ys) - t) for t in range(tail, 0, -1)]
    kinds: dict[int, int] = {}
    own, other = ([kinds.setdefault(w.shape, len(kinds)) for w in ws[head : len(ws) - tail]] for ws in (xs, ys))
    if not own or not other:
        return out
    of = {i: w for ws in (xs, ys) for w in ws if (i := kinds.get(w.shape)) is not None}
    weight = np.zeros((len(kinds), len(kinds)), np.int32)
    for i in set(own):
        for j in set(other):
            weight[i, j] = memo.get((of[i].shape, of[j].shape), 0) if of[i].key == of[j].key else 0
    x, y = np.array(own), np.array(other)

    def row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        best = np.zeros(len(b) + 1, np.int64)
        for k in a:
            new = best.copy()
            new[1:] = np.maximum(best[1:], best[:-1] + weight[k, b])
            best = np.maximum.accumulate(new)
        return best

    todo = [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > CELLS:
            mid = (i0 + i1) // 2
            split = j0 + int((row(x[i0:mid], y[j0:j1]) + row(x[mid:i1][::-1], y[j0:j1][::-1])[::-1]).argmax())
            todo += [(i0, mid, j0, split), (mid, i1, split, j1)]
            continue
        cost = weight[np.ix_(x[i0:i1], y[j0:j1])].tolist()
        best = [[0] * (j1 - j0 + 1) for _ in range(i1 - i0 + 1)]
        for i in range(i1 - i0 - 1, -1, -1):
            for j in range(j1 - j0 - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + cost[i][j])
        i = j = 0
        while i < i1 - i0 and j < j1 - j0:
            if cost[i][j] and best[i][j] == best[i + 1][j + 1] + cost[i][j]:
                out.append((head + i0 + i, head + j0 + j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return out


def aligned(xs: list[W], ys: list[W]) -> list[tuple[W | None, W | None]]:
    """Two child lists side by side, in order; None where one has no match."""
    if [x.key for x in xs] == [y.key for y in ys]:
        return list(zip(xs, ys, strict=True))
    for w in (*xs, *ys):
        shaped(w)
    memo: dict[tuple[int, int], int] = {}
    for p in {x.shape: x for x in xs}.values():
        for q in {y.shape: y for y in ys}.values():
            if p.key == q.key:
                sizes(p, q, memo)
    out, i, j = [], 0, 0
    for a, b in [*sorted(_pairs(xs, ys, memo)), (len(xs), len(ys))]:
        out += [(x, None) for x in xs[i:a]] + [(None, y) for y in ys[j:b]]
        if a < len(xs):
            out.append((xs[a], ys[b]))
        i, j = a + 1, b + 1
    return out


def pruned(root: W) -> W:
    """Without the nodes that less than one page in RARE has."""
    for w in post_order(root, lambda x: x.kids):
        w.kids = [k for k in w.kids if k.n * RARE >= root.n]
    return root


def dumps(root: W) -> str:
    """Nodes in order, parents first, each with the number of its children."""
    out, todo = [], [root]
    while todo:
        w = todo.pop()
        out.append([w.key, w.seen, w.text, w.chars, w.links, w.rows, w.n, w.dress, len(w.kids)])
        todo += reversed(w.kids)
    return json.dumps(out)


def loads(s: str) -> W:
    root, open_ = None, []
    for *fields, n in json.loads(s):
        w = W(*fields)
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].kids.append(w)
            open_[-1][1] -= 1
        else:
            root = w
        open_.append([w, n])
    return root
