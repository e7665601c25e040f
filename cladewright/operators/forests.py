"""Quadratic forms over forests in memory, level by level: what ``dating`` eliminates in one task.

A branch's form over its upper end p, its lower end v, the rate w and 1 is k * (p - v + b) ** 2, and stiff / 2 * (p - v + shortest * w + force / stiff) ** 2 if it is pressed: in both the terms of p and v are alike but for
their signs, so that five numbers tell it (pp, pw, p1, ww, w1). Five tell a node's form (vv, vw, v1, ww, w1). Constants don't matter.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np

TOLERANCE, STEPS, STIFFNESS = 1e-8, 300, 1e4
#: Parts of a step that are tried.
PARTWAY = np.array([a * 2.0**-k for k in range(12) for a in (1.0, 0.75)])
#: Levels with fewer nodes than this, on average, are walked node by node.
NARROW = 24


class Forest:
    """Nodes and all that is known of their constraints. ``node``, ``parent`` (of roots without meaning), ``root``, ``b``, ``k``, ``tip`` and ``low`` (NaN: no bound) are arrays; parents may stand outside."""

    def __init__(self, node, parent, root, b, k, tip, low):
        by = np.argsort(node, kind="stable")
        at = np.minimum(np.searchsorted(node[by], parent), len(node) - 1)
        up = np.where((node[by][at] == parent) & ~root, by[at], -1)
        depth, far = (up >= 0).astype(np.int64), up.copy()
        while (far >= 0).any():  # by pointer doubling
            on = np.flatnonzero(far >= 0)
            depth[on] += depth[far[on]]
            far[on] = far[far[on]]
        order = np.lexsort((up, depth))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.up = np.where(up >= 0, place[up], -1)[order]
        self.level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.node, self.parent, self.root, self.b, self.k, self.tip, self.low = (x[order] for x in (node, parent, root, b, k, tip, low))
        self.force, self.hold = np.zeros((2, len(order)))
        self.pressed, self.held = np.zeros((2, len(order)), dtype=bool)
        self.before = self.after = None
        #: nodes that the clusters' tops hang on, and which of these each top hangs on
        self.hosts, self.host = np.unique(self.parent[: self.level[1]][~self.root[: self.level[1]]], return_inverse=True)

    def raked(self, span: float, shortest: float, given: np.ndarray | None = None) -> np.ndarray:
        """The messages to ``hosts``, or of a tree with its root the root's form. ``given`` is what reaches the nodes from other forests (five rows)."""
        stiff = STIFFNESS * self.k
        c = np.where(self.pressed, stiff / 2, 0.0)
        f = np.where(self.pressed, self.force / stiff, 0.0)
        a, b, d, g, h = self.k + c, c * shortest, self.k * self.b + c * f, c * shortest * shortest, c * shortest * f
        c = np.where(self.held, stiff / 2, 0.0)
        low, f = np.where(self.held, self.low, 0.0), self.hold / stiff
        m = np.array([c, -c * low, -c * f, c * low * low, c * low * f])
        if given is not None:
            m += given
        self.edge = a, b, d
        # a tip's x is the span times the rate: its branch is a form of its parent alone
        t = self.tip
        said = np.zeros_like(m)
        said[:, t] = np.array([a, b - a * span, d, g - 2 * span * b + span * span * a, h - span * d])[:, t]
        ends = self.level
        if len(t) < NARROW * (len(ends) - 1):
            self._walk_up(a, b, d, g, h, m, said)
        else:
            for i, j in zip(ends[-2::-1], ends[:0:-1], strict=True):
                own = np.flatnonzero(~t[i:j]) + i
                e = (x[own] for x in (a, b, d, g, h))
                said[:, own] = _message(*e, *m[:, own])
                if i:
                    start = ends[np.searchsorted(ends, i) - 1]
                    for r in range(5):
                        m[r, start:i] += np.bincount(self.up[i:j] - start, said[r, i:j], i - start)
        self.sums = m
        if self.root.any():
            return m[:, self.root][:, 0]
        top = said[:, : ends[1]]
        return np.array([np.bincount(self.host, top[r], len(self.hosts)) for r in range(5)])

    def _walk_up(self, a, b, d, g, h, m, said) -> None:
        up, tip, e = self.up.tolist(), self.tip.tolist(), list(zip(*(x.tolist() for x in (a, b, d, g, h)), strict=True))
        sums, out = m.T.tolist(), said.T.tolist()
        for v in range(len(up) - 1, -1, -1):
            if not tip[v] and not (up[v] < 0 and self.root[v]):
                out[v] = _message(*e[v], *sums[v])
            if (p := up[v]) >= 0:
                s, o = sums[p], out[v]
                sums[p] = [s[0] + o[0], s[1] + o[1], s[2] + o[2], s[3] + o[3], s[4] + o[4]]
        m[:], said[:] = np.array(sums).T, np.array(out).T

    def placed(self, span: float, shortest: float, rate: float, at: np.ndarray | None = None) -> tuple[int, float]:
        """Places of all nodes under ``rate``, hosts being ``at``; how many constraints came into the active set or left it, and by how much the worst is broken."""
        (a, b, d), m, ends = self.edge, self.sums, self.level
        n = len(self.node)
        x, xu = np.zeros(n), np.zeros(n)
        full = a + m[0]
        one = (-b + m[1]) * rate - d + m[2]
        xu[: ends[1]][~self.root[: ends[1]]] = at[self.host] if at is not None else 0.0
        x[self.tip] = span * rate
        if n < NARROW * (len(ends) - 1):
            up, tip, root, xs, us = self.up.tolist(), self.tip.tolist(), self.root.tolist(), x.tolist(), xu.tolist()
            for v, (p, k, o, f) in enumerate(zip(up, a.tolist(), one.tolist(), full.tolist(), strict=True)):
                if p >= 0:
                    us[v] = xs[p]
                if not tip[v]:
                    xs[v] = 0.0 if root[v] else (k * us[v] - o) / f
            x, xu = np.array(xs), np.array(us)
        else:
            for i, j in zip(ends, ends[1:], strict=False):
                if i:
                    xu[i:j] = x[self.up[i:j]]
                x[i:j] = np.where(self.tip[i:j], x[i:j], np.where(self.root[i:j], 0.0, (a[i:j] * xu[i:j] - one[i:j]) / full[i:j]))
        self.before, self.after = self.after, (x, xu, rate)
        return self._looked(span, shortest)

    def _looked(self, span: float, shortest: float) -> tuple[int, float]:
        x, xu, rate = self.after
        size = abs(rate) * span  # before its constraints hold a solution may run backwards
        self.x, self.e = x, np.where(self.root, -size, shortest * rate + xu - x)
        self.l = np.where(np.isnan(self.low), -size, self.low * rate - x)
        pressed, held = self._active()
        changed = int(((pressed != self.pressed) | (held != self.held)).sum())
        return changed, float(np.maximum(self.e, self.l).max())

    def _active(self) -> tuple[np.ndarray, np.ndarray]:
        stiff = STIFFNESS * self.k
        return self.force + stiff * self.e > 0, self.hold + stiff * self.l > 0

    def falls(self, shortest: float) -> np.ndarray:
        """``fall`` from the places before to the last ones."""
        return -PARTWAY if self.before is None else fall(self.k, self.b, self.root, self.low, self.force, self.hold, self.before, self.after, shortest)

    def back(self, share: float, span: float, shortest: float) -> None:
        """Stop at ``share`` of the way from the places before to the last ones."""
        if share < 1:
            self.after = tuple(a + share * (b - a) for a, b in zip(self.before, self.after, strict=True))
            self._looked(span, shortest)

    def step(self, changed: bool) -> None:
        """The active set that the last places ask for, or, if it stayed, larger multipliers and theirs."""
        if not changed:
            stiff = STIFFNESS * self.k
            self.force, self.hold = np.maximum(0.0, self.force + stiff * self.e), np.maximum(0.0, self.hold + stiff * self.l)
        self.pressed, self.held = self._active()

    def tried(self, span: float, shortest: float, changed: bool) -> list[np.ndarray]:
        """The messages of the active set that the last places ask for, and those of larger multipliers (of a set that changed: none), between which ``chosen`` decides."""
        self.step(True)
        sent, own, self.larger = [self.raked(span, shortest)], (self.force, self.hold, self.pressed, self.held), None
        if not changed:
            self.step(False)
            sent.append(self.raked(span, shortest))
            self.larger = self.force, self.hold, self.pressed, self.held
            self.force, self.hold, self.pressed, self.held = own
        return [*sent, np.zeros_like(sent[0])][:2]

    def chosen(self, raised: bool) -> None:
        if raised:
            self.force, self.hold, self.pressed, self.held = self.larger
        self.larger = None

    def __getstate__(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k not in ("edge", "sums", "x", "e", "l")}
        return out | {k: v and (v[0], v[1][: self.level[1]], v[2]) for k, v in (("before", self.before), ("after", self.after))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        full = lambda x, top, w: (x, np.concatenate([top, x[self.up[self.level[1]:]]]), w)
        self.before, self.after = self.before and full(*self.before), self.after and full(*self.after)


def packed(forest: Forest) -> bytes:
    return zlib.compress(pickle.dumps(forest, 5), 1)


def unpacked(blob: bytes) -> Forest:
    return pickle.loads(zlib.decompress(blob))


def of_rows(pdf) -> Forest:
    """The forest of a frame with a column for each argument of ``Forest``."""
    kinds = {"node": "int64", "parent": "int64", "root": bool, "b": float, "k": float, "tip": bool, "low": float}
    return Forest(*[pdf[c].to_numpy(dtype=kind) for c, kind in kinds.items()])


def heights(forest: Forest) -> np.ndarray:
    """The branches from each node down to its deepest leaf."""
    out, ends = np.zeros(len(forest.node), dtype=np.int64), forest.level
    for i, j in zip(ends[-2:0:-1], ends[:1:-1], strict=True):
        np.maximum.at(out, forest.up[i:j], out[i:j] + 1)
    return out


def _message(a, b, d, g, h, m0, m1, m2, m3, m4):
    """What a node's branch form and the sum of its node forms say to the node above."""
    full, q, k = a + m0, m1 - b, m2 - d
    return a * m0 / full, b + a * q / full, d + a * k / full, g + m3 - q * q / full, h + m4 - q * k / full


def verdict(changed: int, worst: float, rate: float, span: float) -> bool:
    """Whether places are final."""
    if not changed and not rate > 0:
        raise ValueError("the constraints cannot all hold, or the branch lengths give no positive rate")
    return not changed and worst <= TOLERANCE * abs(rate) * span


def fall(k, b, root, low, force, hold, before, after, shortest: float) -> np.ndarray:
    """By how much each of ``PARTWAY`` on the way from places ``before`` to ``after`` (each x, x of the node above, rate) changes the sum of squares with its penalties."""
    (x, xu, w), (x1, xu1, w1) = before, after
    stiff, on, bound = STIFFNESS * k, ~root, ~np.isnan(low)
    r, dr = (xu - x + b)[on], (xu1 - xu - x1 + x)[on]
    out = 2 * PARTWAY * (k[on] * r * dr).sum() + PARTWAY**2 * (k[on] * dr * dr).sum()
    for rows, own, e, de in ((on, force, shortest * w + xu - x, shortest * (w1 - w) + xu1 - xu - x1 + x), (bound, hold, low * w - x, low * (w1 - w) - x1 + x)):
        y, dy, s = (own + stiff * e)[rows], (stiff * de)[rows], stiff[rows]
        some = (y > 0) | (y + dy > 0)
        y, dy, s = y[some], dy[some], s[some]
        y0 = np.maximum(y, 0.0)
        out += np.array([((z := np.maximum(y + a * dy, 0.0)) - y0) @ ((z + y0) / (2 * s)) for a in PARTWAY])
    return out


def share_of(falls: np.ndarray) -> float:
    """How far to go. The whole way, by the active set alone, can go round and round; the way on which the sum with its penalties, which is convex, falls most, cannot."""
    return float(PARTWAY[np.argmin(falls)])


def settled(tree: Forest, span: float, shortest: float) -> float:
    """The rate of a whole tree, whose places (``x``) are set."""
    for _ in range(STEPS):
        form = tree.raked(span, shortest)
        rate = float(-form[4] / form[3])  # the root stands at 0
        changed, worst = tree.placed(span, shortest, rate)
        if verdict(changed, worst, rate, span):
            return rate
        if changed:
            tree.back(share_of(tree.falls(shortest)), span, shortest)
        tree.step(bool(changed))
    raise ValueError("the constraints cannot all hold, or did not settle")
