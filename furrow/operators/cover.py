"""What of the borders of capsules (lines widened by a radius) other capsules leave bare, and which capsules hang together, within one block of ground. Arrays of lines.

Ground that one capsule covers deeply needs no look at the others: it is marked in small cells first, which takes a line as many steps as it has cells, however many lines lie
there. Only parts of borders in other cells are held against the capsules around them, so the work does not grow with the square of a block's lines."""

from __future__ import annotations

import math

import numpy as np

from furrow.operators import kernels

TOUCH = 1e-9  # metres within which two borders count as one
ARCS = 8  # parts of a half circle that are looked at one by one
AT_ONCE = 1 << 20  # parts of borders times lines that are compared at once


def _counted(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + 0 .. count[i] - 1) for each i."""
    count = np.maximum(count, 0)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(count.cumsum() - count, count) + first[owner]


class Block:
    """Lines x1, y1, x2, y2 in the order of their idx, at and around the block cu, cs of sides su, sv in the direction with cosine fc and sine fs."""

    def __init__(self, x1, y1, x2, y2, fc: float, fs: float, su: float, sv: float, cu: int, cs: int, radius: float):
        self.ends, self.turned, self.radius = (x1, y1, x2, y2), (fc, fs), radius
        u1, v1, u2, v2 = *self._across(x1, y1), *self._across(x2, y2)
        self.places, self.box, self.cell = ((u1, v1), (u2, v2)), ((cu * su, (cu + 1) * su), (cs * sv, (cs + 1) * sv)), (su, sv, cu, cs)
        first = u1 <= u2
        self.ulo, self.uhi, self.va, self.vb = (np.where(first, *p) for p in ((u1, u2), (u2, u1), (v1, v2), (v2, v1)))
        self.slope = (self.vb - self.va) / np.where(self.uhi > self.ulo, self.uhi - self.ulo, 1.0)
        self.vlo, self.vhi = np.minimum(v1, v2), np.maximum(v1, v2)
        self.long = np.hypot(x2 - x1, y2 - y1)

    def _across(self, x, y):
        return x * self.turned[0] + y * self.turned[1], y * self.turned[0] - x * self.turned[1]

    def _columns(self, start: float, step: float, low: float = -math.inf, high: float = math.inf):
        """(line, k, v) where lines run over start + k * step, for k in [low, high]."""
        k1, k2 = (np.clip(k, low, high).astype(np.int64) for k in (np.ceil((self.ulo - start) / step), np.floor((self.uhi - start) / step)))
        i, k = _counted(k1, k2 - k1 + 1)
        return i, k, self.va[i] + self.slope[i] * (start + k * step - self.ulo[i])

    def groups(self) -> np.ndarray:
        """For each line the least one that it hangs together with. Lines that cross a stretch shorter than two radii do; lines left apart are measured."""
        n, width = len(self.ulo), 2 * self.radius
        i, k, v = self._columns(0.0, self.radius)
        hub = np.stack([k, np.floor(v / (0.98 * width) + k % 2 / 2).astype(np.int64)])
        order = np.lexsort((hub[1], hub[0]))
        same = (hub[:, order][:, 1:] == hub[:, order][:, :-1]).all(axis=0)
        label = _joined(np.arange(n), i[order][1:][same], i[order][:-1][same])
        rest = np.flatnonzero(label != np.bincount(label, minlength=n).argmax())
        step = max(1, AT_ONCE // n)
        for part in (rest[at : at + step] for at in range(0, len(rest), step)):
            near = label[part][:, None] != label
            for lo, hi in ((self.ulo, self.uhi), (self.vlo, self.vhi)):
                near &= (lo[part][:, None] < hi + width) & (lo < hi[part][:, None] + width)
            a, b = np.nonzero(near)
            a = part[a]
            far, _, _ = kernels.segments_apart(*[c[a] for c in self.ends], *[c[b] for c in self.ends])
            label = _joined(label, a[far < width], b[far < width])
        return label

    def _bare(self, u0: float, v0: float, a: float, b: float, nc: int, nr: int) -> np.ndarray:
        """Sums from the corner u0, v0 on of the cells (a by b) that no capsule covers alone."""
        i, k, v = self._columns(u0, a, 0, nc)
        next_too = np.flatnonzero(i[1:] == i[:-1])
        k, p, q = k[next_too], v[next_too], v[next_too + 1]
        deep = self.radius - 1e-6
        low = np.clip(np.ceil((np.maximum(p, q) - deep - v0) / b), 0, nr).astype(np.int64)
        high = np.clip(np.floor((np.minimum(p, q) + deep - v0) / b), 0, nr).astype(np.int64)
        some = (high > low) & (k < nc)
        marks = np.zeros((nc, nr + 1), np.int64)
        np.add.at(marks, (k[some], low[some]), 1)
        np.add.at(marks, (k[some], high[some]), -1)
        sums = np.zeros((nc + 1, nr + 1), np.int64)
        sums[1:, 1:] = (marks.cumsum(axis=1)[:, :nr] == 0).cumsum(axis=0).cumsum(axis=1)
        return sums

    def _parts(self):
        """line, piece, s, e: the borders whose line's own place is in the block, in short parts; as buffers._pieces."""
        (u1, v1), (u2, v2) = self.places
        t0, t1 = np.zeros(len(u1)), np.ones(len(u1))
        for p, q, (low, high) in ((u1, u2, self.box[0]), (v1, v2, self.box[1])):
            step = q - p
            safe = np.where(step != 0, step, 1.0)
            one, two = (low - p) / safe, (high - p) / safe
            within = (p >= low) & (p < high)
            t0 = np.maximum(t0, np.where(step != 0, np.minimum(one, two), np.where(within, -math.inf, 1.0)))
            t1 = np.minimum(t1, np.where(step != 0, np.maximum(one, two), np.where(within, math.inf, 0.0)))
        count = np.where((t0 < t1) & (self.long > 0), np.maximum(1, np.ceil(self.long * (t1 - t0) / self.radius)), 0).astype(np.int64)
        i, k = _counted(np.zeros(len(count), np.int64), count)
        edge = lambda k: np.where(k == count[i], t1[i], t0[i] + (t1[i] - t0[i]) * k / count[i])
        s, e = edge(k), edge(k + 1)
        out = [(i, np.zeros(len(i), np.int64), s, e), (i, np.full(len(i), 2), 1 - e, 1 - s)]
        su, sv, cu, cs = self.cell
        for piece, (u, v) in ((3, self.places[0]), (1, self.places[1])):
            mine = np.flatnonzero((np.floor(u / su) == cu) & (np.floor(v / sv) == cs))
            k = np.tile(np.arange(ARCS), len(mine))
            out.append((np.repeat(mine, ARCS), np.full(len(k), piece), k / ARCS, (k + 1) / ARCS))
        return [np.concatenate(c) for c in zip(*out)]

    def borders(self):
        """line, piece, s, e: what of the borders whose line's own place is in the block is in no other capsule; where two run as one, the lesser line has it."""
        i, piece, s, e = self._parts()
        x1, y1, x2, y2 = self.ends
        r, arc, last = self.radius, (piece == 1) | (piece == 3), (piece == 1) | (piece == 2)
        heading = np.arctan2(y2 - y1, x2 - x1)
        way = np.where(arc, 0.0, np.where(piece == 0, 1.0, -1.0))
        shape = {
            "ux": np.where(last, x2[i], x1[i]), "uy": np.where(last, y2[i], y1[i]), "dx": way * (x2 - x1)[i], "dy": way * (y2 - y1)[i],
            "turn": heading[i] + np.where(piece < 2, -math.pi / 2, math.pi / 2), "arc": arc, "s": s, "e": e, "i": i,
        }
        # Parts in cells that one capsule covers alone go first.
        (ulow, uhigh), (vlow, vhigh) = self.box
        a, b, rim = r, r / 3, 1.1 * r
        u0, v0 = ulow - rim, vlow - rim
        nc, nr = int((uhigh + rim - u0) / a) + 1, int((vhigh + rim - v0) / b) + 1
        sums = self._bare(u0, v0, a, b, nc, nr)
        one, two = self._across(*_at(shape, s, r)), self._across(*_at(shape, e, r))
        bulge = np.where(arc, r * (1 - np.cos(math.pi * (e - s) / 2)), 0.0) + 1e-7
        at = []
        for axis, start, step, most in ((0, u0, a, nc), (1, v0, b, nr)):
            low, high = np.minimum(one[axis], two[axis]) - bulge, np.maximum(one[axis], two[axis]) + bulge
            at += [np.clip(np.floor((low - start) / step), 0, most - 1).astype(np.int64), np.clip(np.floor((high - start) / step), 0, most - 1).astype(np.int64) + 1]
        c1, c2, r1, r2 = at
        kept = np.flatnonzero(sums[c2, r2] - sums[c1, r2] - sums[c2, r1] + sums[c1, r1] > 0)
        step = max(1, AT_ONCE // max(1, len(x1)))
        found = [self._left({n: c[part] for n, c in shape.items()}, part) for part in (kept[at : at + step] for at in range(0, len(kept), step))]
        if not sum(len(at) for at, _, _ in found):
            return i[:0], piece[:0], s[:0], e[:0]
        at, s, e = (np.concatenate(c) for c in zip(*found))
        i, piece = i[at], piece[at]
        order = np.lexsort((s, piece, i))
        i, piece, s, e = i[order], piece[order], s[order], e[order]
        new = np.append(True, (i[1:] != i[:-1]) | (piece[1:] != piece[:-1]) | (s[1:] != e[:-1]))
        return i[new], piece[new], s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1]

    def _left(self, shape: dict, part: np.ndarray):
        """(part, s, e): what the other capsules leave of parts of borders."""
        r, s, e = self.radius, shape["s"], shape["e"]
        half = np.where(shape["arc"], r * math.pi, np.hypot(shape["dx"], shape["dy"])) * (e - s) / 2
        reach = r + half + 1e-7
        mx, my = _at(shape, (s + e) / 2, r)
        mu, mv = self._across(mx, my)
        near = (shape["i"][:, None] != np.arange(len(self.ulo))) & (self.ulo <= (mu + reach)[:, None]) & (self.uhi >= (mu - reach)[:, None])
        near &= (self.vlo <= (mv + reach)[:, None]) & (self.vhi >= (mv - reach)[:, None])
        p, o = np.nonzero(near)
        close = _far(mx[p], my[p], *[c[o] for c in self.ends]) <= reach[p]
        p, o = p[close], o[close]
        who, low, high = [np.arange(len(part))], [e], [e]  # a last interval of no length ends the sweep of each part
        for arc in (True, False):
            some = shape["arc"][p] == arc
            for at in range(0, int(some.sum()), AT_ONCE >> 3):
                now = np.flatnonzero(some)[at : at + (AT_ONCE >> 3)]
                q, a, b = _covered({n: c[p[now]] for n, c in shape.items()}, o[now], [c[o[now]] for c in self.ends], r, arc)
                who.append(p[now][q]), low.append(a), high.append(b)
        who, low, high = (np.concatenate(c) for c in (who, low, high))
        by_end = np.lexsort((high, who))
        rank = np.empty(len(who), np.int64)
        rank[by_end] = np.arange(len(who))
        order = np.lexsort((high, low, who))
        reached = high[by_end[np.maximum.accumulate(rank[order])]]
        who, low = who[order], low[order]
        begun = np.append(True, who[1:] != who[:-1])
        start = np.where(begun, s[who], np.append(0.0, reached[:-1]))
        bare = low - start > TOUCH
        return part[who[bare]], start[bare], low[bare]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least of its set, with the sets of a[i] and b[i] made one."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        low, high = np.minimum(one, two)[apart], np.maximum(one, two)[apart]
        label = label.copy()
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _at(shape: dict, t: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    turn = shape["turn"] + np.where(shape["arc"], t * math.pi, 0.0)
    return shape["ux"] + shape["dx"] * t + r * np.cos(turn), shape["uy"] + shape["dy"] * t + r * np.sin(turn)


def _far(x, y, ox1, oy1, ox2, oy2) -> np.ndarray:
    dx, dy = ox2 - ox1, oy2 - oy1
    square = dx * dx + dy * dy
    along = np.clip(((x - ox1) * dx + (y - oy1) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    fx, fy = x - (ox1 + dx * along), y - (oy1 + dy * along)
    return np.sqrt(fx * fx + fy * fy)


def _covered(shape: dict, other: np.ndarray, ends: list, r: float, arc: bool):
    """(row, s, e): the intervals of parts that lie in the capsule of their row's other line; as buffers._cuts and buffers._covered."""
    s, e = shape["s"], shape["e"]
    heading = np.arctan2(ends[3] - ends[1], ends[2] - ends[0])
    nx, ny = -np.sin(heading), np.cos(heading)
    cuts = []
    with np.errstate(invalid="ignore", divide="ignore"):
        if arc:
            ux, uy = shape["ux"], shape["uy"]
            for x, y in (ends[:2], ends[2:]):
                px, py = x - ux, y - uy
                half = np.arccos(np.sqrt(px * px + py * py) / (2 * r))
                cuts += [np.arctan2(py, px) + half, np.arctan2(py, px) - half]
            for sign in (-1.0, 1.0):
                turn = np.arccos((nx * (ends[0] - ux) + ny * (ends[1] - uy) + sign * r) / r)
                cuts += [np.arctan2(ny, nx) + turn, np.arctan2(ny, nx) - turn]
            cuts = [np.mod(c - shape["turn"], 2 * math.pi) / math.pi for c in cuts]
        else:
            sx, sy = _at(shape, np.zeros(len(s)), r)
            dx, dy = shape["dx"], shape["dy"]
            square = dx * dx + dy * dy
            for x, y in (ends[:2], ends[2:]):
                fx, fy = x - sx, y - sy
                near = (fx * dx + fy * dy) / square
                root = np.sqrt(np.maximum(near * near - (fx * fx + fy * fy - r * r) / square, 0.0))
                cuts += [near + root, near - root]
            slope = nx * dx + ny * dy
            slope = np.where(np.abs(slope) > 1e-15, slope, np.nan)
            cuts += [(nx * (ends[0] - sx) + ny * (ends[1] - sy) + sign * r) / slope for sign in (-1.0, 1.0)]
        cuts = np.stack(cuts, axis=1)
        cuts = np.sort(np.where((cuts > s[:, None]) & (cuts < e[:, None]), cuts, e[:, None]), axis=1)
    cuts = np.concatenate([s[:, None], cuts, e[:, None]], axis=1)
    row, k = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
    low, high = cuts[row, k], cuts[row, k + 1]
    far = _far(*_at({n: c[row] for n, c in shape.items()}, (low + high) / 2, r), *[c[row] for c in ends])
    inside = (far < r - TOUCH) | ((far <= r + TOUCH) & (other[row] < shape["i"][row]))
    return row[inside], low[inside], high[inside]
