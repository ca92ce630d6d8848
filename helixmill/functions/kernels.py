"""Vectorised kernels over batches of reads. Pure numpy: characters in, positions and flags out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixmill.functions.rolling import flat

#: Fixed value: complement of each base, either case; anything else becomes N.
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip("ACGTacgt", "TGCATGCA"):
    _COMPLEMENT[ord(_a)] = ord(_b)


class Reads:
    """A batch of strings as a padded matrix (0 beyond the end) with lengths."""

    def __init__(self, column: pa.Array | list[str], width: int | None = None):
        chars, at = flat(column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, pa.string()))
        self.size = np.diff(at)
        width = max(int(self.size.max()) if len(self.size) else 0, width or 0)
        self.data = np.zeros((len(self.size), width), np.uint8)
        self.data[np.arange(width) < self.size[:, None]] = chars.astype(np.uint8)

    def __len__(self):
        return len(self.size)

    def from_tail(self) -> np.ndarray:
        """Each row reversed, so that column 0 is the last character."""
        j = self.size[:, None] - 1 - np.arange(self.data.shape[1])
        return np.where(j >= 0, np.take_along_axis(self.data, j.clip(0), axis=1), 0)

    def rows(self, keep) -> "Reads":
        out = object.__new__(Reads)
        out.data, out.size = self.data[keep], self.size[keep]
        return out


def reverse_complement(r: Reads) -> Reads:
    out = r.rows(slice(None))
    t = r.from_tail()
    out.data = np.where(t > 0, _COMPLEMENT[t], 0)
    return out


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of the rows of a matrix as a string column."""
    start, end = np.maximum(start, 0), np.maximum(end, np.maximum(start, 0))
    j = np.arange(data.shape[1])
    body = data[(j >= start[:, None]) & (j < end[:, None])]
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])


def first(hit: np.ndarray, none: np.ndarray | int) -> np.ndarray:
    """Column of the first true value of each row, or ``none``."""
    return np.where(hit.any(axis=1), hit.argmax(axis=1), none) if hit.shape[1] else np.broadcast_to(np.asarray(none), len(hit)).copy()


def _window_sums(values: np.ndarray, w: int) -> np.ndarray:
    total = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values, axis=1)], axis=1)
    return total[:, w:] - total[:, :-w] if values.shape[1] >= w else np.zeros((len(values), 0), np.int64)


def quality_cut(seq: Reads, qual: Reads, front: int, tail: int, cut_front=None, cut_tail=None, cut_right=None):
    """Global trim of ``front`` and ``tail`` characters and sliding-window cuts, each given as (window, mean quality) or None.

    Returns (kept, start, end): reads that vanish aren't kept. Without any cut a read that is exactly used up is kept empty.
    """
    n, size = len(seq), seq.size
    start, end = np.full(n, front), size - tail
    kept = end - start >= 0
    if not (cut_front or cut_tail or cut_right):
        return kept, start, np.maximum(end, start)
    q = qual.data.astype(np.int64)
    j = np.arange(q.shape[1])
    if cut_front:
        w, mean = cut_front
        kept &= size - front - tail - w > 0
        sums = _window_sums(q, w)
        at = np.arange(sums.shape[1])
        good = (sums >= w * (33 + mean)) & (at >= front) & (at + w < (size - tail)[:, None])
        s = first(good, np.maximum(front, size - tail - w))
        s = np.where(s > 0, s + w - 1, s)
        other = (seq.data != ord("N")) & (j >= s[:, None])
        start = first(other & (j < size[:, None]), np.maximum(s, size))
    if cut_right:
        w, mean = cut_right
        kept &= size - start - tail - w > 0
        sums = _window_sums(q, w)
        at = np.arange(sums.shape[1])
        bad = (sums < w * (33 + mean)) & (at >= start[:, None]) & (at + w < (size - tail)[:, None])
        s = first(bad, -1)
        low = (q < 33 + mean) & (j >= s[:, None])
        stop = first(low & (j < (size - 1)[:, None]), np.maximum(size - 1, 0))
        end = np.where(s >= 0, stop, end)
    elif cut_tail:
        w, mean = cut_tail
        kept &= size - start - tail - w > 0
        sums = _window_sums(q, w)  # the window that ends at t begins at t-w+1
        at = np.arange(sums.shape[1]) + w - 1
        good = (sums >= w * (33 + mean)) & (at - w >= start[:, None]) & (at <= (size - tail - 1)[:, None])
        back = first(good[:, ::-1], -1)
        t = np.where(back >= 0, sums.shape[1] - 1 - back + w - 1, start + w - 1)
        t = np.where(t < size - 1, t - w + 1, t)
        other = (seq.data != ord("N")) & (j <= t[:, None]) & (seq.data > 0)
        back = first(other[:, ::-1], -1)
        t = np.where(back >= 0, q.shape[1] - 1 - back, -1)
        end = t + 1
    kept &= (end - start > 0) & (start < size - 1)
    return kept, start, end


def poly_g_end(seq: Reads, least: int = 10) -> np.ndarray:
    """Length that a read keeps after its G tail is cut: at most 5 others and one in 8, at least ``least`` long."""
    tail = seq.from_tail()
    i = np.arange(tail.shape[1])
    there = i < seq.size[:, None]
    is_g = tail == ord("G")
    others = np.cumsum(~is_g, axis=1)
    stop = first(((others > 5) | ((others > (i + 1) // 8) & (i >= least - 1))) & there, seq.size)
    g = is_g & (i < stop[:, None])
    last = np.where(g.any(axis=1), tail.shape[1] - 1 - g[:, ::-1].argmax(axis=1), 0)  # leftmost G of the tail
    return np.where((stop >= least) & (seq.size > 0), seq.size - 1 - last, seq.size)


def poly_x_end(seq: Reads, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(length kept, base 0..3 of A, T, C, G or -1) after a tail of mostly one base is cut; N fits any base."""
    tail = seq.from_tail()
    i = np.arange(tail.shape[1])
    there = i < seq.size[:, None]
    n = tail == ord("N")
    counts = np.stack([np.cumsum((tail == ord(b)) | n, axis=1) for b in "ATCG"], axis=2) if tail.shape[1] else np.zeros((len(seq), 0, 4), int)
    allowed = np.minimum(5, (i + 1) // 8)
    fits = ((i + 1)[None, :, None] - counts <= allowed[None, :, None]).any(axis=2)
    pos = first(~fits & ((i >= 8) | (i + 1 >= least - 1)) & there, seq.size)
    pos = np.minimum(pos, seq.size - 1)
    ok = (pos + 1 >= least) & (seq.size > 0)
    if not tail.shape[1]:
        return seq.size.copy(), np.full(len(seq), -1)
    base = np.take_along_axis(counts, pos.clip(0)[:, None, None], axis=1)[:, 0].argmax(axis=1)
    same = (tail == np.frombuffer(b"ATCG", np.uint8)[base][:, None]) & (i <= pos[:, None])
    back = first(same[:, ::-1], -1)
    ok &= back >= 0
    pos = tail.shape[1] - 1 - back
    return np.where(ok, seq.size - pos - 1, seq.size), np.where(ok, base, -1)


def adapter_at(seq: Reads, adapter: str, least: int = 4, gaps: bool = True) -> np.ndarray:
    """Where an adapter begins in each read (may be negative), or the read's length if it isn't there.

    The first place with at most one mismatch in 8 compared characters counts; failing that, the first with one inserted
    and then with one lost character and one mismatch less.
    """
    a = np.frombuffer(adapter.encode(), np.uint8)
    out = seq.size.copy()
    for lo in range(0, len(seq), 2048):  # blocks that stay in the cache
        part = seq.rows(slice(lo, lo + 2048))
        out[lo : lo + 2048] = _straight(part, a, least)
        if gaps and len(a) > 1:
            rows = np.flatnonzero(out[lo : lo + 2048] == part.size)
            if len(rows):
                out[lo + rows] = _gapped(part.rows(rows), a, least)
    return out


def _counter(m: int):
    return np.int8 if m < 100 else np.int32


def _straight(seq: Reads, a: np.ndarray, least: int) -> np.ndarray:
    n, width, size, m = len(seq), seq.data.shape[1], seq.size, len(a)
    lead = 4 if m >= 16 else 3 if m >= 12 else 2 if m >= 8 else 0
    pos = np.arange(-lead, width)
    padded = np.zeros((n, lead + width + m + 1), np.uint8)
    padded[:, lead : lead + width] = seq.data
    wrong = np.zeros((n, len(pos)), _counter(m))
    for k, c in enumerate(a):
        part = padded[:, k : k + len(pos)]
        wrong += ((part != c) & (part > 0)).view(np.int8)
    length = np.minimum(size[:, None] - pos, m)
    at = first((wrong <= length // 8) & (pos < (size - least)[:, None]), -99)
    return np.where(at == -99, size, at - lead)


def _gapped(seq: Reads, a: np.ndarray, least: int) -> np.ndarray:
    """First place with one inserted, else one lost character. Split at i: the first i characters are compared straight, the rest shifted by one."""
    n, width, size, m = len(seq), seq.data.shape[1], seq.size, len(a)
    out = size.copy()
    if not width:
        return out
    padded = np.zeros((n, width + m + 1), np.uint8)
    padded[:, :width] = seq.data
    there = padded > 0
    pos = np.arange(width)
    found = np.zeros(n, bool)
    kind = _counter(m)
    for extra_in_read in (True, False):
        most = m if extra_in_read else m - 1
        limit = np.minimum(size[:, None] - pos - (1 if extra_in_read else 0), most) // 8 - 1
        balance, least_balance = np.zeros((n, width), kind), np.full((n, width), 99, kind)  # straight minus shifted mismatches so far
        shifted_all = np.zeros((n, width), kind)
        for i in range(most):
            # a split behind the last compared character is no gap; it can only give what the straight search would have found
            if i:
                np.minimum(least_balance, balance, out=least_balance)
            here, next_ = padded[:, i : i + width], padded[:, i + 1 : i + 1 + width]
            inside = there[:, i + 1 : i + 1 + width] if extra_in_read else there[:, i : i + width]
            straight = (here != a[i]) & inside
            shifted = ((next_ != a[i]) if extra_in_read else (here != a[i + 1])) & inside
            balance += straight.view(np.int8)
            balance -= shifted.view(np.int8)
            shifted_all += shifted.view(np.int8)
        end = size - least - (1 if extra_in_read else 0)
        hit = (least_balance.astype(np.int32) + shifted_all <= limit) & (limit >= 0) & (pos < end[:, None])
        at = first(hit, -1)
        new = ~found & (at >= 0)
        out[new] = at[new]
        found |= new
    return out


def overlap(r1: Reads, r2: Reads, least: int = 30, diff_limit: int = 5, diff_pct: float = 0.2):
    """(found, offset, length, differences) of each pair, mate 2 reverse-complemented.

    Offsets 0, 1, ... then 0, -1, ... are tried; the first whose leading 50 characters differ in few enough places counts.
    """
    rc = reverse_complement(r2)
    n = len(r1)
    found, offset, length, diff = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    fixed = int(least * diff_pct) >= diff_limit
    for sign in (1, -1):
        a, b = (r1, rc) if sign > 0 else (rc, r1)
        for step in range(max(0, int(a.size.max(initial=0)) - least)):
            rows = np.flatnonzero(~found & (step < a.size - least))
            if not len(rows):
                continue
            ol = np.minimum(a.size[rows] - step, b.size[rows])
            near = int(min(50, ol.max()))
            x, y = a.data[rows, step : step + near], b.data[rows, :near]
            w = min(x.shape[1], y.shape[1])
            wrong = ((x[:, :w] != y[:, :w]) & (np.arange(w) < ol[:, None])).sum(axis=1)
            limit = diff_limit if fixed else np.minimum(diff_limit, (ol * diff_pct).astype(int))
            ok = wrong <= limit
            hit, ol = rows[ok], ol[ok]
            if len(hit):
                w = int(ol.max())
                full = ((a.data[hit, step : step + w] != b.data[hit, :w]) & (np.arange(w) < ol[:, None])).sum(axis=1)
                found[hit], offset[hit], length[hit], diff[hit] = True, sign * step, ol, full
    return found, offset, length, diff


def overlap_one_gap(r1: Reads, r2: Reads, rows: np.ndarray, least: int = 30, diff_limit: int = 5, diff_pct: float = 0.2):
    """(found, offset, length, differences) of the pairs ``rows`` if one base may be inserted in either mate.

    Offsets are tried as in ``overlap``. The pieces before and after the insertion are compared over one base less than the overlap; the
    fewest differences of any place of the insertion count. As a condition of its own, the straight comparison of all but the last
    base, with the shifted comparison of the last one, must stay within the limit too.
    """
    rc = reverse_complement(r2)
    n = len(rows)
    found, offset, length, diff = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    fixed = int(least * diff_pct) >= diff_limit
    for sign in (1, -1):
        a, b = (r1.rows(rows), rc.rows(rows)) if sign > 0 else (rc.rows(rows), r1.rows(rows))
        for step in range(max(0, int(a.size.max(initial=0)) - least)):
            live = np.flatnonzero(~found & (step < a.size - least))
            if not len(live):
                continue
            ol = np.minimum(a.size[live] - step, b.size[live])
            c = ol - 1
            w = int(ol.max())
            x, y = np.zeros((len(live), w + 1), np.uint8), np.zeros((len(live), w + 1), np.uint8)
            px, py = a.data[live, step : step + w + 1], b.data[live, : w + 1]
            x[:, : px.shape[1]], y[:, : py.shape[1]] = px, py
            k = np.arange(w)
            inside = k < c[:, None]
            straight = (x[:, :w] != y[:, :w]) & inside
            before = np.cumsum(straight, axis=1) - straight
            limit = diff_limit if fixed else np.minimum(diff_limit, (ol * diff_pct).astype(int))
            best = np.full(len(live), 10**6)
            # the insertion lies in the first mate, then in the second
            for ins, norm in ((x, y), (y, x)) if sign > 0 else ((y, x), (x, y)):
                shifted = (ins[:, 1 : w + 1] != norm[:, :w]) & inside
                after = shifted[:, ::-1].cumsum(axis=1)[:, ::-1]
                total = np.where((k >= 1) & inside, before + after, 10**6).min(axis=1)
                last = np.take_along_axis(shifted, (c - 1).clip(0)[:, None], axis=1)[:, 0]
                spent = np.take_along_axis(before, (c - 1).clip(0)[:, None], axis=1)[:, 0]
                ok = (total <= limit) & (spent + last <= limit) & (best == 10**6) & (c > 1)
                best = np.where(ok, total, best)
            hit = best < 10**6
            rows_hit = live[hit]
            found[rows_hit], offset[rows_hit], length[rows_hit], diff[rows_hit] = True, sign * step, ol[hit], best[hit]
    return found, offset, length, diff


def merge_exact_ends(r1: Reads, q1: Reads, r2: Reads, q2: Reads, least: int = 30):
    """(merged, overlap, sequence, quality) of pairs whose ends overlap by at least ``least`` bases, the shortest such overlap.

    At most two differences are allowed, each between a base of Q30 or more and one of Q15 or less; the sure one is kept. Where the mates agree, their qualities add up.
    """
    rc = reverse_complement(r2)
    rq = q2.from_tail()
    n = len(r1)
    size = np.zeros(n, np.int64)
    for ol in range(least, int(min(r1.size.max(initial=0), r2.size.max(initial=0))) + 1):
        live = np.flatnonzero((size == 0) & (ol <= np.minimum(r1.size, r2.size)))
        if not len(live):
            continue
        at = (r1.size[live] - ol)[:, None] + np.arange(ol)
        wrong = r1.data[live[:, None], at] != rc.data[live, :ol]
        u, v = q1.data[live[:, None], at], rq[live, :ol]
        low = wrong & (((u >= 63) & (v <= 48)) | ((u <= 48) & (v >= 63)))
        size[live[(wrong.sum(axis=1) == low.sum(axis=1)) & (low.sum(axis=1) < 3)]] = ol
    seqs, quals = [], []
    for i in range(n):
        ol = int(size[i])
        if not ol:
            seqs.append(None)
            quals.append(None)
            continue
        cut = int(r1.size[i]) - ol
        a, b, u, v = r1.data[i, cut : cut + ol], rc.data[i, : r2.size[i]].copy(), q1.data[i, cut : cut + ol].astype(int), rq[i, : r2.size[i]].astype(int)
        sure = (a != b[:ol]) & (u >= 63) & (v[:ol] <= 48)
        v[:ol] = np.where(a == b[:ol], u + v[:ol] - 33, np.where(sure, u, v[:ol]))
        b[:ol] = np.where(sure, a, b[:ol])
        seqs.append((r1.data[i, :cut].tobytes() + b.tobytes()).decode("latin-1"))
        quals.append((q1.data[i, :cut].tobytes() + v.astype(np.uint8).tobytes()).decode("latin-1"))
    return size > 0, size, seqs, quals


def correct(r1: Reads, q1: Reads, r2: Reads, q2: Reads, found, offset, length, diff, good: int = 30, bad: int = 14):
    """Mismatches in the overlap where one mate is sure and the other isn't take the sure base and its quality. Changes the
    matrices in place and returns (row, from mate, old base, new base) of every correction."""
    rows = np.flatnonzero(found & (diff > 0))
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    w = int(length[rows].max())
    k = np.arange(w)
    at1 = np.maximum(offset[rows], 0)[:, None] + k
    at2 = (r2.size[rows] - 1 - np.maximum(-offset[rows], 0))[:, None] - k
    ok = (k < length[rows][:, None]) & (at1 < r1.data.shape[1]) & (at2 >= 0)
    c1, c2 = at1.clip(0, r1.data.shape[1] - 1), at2.clip(0, r2.data.shape[1] - 1)
    rr = rows[:, None]
    b1, b2, p1, p2 = r1.data[rr, c1], r2.data[rr, c2], q1.data[rr, c1].astype(int) - 33, q2.data[rr, c2].astype(int) - 33
    wrong = ok & (b1 != _COMPLEMENT[b2])
    fix2, fix1 = wrong & (p1 >= good) & (p2 <= bad), wrong & (p2 >= good) & (p1 <= bad)
    out = []
    for mate, fix, into, qinto, col, old, new, qnew in ((2, fix2, r2, q2, c2, b2, _COMPLEMENT[b1], p1), (1, fix1, r1, q1, c1, b1, _COMPLEMENT[b2], p2)):
        i, j = np.nonzero(fix)
        into.data[rows[i], col[i, j]] = new[i, j]
        qinto.data[rows[i], col[i, j]] = (qnew[i, j] + 33).astype(np.uint8)
        out.append((rows[i], np.full(len(i), mate), old[i, j], new[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))
