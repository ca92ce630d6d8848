"""Golden vectors of the read kernels, and fuzzing against slow loops."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from helixmill.functions.kernels import Reads, adapter_at, correct, merge_exact_ends, overlap, overlap_one_gap, poly_g_end, poly_x_end, quality_cut, reverse_complement, strings
from helixmill.functions.rolling import flat
from helixmill.operators.evaluate import suffix_neighbours


def text(r: Reads) -> list[str]:
    return strings(r.data, np.zeros(len(r), int), r.size).to_pylist()


def test_reverse_complement():
    assert text(reverse_complement(Reads(["AAAATTTTCCCCGGGG", "", "acgtN"]))) == ["CCCCGGGGAAAATTTT", "", "NACGT"]


def test_quality_cut_front_and_tail():
    s, q = Reads(["TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTT"]), Reads(["/////CCCCCCCCCCCC////CCCCCCCCCCCCCC////E"])
    kept, a, b = quality_cut(s, q, 0, 1, cut_front=(4, 20), cut_tail=(4, 20))
    assert kept[0] and strings(s.data, a, b).to_pylist() == ["CCCCCCCCCCCCCCCCCCCCCCCCCCCC"] and strings(q.data, a, b).to_pylist() == ["CCCCCCCCCCC////CCCCCCCCCCCCC"]


def test_adapter():
    s = Reads(["TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCCCGGGG"])
    assert s.data[0, : adapter_at(s, "TTTTCCACGGGGATACTACTG")[0]].tobytes().decode() == "TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAA"


def test_overlap_golden():
    a = Reads(["CAGCGCCTACGGGCCCCTTTTTCTGCGCGACCGCGTGGCTGTGGGCGCGGATGCCTTTGAGCGCGGTGACTTCTCACTGCGTATCGAGC"])
    b = Reads(["ACCTCCAGCGGCTCGATACGCAGTGAGAAGTCACCGCGCTCAAAGGCATCCGCGCCCACAGCCACGCGGTCGCGCAGAAAAAGGGGTCC"])
    f, o, n, d = overlap(a, b, 30, 2, 0.2)
    assert (f[0], o[0], n[0], d[0]) == (True, 10, 79, 1)


def test_correction_golden():
    a, qa = Reads(["TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCACGGGG"]), Reads(["E" * 50 + "/" + "E" * 5])
    b, qb = Reads(["AAAAAAAAAACCCCGGGGAAAATTTTAAAATTGGGGGGGGGGTGGGGGGGGGGGGG"]), Reads(["E" * 42 + "/" + "E" * 13])
    got = correct(a, qa, b, qb, *overlap(a, b, 30, 5, 0.2))
    assert len(got[0]) == 2 and text(a)[0].endswith("TTTTCCCCGGGG") and text(b)[0].endswith("TTGGGGGGGGGGGGGGGGGGGGGGGG") and text(qa) == text(qb) == ["E" * 56]


def test_poly_x_golden():
    end, base = poly_x_end(Reads(["ATTTTAAAAAAAAAATAAAAAAAAAAAAAACAAAAAAAAAAAAAAAAAAAAAAAAAT"]))
    assert (end[0], base[0]) == (5, 0)


def _poly_g(s, least=10):
    wrong, cut, i = 0, len(s) - 1, 0
    for i in range(len(s) + 1):
        if i == len(s):
            break
        if s[len(s) - 1 - i] != "G":
            wrong += 1
        else:
            cut = len(s) - 1 - i
        if wrong > 5 or (wrong > (i + 1) // 8 and i >= least - 1):
            break
    return cut if i >= least and s else len(s)


def _cut(s, q, front, tail, w, mean, kind):
    n, start, end = len(s), front, len(s) - tail
    if n - front - tail - w <= 0:
        return None
    val = [ord(c) for c in q]
    avg = lambda i: sum(val[i : i + w]) / w
    if kind == "front":
        p = front
        while p + w < n - tail and avg(p) < 33 + mean:
            p += 1
        if p > 0:
            p += w - 1
        while p < n and s[p] == "N":
            p += 1
        start = p
    elif kind == "right":
        p, hit = front, False
        while p + w < n - tail:
            if avg(p) < 33 + mean:
                hit = True
                break
            p += 1
        if hit:
            while p < n - 1 and val[p] >= 33 + mean:
                p += 1
            end = p
    else:
        t = n - tail - 1
        while t - w >= front and avg(t - w + 1) < 33 + mean:
            t -= 1
        if t < n - 1:
            t = t - w + 1
        while t >= 0 and s[t] == "N":
            t -= 1
        end = t + 1
    return None if end - start <= 0 or start >= n - 1 else (start, end)


def _adapter(s, a, least=4):
    start = -4 if len(a) >= 16 else -3 if len(a) >= 12 else -2 if len(a) >= 8 else 0
    for p in range(start, len(s) - least):
        c = min(len(s) - p, len(a))
        if sum(s[p + i] != a[i] for i in range(max(0, -p), c)) <= c // 8:
            return p

    def one(ins, norm, c):
        return any(sum(x != y for x, y in zip(ins[:i], norm[:i])) + sum(x != y for x, y in zip(ins[i + 1 : c + 1], norm[i:c])) <= c // 8 - 1 for i in range(1, c))

    for p in range(0, len(s) - least - 1):
        if one(s[p:], a, min(len(s) - p - 1, len(a))):
            return p
    for p in range(0, len(s) - least):
        if one(a, s[p:], min(len(s) - p, len(a) - 1)):
            return p
    return len(s)


@pytest.mark.parametrize("seed", range(4))
def test_against_slow_loops(seed):
    rng = random.Random(seed)
    word = lambda n, abc="ACGTN": "".join(rng.choice(abc) for _ in range(n))
    reads = [word(rng.randrange(0, 60), rng.choice(["ACGT", "ACGTN", "G", "GGGGGGGGA", "AAAAAAAAAT"])) + word(rng.randrange(0, 30), rng.choice(["G", "GGGGGGGGGGA", "ACGT", "A", "N"])) for _ in range(400)] + ["", "N", "G" * 9, "G" * 10]
    quals = ["".join(rng.choice("#/5?EI") for _ in s) for s in reads]
    s, q = Reads(reads), Reads(quals)
    assert poly_g_end(s).tolist() == [_poly_g(x) for x in reads]
    for kind in ("front", "right", "tail"):
        for front, tail, w, mean in ((0, 0, 4, 20), (2, 1, 5, 25), (0, 3, 1, 15)):
            kept, a, b = quality_cut(s, q, front, tail, **{f"cut_{kind}": (w, mean)})
            want = [_cut(x, y, front, tail, w, mean, kind) for x, y in zip(reads, quals)]
            assert [(int(i), int(j)) if k else None for k, i, j in zip(kept, a, b)] == want, kind
    adapter = "AGATCGGAAGAGCACACG"
    mutated = []
    for x in reads:
        t = list(adapter[rng.randrange(0, 4) :])
        op = rng.randrange(4)
        p = rng.randrange(1, len(t))
        if op == 0:
            t[p] = "N"
        elif op == 1:
            t.insert(p, "T")
        elif op == 2:
            t.pop(p)
        mutated.append(x[:40] + "".join(t)[: rng.randrange(3, 20)])
    assert adapter_at(Reads(mutated), adapter).tolist() == [_adapter(x, adapter) for x in mutated]


def test_repeats_against_brute_force():
    """Neighbours in suffix order and their common beginnings, all texts of a batch at once."""
    rng = random.Random(5)
    texts = ["banana", "abc", "", "a", "aaaaaaaa", "GATTACAGATTACA"] + ["".join(rng.choice("ACG"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    chars, at = flat(pa.array(texts))
    for least in (1, 2, 5):
        own, length, one, two = suffix_neighbours(chars, at, np.arange(len(texts)), least)
        got = sorted(zip(own.tolist(), length.tolist(), one.tolist(), two.tolist()))
        want = []
        for n, t in enumerate(texts):
            order = sorted(range(len(t)), key=lambda i: t[i:])
            for j, i in zip(order, order[1:]):
                k = len(os.path.commonprefix([t[i:], t[j:]]))
                if k >= least:
                    want.append((n, k, i, j))
        assert got == sorted(want)



def _one_gap(a, b, least, most, pct):
    def fewest(ins, norm, c, limit):
        last = int(ins[c] != norm[c - 1])
        best = 10**6
        for i in range(1, c):
            left = sum(x != y for x, y in zip(ins[:i], norm[:i]))
            if left + last > limit:
                return -1
            best = min(best, left + sum(x != y for x, y in zip(ins[i + 1 : c + 1], norm[i:c])))
        return best

    for sign in (1, -1):
        first, second = (a, b) if sign > 0 else (b, a)
        for step in range(max(0, len(first) - least)):
            ol = min(len(first) - step, len(second))
            limit = most if int(least * pct) >= most else min(most, int(ol * pct))
            x, y = first[step:] + "~" * 3, second + "~" * 3
            for ins, norm in ((x, y), (y, x)) if sign > 0 else ((y, x), (x, y)):
                d = fewest(ins, norm, ol - 1, limit)
                if 0 <= d <= limit:
                    return True, sign * step, ol, d
    return False, 0, 0, 0


def test_one_gap_against_slow_loop():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one, two = [], []
    for i in range(60):
        f = word(60)
        g = list(f[rng.randrange(0, 20) :])
        g.insert(rng.randrange(len(g) - 6, len(g)), "A") if i % 3 else g.pop(len(g) - 4)
        one.append(f)
        two.append(rc("".join(g)))
    two[0] = word(60)
    want = [_one_gap(x, rc(y), 20, 2, 0.2) for x, y in zip(one, two)]
    got = overlap_one_gap(Reads(one), Reads(two), np.arange(60), 20, 2, 0.2)
    assert [tuple(t) for t in zip(*[g.tolist() for g in got])] == want and 10 < sum(w[0] for w in want) < 60


def test_simple_merge():
    rng = random.Random(2)
    f = "".join(rng.choice("ACGT") for _ in range(120))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = f[:80], list(f[40:])
    b[5] = "A" if b[5] != "A" else "C"
    b = "".join(b)
    qb = ["5"] * 80
    qb[5] = "#"
    done, size, seqs, quals = merge_exact_ends(Reads([a, f[:40], ""]), Reads(["F" * 80, "F" * 40, ""]), Reads([rc(b), rc(f[60:]), ""]), Reads(["".join(qb)[::-1], "5" * 60, ""]))
    assert done.tolist() == [True, False, False] and size[0] == 40 and seqs[0] == f
    assert quals[0] == "F" * 40 + chr(70 + 53 - 33) * 5 + "F" + chr(70 + 53 - 33) * 34 + "5" * 40
