"""What has to be known of the reads before they are cleaned: adapters, hot sequences, read length, chemistry."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.rolling import codes, flat, mix, window_starts
from helixmill.operators.exchange import from_planes, planes
from helixmill.operators.staging import BROADCAST_BYTES, small_enough, spread, staged
from helixmill.operators.stats import kmer_name, kmers

#: Read-name prefixes of two-colour instruments; substring lengths and counts that make a sequence hot.
TWO_COLOUR = ["@FS", "@MN", "@SH", "@NS", "@NB", "@NDX", "@VL", "@VH", "@A", "@NA", "@LH"]
STEPS = [10, 20, 40, 100, 150]
HOT_BASES = 1_510_000
_U = np.uint64


def sequence_length(df: DataFrame, first: int | None = None) -> DataFrame:
    """(seq_len): the longest read, of the reads with an ordinal below ``first`` if given."""
    return (df.where(F.col("read_id") < first) if first else df).agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).cast("int").alias("seq_len"))


def two_colour(df: DataFrame) -> DataFrame:
    """(read_id, two_color): whether the first read's name begins as those of a two-colour instrument."""
    first = df.agg(F.min(F.struct("read_id", "name")).alias("f")).select("f.read_id", "f.name")
    return first.select("read_id", F.coalesce(F.col("name").rlike("^(" + "|".join(TWO_COLOUR) + ")"), F.lit(False)).alias("two_color"))


def hot_least(step: int, seq_len: int) -> int:
    """Count from which a substring of this length is hot, in about HOT_BASES bases."""
    return 3 if step >= seq_len - 1 else 5 if step >= 100 else 20 if step >= 40 else 100 if step >= 20 else 500


def hot_sequences(df: DataFrame, steps: list[int] | None = None, buckets_bits: int = 20) -> DataFrame:
    """(seq, n): substrings of the given lengths that occur often for the amount of data.

    Counts grow with the data, so the least counts do too. First every substring is counted in hash buckets of a fixed
    number; only substrings of buckets that reach their least count are then counted exactly.
    """
    shape = df.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("b")).first()
    if steps is None:
        steps = sorted({s for s in [*STEPS[:-1], min(STEPS[-1], shape["n"] - 2)] if s > 0})
    scale = max(1.0, shape["b"] / HOT_BASES)
    least = {s: int(np.ceil(hot_least(s, shape["n"]) * scale)) for s in steps}
    width = 1 << buckets_bits
    stripe = min(width, 1 << 16)  # counts move packed by stripes

    def slots(chars, at, step):
        owner, place = window_starts(at, step)
        tag = mix(codes(chars, step)[place], step) if len(place) else np.zeros(0, _U)
        return owner, place, (tag & _U(width - 1)).astype(np.int64)

    def coarse(batches):
        total = {s: np.zeros(width, np.int64) for s in steps}
        for batch in batches:
            if batch.num_rows:
                chars, at = flat(batch.column(0))
                for s in steps:
                    total[s] += np.bincount(slots(chars, at, s)[2], minlength=width)
        cells = [(s, i, total[s][i : i + stripe]) for s in steps for i in range(0, width, stripe)]
        cells = [(s, i, pa.compress(planes(c), codec="zstd", asbytes=True)) for s, i, c in cells if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["step", "begin", "part"])

    def often(frame):
        """Buckets of a stripe that reach the least count, of the sums of all tasks."""
        step, begin = int(frame["step"].iloc[0]), int(frame["begin"].iloc[0])
        total = sum(from_planes(pa.decompress(p, decompressed_size=8 * stripe, codec="zstd", asbytes=True), stripe, np.int64) for p in frame["part"])
        bucket = np.flatnonzero(total >= least[step]) + begin
        return pd.DataFrame({"step": np.full(len(bucket), step, np.int32), "bucket": bucket.astype(np.int64)})

    seqs = spread(df.select("seq"))
    # at most 2^buckets_bits a step, and no more than the total over the least count
    heavy = seqs.mapInArrow(coarse, "step int, begin long, part binary").groupBy("step", "begin").applyInPandas(often, "step int, bucket long").collect()
    marks = {s: np.zeros(width, bool) for s in steps}
    for r in heavy:
        marks[r["step"]][r["bucket"]] = True
    known = df.sparkSession.sparkContext.broadcast(marks)

    def survivors(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, at = flat(batch.column(0))
            texts = batch.column(0).to_pylist()
            for s in steps:
                owner, place, slot = slots(chars, at, s)
                keep = known.value[s][slot]
                place, owner = place[keep], owner[keep]
                if not len(place):
                    continue
                _, first, same, count = np.unique(codes(chars, s)[place], return_index=True, return_inverse=True, return_counts=True)
                text = lambda i: texts[owner[i]][place[i] - at[owner[i]] : place[i] - at[owner[i]] + s]
                found = [text(i) for i in first]
                heads = place[first][same]
                odd = np.zeros(len(place), bool)  # of equal code, but another text
                for k in range(s):
                    odd |= chars[place + k] != chars[heads + k]
                if odd.any():
                    count = count - np.bincount(same[odd], minlength=len(count))
                    found, count = found + [text(i) for i in np.flatnonzero(odd)], np.append(count, np.ones(odd.sum(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(count.astype(np.int64))], names=["seq", "n"])

    exact = F.lit(False)
    for s in steps:
        exact = exact | ((F.length("seq") == s) & (F.col("n") >= least[s]))
    return seqs.mapInArrow(survivors, "seq string, n long").groupBy("seq").agg(F.sum("n").alias("n")).where(exact)


def without_contained(hot: list[tuple[str, int]], ratio: int = 10) -> list[tuple[str, int]]:
    """Hot sequences without those that stand in another one which isn't ``ratio`` times rarer. In order, each sees the removals before it.

    Holders are found by looking every piece of a sequence up, so the effort grows with the letters, not with the pairs.
    """
    left = dict(sorted(hot))
    sizes = sorted({len(s) for s in left})
    holders: dict[str, set[str]] = {}
    for other in left:
        for size in sizes:
            for i in range(len(other) - size + 1 if size < len(other) else 0):
                if (piece := other[i : i + size]) in left:
                    holders.setdefault(piece, set()).add(other)
    for seq in sorted(holders):
        if any(other in left and left[seq] // left[other] < ratio for other in holders[seq]):
            del left[seq]
    return sorted(left.items())


def hot_counts(df: DataFrame, hot: list[str] | DataFrame, sampling: int = 1, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(seq, n): non-overlapping occurrences of the hot sequences, per length, in the reads whose ordinal is a multiple of ``sampling``.

    ``sampling`` is the feature's own parameter; 1 takes every read. ``hot``: a list or a table with ``seq``, broadcast if it
    stays under ``limit`` bytes; beyond, the windows of the reads, one row each ordinal, are joined with it.
    """
    return hot_starts(df, hot, sampling, limit).groupBy("seq").agg(F.sum("n").alias("n"))


def hot_cycles(starts: DataFrame) -> DataFrame:
    """(seq, cycle, n): how many counted occurrences of each hot sequence, as ``hot_starts`` gives them, cover each cycle, from 0."""
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + F.length("seq") - 1))
    return starts.select("seq", covered.alias("cycle"), "n").groupBy("seq", "cycle").agg(F.sum("n").alias("n"))


def hot_starts(df: DataFrame, hot: list[str] | DataFrame, sampling: int = 1, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(seq, at, n): as ``hot_counts``, by the place in the read where the occurrence begins."""
    spark = df.sparkSession
    table = spark.createDataFrame([(h,) for h in hot], "seq string") if isinstance(hot, list) else staged(hot.select("seq"), "hot")
    few = len(hot) * 256 <= limit if isinstance(hot, list) else small_enough(table, 256, limit)  # of at most 150 letters
    seqs = spread(df.where(F.col("read_id") % sampling == 0).select(F.col("read_id").cast("long").alias("read_id"), "seq"))
    if not few:
        return _hot_starts_joined(seqs, table)
    by: dict[int, list] = {}
    for h in hot if isinstance(hot, list) else [r["seq"] for r in table.collect()]:
        by.setdefault(len(h), []).append(h)
    known = spark.sparkContext.broadcast({k: sorted(set(v)) for k, v in by.items()})

    def scan(batches):
        tables = {}
        for step, wanted in known.value.items():
            chars, at = flat(pa.array(wanted))
            code = codes(chars, step)[at[:-1]]
            order = np.argsort(code)
            tables[step] = code[order], order, chars.reshape(len(wanted), step)
        total: dict[int, np.ndarray] = {step: np.zeros(0, np.int64) for step in tables}
        wide = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, at = flat(batch.column(1))
            longest = int(np.diff(at).max(initial=0)) + 1
            if longest > wide:  # cells are numbered by sequence, then place
                total = {k: np.pad(v.reshape(-1, max(1, wide)), ((0, len(known.value[k]) - len(v.reshape(-1, max(1, wide)))), (0, longest - wide))).ravel() if len(v) else np.zeros(len(known.value[k]) * longest, np.int64) for k, v in total.items()}
                wide = longest
            for step, (code, order, letters) in tables.items():
                owner, place = window_starts(at, step)
                if not len(place):
                    continue
                here = codes(chars, step)[place]
                found = np.searchsorted(code, here).clip(0, len(code) - 1)
                keep = np.flatnonzero((code[found] == here) & (place < at[1:][owner] - step))  # the last window isn't looked at
                which = order[found[keep]]
                same = (chars[place[keep][:, None] + np.arange(step)] == letters[which]).all(axis=1)
                keep, which = keep[same], which[same]
                first = _apart(owner[keep], place[keep], step + 1)
                cell = which[first] * wide + (place - at[:-1][owner])[keep[first]]
                total[step] += np.bincount(cell, minlength=len(total[step]))
        for step, cells in total.items():
            there = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([known.value[step][i] for i in there // max(1, wide)], pa.string()), pa.array((there % max(1, wide)).astype(np.int32)), pa.array(cells[there])], names=["seq", "at", "n"])

    return seqs.mapInArrow(scan, "seq string, at int, n long").groupBy("seq", "at").agg(F.sum("n").alias("n"))


def _apart(owner: np.ndarray, place: np.ndarray, gap: int) -> np.ndarray:
    """Of hits in order of owner and place, those that a scan takes which moves on by ``gap`` after each."""
    if not len(owner):
        return np.zeros(0, np.int64)
    key = owner * (int(place.max()) + gap + 1) + place
    now, taken = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), []
    while len(now):
        taken.append(now)
        after = np.searchsorted(key, key[now] + gap)
        ok = after < len(key)
        now = after[ok][owner[after[ok]] == owner[now[ok]]]
    return np.sort(np.concatenate(taken))


def _hot_starts_joined(seqs: DataFrame, hot: DataFrame) -> DataFrame:
    """``hot_starts`` of a set too large for a broadcast: its windows meet it in a shuffle, and come back to one row a read and length."""
    steps = [r["k"] for r in hot.select(F.length("seq").alias("k")).distinct().collect()]  # the few lengths there are

    def windows(batches):
        for batch in batches:
            for read, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = [(read, i, text[i : i + step]) for step in steps for i in range(len(text or "") - step)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int32(), pa.string()))], names=["read_id", "at", "seq"])

    def greedy(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            for hits in batch.column(0).to_pylist():
                free = 0
                for h in hits:
                    if h["at"] >= free:
                        total[h["seq"], h["at"]] = total.get((h["seq"], h["at"]), 0) + 1
                        free = h["at"] + len(h["seq"]) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["seq", "at", "n"])

    met = seqs.mapInArrow(windows, "read_id long, at int, seq string").join(hot.hint("shuffle_hash"), "seq")
    held = met.groupBy("read_id", F.length("seq").alias("step")).agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("hits"))  # at most the letters of a read
    return held.select("hits").mapInArrow(greedy, "seq string, at int, n long").groupBy("seq", "at").agg(F.sum("n").alias("n"))


def long_repeats(df: DataFrame, least: int = 10, most: int = 20, complexity: float | None = None, column: str = "seq", ident: str = "read_id") -> DataFrame:
    """(id, repeat_len, pos1, pos2, repeat_seq): pieces of at least ``least`` characters that stand twice in a text, as the common beginnings of
    neighbours in the order of its suffixes; the ``most`` longest of a text (ties: by pos1), without those in which fewer than
    ``complexity`` of the steps change the letter. Most texts have none: those are told by their window codes before any suffix is sorted.
    """

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, at = flat(batch.column(1))
            rows = _with_repeat(chars, at, np.flatnonzero(np.diff(at) > least), least)
            for lo in range(0, len(rows), 1024):
                some = rows[lo : lo + 1024]
                own, length, one, two = suffix_neighbours(chars, at, some, least)
                texts = [bytes(chars[a : a + n]).decode("latin-1") if chars.dtype == np.uint8 else chars[a : a + n].astype(np.uint32).tobytes().decode("utf-32-le") for a, n in zip(at[:-1][some[own]] + one, length)]
                if complexity is not None:
                    keep = np.array([len(t) > 1 and sum(x != y for x, y in zip(t, t[1:])) >= complexity * (len(t) - 1) for t in texts], bool)
                    own, length, one, two, texts = own[keep], length[keep], one[keep], two[keep], [t for t, k in zip(texts, keep) if k]
                order = np.lexsort((one, -length, own))
                place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
                order = order[place < most]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some[own[order]])), *(pa.array(x[order].astype(np.int32)) for x in (length, one, two)), pa.array([texts[i] for i in order], pa.string())], names=[ident, "repeat_len", "pos1", "pos2", "repeat_seq"]
                )

    schema = f"{ident} long, repeat_len int, pos1 int, pos2 int, repeat_seq string"
    return spread(df.select(F.col(ident).cast("long").alias(ident), F.coalesce(column, F.lit("")).alias("t"))).mapInArrow(scan, schema)


def suffix_neighbours(chars: np.ndarray, at: np.ndarray, rows: np.ndarray, least: int):
    """(row, length, place, place before) of the neighbours in the suffix order of each text that agree in at least ``least`` characters.

    All texts at once: ranks of pieces of 1, 2, 4, ... characters order the suffixes, and the same ranks tell how far neighbours agree.
    """
    size = at[1:][rows] - at[:-1][rows]
    own = np.repeat(np.arange(len(rows)), size)
    begin = np.cumsum(size) - size
    pos = np.arange(len(own)) - begin[own]
    left = size[own] - pos  # characters from here to the end
    levels = [np.unique(chars[at[:-1][rows][own] + pos], return_inverse=True)[1] + 1]
    k = 1
    while k < size.max(initial=0):
        second = np.zeros(len(own), np.int64)
        inside = np.flatnonzero(left > k)
        second[inside] = levels[-1][inside + k]
        levels.append(np.unique(levels[-1] * (len(own) + 1) + second, return_inverse=True)[1] + 1)
        k *= 2
    order = np.lexsort((levels[-1], own))
    a, b = order[1:], order[:-1]
    near = own[a] == own[b]
    a, b = a[near], b[near]
    common, x, y = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for n in range(len(levels) - 1, -1, -1):
        step = 1 << n
        ok = (left[a] - common >= step) & (left[b] - common >= step)
        same = np.zeros(len(a), bool)
        same[ok] = levels[n][x[ok]] == levels[n][y[ok]]
        common += step * same
        go = same & (left[a] > common) & (left[b] > common)  # else one of them has ended
        x, y = np.where(go, a + common, x), np.where(go, b + common, y)
    keep = common >= least
    return own[a[keep]], common[keep], pos[a[keep]], pos[b[keep]]


def _with_repeat(chars, at, rows, k):
    n = at[1:][rows] - at[:-1][rows] - k + 1
    owner = np.repeat(np.arange(len(rows)), n)
    begin = np.cumsum(n) - n
    place = at[:-1][rows][owner] + np.arange(len(owner)) - begin[owner]
    if not len(place):
        return rows[:0]
    lo, hi = int(place.min()), int(place.max()) + k
    code = mix(codes(chars[lo:hi], k)[place - lo]) + owner.astype(_U) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(mix(code), kind="stable")
    same = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return rows[np.unique(owner[order][1:][same])]


def adapter_seeds(df: DataFrame, top: int = 10, keep_tail: int = 1) -> DataFrame:
    """(kmer, n): 10-mers that may belong to an adapter, the most frequent first.

    Counted from base 20 on, without the last ``keep_tail`` bases; poor, GC-rich and rare ones are left out.
    """
    counted = staged(kmers(df, 10, first=20, last=keep_tail).select("code", "n"), "seeds")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    often = counted.where((F.col("n") >= 10) & (F.col("n") * 4**10 >= 20 * total)).withColumn("kmer", kmer_name(F.col("code"), 10))
    k = F.col("kmer")
    most = lambda b: F.length(k) - F.length(F.translate(k, b, ""))
    turns = sum((F.substring(k, i, 1) != F.substring(k, i + 1, 1)).cast("int") for i in range(1, 10))
    ok = (k != "A" * 10) & (most("CG") < 8) & ~k.startswith("GGGG") & (turns >= 3)
    for b in "ATCG":
        ok = ok & (most(b) < 6)
    return often.where(ok).orderBy(F.desc("n"), F.desc("code")).limit(top).select("kmer", "n")


def known_adapter_votes(df: DataFrame, adapters: list[str], least: int = 8, per: int = 16) -> DataFrame:
    """(adapter, n, mismatches): reads that hold each known adapter, at its first place with at most one mismatch in ``per``.

    A match keeps one of the adapter's first pieces of 8 intact, so places are looked up by piece and then compared.
    """
    adapters = sorted({a.upper() for a in adapters if a and len(a) > least})

    def vote(batches):
        hits, wrong = np.zeros(len(adapters), np.int64), np.zeros(len(adapters), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, at = flat(batch.column(0))
            size = np.diff(at)
            owner, place = window_starts(at, 8)
            code = codes(chars, 8)[place] if len(place) else np.zeros(0, _U)
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            for n, a in enumerate(adapters):
                text = np.frombuffer(a.encode(), np.uint8)
                who, begin = [], []
                for c in range(0, min(8 * (len(a) // per), len(a) - 8) + 1, 8):
                    piece = codes(text[c : c + 8], 8)[0]
                    hit = order[np.searchsorted(ranked, piece) : np.searchsorted(ranked, piece, "right")]
                    who.append(owner[hit])
                    begin.append(place[hit] - at[owner[hit]] - c)
                o, p = np.concatenate(who), np.concatenate(begin)
                ok = (p >= 0) & (p < size[o] - least) & (len(a) < size[o])
                both = np.unique(o[ok] << 32 | p[ok])
                o, p = both >> 32, both & 0xFFFFFFFF
                if not len(o):
                    continue
                length = np.minimum(size[o] - p, len(a))
                k = np.arange(len(a))
                inside = k < length[:, None]
                bad = ((chars[np.where(inside, (at[o] + p)[:, None] + k, 0)] != text) & inside).sum(axis=1)
                ok = bad <= length // per
                first = np.unique(o[ok], return_index=True)[1]  # the first place of each read
                hits[n] += len(first)
                wrong[n] += bad[ok][first].sum()
        there = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array([adapters[i] for i in there], pa.string()), pa.array(hits[there]), pa.array(wrong[there])], names=["adapter", "n", "mismatches"])

    return spread(df.select("seq")).mapInArrow(vote, "adapter string, n long, mismatches long").groupBy("adapter").agg(F.sum("n").alias("n"), F.sum("mismatches").alias("mismatches"))


def dominant_path(counts: dict[str, int], share: float = 0.95, least: int = 50, longest: int = 60) -> tuple[str, bool]:
    """The path that most texts follow from the start, and whether it ended because too few were left. ``counts``: texts with how often each stands."""
    path, live = "", dict(counts)
    while len(path) < longest:
        by: dict[str, int] = {}
        for t, n in live.items():
            if len(t) > len(path):
                by[t[len(path)]] = by.get(t[len(path)], 0) + n
        total = sum(by.values())
        if total < least:
            return path, True
        base, n = max(by.items(), key=lambda x: (x[1], x[0]))
        if n < share * total:
            return path, False
        path += base
        live = {t: c for t, c in live.items() if len(t) >= len(path) and t[len(path) - 1] == base}
    return path, True


def detect_adapter(df: DataFrame, known: list[str], fewest: int = 10_000) -> str | None:
    """The adapter of a set of reads, or None: the known one with enough votes, else one that is grown from frequent seeds."""
    reads = df.count()
    if reads < fewest:
        return None
    votes = known_adapter_votes(df, known).orderBy(F.desc("n"), "adapter").limit(1).collect()
    if votes and (votes[0]["n"] > reads / 50 or (votes[0]["n"] > reads / 200 and votes[0]["mismatches"] < reads)):
        return votes[0]["adapter"]
    for adapter, leaf in _grown(df, [r["kmer"] for r in adapter_seeds(df).collect()]):
        for k in sorted(known):
            if k and adapter.startswith(k):
                return k
        if leaf:
            return adapter
    return None


def _grown(df: DataFrame, seeds: list[str]) -> list[tuple[str, bool]]:
    """Every seed extended both ways along the path nearly all reads follow, and whether the last way ended for want of reads.

    One pass over the reads counts the distinct contexts of all seeds; the paths then grow side by side over that table, 8 bases a step.
    """
    if not seeds:
        return []
    hits = df.select("seq", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).withColumn("at", F.expr("locate(seed, seq, 21)")).where("at > 0")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("reverse(substring(seq, greatest(1, at - 60), least(60, at - 1)))").alias("t")), F.struct(F.lit(1).alias("side"), F.expr("substring(seq, at + 10, least(60, length(seq) - at - 10))").alias("t"))))
    contexts = staged(hits.select("seed", sides.alias("s")).groupBy("seed", "s.side", "s.t").agg(F.count(F.lit(1)).alias("n")), "contexts")
    path, leaf, live = {(s, k): "" for s in seeds for k in (0, 1)}, {(s, k): True for s in seeds for k in (0, 1)}, {(s, k) for s in seeds for k in (0, 1)}
    while live:
        inside = F.lit(False)
        for s, k in sorted(live):
            inside = inside | ((F.col("seed") == s) & (F.col("side") == k) & F.col("t").startswith(path[s, k]) & (F.length("t") > len(path[s, k])))
        length = len(next(iter(path[x] for x in live)))  # all that are live are equally long
        got: dict[tuple, dict] = {x: {} for x in live}
        for r in contexts.where(inside).groupBy("seed", "side", F.substring("t", length + 1, 8).alias("p")).agg(F.sum("n").alias("n")).collect():  # at most 5^8 a seed and side
            got[r["seed"], r["side"]][r["p"]] = r["n"]
        for x in list(live):
            more, leaf[x] = dominant_path(got[x], longest=8)
            path[x] += more
            if len(more) < 8 or len(path[x]) >= 60:
                live.discard(x)
    return [((path[s, 0][::-1] + s + path[s, 1])[:60], leaf[s, 1]) for s in seeds]
