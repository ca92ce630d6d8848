"""Near-duplicate records with small edits: HyperMinHash registers, banding, corrected estimates, exact check.

Equal sequences are collapsed first. Every distinct sequence gets a HyperMinHash sketch of its k-character
substrings; bands of compressed registers are exchanged as packed blocks, and sequences that agree in ``AGREE``
bands are candidates: one agreement alone is mostly a shared adapter or tail. A band value held by more than ``HOT`` sequences isn't expanded into pairs: its holders go
through another pass with new hash functions and longer bands, which parts those that only share common
pieces. What is still together after the last pass is alike, and is compared in salted block pairs.

No join here is broadcast, as every side grows with the data; the exchange has as many partitions as the
number of sequences asks for, so that a task reads about as much whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.rolling import codes, flat, mix, window_starts
from helixmill.llm.reads import distinct_sequences
from helixmill.llm.sketch import band_keys, estimate, registers
from helixmill.operators.exchange import from_planes, packed_exchange, partitions_of, planes, split_by
from helixmill.operators.staging import staged

_U = np.uint64
#: Holders of one band value beyond which a pass hands them to the next one. A pass makes at most HOT/2 candidate pairs per band entry.
HOT = 48
#: Bands in which a pair must agree.
AGREE = 2
#: Rows per block in the last resort for groups that no pass could part.
BLOCK = 256


@dataclass(frozen=True)
class NearDupOptions:
    """k: characters of a substring. threshold: least Jaccard similarity. least: shortest sequence that takes part.

    miss: chance to miss a pair exactly at the threshold in a pass; it sets the number of bands.
    slack: how far below the threshold an estimate may lie and still be verified.
    """

    k: int = 8
    threshold: float = 0.5
    least: int = 30
    rows: int = 3
    miss: float = 0.015
    buckets: int = 24
    slack: float = 0.22
    passes: int = 3

    def bands(self, rows: int) -> int:
        """Bands for bands of so many registers, rounded up so that the registers fill whole groups of buckets."""
        one = self.threshold**rows
        missed = lambda n: (1 - one) ** n + n * one * (1 - one) ** (n - 1)  # noqa: E731  (agrees in none or in one)
        need = 1
        while missed(need) > self.miss or need * rows % self.buckets:
            need += 1
        return need


def similar_pairs(df: DataFrame, opts: NearDupOptions = NearDupOptions()) -> DataFrame:
    """(read_id_a, read_id_b, jaccard), a < b, of distinct sequences at least ``threshold`` similar.

    ``df``: read_id, seq as from ``reads.normal``. Each distinct sequence stands for the smallest id that holds it.
    Rows with null or empty seq were left out there; sequences under ``least`` characters have no pair;
    repeated rows and ties change nothing; an empty table gives an empty result. Candidates are verified on the whole sequences.
    The number of partitions changes nothing.
    """
    return pairs_of_distinct(_held(df, opts), opts)


def _held(df: DataFrame, opts: NearDupOptions) -> DataFrame:
    return staged(distinct_sequences(df, max(opts.least, opts.k)).select("rid", "seq"), "distinct")


def pairs_of_distinct(held: DataFrame, opts: NearDupOptions) -> DataFrame:
    found, settled, now = [], None, held
    for turn in range(opts.passes):
        got = staged(_band_pass(now, opts, opts.rows + turn, turn), "bands")
        found.append(got.where("not hot").select("a", "b", "n"))
        hot = got.where("hot").select(F.col("a").alias("rid")).distinct()
        if not got.where("hot").limit(1).count():
            break
        if turn + 1 < opts.passes:
            now = staged(held.join(staged(hot, "hot").hint("merge"), "rid", "left_semi"), "again")
        else:
            settled = staged(_block_pairs(got.where("hot").select("key", F.col("a").alias("rid")).distinct(), held, opts), "settled")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = staged(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= AGREE).select("a", "b"), "pairs")
    checked = staged(_verified(pairs, held, opts), "checked")
    # a pair may come out of several band values
    return checked if settled is None else checked.unionByName(settled).groupBy("read_id_a", "read_id_b").agg(F.max("jaccard").alias("jaccard"))


def _band_pass(held: DataFrame, opts: NearDupOptions, rows: int, turn: int) -> DataFrame:
    """Rows (hot, key, a, b, n): candidate pairs with the number of bands they agree in, or with hot the members a of a band value
    that too many hold. A value that more than HOT rows of one batch hold moves as one mark; its members are dealt out by their ids."""
    bands = opts.bands(rows)
    groups = bands * rows // opts.buckets
    n = partitions_of(held, 6 * bands)

    def pack(batch, n):
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        by_id = np.argsort(rid, kind="stable")
        batch, rid = batch.take(pa.array(by_id)), rid[by_id]
        reg, _ = registers(*flat(batch.column(1)), opts.k, groups, opts.buckets, turn)
        key = band_keys(reg, bands, rows, turn).ravel()
        pid = ((key >> _U(40)) % _U(n)).astype(np.int64)
        tag = (key & _U(0xFFFFFFFF)).astype(np.uint32)
        own = np.repeat(np.arange(len(rid)), bands)
        many = _held_often(key)
        if many.any():
            value = (pid[many] << 32) | tag[many]
            for v in np.unique(value):
                yield int(v >> 32), np.array([_MARK, v & 0xFFFFFFFF, 0], np.int64).tobytes()
            ids = rid[own[many]]
            salted = (mix(ids.astype(_U), 5) % _U(n)).astype(np.int64)
            order, ends = split_by(salted, n)
            for p in np.unique(salted):
                at = order[ends[p] : ends[p + 1]]
                yield int(p), np.array([_MEMBERS, len(at), 0], np.int64).tobytes() + planes(value[at]) + planes(ids[at])
            pid, tag, own = pid[~many], tag[~many], own[~many]
        order, ends = split_by(pid, n)
        tag, own = tag[order], own[order]
        for p in np.unique(pid):
            lo, hi = ends[p], ends[p + 1]
            uses = np.unique(own[lo:hi])
            head = np.array([_ITEMS, len(uses), hi - lo], np.int64).tobytes()
            # 4 bytes of the tag and the number of its read in this cell
            yield int(p), head + planes(np.diff(rid[uses], prepend=0)) + tag[lo:hi].tobytes() + planes(np.searchsorted(uses, own[lo:hi]).astype(np.uint32))

    def reduce(pid, blobs):
        tags, owners, marks = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for blob in blobs:
            kind, x, y = np.frombuffer(blob, np.int64, 3)
            if kind == _MARK:
                marks.append(x)
            elif kind == _MEMBERS:
                ids = from_planes(blob[24 + 8 * x :], x, np.int64)
                yield _batch(True, from_planes(blob[24:], x, np.int64), ids, ids, np.zeros(x, np.int32))
            else:
                ids, place = np.cumsum(from_planes(blob[24:], x, np.int64)), 24 + 8 * x
                tags.append(np.frombuffer(blob, np.uint32, y, place))
                owners.append(ids[from_planes(blob[place + 4 * y :], y, np.uint32)])
        yield from _runs(pid, np.concatenate(tags), np.concatenate(owners), np.array(sorted(set(marks)), np.uint32))

    return packed_exchange(held, pack, reduce, "hot boolean, key long, a long, b long, n int", n)


_ITEMS, _MARK, _MEMBERS = range(3)


def _held_often(key: np.ndarray) -> np.ndarray:
    """Which entries have a key that more than HOT entries have."""
    slot = (key >> _U(20)) & _U((1 << 20) - 1)
    often = np.bincount(slot.astype(np.int64), minlength=1 << 20) > HOT
    some = np.flatnonzero(often[slot.astype(np.int64)])
    out = np.zeros(len(key), bool)
    if len(some):
        _, which, count = np.unique(key[some], return_inverse=True, return_counts=True)
        out[some[count[which] > HOT]] = True
    return out


def _runs(pid: int, tag: np.ndarray, owner: np.ndarray, marks: np.ndarray):
    """Candidates among items of equal tag, in batches; marked tags are hot whatever their number."""
    if not len(tag):
        return
    order = np.argsort(tag, kind="stable")
    tag, owner = tag[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    size = np.diff(np.append(begin, len(tag)))
    hot = (size > HOT) | np.isin(tag[begin], marks)
    for s in np.unique(size[(size > 1) & ~hot]):
        group = np.sort(owner[begin[(size == s) & ~hot][:, None] + np.arange(s)], axis=1)
        i, j = np.triu_indices(s, 1)
        step = max(1, 200_000 // len(i))
        for lo in range(0, len(group), step):
            a, b = group[lo : lo + step][:, i].ravel(), group[lo : lo + step][:, j].ravel()
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            times = np.diff(np.append(head, len(a))).astype(np.int32)  # the groups are of different bands: every one counts
            head, times = head[a[head] != b[head]], times[a[head] != b[head]]
            yield _batch(False, np.zeros(len(head), np.int64), a[head], b[head], times)
    for k in np.flatnonzero(hot):
        members = owner[begin[k] : begin[k] + size[k]]
        for lo in range(0, len(members), 200_000):
            some = members[lo : lo + 200_000]
            yield _batch(True, np.full(len(some), (pid << 32) | int(tag[begin[k]]), np.int64), some, some, np.zeros(len(some), np.int32))


def _batch(hot: bool, key, a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(key), pa.array(a), pa.array(b), pa.array(n)], names=["hot", "key", "a", "b", "n"])


def _block_pairs(members: DataFrame, held: DataFrame, opts: NearDupOptions) -> DataFrame:
    """Similar pairs within band values that no pass could part: members are dealt into blocks of about BLOCK, every two blocks of a
    value meet in one task of their own, and are checked exactly there. Members of such a value share nearly all of their long
    bands, so that most of what is compared is a pair of the result."""
    sizes = members.groupBy("key").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).select("key", "blocks")
    dealt = members.join(staged(sizes, "sizes").hint("merge"), "key").withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = dealt.select("key", "rid", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", "rid", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine")

    def compare(frame):
        import pandas as pd

        rid, mine, two = frame["rid"].to_numpy(), frame["mine"].to_numpy(), frame["x"].iloc[0] != frame["y"].iloc[0]
        near = _all_jaccards(pa.array(frame["seq"]), opts.k)
        i, j = np.nonzero((near >= opts.threshold) & (rid[:, None] < rid) & ((mine[:, None] != mine) | (not two)))
        return pd.DataFrame({"read_id_a": rid[i], "read_id_b": rid[j], "jaccard": near[i, j]})

    return met.join(held.hint("merge"), "rid").groupBy("key", "x", "y").applyInPandas(compare, "read_id_a long, read_id_b long, jaccard double")


def _verified(pairs: DataFrame, held: DataFrame, opts: NearDupOptions) -> DataFrame:
    """Pairs whose whole substring sets are similar enough; the corrected estimate spares the exact count for most others."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids")
    # the sides grow with the data: shuffled, whatever their size
    texts = staged(held.join(ids.hint("merge"), "rid"), "texts")
    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("seq").alias("sa")).hint("merge"), "a")
    both = left.join(texts.select(F.col("rid").alias("b"), F.col("seq").alias("sb")).hint("merge"), "b")

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (ca, oa), (cb, ob) = flat(batch.column(2)), flat(batch.column(3))
            ra, fa = registers(ca, oa, opts.k, 4, opts.buckets, 91)
            rb, fb = registers(cb, ob, opts.k, 4, opts.buckets, 91)
            na, nb = np.diff(oa) - opts.k + 1, np.diff(ob) - opts.k + 1
            likely = estimate(ra, rb, fa, fb, na, nb, opts.buckets) >= opts.threshold - opts.slack
            near = np.flatnonzero(likely | (np.minimum(na, nb) < 2 * opts.buckets))  # few items: the estimate is too coarse
            exact = _jaccard(ca, oa, cb, ob, near, opts.k)
            keep = exact >= opts.threshold
            rows = pa.array(near[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(exact[keep])], names=["read_id_a", "read_id_b", "jaccard"])

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "read_id_a long, read_id_b long, jaccard double")


def _all_jaccards(seqs: pa.Array, k: int) -> np.ndarray:
    """Exact Jaccard similarities of the substring sets of a few texts, as products of their membership matrices."""
    chars, at = flat(seqs)
    owner, place = window_starts(at, k)
    _, gram = np.unique(codes(chars, k)[place] if len(place) else np.zeros(0, _U), return_inverse=True)
    held = np.unique(gram.astype(np.int64) * len(seqs) + owner)  # in order of the substring
    gram, owner = held // len(seqs), held % len(seqs)
    size = np.bincount(owner, minlength=len(seqs)).astype(float)
    shared = np.bincount(gram) > 1
    number = np.cumsum(shared) - 1
    gram, owner = number[gram[shared[gram]]], owner[shared[gram]]
    common = np.zeros((len(seqs), len(seqs)), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(gram, [lo, lo + 4096])
        there = np.zeros((len(seqs), 4096), np.float32)
        there[owner[a:b], gram[a:b] - lo] = 1
        common += there @ there.T
    return common / np.maximum(size[:, None] + size - common, 1)


def _jaccard(ca, oa, cb, ob, rows: np.ndarray, k: int) -> np.ndarray:
    """Exact Jaccard similarity of the substring sets of the pairs ``rows``."""
    out = np.zeros(len(rows))
    (wa, pa_), (wb, pb_) = window_starts(oa, k), window_starts(ob, k)
    ha, hb = codes(ca, k)[pa_] if len(pa_) else np.zeros(0, _U), codes(cb, k)[pb_] if len(pb_) else np.zeros(0, _U)
    ea, eb = np.searchsorted(wa, np.arange(len(oa))), np.searchsorted(wb, np.arange(len(ob)))
    for n, i in enumerate(rows):
        a, b = np.unique(ha[ea[i] : ea[i + 1]]), np.unique(hb[eb[i] : eb[i + 1]])
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        out[n] = common / max(1, len(a) + len(b) - common)
    return out


def membership(df: DataFrame, opts: NearDupOptions = NearDupOptions()) -> DataFrame:
    """(read_id, rep_id): which distinct sequence's smallest id stands for each read long enough to take part."""
    long = df.where(F.length("seq") >= max(opts.least, opts.k)).distinct()
    reps = distinct_sequences(long, max(opts.least, opts.k)).where("many").select("seq", F.col("rid").alias("rep_id"))
    return long.join(reps, "seq", "left").select("read_id", F.coalesce("rep_id", "read_id").alias("rep_id"))


def groups(df: DataFrame, opts: NearDupOptions = NearDupOptions()) -> DataFrame:
    """(read_id, rep_id, group_id, links): for every read long enough to take part the id that stands for its sequence, the smallest id of
    those reached over similar pairs, and how many other distinct sequences are similar to its own. A read like no other is its own group."""
    pairs = staged(pairs_of_distinct(_held(df, opts), opts).select("read_id_a", "read_id_b"), "similar")
    ends = pairs.select(F.explode(F.array("read_id_a", "read_id_b")).alias("rep_id")).groupBy("rep_id").agg(F.count(F.lit(1)).alias("links"))
    roots = connected(pairs.select(F.col("read_id_a").alias("u"), F.col("read_id_b").alias("v"))).select(F.col("u").alias("rep_id"), F.col("v").alias("group_id"))
    return membership(df, opts).join(ends, "rep_id", "left").join(roots, "rep_id", "left").select("read_id", "rep_id", F.coalesce("group_id", "rep_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): every id that has an edge and isn't the smallest of its component, with that smallest id.

    Rounds of two steps over tables: every id points its larger neighbours to its smallest one, then its smaller neighbours. They
    end when a round changes nothing, after about the logarithm of a component's width.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = staged(small.where("u <> v").distinct(), "small")
        if (is_ := mark(now)) == was:
            return now
        was = is_
