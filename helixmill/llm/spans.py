"""Long exact spans shared between records, by fixed-block anchors.

Every sequence is cut into reference blocks at multiples of a stride such that any span of ``least``
characters holds exactly one whole block. Every rolling window of every sequence is probed against the
blocks; hits are extended in both directions by comparing the ``least`` long windows around them, and adjoining
shared windows merge into maximal stretches.

Equal sequences are collapsed first: what several records hold as a whole is shared as a whole. Windows meet blocks
in a packed exchange by their hash, whatever the size of the input; nothing is broadcast. A batch settles by itself what it
holds twice and sends one mark for it, so a window that a third of all records hold costs one mark a batch.
No pair of records is ever listed: a window is shared if two of those that hold it differ.

Windows are compared by 128 bits of two polynomial codes, not letter by letter: two different ones among 10^15 would
be taken for equal with a chance of about 10^-9.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.rolling import codes, flat, mix, window_starts
from helixmill.llm.reads import distinct_sequences
from helixmill.operators.exchange import from_planes, packed_exchange, partitions_of, planes, split_by
from helixmill.operators.staging import staged

_U = np.uint64
#: Entries of a batch with one tag from which they count as hits without a block among them; extension then decides exactly.
HOT = 256
_ITEMS, _MARK, _SURE = range(3)


@dataclass(frozen=True)
class SpanOptions:
    """least: shortest span. block: characters of a reference block, at most ``least``."""

    least: int = 60
    block: int = 31

    @property
    def stride(self) -> int:
        return self.least - self.block + 1


def shared_spans(df: DataFrame, opts: SpanOptions = SpanOptions()) -> DataFrame:
    """(read_id, span_start, span_end): maximal stretches whose every position lies in a substring of at least ``least``
    characters that a record with another id holds too. Start counts from 0, end is exclusive.

    ``df``: read_id, seq as from ``reads.normal``. Shorter sequences share nothing; repeated rows of one id count once;
    a repeat inside one record alone isn't shared; an empty table gives an empty result.
    """
    held = staged(distinct_sequences(df, opts.least).withColumn("at", F.monotonically_increasing_id()), "distinct")
    found = _islands(_shared_windows(held, opts), opts)
    whole = df.where(F.length("seq") >= opts.least).join(held.where("many").select("seq"), "seq", "left_semi").distinct()
    return found.unionByName(whole.select("read_id", F.lit(0).alias("span_start"), F.length("seq").cast("int").alias("span_end")))


def shared_share(df: DataFrame, opts: SpanOptions = SpanOptions()) -> DataFrame:
    """(read_id, n_chars, n_shared): for every record how many of its characters other records hold too; 0 where none."""
    spans = shared_spans(df, opts).groupBy("read_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = df.groupBy("read_id").agg(F.max(F.length("seq")).cast("long").alias("n_chars"))
    return sizes.join(spans, "read_id", "left").select("read_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def _groups(tag: np.ndarray, owner: np.ndarray, more=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of their tag, where each group begins, its size, and whether two owners stand in it."""
    order = np.argsort(tag) if more is None else np.lexsort((more, tag))
    tag, owner = tag[order], owner[order]
    new = tag[1:] != tag[:-1] if more is None else (tag[1:] != tag[:-1]) | (more[order][1:] != more[order][:-1])
    begin = np.flatnonzero(np.concatenate([[True], new]))
    return order, begin, np.diff(np.append(begin, len(tag))), np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)


def _sent(n: int, pid, owner, ids, columns, sure, marks):
    """Cells of a batch, of entries with an owner, a small number and hashes: ``sure`` entries go to partitions dealt out by id, ``marks`` (entries whose values they settle) and the other
    entries to their value's partition ``pid``. ``ids``: of the owners, in ascending order."""
    salted = (mix(ids.astype(_U), 5) % _U(n)).astype(np.int64)
    for kind, rows, part in ((_SURE, np.flatnonzero(sure), salted[owner[sure]]), (_ITEMS, np.flatnonzero(~sure), pid[~sure]), (_MARK, np.sort(marks), pid[np.sort(marks)])):
        if not len(rows):
            continue
        order, ends = split_by(part, n)
        rows = rows[order]
        for p in np.unique(part):
            at = rows[ends[p] : ends[p + 1]]
            uses, first = _runs_of(owner[at])
            # ids of one batch stand near each other where they were numbered in order; small numbers are packed, hashes can't be
            small = planes(np.diff(ids[uses])) + planes(np.diff(np.append(first, len(at))).astype(np.uint32)) + planes(columns[0][at])
            packed = pa.compress(small, codec="zstd", asbytes=True)
            head = np.array([kind, len(at), len(uses), ids[uses[0]], len(small), len(packed)], np.int64).tobytes()
            yield int(p), b"".join([head, packed, *(planes(c[at]) for c in columns[1:])])


def _runs_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], first


def _received(blob: bytes, dtypes) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Kind, ids of the entries and columns of a cell."""
    kind, n, uses, first, size, packed = np.frombuffer(blob, np.int64, 6)
    small = pa.decompress(blob[48 : 48 + packed], decompressed_size=size, codec="zstd", asbytes=True)
    ids = first + np.concatenate([[0], np.cumsum(from_planes(small, uses - 1, np.int64))])
    ids = np.repeat(ids, from_planes(small[8 * (uses - 1) :], uses, np.uint32))
    columns, at = [from_planes(small[8 * (uses - 1) + 4 * uses :], n, dtypes[0])], 48 + packed
    for d in dtypes[1:]:
        columns.append(from_planes(blob[at:], n, d))
        at += n * np.dtype(d).itemsize
    return int(kind), ids, columns


def _hits(held: DataFrame, opts: SpanOptions) -> DataFrame:
    """(at, pos): windows and blocks whose hash a window or block of another sequence has, one of them a block."""

    def pack(batch, n):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        by_id = np.argsort(ids, kind="stable")
        ids, batch = ids[by_id], batch.take(pa.array(by_id)) if (np.diff(ids) < 0).any() else batch
        chars, begin = flat(batch.column(1))
        owner, place = window_starts(begin, opts.block)
        if not len(owner):
            return
        pos = (place - begin[:-1][owner]).astype(np.int32)
        use = (pos % opts.stride == 0) | ~batch.column(2).to_numpy(zero_copy_only=False)[owner]  # sequences held twice are shared anyway: their blocks do
        owner, pos, tag = owner[use], pos[use], mix(codes(chars, opts.block)[place[use]])
        order, first, size, differ = _groups(tag, owner)
        settled = differ & (np.logical_or.reduceat((pos % opts.stride == 0)[order], first) | (size > HOT))
        sure = np.zeros(len(tag), bool)
        sure[order] = np.repeat(settled, size)
        pid = ((tag >> _U(40)) % _U(n)).astype(np.int64)
        yield from _sent(n, pid, owner, ids, [pos, tag.astype(np.uint32)], sure, order[first[settled]])

    def reduce(pid, blobs):
        all_ids, all_pos, all_tag, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for blob in blobs:
            kind, ids, (pos, tag) = _received(blob, (np.int32, np.uint32))
            if kind == _SURE:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos)], names=["at", "pos"])
            elif kind == _MARK:
                marks.append(tag)
            else:
                for have, one in ((all_ids, ids), (all_pos, pos), (all_tag, tag)):
                    have.append(one)
        ids, pos, tag, mark = (np.concatenate(x) for x in (all_ids, all_pos, all_tag, marks))
        wanted = np.zeros(1 << 24, bool)
        wanted[tag[pos % opts.stride == 0] >> 8] = True
        wanted[mark >> 8] = True
        near = np.flatnonzero(wanted[tag >> 8])
        if not len(near):
            return
        order, first, size, differ = _groups(tag[near], ids[near])
        settled = np.isin(tag[near][order[first]], mark) | differ & np.logical_or.reduceat((pos[near] % opts.stride == 0)[order], first)
        got = near[order[np.repeat(settled, size)]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(pos[got])], names=["at", "pos"])

    # about 100 windows a sequence, at 5.5 bytes
    return packed_exchange(held.select("at", "seq", "many"), pack, reduce, "at long, pos int", partitions_of(held, 550))


def _shared_windows(held: DataFrame, opts: SpanOptions) -> DataFrame:
    """(rid, start): windows of ``least`` characters of sequences held once that another sequence holds too."""
    places = staged(_hits(held, opts).groupBy("at").agg(F.collect_set("pos").alias("hits")), "places")  # at most one per character of the row
    near = staged(held.join(places, "at").select("rid", "seq", "many", "hits"), "near")

    def pack(batch, n):
        by_id = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
        batch = batch.take(pa.array(by_id))
        ids, many = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        owner, start, u, v = _around(batch.column(1), batch.column(3), opts)
        if not len(owner):
            return
        order, first, size, differ = _groups(u, owner, v)
        sure = np.zeros(len(u), bool)
        sure[order] = np.repeat(differ, size)
        yield from _sent(n, ((u >> _U(40)) % _U(n)).astype(np.int64), owner, ids, [(2 * start + many[owner]).astype(np.uint32), u, v], sure, order[first[differ]])

    def reduce(pid, blobs):
        rows, marks = [], []
        for blob in blobs:
            kind, ids, (start, u, v) = _received(blob, (np.uint32, _U, _U))
            if kind == _SURE:
                yield _starts(ids, start)
            elif kind == _MARK:
                marks.append((np.full(len(u), -1), np.ones(len(u), np.uint32), u, v))  # an owner of its own
            else:
                rows.append((ids, start, u, v))
        if not rows:
            return
        ids, start, u, v = (np.concatenate(x) for x in zip(*rows, *marks))
        order, first, size, differ = _groups(u, ids, v)
        got = order[np.repeat(differ, size)]
        yield _starts(ids[got], start[got])

    return packed_exchange(near, pack, reduce, "rid long, start int", partitions_of(near, 550))


def _starts(ids: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    own = start % 2 == 0
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array((start[own] // 2).astype(np.int32))], names=["rid", "start"])


def _around(seqs: pa.Array, hits: pa.Array, opts: SpanOptions):
    """Owner, start and 128-bit code of every window of ``least`` characters around a hit."""
    chars, at = flat(seqs)
    owner = np.repeat(np.arange(len(seqs)), np.diff(hits.offsets.to_numpy()))
    pos = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    reach = opts.least - opts.block
    start = (pos[:, None] - np.arange(reach + 1)).ravel()
    who = np.repeat(owner, reach + 1)
    ok = (start >= 0) & (start + opts.least <= np.diff(at)[who])
    both = np.unique((who[ok] << 32) | start[ok])
    owner, start = both >> 32, both & 0xFFFFFFFF
    place = at[:-1][owner] + start
    return owner, start, codes(chars, opts.least, 11)[place], codes(chars, opts.least, 12)[place]


def _islands(windows: DataFrame, opts: SpanOptions) -> DataFrame:
    """Adjoining or overlapping windows merged, per record. A record's starts are at most as many as its characters."""
    per = windows.groupBy("rid").agg(F.sort_array(F.collect_set("start")).alias("s"))
    breaks = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == F.size("s")) | (F.element_at("s", (i + 1).cast("int")) > F.element_at("s", i.cast("int")) + opts.least))
    cut = per.select("rid", "s", breaks.alias("e")).select("rid", "s", F.posexplode("e").alias("n", "last"), F.col("e"))
    first = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.element_at("e", F.greatest(F.col("n"), F.lit(1))) + 1)
    return cut.select(F.col("rid").alias("read_id"), F.element_at("s", first).alias("span_start"), (F.element_at("s", F.col("last")) + opts.least).cast("int").alias("span_end"))
