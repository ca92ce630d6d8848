"""Steps between the raw and the clean read, fused into one Arrow kernel for single reads and one for pairs.

What plain expressions can do (index filter, name fixes, UMIs) happens before, inside code generation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import expressions as E
from helixmill.functions.kernels import Reads, adapter_at, correct, overlap, overlap_one_gap, poly_g_end, poly_x_end, quality_cut, reverse_complement, strings
from helixmill.operators.staging import spread
from helixmill.plans.options import Options

SINGLE = "read_id long, name string, seq string, strand string, qual string, verdict int, adapter string, poly_base string, poly_len int, dup boolean"
PAIR = (
    "read_id long, name1 string, seq1 string, qual1 string, name2 string, seq2 string, qual2 string, verdict1 int, verdict2 int, overlapped boolean, offset int, overlap_len int, diff int, has_gap boolean, "
    "insert_size int, adapter1 string, adapter2 string, poly_base1 string, poly_len1 int, poly_base2 string, poly_len2 int, corrected1 int, corrected2 int, merged_seq string, merged_qual string, merged_name string, merged_verdict int, overlapped_seq string, overlapped_qual string, corrections array<string>, dup boolean"
)


def shifted(r: Reads, start: np.ndarray, end: np.ndarray) -> Reads:
    """The slices [start, end) of the rows, moved to the front."""
    out = object.__new__(Reads)
    out.size = np.maximum(end - start, 0)
    j = np.arange(r.data.shape[1])
    out.data = np.where(j < out.size[:, None], np.take_along_axis(r.data, (j + start[:, None]).clip(0, max(0, r.data.shape[1] - 1)), axis=1) if r.data.shape[1] else r.data, 0)
    return out


def verdicts(seq: Reads, qual: Reads, there: np.ndarray, o: Options) -> np.ndarray:
    """Result codes, as ``expressions.verdict``."""
    n = seq.size
    out = np.full(len(n), E.PASS)
    todo = np.ones(len(n), bool)

    def rule(bad, code):
        nonlocal todo
        out[todo & bad] = code
        todo = todo & ~bad

    rule(~there | (n == 0), E.LENGTH)
    inside = np.arange(qual.data.shape[1]) < n[:, None]
    if o.quality_filter:
        rule(((qual.data < 33 + o.qualified) & inside).sum(axis=1) * 100 > o.unqualified_percent * n, E.QUALITY)
        if o.average_quality > 0:
            total = np.where(inside, qual.data.astype(np.int64) - 33, 0).sum(axis=1)
            rule(total // np.maximum(n, 1) < o.average_quality, E.QUALITY)
        rule((seq.data == ord("N")).sum(axis=1) > o.n_limit, E.N_BASE)
    if o.length_filter:
        rule(n < o.shortest, E.LENGTH)
        if o.longest > 0:
            rule(n > o.longest, E.TOO_LONG)
    if o.complexity_filter:
        steps = ((seq.data[:, 1:] != seq.data[:, :-1]) & (np.arange(max(0, seq.data.shape[1] - 1)) < (n - 1)[:, None])).sum(axis=1)
        rule(~((n > 1) & (steps * 100 >= o.complexity * (n - 1))), E.COMPLEXITY)
    return out


class Mate:
    """One mate of a batch on its way through the steps."""

    def __init__(self, seq, qual):
        self.seq, self.qual = Reads(seq), Reads(qual)
        n = len(self.seq)
        self.there = np.ones(n, bool)
        self.front = np.zeros(n, np.int64)
        self.adapter = np.full(n, None, object)
        self.poly_base, self.poly_len = np.full(n, None, object), np.zeros(n, np.int64)

    def keep(self, start, end, rows=None):
        if rows is not None:
            start, end = np.where(rows, start, 0), np.where(rows, end, self.seq.size)
        self.seq, self.qual = shifted(self.seq, start, end), shifted(self.qual, start, end)

    def truncate(self, end, rows):
        """Rows cut to their first ``end`` characters, in place; only those that change are touched."""
        hit = np.flatnonzero(rows & (end < self.seq.size))
        if len(hit):
            gone = np.arange(self.seq.data.shape[1]) >= end[hit][:, None]
            for r in (self.seq, self.qual):
                part = r.data[hit]
                part[gone[:, : part.shape[1]]] = 0
                r.data[hit] = part
                r.size = r.size.copy()
                r.size[hit] = end[hit]

    def trim(self, front: int, tail: int, o: Options):
        cut = lambda c: (c.window, c.mean) if c else None
        kept, start, end = quality_cut(self.seq, self.qual, front, tail, cut(o.cut_front), cut(o.cut_tail), cut(o.cut_right))
        self.there &= kept
        self.front = np.where(kept, start, 0)
        self.keep(np.where(kept, start, 0), np.where(kept, end, 0))

    def poly_g(self, least: int, rows):
        self.truncate(poly_g_end(self.seq, least), rows)

    def poly_x(self, least: int, rows):
        end, base = poly_x_end(self.seq, least)
        hit = rows & (base >= 0)
        self.poly_base[hit] = np.array(list("ATCG"), object)[base[hit]]
        self.poly_len[hit] = (self.seq.size - end)[hit]
        self.truncate(end, hit)

    def cut_adapter(self, adapter: str, least: int, gaps: bool, rows) -> None:
        at = adapter_at(self.seq, adapter, least, gaps)
        hit = np.flatnonzero(rows & (at < self.seq.size))
        if not len(hit):
            return
        gone = strings(self.seq.data[hit], np.maximum(at[hit], 0), self.seq.size[hit]).to_pylist()
        for i, text in zip(hit, gone):
            piece = adapter[: len(adapter) + at[i]] if at[i] < 0 else text
            self.adapter[i] = piece if self.adapter[i] is None else piece + self.adapter[i]
        self.truncate(np.maximum(at, 0), rows)

    def cut_list(self, adapters: tuple[str, ...], gaps: bool, rows) -> None:
        least = 4 if len(adapters) <= 16 else 5 if len(adapters) <= 256 else 6
        for a in adapters:
            self.cut_adapter(a, least, gaps, rows)

    def limit(self, most: int):
        if most > 0:
            self.truncate(np.minimum(self.seq.size, most), np.ones(len(self.seq), bool))

    def text(self):
        z = np.zeros(len(self.seq), np.int64)
        return strings(self.seq.data, z, self.seq.size), strings(self.qual.data, z, self.qual.size)


def clean_single(df: DataFrame, o: Options) -> DataFrame:
    """Single reads (read_id, name, seq, strand, qual) through trimming, adapters, tails and filters; every read comes out with its verdict."""
    adapter = "" if o.adapter1 == "auto" else o.adapter1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = Mate(b.column("seq"), b.column("qual"))
            m.trim(o.front1, o.tail1, o)
            if o.poly_g:
                m.poly_g(o.poly_g_min, m.there)
            if o.adapter_trimming:
                if adapter:
                    m.cut_adapter(adapter, 4, o.gapped_adapters, m.there)
                m.cut_list(o.adapter_list, o.gapped_adapters, m.there)
            dimer = m.there & (m.adapter != None) & (m.seq.size <= o.dimer_max_len)  # noqa: E711
            if o.poly_x:
                m.poly_x(o.poly_x_min, m.there)
            m.limit(o.max_len1)
            v = np.where(dimer, E.ADAPTER_DIMER, verdicts(m.seq, m.qual, m.there, o))
            seq, qual = m.text()
            yield pa.RecordBatch.from_arrays(
                [b.column("read_id"), b.column("name"), seq, b.column("strand"), qual, pa.array(v.astype(np.int32)), pa.array(m.adapter.tolist(), pa.string()), pa.array(m.poly_base.tolist(), pa.string()), pa.array(m.poly_len.astype(np.int32)), b.column("dup")],
                names=[c.split()[0] for c in SINGLE.split(", ")],
            )

    return spread(_with_dup(df, "read_id", "name", "seq", "strand", "qual")).mapInArrow(run, SINGLE)


def clean_pairs(df: DataFrame, o: Options) -> DataFrame:
    """Pairs (read_id, name1, seq1, qual1, name2, seq2, qual2) through all steps; every pair comes out once with both verdicts.

    If a mate vanishes in trimming, the pair skips the steps in between and is judged. Adapters by overlap come first, by sequence otherwise.
    """
    auto = lambda a: "" if a == "auto" else a
    names = [c.split()[0] for c in PAIR.split(", ")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = Mate(b.column("seq1"), b.column("qual1")), Mate(b.column("seq2"), b.column("qual2"))
            n = len(x.seq)
            x.trim(o.front1, o.tail1, o)
            y.trim(o.front2 or 0, o.tail2 or 0, o)
            both = x.there & y.there
            if o.poly_g:
                x.poly_g(o.poly_g_min, both)
                y.poly_g(o.poly_g_min, both)
            found, offset, length, diff = overlap(x.seq, y.seq, o.overlap_least, o.overlap_diff, o.overlap_diff_percent / 100)
            found &= both
            gap = np.zeros(n, bool)
            if o.allow_gap_overlap:
                rows = np.flatnonzero(both & ~found)
                more = overlap_one_gap(x.seq, y.seq, rows, o.overlap_least, o.overlap_diff, o.overlap_diff_percent / 100)
                found[rows], offset[rows], length[rows], diff[rows] = more
                gap[rows] = more[0]
            l1, l2 = x.seq.size.copy(), y.seq.size.copy()
            insert = np.where(found, np.where(offset > 0, l1 + l2 - length, length) + x.front + y.front, 512).clip(0, 512)
            insert[~both] = -1
            fixed, changes, ends = [np.zeros(n, np.int64), np.zeros(n, np.int64)], [], np.zeros(n + 1, np.int64)
            if o.correction:
                row, mate, old, new = correct(x.seq, x.qual, y.seq, y.qual, found & ~gap, offset, length, diff)
                by_row = np.argsort(row, kind="stable")
                changes = [chr(old[i]) + chr(new[i]) for i in by_row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                for k in (1, 2):
                    fixed[k - 1] += np.bincount(row[mate == k], minlength=n)
            if o.adapter_trimming:
                by = found & (offset < 0)
                for m, other, size in ((x, y, l1), (y, x, l2)):
                    end = np.where(by, np.minimum(size, length + other.front), size)
                    gone = strings(m.seq.data, end, size).to_pylist()
                    hit = by & (end < size)
                    m.adapter[hit] = np.array(gone, object)[hit]
                    m.truncate(end, by)
                rest = both & ~by
                for m, a in ((x, auto(o.adapter1)), (y, auto(o.adapter2))):
                    if a:
                        m.cut_adapter(a, 4, o.gapped_adapters, rest)
                    m.cut_list(o.adapter_list, o.gapped_adapters, both)
            dimer = both & ((x.adapter != None) | (y.adapter != None)) & (x.seq.size <= o.dimer_max_len) & (y.seq.size <= o.dimer_max_len)  # noqa: E711
            exact, eo, el, _ = overlap(x.seq, y.seq, o.overlap_least, o.overlap_diff, 0.0)
            start = np.where(exact, np.maximum(eo, 0), 0)
            common = strings(x.seq.data, start, np.where(exact, start + el, start)), strings(x.qual.data, start, np.where(exact, start + el, start))
            if o.poly_x:
                x.poly_x(o.poly_x_min, both)
                y.poly_x(o.poly_x_min, both)
            x.limit(o.max_len1)
            y.limit(o.max_len2 or 0)
            v1, v2 = verdicts(x.seq, x.qual, x.there, o), verdicts(y.seq, y.qual, y.there, o)
            merged = _merge(x, y, o, b.column("name1")) if o.merge else None
            (s1, q1), (s2, q2) = x.text(), y.text()
            v1, v2 = np.where(dimer, E.ADAPTER_DIMER, v1), np.where(dimer, E.ADAPTER_DIMER, v2)
            none = pa.nulls(n, pa.string())
            ms, mq, mn, mv = merged or (none, none, none, pa.nulls(n, pa.int32()))
            i32 = lambda a: pa.array(np.asarray(a).astype(np.int32))
            blank = pa.array(~(exact & both))
            cols = [b.column("read_id"), b.column("name1"), s1, q1, b.column("name2"), s2, q2, i32(v1), i32(v2), pa.array(found), i32(offset), i32(length), i32(diff), pa.array(gap), i32(insert)]
            cols += [pa.array(x.adapter.tolist(), pa.string()), pa.array(y.adapter.tolist(), pa.string()), pa.array(x.poly_base.tolist(), pa.string()), i32(x.poly_len), pa.array(y.poly_base.tolist(), pa.string()), i32(y.poly_len)]
            cols += [i32(fixed[0]), i32(fixed[1]), ms, mq, mn, mv, _blank(common[0], blank), _blank(common[1], blank)]
            cols += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(changes, pa.string())), b.column("dup")]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(_with_dup(df, "read_id", "name1", "seq1", "qual1", "name2", "seq2", "qual2")).mapInArrow(run, PAIR)


def _with_dup(df: DataFrame, *columns: str) -> DataFrame:
    """The columns a kernel reads, with ``dup`` carried along where there is one."""
    return df.select(*columns, "dup" if "dup" in df.columns else F.lit(False).alias("dup"))


def correction_matrix(judged: DataFrame) -> DataFrame:
    """(old_base, new_base, n): how often a base was corrected into another one, of pairs as ``clean_pairs`` gives them."""
    one = judged.select(F.explode("corrections").alias("c"))
    return one.groupBy(F.substring("c", 1, 1).alias("old_base"), F.substring("c", 2, 1).alias("new_base")).agg(F.count(F.lit(1)).alias("n"))


def _blank(column: pa.Array, where: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(where, pa.scalar(None, pa.string()), column)


def _merge(x: Mate, y: Mate, o: Options, names):
    """Overlapping pairs as one read; others null."""
    found, offset, length, _ = overlap(x.seq, y.seq, o.overlap_least, o.overlap_diff, o.overlap_diff_percent / 100)
    found &= x.there & y.there
    n1 = length + np.maximum(offset, 0)
    n2 = np.where(offset > 0, y.seq.size - length, 0)
    rc, rq = reverse_complement(y.seq), y.qual.from_tail()
    z = np.zeros(len(x.seq), np.int64)
    head, hq = strings(x.seq.data, z, np.where(found, n1, 0)).to_pylist(), strings(x.qual.data, z, np.where(found, n1, 0)).to_pylist()
    rest, tq = strings(rc.data, length, np.where(found, length + n2, length)).to_pylist(), strings(rq, length, np.where(found, length + n2, length)).to_pylist()
    seq = [a + b if f else None for a, b, f in zip(head, rest, found)]
    qual = [a + b if f else None for a, b, f in zip(hq, tq, found)]
    name = [f"{m} merged_{a}_{b}" if f else None for m, a, b, f in zip(names.to_pylist(), n1, n2, found)]
    v = verdicts(Reads([s or "" for s in seq]), Reads([q or "" for q in qual]), found, o)
    return pa.array(seq, pa.string()), pa.array(qual, pa.string()), pa.array(name, pa.string()), pa.array([int(c) if f else None for c, f in zip(v, found)], pa.int32())


def index_filter(df: DataFrame, column: str, barcodes: list[str], threshold: int = 0, which: str = "first") -> DataFrame:
    """Reads whose index isn't within ``threshold`` differences of a barcode of the same length; reads without an index stay.

    The list is the user's own blacklist; it travels with the function.
    """
    if not barcodes:
        return df
    by_size: dict[int, np.ndarray] = {}
    for n in {len(b) for b in barcodes if b}:
        by_size[n] = np.array([list(b.encode()) for b in sorted({b for b in barcodes if len(b) == n})], np.uint8)

    @F.pandas_udf("boolean")
    def listed(index: pd.Series) -> pd.Series:
        r = Reads(index.fillna("").tolist())
        hit = np.zeros(len(r), bool)
        for n, bars in by_size.items():
            rows = np.flatnonzero(r.size == n)
            for b in bars:
                hit[rows] |= (r.data[rows, :n] != b).sum(axis=1) <= threshold
        return pd.Series(hit)

    return df.where(~listed(E.first_index(column) if which == "first" else E.last_index(column)))


def move_umi(df: DataFrame, loc: str, length: int = 0, skip: int = 0, prefix: str = "", delimiter: str = ":") -> DataFrame:
    """UMIs of single reads moved into the name; bases of the read leave at least one behind."""
    if loc in ("index1", "per_index"):
        return df.withColumn("name", E.tag_name("name", E.first_index("name"), delimiter, prefix))
    umi = F.substring("seq", 1, length)
    gone = F.least(F.lit(length + skip), F.length("seq") - 1)
    rest = lambda c: F.when(gone > 0, F.substring(F.col(c), (gone + 1).cast("int"), F.length(c))).otherwise(F.col(c))
    return df.select(*[c for c in df.columns if c not in ("name", "seq", "qual")], E.tag_name("name", umi, delimiter, prefix).alias("name"), rest("seq").alias("seq"), rest("qual").alias("qual"))


def move_umi_pairs(df: DataFrame, loc: str, length: int = 0, skip: int = 0, prefix: str = "", delimiter: str = ":") -> DataFrame:
    """UMIs of pairs; both mates get the same tag."""
    gone = lambda s: F.least(F.lit(length + skip), F.length(s) - 1)
    rest = lambda c, s: F.when(gone(s) > 0, F.substring(F.col(c), (gone(s) + 1).cast("int"), F.length(c))).otherwise(F.col(c))
    first, last = E.first_index("name1"), E.last_index("name2")
    umi = {
        "index1": first, "index2": last, "per_index": F.concat_ws("_", first, last), "read1": F.substring("seq1", 1, length), "read2": F.substring("seq2", 1, length),
        "per_read": F.concat_ws("_", F.substring("seq1", 1, length), F.substring("seq2", 1, length)),
    }[loc]
    cols = {"name1": E.tag_name("name1", umi, delimiter, prefix), "name2": E.tag_name("name2", umi, delimiter, prefix)}
    for m in ("1", "2"):
        if loc in ("per_read", f"read{m}"):
            cols |= {f"seq{m}": rest(f"seq{m}", f"seq{m}"), f"qual{m}": rest(f"qual{m}", f"seq{m}")}
    return df.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in df.columns])


def trimmed(df: DataFrame, how) -> DataFrame:
    """(read_id, seq, qual) of reads that a cut leaves; ``how``: (seq, qual) -> (kept, start, end)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s, q = Reads(b.column(1)), Reads(b.column(2))
            kept, start, end = how(s, q)
            rows = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), strings(s.data, start, end).take(rows), strings(q.data, start, end).take(rows)], names=["read_id", "seq", "qual"])

    return df.select("read_id", "seq", "qual").mapInArrow(run, "read_id long, seq string, qual string")


def merge_ends(df: DataFrame, least: int = 30) -> DataFrame:
    """(read_id, name, seq, qual) of the pairs that the simple merge joins; the name tells offset and overlap."""
    from helixmill.functions.kernels import merge_exact_ends

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r1, q1, r2, q2 = (Reads(b.column(c)) for c in ("seq1", "qual1", "seq2", "qual2"))
            done, size, seqs, quals = merge_exact_ends(r1, q1, r2, q2, least)
            rows = np.flatnonzero(done)
            names = b.column("name").to_pylist()
            name = [f"{names[i]} merged offset:{r1.size[i] - size[i]} overlap:{size[i]}" for i in rows]
            yield pa.RecordBatch.from_arrays([b.column("read_id").take(pa.array(rows)), pa.array(name, pa.string()), pa.array([seqs[i] for i in rows], pa.string()), pa.array([quals[i] for i in rows], pa.string())], names=["read_id", "name", "seq", "qual"])

    return spread(df.select("read_id", "name", "seq1", "qual1", "seq2", "qual2")).mapInArrow(run, "read_id long, name string, seq string, qual string")
