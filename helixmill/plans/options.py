"""Settings of the read pipeline, checked once before a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass


class OptionError(ValueError):
    """A setting that makes no sense, alone or with the others."""


@dataclass(frozen=True)
class Cut:
    window: int = 4
    mean: int = 20


@dataclass(frozen=True)
class Umi:
    """loc: index1, index2, read1, read2, per_index or per_read."""

    loc: str = "read1"
    length: int = 0
    skip: int = 0
    prefix: str = ""
    delimiter: str = ":"


@dataclass(frozen=True)
class Options:
    paired: bool = False
    # input and output
    phred64: bool = False
    fix_mgi_id: bool = False
    reads_to_process: int = 0
    interleaved: bool = False
    merge: bool = False
    include_unmerged: bool = False
    out1: str = ""
    out2: str = ""
    unpaired1: str = ""
    unpaired2: str = ""
    failed_out: str = ""
    merged_out: str = ""
    overlapped_out: str = ""
    compression: int = 4
    dont_overwrite: bool = False
    to_stdout: bool = False
    # adapters
    adapter_trimming: bool = True
    adapter1: str = "auto"
    adapter2: str = "auto"
    adapter_list: tuple[str, ...] = ()
    detect_adapter_for_pe: bool = False
    gapped_adapters: bool = True
    allow_gap_overlap: bool = False
    dimer_max_len: int = 2
    # trimming; mate 2 follows mate 1 where None
    front1: int = 0
    tail1: int = 0
    max_len1: int = 0
    front2: int | None = None
    tail2: int | None = None
    max_len2: int | None = None
    poly_g: bool | None = None
    poly_g_min: int = 10
    poly_x: bool = False
    poly_x_min: int = 10
    cut_front: Cut | None = None
    cut_tail: Cut | None = None
    cut_right: Cut | None = None
    # filters
    quality_filter: bool = True
    qualified: int = 15
    unqualified_percent: int = 40
    n_limit: int = 5
    average_quality: int = 0
    length_filter: bool = True
    shortest: int = 15
    longest: int = 0
    complexity_filter: bool = False
    complexity: int = 30
    index1: tuple[str, ...] = ()
    index2: tuple[str, ...] = ()
    index_threshold: int = 0
    # pairs
    correction: bool = False
    overlap_least: int = 30
    overlap_diff: int = 5
    overlap_diff_percent: int = 20
    # the rest
    dedup: bool = False
    umi: Umi | None = None
    overrepresentation: bool = False
    overrepresentation_sampling: int = 20
    long_repeat_length: int = 0
    split: int = 0
    split_by_lines: int = 0
    split_prefix_digits: int = 4
    report_title: str = "read report"
    json: str = ""
    html: str = ""

    def resolved(self) -> "Options":
        """With mate 2 following mate 1, and what some settings imply; raises OptionError."""
        from dataclasses import replace

        o = self
        if o.merge and not o.correction:
            o = replace(o, correction=True)
        if o.correction and not o.paired:
            o = replace(o, correction=False)
        o = replace(o, front2=o.front1 if o.front2 is None else o.front2, tail2=o.tail1 if o.tail2 is None else o.tail2, max_len2=o.max_len1 if o.max_len2 is None else o.max_len2)
        if o.adapter2 == "auto" and o.adapter1 != "auto":
            o = replace(o, adapter2=o.adapter1)
        o._check()
        return o

    def _check(self) -> None:
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise OptionError(why)

        need(not (self.merge and not self.paired), "merging needs pairs")
        need(not (self.merge and (self.split or self.split_by_lines)), "merging and splitting don't go together")
        need(not (self.to_stdout and (self.split or self.split_by_lines)), "a single stream can't be split")
        need(not (self.split and self.split_by_lines), "split by number or by lines, not both")
        need(not self.split or 2 <= self.split <= 999, "split must be 2 to 999")
        need(not self.split_by_lines or (self.split_by_lines >= 1000 and self.split_by_lines % 4 == 0), "split_by_lines must be a multiple of 4, at least 1000")
        need(0 <= self.split_prefix_digits <= 10, "split_prefix_digits must be 0 to 10")
        need(not (self.paired and self.out1 and not self.out2 and not self.to_stdout and not self.merge), "pairs with out1 need out2")
        need(1 <= self.compression <= 9, "compression must be 1 to 9")
        for name in ("front1", "tail1", "front2", "tail2", "max_len1", "max_len2", "reads_to_process", "dimer_max_len", "index_threshold", "longest", "shortest", "long_repeat_length"):
            need(getattr(self, name) >= 0, f"{name} must not be negative")
        for c in (self.cut_front, self.cut_tail, self.cut_right):
            need(c is None or (1 <= c.window <= 1000 and 1 <= c.mean <= 30), "cut windows are 1 to 1000 wide, means 1 to 30")
        need(0 <= self.qualified <= 93 and 0 <= self.unqualified_percent <= 100 and 0 <= self.n_limit <= 50, "quality filter out of range")
        need(0 <= self.complexity <= 100, "complexity must be 0 to 100")
        need(0 <= self.overlap_diff_percent <= 100 and self.overlap_least > 0 and self.overlap_diff >= 0, "overlap settings out of range")
        need(1 <= self.overrepresentation_sampling <= 10000, "overrepresentation_sampling must be 1 to 10000")
        need(self.poly_g_min > 0 and self.poly_x_min > 0, "tails need a least length")
        for a in (self.adapter1, self.adapter2):
            need(a in ("auto", "") or (len(a) > 3 and re.fullmatch("[ATCG]+", a)), "adapters are longer than 3 and of A, T, C, G")
        for b in (*self.index1, *self.index2):
            need(re.fullmatch("[ATCG]*", b) is not None, "barcodes are of A, T, C, G")
        if self.umi:
            u = self.umi
            need(u.loc in ("index1", "index2", "read1", "read2", "per_index", "per_read"), "unknown place of the UMI")
            need(self.paired or u.loc not in ("index2", "read2"), "that place of the UMI needs pairs")
            need("index" in u.loc or 1 <= u.length <= 100, "a UMI in a read is 1 to 100 long")
            need(0 <= u.skip <= 100, "umi skip must be 0 to 100")
            need(re.fullmatch("[A-Za-z0-9]*", u.prefix) is not None, "the UMI prefix is of letters and digits")
