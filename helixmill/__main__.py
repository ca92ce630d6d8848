"""Command line: FASTQ in, clean FASTQ and reports out.

    python -m helixmill --in1 R1.fq.gz --out clean --json report.json
"""

from __future__ import annotations

import argparse
import sys

from helixmill.plans.options import Cut, OptionError, Options, Umi


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixmill")
    p.add_argument("--in1")
    p.add_argument("--stdin", action="store_true", help="reads come from standard input (with --interleaved: pairs)")
    p.add_argument("--in2")
    p.add_argument("--out", help="folder; one folder of files per route")
    p.add_argument("--stdout", dest="to_stdout", action="store_true", help="reads that pass go to standard output, mates in turn")
    p.add_argument("--adapter_fasta")
    p.add_argument("--json")
    p.add_argument("--html")
    p.add_argument("--filter_by_index1")
    p.add_argument("--filter_by_index2")
    for name, kind, value in (("adapter1", str, "auto"), ("adapter2", str, "auto"), ("front1", int, 0), ("tail1", int, 0), ("max_len1", int, 0), ("front2", int, None), ("tail2", int, None), ("max_len2", int, None), ("qualified", int, 15), ("unqualified_percent", int, 40), ("n_limit", int, 5), ("average_quality", int, 0), ("shortest", int, 15), ("longest", int, 0), ("complexity", int, 30), ("index_threshold", int, 0), ("overlap_least", int, 30), ("overlap_diff", int, 5), ("overlap_diff_percent", int, 20), ("poly_g_min", int, 10), ("poly_x_min", int, 10), ("reads_to_process", int, 0), ("dimer_max_len", int, 2), ("compression", int, 4), ("overrepresentation_sampling", int, 20), ("long_repeat_length", int, 0), ("split", int, 0), ("split_by_lines", int, 0), ("unpaired1", str, ""), ("unpaired2", str, ""), ("overlapped_out", str, ""), ("report_title", str, "read report")):
        p.add_argument(f"--{name}", type=kind, default=value)
    for name in ("phred64", "fix_mgi_id", "interleaved", "merge", "include_unmerged", "allow_gap_overlap", "dont_overwrite", "detect_adapter_for_pe", "poly_x", "complexity_filter", "correction", "dedup", "overrepresentation"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("adapter_trimming", "quality_filter", "length_filter", "gapped_adapters"):
        p.add_argument(f"--disable_{name}", action="store_true")
    for name in ("failed_out", "merged_out"):
        p.add_argument(f"--{name}", default="", help="folder for these reads instead of one in --out")
    p.add_argument("--trim_poly_g", dest="poly_g", action="store_true", default=None)
    p.add_argument("--disable_trim_poly_g", dest="poly_g", action="store_false")
    for end in ("front", "tail", "right"):
        p.add_argument(f"--cut_{end}", nargs="*", type=int, metavar="N", help="window and mean quality")
    p.add_argument("--umi_loc")
    p.add_argument("--umi_len", type=int, default=0)
    p.add_argument("--umi_skip", type=int, default=0)
    p.add_argument("--umi_prefix", default="")
    p.add_argument("--umi_delim", default=":")
    return p


def options(a: argparse.Namespace, adapters=(), index1=(), index2=()) -> Options:
    fields = {k: v for k, v in vars(a).items() if k in Options.__dataclass_fields__ and k not in ("json", "html")}
    for end in ("front", "tail", "right"):
        given = getattr(a, f"cut_{end}")
        fields[f"cut_{end}"] = Cut(*given) if given is not None else None
    for name in ("adapter_trimming", "quality_filter", "length_filter", "gapped_adapters"):
        fields[name] = not getattr(a, f"disable_{name}")
    umi = Umi(a.umi_loc, a.umi_len, a.umi_skip, a.umi_prefix, a.umi_delim) if a.umi_loc else None
    paired = bool(a.in2 or a.interleaved)
    return Options(**fields | {"paired": paired, "umi": umi, "adapter_list": tuple(adapters), "index1": tuple(index1), "index2": tuple(index2), "out1": a.out or "", "out2": (a.out or "") if paired else ""})


def main(argv: list[str] | None = None) -> int:
    from dataclasses import replace

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from helixmill.operators import evaluate
    from helixmill.plans import pipeline, report
    from helixmill.sources import fastq, lists
    from helixmill.sources.adapters import KNOWN

    a = parser().parse_args(argv)
    if bool(a.in1) == a.stdin or not (a.out or a.to_stdout):
        print("helixmill: one of --in1 and --stdin, and --out or --stdout", file=sys.stderr)
        return 2
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("helixmill").getOrCreate()
    fastq.register(spark)
    load = lambda p: fastq.ordinals(spark.read.format("fastq").load(p))
    adapters = [r["seq"] for r in lists.fasta(spark, a.adapter_fasta).orderBy("header").collect()] if a.adapter_fasta else []
    bars = [lists.barcodes(spark, p) if p else [] for p in (a.filter_by_index1, a.filter_by_index2)]
    try:
        o = options(a, adapters, *bars).resolved()
    except OptionError as e:
        print(f"helixmill: {e}", file=sys.stderr)
        return 2
    in1 = lists.from_stream(spark, sys.stdin.buffer) if a.stdin else a.in1
    r1 = load(in1)
    if o.poly_g is None:
        o = replace(o, poly_g=bool(evaluate.two_colour(r1).first()["two_color"]))
    mates = [r1]
    if o.paired:
        both = pipeline.deinterleave(r1) if o.interleaved else pipeline.require_pairs(pipeline.pair_up(r1, load(a.in2)))
        mates = [both.select("read_id", F.col(f"seq{m}").alias("seq")) for m in (1, 2)] if o.interleaved else [r1, load(a.in2)]
    if o.adapter_trimming and (not o.paired or o.detect_adapter_for_pe):
        known = sorted({*KNOWN, *adapters})
        for name, mate in zip(("adapter1", "adapter2"), mates):
            if getattr(a, name) == "auto":  # as given: mate 2 doesn't follow mate 1 where each is detected
                o = replace(o, **{name: (evaluate.detect_adapter(mate, known) or "auto")[:60]})
    if o.paired:
        result = pipeline.paired(both, o)
    else:
        result = pipeline.single(r1, o)
    pipeline.check_conservation(result)
    routed = result.routed
    if o.split or o.split_by_lines:
        routed = pipeline.split_routes(routed, o)
    if o.to_stdout:
        lists.to_stream(routed, sys.stdout.buffer)
        routed = routed.where("route not in ('out1', 'out2', 'merged')")
    kind = "bgzf" if in1.endswith(".gz") else "none"
    for route, folder in (("failed", o.failed_out), ("merged", o.merged_out)):
        if folder:
            lists.write_routes(routed.where(F.col("route") == route), folder, kind, o.compression, not o.dont_overwrite)
            routed = routed.where(F.col("route") != route)
    if a.out:
        lists.write_routes(routed, a.out, kind, o.compression, not o.dont_overwrite)
    if a.json or a.html:
        made = report.build(result, "helixmill " + " ".join(argv if argv is not None else sys.argv[1:]))
        if a.json:
            report.write_json(made, a.json)
        if a.html:
            with open(a.html, "w") as f:
                f.write(report.to_html(made, o.report_title))
    return 0


if __name__ == "__main__":
    sys.exit(main())
