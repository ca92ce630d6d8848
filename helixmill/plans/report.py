"""Report of a pipeline run: JSON with fixed keys, and HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill import __version__
from helixmill.functions import expressions as E
from helixmill.operators.cleaning import correction_matrix
from helixmill.operators import evaluate, stats
from helixmill.plans.pipeline import Result, buckets, check_conservation

#: Fixed value: names of the buckets in the report.
BUCKETS = {E.PASS: "passed_filter_reads", E.QUALITY: "low_quality_reads", E.N_BASE: "too_many_N_reads", E.COMPLEXITY: "low_complexity_reads", E.ADAPTER_DIMER: "adapter_dimer_reads", E.LENGTH: "too_short_reads", E.TOO_LONG: "too_long_reads"}


def _six(x: float) -> float:
    """Six significant digits."""
    return float(f"{x:.6g}")


def _totals(mates: list[DataFrame]) -> dict:
    got = [stats.summary(m).first() for m in mates]
    out = {k: sum(r[k] for r in got) for k in ("total_reads", "total_bases", "q20_bases", "q30_bases")}
    bases = out["total_bases"] or 1
    out |= {"q20_rate": _six(out["q20_bases"] / bases), "q30_rate": _six(out["q30_bases"] / bases)}
    out |= {f"read{i + 1}_mean_length": r["mean_length"] for i, r in enumerate(got)}
    out["gc_content"] = _six(sum(r["gc_bases"] for r in got) / bases)
    return out


def profile(df: DataFrame, with_kmers: bool = True, hot: list[str] | None = None, sampling: int = 20) -> dict:
    """The per-cycle part of the report for one mate. Everything that reaches the driver is bounded by the read length or by 4^5."""
    total = stats.summary(df).first()
    cycles = stats.per_cycle(df)
    rows = cycles.collect()
    last = max((r["cycle"] for r in rows), default=0)
    at = {(r["cycle"], r["base"]): r for r in rows}
    n = [sum(at[c, b]["n"] for b in "ACGTN?" if (c, b) in at) for c in range(1, last + 1)]
    mean = [_six(sum(at[c, b]["qsum"] for b in "ACGTN?" if (c, b) in at) / n[c - 1]) for c in range(1, last + 1)]
    quality = {b: [_six(at[c, b]["qsum"] / at[c, b]["n"]) if (c, b) in at else mean[c - 1] for c in range(1, last + 1)] for b in "ATCG"} | {"mean": mean}
    count = lambda c, bs: sum(at[c, b]["n"] for b in bs if (c, b) in at)
    content = {k: [_six(count(c, k) / n[c - 1]) for c in range(1, last + 1)] for k in ("A", "T", "C", "G", "N", "GC")}
    q = {r["quality"]: r["n"] for r in stats.quality_histogram(df).collect()}
    out = {k: total[k] for k in ("total_reads", "total_bases", "q20_bases", "q30_bases")} | {"q40_bases": sum(v for k, v in q.items() if k >= 40), "total_cycles": last, "quality_curves": quality, "content_curves": content}
    out["kmer_count"] = {r["kmer"]: r["n"] for r in stats.kmers(df).collect()} if with_kmers else {}
    out["overrepresented_sequences"] = {r["seq"]: r["n"] for r in evaluate.hot_counts(df, hot, sampling).collect()} if hot else {}
    return out


def build(result: Result, command: str = "", top_share: float = 0.01) -> dict:
    """All sections of the report. Fails if reads got lost on the way."""
    o = result.options
    check_conservation(result)
    paired = o.paired
    mate = lambda df, m: df.select("read_id", F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual"))
    before = [mate(result.before, m) for m in (1, 2)] if paired else [result.before]
    written = result.routed.where("route in ('out1', 'out2', 'unpaired1', 'unpaired2', 'merged')")
    after = [written.where("mate <= 1" if m == 1 else "mate = 2") for m in ((1, 2) if paired and not o.merge else (1,))]
    hot: list[list[str]] = [[], []]  # of each mate
    if o.overrepresentation:
        for i, df in enumerate(before):
            found = [(r["seq"], r["n"]) for r in evaluate.hot_sequences(df).collect()]  # bounded by the bases over the least counts, which grow with them
            hot[i] = [s for s, _ in evaluate.without_contained(found)]
    report: dict = {"summary": {"helixmill_version": __version__, "sequencing": "paired end" if paired else "single end", "before_filtering": _totals(before), "after_filtering": _totals(after)}}
    counts = {r["result"]: r["n"] for r in buckets(result).collect()}
    shown = [k for k in BUCKETS if k not in (E.COMPLEXITY, E.ADAPTER_DIMER) or counts.get(k) or (k == E.COMPLEXITY and o.complexity_filter)]
    report["filtering_result"] = {BUCKETS[k]: counts.get(k, 0) for k in shown}
    j = result.judged
    if paired and o.correction:
        c = j.agg(F.coalesce(F.sum(F.col("corrected1") + F.col("corrected2")), F.lit(0)).alias("bases"), F.coalesce(F.sum((F.col("corrected1") > 0).cast("int") + (F.col("corrected2") > 0).cast("int")), F.lit(0)).alias("reads")).first()
        report["filtering_result"] |= {"corrected_reads": c["reads"], "corrected_bases": c["bases"]}
        report["corrections"] = {f"{r['old_base']}>{r['new_base']}": r["n"] for r in correction_matrix(j).orderBy("old_base", "new_base").collect()}  # at most 8 x 8
    report["duplication"] = {"rate": stats.duplication(result.before, *(("seq1", "seq2") if paired else ("seq",))).first()["rate"]}
    if paired:
        sizes = {r["insert_size"]: r["n"] for r in j.where("insert_size >= 0").groupBy("insert_size").agg(F.count(F.lit(1)).alias("n")).collect()}
        hist = [sizes.get(i, 0) for i in range(512)]
        report["insert_size"] = {"peak": hist.index(max(hist)) if any(hist) else 0, "unknown": sizes.get(512, 0), "histogram": hist}
    names = ("adapter1", "adapter2") if paired else ("adapter",)
    if o.adapter_trimming:
        cut = {"adapter_trimmed_reads": 0, "adapter_trimmed_bases": 0}
        for i, c in enumerate(names):
            per = j.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("a")).agg(F.count(F.lit(1)).alias("n"))
            t = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.length("a")), F.lit(0)).alias("b")).first()
            often = per.where(F.col("n") >= top_share * t["n"]).orderBy(F.length("a"), "a").collect()  # at most 1/top_share rows
            cut["adapter_trimmed_reads"] += t["n"]
            cut["adapter_trimmed_bases"] += t["b"]
            cut[f"read{i + 1}_adapter_sequence"] = (o.adapter1, o.adapter2)[i]
            cut[f"read{i + 1}_adapter_counts"] = {r["a"]: r["n"] for r in often} | ({"others": rest} if (rest := t["n"] - sum(r["n"] for r in often)) else {})
        report["adapter_cutting"] = cut
    if o.poly_x:
        tails = [j.select(F.col(f"poly_base{m}").alias("b"), F.col(f"poly_len{m}").alias("n")) for m in ("1", "2")] if paired else [j.select(F.col("poly_base").alias("b"), F.col("poly_len").alias("n"))]
        both = tails[0].unionByName(tails[1]) if paired else tails[0]
        got = {r["b"]: (r["r"], r["n"]) for r in both.where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n")).collect()}
        for k, what in enumerate(("reads", "bases")):
            report.setdefault("polyx_trimming", {})
            report["polyx_trimming"] |= {f"total_polyx_trimmed_{what}": sum(v[k] for v in got.values()), f"polyx_trimmed_{what}": {b: got.get(b, (0, 0))[k] for b in "ATCG"}}
    for i, df in enumerate(before):
        report[f"read{i + 1}_before_filtering"] = profile(df, True, hot[i], o.overrepresentation_sampling)
    for i, df in enumerate(after):
        report["merged_and_filtered" if o.merge else f"read{i + 1}_after_filtering"] = profile(df, True, hot[i], o.overrepresentation_sampling)
    if o.long_repeat_length:
        report["long_repeats"] = []
        for i, df in enumerate(before):
            found = evaluate.long_repeats(df, o.long_repeat_length, complexity=o.complexity / 100 if o.complexity_filter else None)
            top = found.orderBy(F.desc("repeat_len"), "read_id", "pos1", "pos2").limit(20).collect()
            report["long_repeats"] += [{"mate": i + 1, "read_id": r["read_id"], "length": r["repeat_len"], "pos1": r["pos1"], "pos2": r["pos2"], "seq": r["repeat_seq"]} for r in top]
    report["command"] = command
    return report


def thinned(cycles: int) -> list[int]:
    """Cycles that a plot shows: all up to 300, beyond that the first 40 and then ever wider steps."""
    if cycles <= 300:
        return list(range(cycles))
    out, at = list(range(40)), 40.0
    while at < cycles:
        out.append(int(at))
        at = max(at * 1.05, at + 1)
    return out


def write_json(report: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=1)


_PALETTE = {"A": "#4269d0", "T": "#efb118", "C": "#3ca951", "G": "#ff725c", "N": "#888888", "GC": "#a463f2", "mean": "#222222"}


def _plot(title: str, curves: dict[str, list[float]]) -> str:
    """Line chart as inline SVG."""
    xs = thinned(max((len(v) for v in curves.values()), default=0))
    top = max((max(v) for v in curves.values() if v), default=1) or 1
    w, h = 640, 220
    last = max(xs, default=1) or 1
    lines = "".join(f'<polyline fill="none" stroke="{_PALETTE.get(k, "#4269d0")}" stroke-width="1.5" points="{" ".join(f"{40 + x / last * (w - 60):.1f},{h - 25 - v[x] / top * (h - 45):.1f}" for x in xs if x < len(v))}"><title>{html.escape(k)}</title></polyline>' for k, v in curves.items())
    key = "".join(f'<text x="{50 + 60 * i}" y="12" font-size="11" fill="{_PALETTE.get(k, "#4269d0")}">{html.escape(k)}</text>' for i, k in enumerate(curves))
    axes = f'<line x1="40" y1="{h - 25}" x2="{w - 20}" y2="{h - 25}" stroke="#999"/><text x="4" y="24" font-size="10">{top:.3g}</text><text x="{w - 40}" y="{h - 8}" font-size="10">{last + 1}</text>'
    return f'<h3>{html.escape(title)}</h3><svg width="{w}" height="{h}" role="img">{key}{axes}{lines}</svg>'


def _table(values: dict) -> str:
    return "<table>" + "".join(f"<tr><th>{html.escape(str(k).replace('_', ' '))}</th><td>{html.escape(f'{v:,}' if isinstance(v, int) else str(v))}</td></tr>" for k, v in values.items() if not isinstance(v, (dict, list))) + "</table>"


def to_html(report: dict, title: str = "read report") -> str:
    """One page: summary, filtering, adapters, insert size, curves, k-mers, hot sequences, repeats."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}th{{text-align:left;padding-right:2em;font-weight:normal}}td{{text-align:right}}</style><h1>{html.escape(title)}</h1>"]
    for part in ("before_filtering", "after_filtering"):
        out.append(f"<h2>{part.replace('_', ' ')}</h2>" + _table(report["summary"][part]))
    for part in ("filtering_result", "duplication", "adapter_cutting", "polyx_trimming"):
        if part in report:
            out.append(f"<h2>{part.replace('_', ' ')}</h2>" + _table(report[part]))
            out += [f"<h3>{html.escape(k.replace('_', ' '))}</h3>" + _table(v) for k, v in report[part].items() if isinstance(v, dict)]
    if "insert_size" in report:
        out.append(f"<h2>insert size</h2>{_table(report['insert_size'])}" + _plot("insert sizes", {"mean": report["insert_size"]["histogram"]}))
    for part, p in report.items():
        if isinstance(p, dict) and "quality_curves" in p:
            out.append(f"<h2>{html.escape(part.replace('_', ' '))}</h2>" + _table(p) + _plot("quality", p["quality_curves"]) + _plot("base content", p["content_curves"]))
            best = sorted(p["kmer_count"].items(), key=lambda x: (-x[1], x[0]))[:20]
            out.append("<h3>most frequent 5-mers</h3>" + _table(dict(best)))
            if p["overrepresented_sequences"]:
                out.append("<h3>over-represented sequences</h3>" + _table(p["overrepresented_sequences"]))
    if report.get("long_repeats"):
        out.append("<h2>long repeats</h2>" + _table({f"mate {r['mate']}, read {r['read_id']}, {r['pos1']} and {r['pos2']}": f"{r['length']}: {r['seq']}" for r in report["long_repeats"]}))
    return "\n".join(out)
