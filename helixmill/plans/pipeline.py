"""The ordered plans for single reads and for pairs: from raw reads to routed output and report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import expressions as E
from helixmill.operators import cleaning, stats
from helixmill.operators.staging import staged
from helixmill.plans.options import Options, Umi


@dataclass
class Result:
    """routed: (route, read_id, mate, name, seq, strand, qual), rows for the sinks. before: reads that entered. judged: every read or pair
    with its verdict. All lazy; ``judged`` is staged, because several results are computed from it."""

    options: Options
    before: DataFrame
    judged: DataFrame
    routed: DataFrame


class ConservationError(AssertionError):
    """Reads got lost or appeared on the way."""


def _duplicates(df: DataFrame, o: Options, *key: str) -> DataFrame:
    """``dup``: whether a read with a smaller ordinal has the same raw bases. Only where asked for: it is a shuffle."""
    if not o.dedup:
        return df.withColumn("dup", F.lit(False))
    heads = stats.heads(df, list(key)).select("read_id", F.lit(True).alias("_head"))
    return df.join(heads, "read_id", "left").withColumn("dup", F.col("_head").isNull()).drop("_head")


def single(df: DataFrame, options: Options) -> Result:
    """Single reads: read_id, name, seq, strand, qual."""
    o = options.resolved()
    df = df.select("read_id", "name", "seq", "strand", "qual")
    if o.reads_to_process:
        df = df.where(F.col("read_id") < o.reads_to_process)
    if o.phred64:
        df = df.withColumn("qual", E.phred64_to_33("qual"))
    df = _duplicates(df, o, "seq")
    df = cleaning.index_filter(df, "name", list(o.index1), o.index_threshold)
    if o.fix_mgi_id:
        df = df.withColumn("name", E.mgi_fix("name"))
    if o.umi:
        df = cleaning.move_umi(df, *_umi(o.umi))
    judged = staged(cleaning.clean_single(df, o), "judged")
    good = F.col("verdict") == E.PASS
    name = F.when(good, F.col("name")).otherwise(F.concat_ws(" ", "name", E.tag("verdict")))
    routed = judged.where(~good | ~F.col("dup")).select(F.when(good, "out1").otherwise("failed").alias("route"), "read_id", F.lit(1).alias("mate"), name.alias("name"), "seq", "strand", "qual")
    return Result(o, df, judged, routed)


def paired(df: DataFrame, options: Options) -> Result:
    """Pairs: read_id, name (or name1 and name2), seq1, qual1, seq2, qual2."""
    from dataclasses import replace

    o = replace(options, paired=True).resolved()
    if "name" in df.columns:
        df = df.withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    df = df.select("read_id", "name1", "seq1", "qual1", "name2", "seq2", "qual2")
    if o.reads_to_process:
        df = df.where(F.col("read_id") < o.reads_to_process)
    if o.phred64:
        df = df.withColumn("qual1", E.phred64_to_33("qual1")).withColumn("qual2", E.phred64_to_33("qual2"))
    df = _duplicates(df, o, "seq1", "seq2")
    df = cleaning.index_filter(df, "name1", list(o.index1), o.index_threshold)
    df = cleaning.index_filter(df, "name2", list(o.index2), o.index_threshold, "last")
    if o.fix_mgi_id:
        df = df.withColumn("name1", E.mgi_fix("name1")).withColumn("name2", E.mgi_fix("name2"))
    if o.umi:
        df = cleaning.move_umi_pairs(df, *_umi(o.umi))
    judged = staged(cleaning.clean_pairs(df, o), "judged")
    return Result(o, df, judged, route_pairs(judged, o))


def _umi(u: Umi):
    return u.loc, u.length, u.skip, u.prefix, u.delimiter


def route_pairs(judged: DataFrame, o: Options) -> DataFrame:
    """Where each mate goes. Both pass: out. One passes: to its unpaired file (mate 2 to mate 1's where it has none), the other fails;
    without an unpaired file both fail. Duplicates go nowhere. Merged pairs replace their mates."""
    ok1, ok2, live = F.col("verdict1") == E.PASS, F.col("verdict2") == E.PASS, ~F.col("dup")
    lone1 = bool(o.unpaired1)
    lone2 = bool(o.unpaired2) or lone1
    to2 = "unpaired2" if o.unpaired2 and o.unpaired2 != o.unpaired1 else "unpaired1"
    both = ok1 & ok2
    merged = F.col("merged_seq").isNotNull() & (F.col("merged_verdict") == E.PASS) if o.merge else F.lit(False)
    row = lambda route, mate, name, seq, qual: F.struct(F.lit(route).alias("route"), F.lit(mate).alias("mate"), name.alias("name"), F.col(seq).alias("seq"), F.col(qual).alias("qual"))
    plain = lambda m, route, cond: F.when(cond, row(route, m, F.col(f"name{m}"), f"seq{m}", f"qual{m}"))
    tagged = lambda m, cond, t: F.when(cond, row("failed", m, F.concat_ws(" ", f"name{m}", t), f"seq{m}", f"qual{m}"))
    rest = ~merged
    partner = F.lit("paired_read_is_failing")
    rows = [F.when(merged, row("merged", 0, F.col("merged_name"), "merged_seq", "merged_qual"))] if o.merge else []
    if o.merge and o.include_unmerged:
        rows += [plain(1, "merged", rest & ok1), plain(2, "merged", rest & ok2)]
    else:
        rows += [plain(1, "out1", rest & both), plain(2, "out2", rest & both)]
        rows += [plain(1, "unpaired1", rest & ok1 & ~ok2) if lone1 else tagged(1, rest & ok1 & ~ok2, partner)]
        rows += [plain(2, to2, rest & ok2 & ~ok1) if lone2 else tagged(2, rest & ok2 & ~ok1, partner)]
    rows += [tagged(1, rest & ~ok1, E.tag("verdict1")), tagged(2, rest & ~ok2, E.tag("verdict2"))]
    if o.overlapped_out:
        rows.append(F.when(F.col("overlapped_seq").isNotNull(), row("overlapped", 0, F.col("name1"), "overlapped_seq", "overlapped_qual")))
    # one pass: every pair gives the rows it has
    out = judged.where(live).select("read_id", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return out.select("r.route", "read_id", "r.mate", "r.name", "r.seq", F.lit("+").alias("strand"), "r.qual")


def buckets(result: Result) -> DataFrame:
    """(result, n): reads by verdict; a pair counts twice under the worse of its verdicts."""
    if result.options.paired:
        worse = F.greatest("verdict1", "verdict2")
        if result.options.merge:
            worse = F.when(F.col("merged_seq").isNotNull(), F.col("merged_verdict")).otherwise(worse)
        return result.judged.groupBy(worse.alias("result")).agg((2 * F.count(F.lit(1))).alias("n"))
    return result.judged.groupBy(F.col("verdict").alias("result")).agg(F.count(F.lit(1)).alias("n"))


def check_conservation(result: Result) -> int:
    """The reads that came in, if as many were judged; raises otherwise."""
    came = result.before.count() * (2 if result.options.paired else 1)
    judged = buckets(result).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if came != judged:
        raise ConservationError(f"{came} reads came in, {judged} were judged")
    return came


def pair_up(r1: DataFrame, r2: DataFrame, by: str = "read_id") -> DataFrame:
    """Mates joined by position, or by the column ``by``; ``paired`` is false where one file has no partner. Use ``require_pairs`` to fail on those."""
    a = r1.select(by, F.col("name").alias("name1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = r2.select(by, F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return a.join(b, by, "full").withColumn("paired", F.col("seq1").isNotNull() & F.col("seq2").isNotNull())


def require_pairs(joined: DataFrame) -> DataFrame:
    """Fails at the first read without a partner."""
    return joined.withColumn("paired", F.when(F.col("paired"), True).otherwise(F.raise_error(F.lit("the files hold different numbers of reads")).cast("boolean"))).where("paired")


def deinterleave(df: DataFrame, *within: str) -> DataFrame:
    """Alternate reads of one file as pairs; a last read without a partner is dropped. ``within``: columns that tell several files apart."""
    half = df.withColumn("pair", F.floor(F.col("read_id") / 2))
    key = F.concat_ws(":", *within, "pair") if within else F.col("pair")
    side = lambda odd: half.where(F.col("read_id") % 2 == odd).select(key.alias("read_id"), "name", "seq", "qual")
    return pair_up(side(0), side(1)).where("paired")


def split_routes(routed: DataFrame, o: Options) -> DataFrame:
    """Routes out1 and out2 cut into numbered files: ``split`` files of about equal size, or ``split_by_lines`` lines each. Mates stay together."""
    from helixmill.operators.ordered import ranked

    main = routed.where("route in ('out1', 'out2')")
    order = ranked(main.select("read_id").distinct(), ["read_id"])
    if o.split_by_lines:
        number = F.floor(F.col("rank") / (o.split_by_lines // 4))
    else:
        number = F.least(F.floor(F.col("rank") * o.split / max(1, order.count())), F.lit(o.split - 1))
    prefix = F.lpad((number + 1).cast("string"), max(1, o.split_prefix_digits), "0") if o.split_prefix_digits else (number + 1).cast("string")
    placed = main.join(order.select("read_id", prefix.alias("_file")), "read_id")
    named = placed.withColumn("route", F.concat_ws(".", "_file", "route")).select(*main.columns)
    return named.unionByName(routed.where("route not in ('out1', 'out2')"))
