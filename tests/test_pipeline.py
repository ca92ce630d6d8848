"""Options, routing, conservation, reports, streaming and the command line."""

import json
import random

import pytest

from helixmill.__main__ import main
from helixmill.functions import expressions as E
from helixmill.operators import evaluate, stats
from helixmill.plans import pipeline, prescan, report
from helixmill.plans.options import Cut, OptionError, Options, Umi
from helixmill.plans.views import ADAPTER1, pairs, reads
from helixmill.sources import fastq
from helixmill.streaming import running
from tests.oracle import DATA


@pytest.mark.parametrize(
    "bad",
    [
        {"merge": True}, {"merge": True, "paired": True, "split": 4}, {"split": 1}, {"split_by_lines": 1001}, {"paired": True, "out1": "a"}, {"cut_tail": Cut(4, 40)}, {"adapter1": "AXGT"}, {"adapter1": "ACG"},
        {"umi": Umi("read2", 8)}, {"umi": Umi("read1", 0)}, {"umi": Umi("nowhere", 8)}, {"index1": ("ACGN",)}, {"compression": 0}, {"front1": -1}, {"to_stdout": True, "split": 3}, {"overrepresentation_sampling": 0},
    ],
)
def test_bad_options(bad):
    with pytest.raises(OptionError):
        Options(**bad).resolved()


def test_options_follow():
    o = Options(paired=True, merge=True, front1=3, max_len1=80, adapter1="ACGTACGT").resolved()
    assert o.correction and (o.front2, o.max_len2, o.adapter2) == (3, 80, "ACGTACGT")
    assert not Options(correction=True).resolved().correction


def test_conservation_and_mates(spark):
    o = Options(out1="a", out2="b", unpaired1="u", dedup=True, poly_g=True, poly_x=True, correction=True, cut_tail=Cut(), adapter1=ADAPTER1)
    r = pipeline.paired(pairs(spark, DATA), o)
    assert pipeline.check_conservation(r) == 2 * pairs(spark, DATA).count()
    got = {x["route"]: x["n"] for x in r.routed.groupBy("route").count().withColumnRenamed("count", "n").collect()}
    assert got["out1"] == got["out2"] > 0
    again = pipeline.paired(pairs(spark, DATA).repartition(7), o).routed
    assert sorted(map(tuple, r.routed.collect())) == sorted(map(tuple, again.collect()))


def test_merged_reads_spell_the_insert(spark):
    o = Options(merge=True, adapter_trimming=False, poly_g=False)
    rng = random.Random(0)
    frag = ["".join(rng.choice("ACGT") for _ in range(140)) for _ in range(20)]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(i, f"@r{i} x", f[:100], "I" * 100, rc(f[40:]), "I" * 100) for i, f in enumerate(frag)]
    df = spark.createDataFrame(rows, "read_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string")
    out = pipeline.paired(df, o).routed.orderBy("read_id").collect()
    assert [x["seq"] for x in out] == frag and all(x["route"] == "merged" and x["name"] == f"@r{x['read_id']} x merged_100_40" for x in out)


def test_missing_mate(spark):
    a = spark.createDataFrame([(0, "@a", "A", "I"), (1, "@b", "A", "I")], "read_id long, name string, seq string, qual string")
    with pytest.raises(Exception, match="different numbers"):
        pipeline.require_pairs(pipeline.pair_up(a, a.limit(1))).collect()
    assert pipeline.deinterleave(a.union(spark.createDataFrame([(2, "@c", "A", "I")], a.schema))).count() == 1


def test_verdicts_of_kernel_and_expression_agree(spark):
    o = Options(adapter_trimming=False, poly_g=False, average_quality=25, longest=120, complexity_filter=True)
    df = reads(spark, DATA)
    kernel = pipeline.single(df, o).judged.select("read_id", "verdict")
    native = df.select("read_id", E.verdict("seq", "qual", average=25, longest=120, complexity=30).alias("verdict"))
    assert sorted(map(tuple, kernel.collect())) == sorted(map(tuple, native.collect()))


def test_empty_table(spark):
    df = reads(spark, DATA).limit(0)
    r = pipeline.single(df, Options(dedup=True))
    assert r.routed.count() == 0 and pipeline.check_conservation(r) == 0
    made = report.build(r)
    assert made["summary"]["before_filtering"]["total_reads"] == 0
    assert stats.per_cycle(df).count() == stats.kmers(df).count() == 0


def test_report(spark):
    r = pipeline.paired(pairs(spark, DATA), Options(out1="a", out2="b", correction=True, poly_x=True, overrepresentation=True, long_repeat_length=10))
    made = json.loads(json.dumps(report.build(r, "x")))
    s = made["summary"]["before_filtering"]
    assert s["total_reads"] == 2 * pairs(spark, DATA).count() == sum(v for k, v in made["filtering_result"].items() if not k.startswith("corrected"))
    assert len(made["insert_size"]["histogram"]) == 512 and sum(made["insert_size"]["histogram"]) + made["insert_size"]["unknown"] == s["total_reads"] / 2
    p = made["read1_before_filtering"]
    assert p["total_cycles"] == len(p["quality_curves"]["mean"]) == len(p["content_curves"]["GC"]) and len(p["kmer_count"]) == 1024
    page = report.to_html(made)
    assert page.count("<svg") >= 8 and "insert size" in page
    assert report.thinned(300) == list(range(300)) and len(report.thinned(100000)) < 300


def test_sql_functions(spark):
    E.register(spark)
    got = spark.sql("SELECT revcomp('AACGN') AS a, hamming('ACGT', 'AGGTT') AS b, poly_g_len('ACGTGGGGGGGGGGGGGG') AS c, poly_x_len('ACGTAAAAAAAAAAAAAA') AS d, adapter_pos('ACGTAGATCGGAAGAGC', 'AGATCGGAAGAGC') AS e").first()
    assert (got["a"], got["b"], got["e"]) == ("NCGTT", 1, 4) and got["c"] <= 5 and got["d"] <= 4
    assert spark.sql("SELECT * FROM fastq_parse('@a\nAC\n+\nII\n@b\nG\n+\nI\n')").count() == 2


def test_streams(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/fastq_reads.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    whole = lambda d: __import__("helixmill.plans.views", fromlist=["whole"]).whole(d)
    stream = running.read_stream(spark, str(tmp_path / "in"), df.schema)
    running.running_profile(whole(stream), str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, running.profile_so_far(spark, str(tmp_path / "sums")).select("cycle", "base", "n").collect())) == sorted(map(tuple, stats.per_cycle(whole(df)).select("cycle", "base", "n").collect()))
    q = running.bucket_counts(whole(stream)).writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("buckets").collect()} == {tuple(r) for r in running.bucket_counts(whole(df)).collect()}
    q = running.first_deliveries(stream.where("loaded_at is not null"), delay="3650 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == df.where("loaded_at is not null").select("read_id").distinct().count()


def test_command_line(spark, tmp_path):
    rows = pairs(spark, DATA).where("length(seq1) > 0 and length(seq2) > 0").orderBy("read_id").limit(300).collect()
    for m in (1, 2):
        text = "".join(f"@r{i} {m}\n{r[f'seq{m}']}\n+\n{r[f'qual{m}']}\n" for i, r in enumerate(rows))
        (tmp_path / f"{m}.fq").write_text(text)
    assert main(["--in1", str(tmp_path / "1.fq"), "--in2", str(tmp_path / "2.fq"), "--out", str(tmp_path / "out"), "--json", str(tmp_path / "r.json"), "--html", str(tmp_path / "r.html"), "--split", "2", "--cut_tail", "4", "20", "--correction"]) == 0
    made = json.loads((tmp_path / "r.json").read_text())
    assert made["summary"]["before_filtering"]["total_reads"] == 600
    fastq.register(spark)
    count = lambda route: spark.read.format("fastq").load(str(tmp_path / f"out/{route}/part-*")).count()
    assert count("0001.out1") == count("0001.out2") and 2 * (count("0001.out1") + count("0002.out1")) == made["summary"]["after_filtering"]["total_reads"]
    assert main(["--in1", str(tmp_path / "1.fq"), "--out", str(tmp_path / "o2"), "--merge"]) == 2


def test_report_keeps_all_hot_sequences_of_each_mate(spark):
    """More than 1,000 hot pieces in either mate: none of the longest, which hold the others, may be missing."""
    rng = random.Random(2)
    mates = [["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(60)] for _ in range(2)]
    rows = [(5 * i + k, f"@r{5 * i + k}", mates[0][i], "I" * 120, mates[1][i], "I" * 120) for i in range(60) for k in range(5)]
    df = spark.createDataFrame(rows, "read_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string")
    o = Options(paired=True, out1="a", out2="b", adapter_trimming=False, poly_g=False, overrepresentation=True, overrepresentation_sampling=1)
    made = report.build(pipeline.paired(df, o))
    for m in (0, 1):
        for when in ("before", "after"):
            assert made[f"read{m + 1}_{when}_filtering"]["overrepresented_sequences"] == {s[:118]: 5 for s in mates[m]}


def test_containment_against_all_pairs():
    rng = random.Random(3)
    hot = {"".join(rng.choice("AC") for _ in range(rng.choice([3, 5, 9, 14]))): rng.choice([1, 2, 5, 30]) for _ in range(300)}
    left = dict(sorted(hot.items()))
    for seq in sorted(left):
        if any(seq != other and seq in other and left[seq] // n < 10 for other, n in left.items()):
            del left[seq]
    assert evaluate.without_contained(list(hot.items())) == sorted(left.items()) and 0 < len(left) < len(hot)


def test_counts_of_hot_sequences_of_every_length(spark):
    """The query against a slow loop over all hot sequences, and the joined way against the broadcast one."""
    hot = [r["seq"] for r in prescan.overrep_hot(spark, DATA).collect()]
    want: dict[str, int] = {}
    texts = {(r["read_id"], r["seq"]) for r in reads(spark, DATA).collect()}
    for step in {len(h) for h in hot}:
        wanted = {h for h in hot if len(h) == step}
        for _, s in texts:
            i = 0
            while i < len(s) - step:
                if s[i : i + step] in wanted:
                    want[s[i : i + step]] = want.get(s[i : i + step], 0) + 1
                    i += step
                i += 1
    got = {r["seq"]: r["n"] for r in prescan.overrep_counts(spark, DATA).collect()}
    assert got == want and min(map(len, got)) < 40
    joined = evaluate.hot_counts(reads(spark, DATA).select("read_id", "seq").distinct(), hot, limit=0)
    assert {r["seq"]: r["n"] for r in joined.collect()} == want


def test_command_line_detects_the_adapter_of_each_mate(spark, tmp_path):
    """Pairs whose ends don't overlap; without a FASTA the built-in list has both adapters."""
    rng = random.Random(6)
    ends = ["AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"]
    for m, end in enumerate(ends, 1):
        text = "".join(f"@r{i} {m}\n{(''.join(rng.choices('ACGT', k=60)) + (end if i % 3 == 0 else ''.join(rng.choices('ACGT', k=33))))[-70:]}\n+\n{'I' * 70}\n" for i in range(10_200))
        (tmp_path / f"{m}.fq").write_text(text)
    assert main(["--in1", str(tmp_path / "1.fq"), "--in2", str(tmp_path / "2.fq"), "--out", str(tmp_path / "out"), "--json", str(tmp_path / "r.json"), "--detect_adapter_for_pe"]) == 0
    cut = json.loads((tmp_path / "r.json").read_text())["adapter_cutting"]
    assert [cut["read1_adapter_sequence"], cut["read2_adapter_sequence"]] == ends and cut["adapter_trimmed_reads"] >= 2 * 3400


def test_streams_of_bytes(spark, tmp_path, monkeypatch):
    """Interleaved pairs from standard input to standard output, the failed ones to a folder of their own."""
    import io
    import types

    rows = pairs(spark, DATA).where("length(seq1) > 20 and length(seq2) > 20").orderBy("read_id").limit(200).collect()
    text = "".join(f"@r{i} {m}\n{r[f'seq{m}']}\n+\n{r[f'qual{m}']}\n" for i, r in enumerate(rows) for m in (1, 2))
    out = io.BytesIO()
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(text.encode())))
    monkeypatch.setattr("sys.stdout", types.SimpleNamespace(buffer=out, write=lambda s: None, flush=lambda: None))
    assert main(["--stdin", "--interleaved", "--stdout", "--out", str(tmp_path / "rest"), "--failed_out", str(tmp_path / "bad"), "--disable_adapter_trimming", "--disable_trim_poly_g"]) == 0
    lines = out.getvalue().decode().split("\n")
    names = [x for x in lines[:-1:4]]
    assert len(names) > 200 and names == sorted(names, key=lambda n: (int(n[2:].split()[0]), n)) and len(names) % 2 == 0
    bad = spark.read.format("fastq").load(str(tmp_path / "bad/failed/part-*")).count()
    assert len(names) + bad == 400
    assert main(["--stdout"]) == 2
