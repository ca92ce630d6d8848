"""The FASTQ source and sinks: every kind of file, wherever it is cut, and broken ones."""

import gzip
import random

import pytest

from helixmill.sources import fastq, lists


def _reads(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randrange(0, 90)
        q = "".join(rng.choice("@+!IJ~#") for _ in range(k))
        out.append((f"@r{i} 1:N:0:AC+GT", "".join(rng.choice("ACGTN") for _ in range(k)), "+", q))
    return out


def _text(reads, end="\n"):
    return "".join(end.join(r) + end for r in reads)


def test_plain_is_cut_anywhere(tmp_path):
    reads = _reads(120)
    p = tmp_path / "a.fastq"
    for end in ("\n", "\r\n"):
        p.write_bytes(_text(reads, end).encode())
        for size in (37, 100, 999, 10**6):
            got = [r for part in fastq.plan(str(p), size) for r in fastq.read_part(part)]
            assert [r[3:] for r in got] == reads, (end, size)


def test_bare_carriage_returns_and_missing_end(tmp_path):
    reads = _reads(5)
    p = tmp_path / "a.fastq"
    p.write_bytes(_text(reads, "\r").encode())
    assert [r[3:] for part in fastq.plan(str(p)) for r in fastq.read_part(part)] == reads
    p.write_bytes(_text(reads).rstrip("\n").encode())
    assert [r[3:] for part in fastq.plan(str(p)) for r in fastq.read_part(part)] == reads


def test_gzip_members_and_blocks(tmp_path):
    reads = _reads(400)
    p = tmp_path / "a.fastq.gz"
    p.write_bytes(gzip.compress(_text(reads[:100]).encode()) + gzip.compress(_text(reads[100:]).encode()))
    parts = fastq.plan(str(p))
    assert len(parts) == 1 and [r[3:] for r in fastq.read_part(parts[0])] == reads
    data = _text(reads).encode()
    p.write_bytes(b"".join(fastq.bgzf_block(data[i : i + 700]) for i in range(0, len(data), 700)) + fastq.BGZF_END)
    parts = fastq.plan(str(p), 1500)
    assert len(parts) > 3 and [r[3:] for q in parts for r in fastq.read_part(q)] == reads
    assert gzip.decompress(p.read_bytes()) == data


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("kind", ["plain", "bgzf"])
def test_ranges_read_what_the_whole_file_holds(tmp_path, end, kind):
    """Blank lines anywhere between records, every kind of line end, a missing last one: the same records for every size of the ranges."""
    rng = random.Random(3)
    reads = _reads(150)
    text = end * 3 + "".join(end.join(r) + end * rng.choice([1, 1, 1, 2, 4, 90 if i == 70 else 3]) for i, r in enumerate(reads))
    for cut in (text, text.rstrip(end)):
        data = cut.encode()
        p = tmp_path / "a.fastq"
        p.write_bytes(data if kind == "plain" else b"".join(fastq.bgzf_block(data[i : i + 600]) for i in range(0, len(data), 600)) + fastq.BGZF_END)
        for size in (1, 60, 300, 500, 5000, 10**7) if kind == "plain" else (60, 300, 500, 5000, 10**7):
            parts = fastq.plan(str(p), size)
            got = [r[3:] for part in parts for r in fastq.read_part(part)]
            assert got == reads if reads[-1][1] or cut is text else got[:-1] == reads[:-1], (size, len(got))


@pytest.mark.parametrize("size", [50, 400, 10**6])
def test_a_broken_record_is_never_passed_over(tmp_path, size):
    reads = _reads(60)
    for bad in range(0, 60, 7):
        lines = [list(r) for r in reads]
        lines[bad][0] = "no_name"
        p = tmp_path / "a.fastq"
        p.write_text(_text(lines))
        with pytest.raises(fastq.FormatError):
            [r for part in fastq.plan(str(p), size) for r in fastq.read_part(part)]


@pytest.mark.parametrize(
    "text",
    ["THIS_IS_NOT_A_FASTQ\nACGT\n+\nIIII\n", "@a\nACGT\n+\nIIII\n@b\nACGT\n", "@a\nACGT\n+\nII\n", "@a\nACGT\n-\nIIII\n", "@a\nACGT\n+\nII\x01I\n"],
)
def test_broken_files_fail(tmp_path, text):
    p = tmp_path / "a.fastq"
    p.write_text(text)
    with pytest.raises(fastq.FormatError):
        [r for part in fastq.plan(str(p)) for r in fastq.read_part(part)]


def test_truncated_gzip_fails(tmp_path):
    p = tmp_path / "a.fastq.gz"
    p.write_bytes(gzip.compress(_text(_reads(50)).encode())[:-20])
    with pytest.raises(fastq.FormatError):
        list(fastq.read_part(fastq.plan(str(p))[0]))


def test_through_spark(spark, tmp_path):
    reads = _reads(300)
    (tmp_path / "a.fastq").write_text(_text(reads))
    fastq.register(spark)
    df = fastq.ordinals(spark.read.format("fastq").option("rangeBytes", "900").load(str(tmp_path / "a.fastq")))
    rows = df.orderBy("read_id").collect()
    assert [(r.name, r.seq, r.strand, r.qual) for r in rows] == reads and [r.read_id for r in rows] == list(range(300))
    routed = df.selectExpr("if(read_id % 3 = 0, 'failed', 'out1') AS route", "read_id", "1 AS mate", "name", "seq", "strand", "qual")
    assert lists.write_routes(routed, str(tmp_path / "out"), "bgzf") == ["failed", "out1"]
    back = spark.read.format("fastq").load(str(tmp_path / "out/out1/part-*")).collect()
    assert [(r.name, r.seq, r.strand, r.qual) for r in sorted(back, key=lambda r: (r.path, r.part, r.record))] == [r for i, r in enumerate(reads) if i % 3]
    with pytest.raises(FileExistsError):
        lists.write_routes(routed, str(tmp_path / "out"), overwrite=False)


def test_fasta_and_barcodes(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacgt\nACGT\n>short\nACG\n>two\nACGTACGT\n>one x\nTTTTTTTT\n")
    assert sorted(map(tuple, lists.fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one x", "TTTTTTTT"), ("two", "ACGTACGT")]
    (tmp_path / "b.txt").write_text("ACGT\n\nTTTT\n")
    assert lists.barcodes(spark, str(tmp_path / "b.txt")) == ["ACGT", "TTTT"]
    (tmp_path / "b.txt").write_text("ACGN\n")
    with pytest.raises(fastq.FormatError):
        lists.barcodes(spark, str(tmp_path / "b.txt"))
