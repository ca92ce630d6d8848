"""Read-level functions as Catalyst expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Result codes, larger is worse, and the tag a failed read gets.
PASS, N_BASE, LENGTH, TOO_LONG, QUALITY, COMPLEXITY, ADAPTER_DIMER = 0, 12, 16, 17, 20, 24, 28
TAGS = {PASS: "passed", N_BASE: "failed_too_many_n_bases", LENGTH: "failed_too_short", TOO_LONG: "failed_too_long", QUALITY: "failed_quality_filter", COMPLEXITY: "failed_low_complexity", ADAPTER_DIMER: "failed_adapter_dimer"}

_col = lambda c: F.col(c) if isinstance(c, str) else c


def reverse_complement(seq) -> Column:
    """Complement of either case in upper case, anything else N, reversed. Null stays null."""
    return F.reverse(F.translate(F.regexp_replace(_col(seq), "[^ACGTacgt]", "N"), "ACGTacgt", "TGCATGCA"))


def count_of(text, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(_col(text)) - F.length(F.translate(_col(text), characters, ""))


def low_quality_bases(qual, phred: int) -> Column:
    return count_of(qual, "".join(map(chr, range(33, 33 + phred))))


def quality_sum(qual) -> Column:
    return F.aggregate(F.split(_col(qual), ""), F.lit(0), lambda total, c: total + F.when(c == "", 0).otherwise(F.ascii(c) - 33))


def changes(seq) -> Column:
    """Neighbouring characters that differ."""
    s = _col(seq)
    return F.when(F.length(s) > 1, F.size(F.filter(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(1)) != F.substring(s, i + 1, F.lit(1))))).otherwise(0)


def complex_enough(seq, percent: int = 30) -> Column:
    """At least ``percent`` % of the steps to the next base change it; reads of one base or none fail."""
    s = _col(seq)
    return F.when(F.length(s) > 1, changes(s) * 100 >= percent * (F.length(s) - 1)).otherwise(False)


def poor_adapter(seq) -> Column:
    """Fewer than half of an adapter's letters differ from the one before (half rounded down); null stays null."""
    s = _col(seq)
    return F.when(s.isNotNull(), changes(s) < F.floor(F.length(s) / 2))


def hamming(a, b) -> Column:
    """Differences over the shorter length."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))).otherwise(0)


def last_index(name) -> Column:
    """The index at the end of a read name, after its last : or +; the last three characters don't end it."""
    return F.when(F.length(_col(name)) >= 5, F.regexp_extract(_col(name), r"[:+]([^:+]*.{2})$", 1)).otherwise("")


def first_index(name) -> Column:
    """The first index of a read name: between its last : and the + that follows, if any."""
    return F.when(F.length(_col(name)) >= 5, F.regexp_extract(_col(name), r":([^:+]*)(\+[^:]*)?$", 1)).otherwise("")


def mgi_fix(name) -> Column:
    """A space before a trailing /1 or /2."""
    return F.regexp_replace(_col(name), r"/([12])$", " /$1")


def tag_name(name, umi, delimiter: str = ":", prefix: str = "") -> Column:
    """The UMI put before the first space of a read name."""
    mark = F.concat(F.lit(delimiter + (prefix + "_" if prefix else "")), umi)
    return F.when(F.length(umi) > 0, F.concat(F.regexp_extract(_col(name), r"^([^ ]*)", 1), mark, F.regexp_extract(_col(name), r"^[^ ]*(.*)$", 1))).otherwise(_col(name))


def phred64_to_33(qual) -> Column:
    """max(33, q - 31) of every character."""
    src = "".join(map(chr, range(33, 127)))
    return F.translate(_col(qual), src, "".join(chr(max(33, ord(c) - 31)) for c in src))


def verdict(seq, qual, *, qualified: int = 15, unqualified_percent: int = 40, n_limit: int = 5, average: int = 0, shortest: int = 15, longest: int = 0, complexity: int | None = None, quality_filter: bool = True, length_filter: bool = True) -> Column:
    """Result code of a read; the first rule that fails counts. Null and empty reads are too short."""
    s, q = F.coalesce(_col(seq), F.lit("")), F.coalesce(_col(qual), F.lit(""))
    n = F.length(s)
    out = F.when(n == 0, LENGTH)
    if quality_filter:
        out = out.when(low_quality_bases(q, qualified) * 100 > unqualified_percent * n, QUALITY)
        if average > 0:
            out = out.when(F.floor(quality_sum(q) / n) < average, QUALITY)
        out = out.when(count_of(s, "N") > n_limit, N_BASE)
    if length_filter:
        out = out.when(n < shortest, LENGTH)
        if longest > 0:
            out = out.when(n > longest, TOO_LONG)
    if complexity is not None:
        out = out.when(~complex_enough(s, complexity), COMPLEXITY)
    return out.otherwise(PASS)


def tag(code) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TAGS.items():
        out = F.when(_col(code) == k, v).otherwise(out)
    return out


def register(spark: SparkSession) -> None:
    """SQL functions of the engine: expressions as SQL functions, kernels as Arrow functions, and a table function for FASTQ text."""
    from pyspark.sql.functions import pandas_udf, udtf

    from helixmill.functions import kernels
    from helixmill.functions.kernels import Reads, adapter_at, poly_g_end, poly_x_end

    sql = {
        "revcomp": ("(s STRING) RETURNS STRING", "reverse(translate(regexp_replace(s, '[^ACGTacgt]', 'N'), 'ACGTacgt', 'TGCATGCA'))"),
        "hamming": ("(a STRING, b STRING) RETURNS INT", "CASE WHEN least(length(a), length(b)) > 0 THEN size(filter(sequence(1, least(length(a), length(b))), i -> substring(a, i, 1) <> substring(b, i, 1))) ELSE 0 END"),
        "phred": ("(c STRING) RETURNS INT", "ascii(c) - 33"),
    }
    for name, (head, body) in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{head} RETURN {body}")

    spark.udf.register("poly_g_len", pandas_udf(lambda s: pd.Series(poly_g_end(Reads(s.fillna("").tolist()))).astype("int32"), "int"))
    spark.udf.register("poly_x_len", pandas_udf(lambda s: pd.Series(poly_x_end(Reads(s.fillna("").tolist()))[0]).astype("int32"), "int"))
    def by_value(columns: list[pd.Series], run) -> dict:
        """``run`` on the rows of each combination of the values of ``columns``: arguments may differ from row to row."""
        out: dict = {}
        for key, rows in pd.DataFrame(dict(enumerate(columns))).groupby(list(range(len(columns))), dropna=False).indices.items():
            for i, v in zip(rows, run(rows, *(key if isinstance(key, tuple) else (key,)))):
                out[i] = v
        return out

    def place(s: pd.Series, a: pd.Series) -> pd.Series:
        texts = s.fillna("")
        got = by_value([a], lambda rows, adapter: adapter_at(Reads(texts.iloc[rows].tolist()), adapter) if adapter == adapter and adapter else texts.iloc[rows].str.len())
        return pd.Series([int(got[i]) for i in range(len(s))], dtype="int32")

    def trim(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t[: max(0, at)] for t, at in zip(s.astype(object).where(s.notna(), None), place(s, a))], dtype="object")

    def cut(s: pd.Series, q: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        seqs, quals = s.fillna(""), q.fillna("")

        def run(rows, window, mean):
            kept, a, b = kernels.quality_cut(Reads(seqs.iloc[rows].tolist()), Reads(quals.iloc[rows].tolist()), 0, 0, cut_tail=(int(window), int(mean)))
            return [x[i:j] if k else None for x, k, i, j in zip(seqs.iloc[rows], kept, a, b)]

        got = by_value([w, m], run)
        return pd.Series([got[i] for i in range(len(s))], dtype="object")

    def overlaps(s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        found, offset, length, diff = kernels.overlap(Reads(s1.fillna("").tolist()), Reads(s2.fillna("").tolist()))
        return pd.DataFrame({"overlapped": found, "offset": offset.astype("int32"), "overlap_len": length.astype("int32"), "diff": diff.astype("int32")})

    spark.udf.register("adapter_pos", pandas_udf(place, "int"))
    spark.udf.register("trim_adapter", pandas_udf(trim, "string"))
    spark.udf.register("quality_cut", pandas_udf(cut, "string"))
    spark.udf.register("overlap", pandas_udf(overlaps, "overlapped boolean, offset int, overlap_len int, diff int"))

    @udtf(returnType="name string, seq string, strand string, qual string")
    class FastqParse:
        """Rows of a FASTQ text."""

        def eval(self, text: str):
            lines = (text or "").splitlines()
            for i in range(0, len(lines) - 3, 4):
                yield tuple(lines[i : i + 4])

    spark.udtf.register("fastq_parse", FastqParse)
