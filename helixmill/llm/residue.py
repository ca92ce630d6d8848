"""Template residue, filler, error pages and script notices in place of content.

Character n-gram models are fitted for four kinds of residue and for natural prose. Three kinds are told by their letters: filler, error
messages and notices, and values that a script failed to fill in or notes to the writer. Unfilled fields are told by the shape of
the text, in which every run of letters or digits is one sign, whatever the name of the field. Every character gets a
log-likelihood ratio of each kind against prose; windows with a high sum localise the residue, and a document is
excluded if they cover enough characters of one kind. What is quoted or stands in nowiki, pre or syntaxhighlight isn't
content and is taken out first.

Prose is learned from all documents: trigrams of letters, and shapes of up to five signs, in which rare contexts are smoothed away, so that
residue can't teach prose its own marks. The kinds are learned from the wording in ``residue_seeds`` (general knowledge: status
phrases, common notices and fillers in several languages, syntaxes of template engines; none was taken from the documents) and then
from weak labels: lines of a bounded sample of documents that the first models cover for the most part are added as
examples, and the models are fitted again, so that they learn how the corpus at hand words its residue.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.residue_seeds import MENTIONS, families
from helixmill.llm.sample import sampled
from helixmill.operators.exchange import from_planes, planes
from helixmill.operators.staging import staged

_APART = re.compile(r"<(nowiki|pre|syntaxhighlight|math)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_QUOTED = re.compile(r"\"[^\"\n]{2,300}\"|“[^”\n]{2,300}”|«[^»\n]{2,300}»|„[^“”\n]{2,300}[“”]|(?<!')''(?!')[^'\n]*[^'\n\W][ ][^'\n]*''(?!')")

_REDIRECT = re.compile(r"\s*#\w+:?\s*\[\[")

ORDER, BITS = 5, 18
_LETTERS = {c: n + 1 for n, c in enumerate(" \nabcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~äöüßéèàçñíóá")}
_OTHER, ALPHABET = 110, 140
_CODE = np.full(0x3000, _OTHER, np.uint8)
for _c, _n in _LETTERS.items():
    _CODE[ord(_c)] = _n
_CODE[ord("1") : ord("9") + 1] = _LETTERS["0"]
_CODE[ord("\t")] = _LETTERS[" "]
_CODE[0x400:0x530] = 109  # Cyrillic letters are kept apart below
_CODE[0x430:0x450] = 112 + np.arange(32) % 28


# shapes: letters of either case, digits, space, line end, other letters, and the marks themselves
_MARKS = {c: n + 8 for n, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}
_SHAPE = np.full(ALPHABET, 5, np.int64)
for _c, _n in _LETTERS.items():
    _SHAPE[_n] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c == "0" else 4 if _c == " " else 6 if _c == "\n" else _MARKS.get(_c, 5)
_SHAPE[109], _SHAPE[112:] = 1, 1  # letters without case, or kept apart only to be told by their letters
_SHAPE[0] = 0


@dataclass(frozen=True)
class ResidueOptions:
    """Per kind: characters (signs, for fields) of a window, least sum of log-likelihood ratios in it, least covered characters in a document.

    learn: for the kinds that are learned from the corpus too, the least sum for that.
    rare, rare_shape: contexts with a smaller share of all characters, or signs, say little about prose, so that residue can't teach it its own marks.
    sample: documents that weak labels are looked for in, chosen by a hash of their id. lines: most lines learned a kind. share: of a line
    that must be covered by one kind for it to be learned. rounds: of learning lines.
    """

    window: dict = field(default_factory=lambda: {"field": 4, "value": 10, "filler": 36, "notice": 28})
    score: dict = field(default_factory=lambda: {"field": 6.5, "value": 6.5, "filler": 0.0, "notice": 4.0})
    learn: dict = field(default_factory=lambda: {"filler": 8.0, "notice": 12.0})
    cover: dict = field(default_factory=lambda: {"field": 2, "value": 8, "filler": 30, "notice": 24})
    floor: float = -3.0
    ceiling: dict = field(default_factory=lambda: {"field": 6.0, "value": 4.0, "filler": 4.0, "notice": 4.0})
    smooth: float = 0.5
    rare: float = 5e-5
    rare_shape: float = 6e-4
    sample: int = 20_000
    lines: int = 2_000
    share: float = 0.4
    rounds: int = 2
    longest: int = 400
    seed: int = 3


KINDS = ("field", "value", "filler", "notice")


def content(text: str) -> str:
    """The text without what is quoted or set apart. Redirects have no content."""
    if _REDIRECT.match(text):
        return ""
    return _QUOTED.sub(" ", _APART.sub(" ", text))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers below ALPHABET, and where each text begins; a 0 stands before each text."""
    joined = "\0" + "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], _OTHER).astype(np.int64)
    wide = points >= 0x3000
    codes[wide] = 112 + points[wide] % 28  # ideographs and kana share few numbers; long matches still tell them apart
    codes[points == 0] = 0
    return codes, np.flatnonzero(points == 0) + 1


def shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the shape, and the place in ``codes`` of the first character of each. Runs of one class of letters, of digits or of blanks are one sign."""
    sign = _SHAPE[codes]
    first = np.ones(len(sign), bool)
    first[1:] = (sign[1:] != sign[:-1]) | (sign[1:] > 5) | (sign[1:] == 0)
    at = np.flatnonzero(first)
    out = sign[at]
    out[(out == 1) & (np.diff(np.append(at, len(sign))) == 1)] = 7  # a letter alone is no word
    return out, at


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Number of the n characters that end at each place; places too near the start get what there is."""
    out = np.zeros(len(codes), np.int64)
    for i in range(n):
        out[i:] += codes[: len(codes) - i] * ALPHABET**i
    return out


def _slot(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


class Ngrams:
    """Interpolated character model up to ORDER, in hashed count tables of a fixed size."""

    def __init__(self, codes: np.ndarray, smooth: float):
        self.smooth = np.float32(smooth)
        self.counts = [np.bincount(_slot(_grams(codes, n), n), minlength=1 << BITS).astype(np.float32) for n in range(1, ORDER + 1)]
        self.total = np.float32(len(codes))

    def logs(self, slots: list[np.ndarray]) -> np.ndarray:
        """Log probability of each character given those before it. ``slots``: of the 1-, 2-, ... grams at each place."""
        p = (self.counts[0][slots[0]] + np.float32(0.5)) / (self.total + np.float32(0.5 * ALPHABET))
        for n in range(1, ORDER):
            context = np.concatenate([[np.float32(0)], self.counts[n - 1][slots[n - 1][:-1]]])
            p = (np.minimum(self.counts[n][slots[n]], context) + self.smooth * p) / (context + self.smooth)
        return np.log(p)


class ShapeProse(Ngrams):
    """The same of counted tables, with contexts smoothed by a share of all signs."""

    def __init__(self, tables: np.ndarray, rare: float):
        self.counts = [t.astype(np.float32) for t in tables]
        self.total = np.float32(self.counts[0].sum())
        self.smooth = np.float32(max(1.0, rare * self.total))


def counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each trigram of letters and each shape of up to ORDER signs (by slot) stands in all documents: tables of a fixed size.

    A task sums its documents; stripes of the sums move packed and are added, and only the totals reach the driver.
    """
    stripe = 1 << 16
    size = ALPHABET**3 + ORDER * (1 << BITS)

    def unpacked(part: bytes, begin: int) -> np.ndarray:
        n = min(stripe, size - begin)
        return from_planes(pa.decompress(part, decompressed_size=8 * n, codec="zstd", asbytes=True), n, np.int64)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = [content(t) for t in batch.column(0).to_pylist() if t]
            for lo, hi in _chunks([len(t) for t in texts], 1 << 20):
                codes = encode(texts[lo:hi])[0]
                total[: ALPHABET**3] += np.bincount(_grams(codes, 3), minlength=ALPHABET**3)
                sign, _ = shapes(codes)
                for n in range(1, ORDER + 1):
                    begin = ALPHABET**3 + (n - 1) * (1 << BITS)
                    total[begin : begin + (1 << BITS)] += np.bincount(_slot(_grams(sign, n), n), minlength=1 << BITS)
        cells = [(i, total[i : i + stripe]) for i in range(0, size, stripe)]
        cells = [(i, pa.compress(planes(c), codec="zstd", asbytes=True)) for i, c in cells if c.any()]  # mostly zeros and small numbers
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cells], pa.int64()), pa.array([c for _, c in cells], pa.binary())], names=["begin", "part"])

    def add(frame):
        import pandas as pd

        begin = int(frame["begin"].iloc[0])
        total = sum(unpacked(p, begin) for p in frame["part"])
        return pd.DataFrame({"begin": [begin], "part": [pa.compress(planes(total), codec="zstd", asbytes=True)]})

    out = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(count, "begin long, part binary").groupBy("begin").applyInPandas(add, "begin long, part binary").collect():  # the tables' fixed size
        part = unpacked(bytes(r["part"]), r["begin"])
        out[r["begin"] : r["begin"] + len(part)] = part
    return out[: ALPHABET**3], out[ALPHABET**3 :].reshape(ORDER, 1 << BITS)


class Judge:
    """The fitted models and the windows. ``more``: further examples of each kind."""

    def __init__(self, counts: np.ndarray, forms: np.ndarray, opts: ResidueOptions, more: dict[str, list[str]] | None = None, without: tuple = ()):
        self.opts = opts
        seeds = {k: [] for k in KINDS}
        for name, (kind, examples) in families().items():
            if name not in without:
                seeds[kind] += examples
        all_of = lambda k: encode(seeds[k] + (more or {}).get(k, []))[0]
        self.kinds = {k: Ngrams(shapes(all_of(k))[0] if k == "field" else all_of(k), opts.smooth) for k in KINDS}
        self.mention = Ngrams(encode(MENTIONS * 2)[0], opts.smooth)
        c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * ALPHABET)
        rare = max(1.0, opts.rare * c1.sum())
        p2 = (c2 + rare * p1) / (c2.sum(1, keepdims=True) + rare)
        p3 = (c3 + rare * p2[None]) / (c3.sum(2, keepdims=True) + rare)
        self.prose = np.log(p3).astype(np.float32).ravel()
        self.forms = ShapeProse(forms, opts.rare_shape)

    def marked(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        """For each kind, which characters lie in windows that score high enough."""
        slots = [_slot(_grams(codes, n), n) for n in range(1, ORDER + 1)]
        prose = np.maximum(self.prose[_grams(codes, 3)], self.mention.logs(slots))
        out = {}
        for kind, model in self.kinds.items():
            if kind == "field":
                sign, at = shapes(codes)
                own = [_slot(_grams(sign, n), n) for n in range(1, ORDER + 1)]
                hit = self._windows(kind, model.logs(own) - self.forms.logs(own), sign == 0)
                out[kind] = np.repeat(hit, np.diff(np.append(at, len(codes))))
            else:
                out[kind] = self._windows(kind, model.logs(slots) - prose, codes == 0)
        return out

    def _windows(self, kind: str, ratio: np.ndarray, ends: np.ndarray) -> np.ndarray:
        w = self.opts.window[kind]
        ratio = ratio.clip(self.opts.floor, self.opts.ceiling[kind]).astype(np.float64)
        ratio[ends] = -1e3  # no window reaches over the end of a text
        total = np.concatenate([[0], np.cumsum(ratio)])
        high = np.zeros(len(ratio) + 1, np.int64)
        if len(ratio) >= w:
            at = np.flatnonzero(total[w:] - total[:-w] >= self.opts.score[kind])
            np.add.at(high, at, 1)
            np.add.at(high, at + w, -1)
        return np.cumsum(high[:-1]) > 0

    def covered(self, texts: list[str]) -> dict[str, np.ndarray]:
        """For each kind, how many characters of each text are marked. Long texts are judged in pieces that overlap by a window."""
        out = {k: np.zeros(len(texts), np.int64) for k in KINDS}
        pieces = [(n, lo) for n, t in enumerate(texts) for lo in range(0, max(1, len(t)), PIECE)]
        lap = 8 * max(self.opts.window.values())
        for a, b in _chunks([min(len(texts[n]) - lo, PIECE) for n, lo in pieces], PIECE):
            some = pieces[a:b]
            codes, begin = encode([texts[n][max(0, lo - lap) : lo + PIECE + lap] + "\n" for n, lo in some])  # the end of a text is the end of a line
            for kind, hit in self.marked(codes).items():
                inside = np.concatenate([[0], np.cumsum(hit)])
                for (n, lo), at in zip(some, begin):
                    first = at + min(lo, lap)
                    out[kind][n] += inside[first + min(PIECE, len(texts[n]) - lo)] - inside[first]
        return out


#: Characters of a text that are judged at once.
PIECE = 200_000


def weak_labels(docs: DataFrame, judge: Judge, opts: ResidueOptions) -> dict[str, list[str]]:
    """Lines of a sample of documents that the models cover for the most part, at most ``lines`` a kind, each once."""
    strict = copy.copy(judge)
    strict.opts = replace(opts, score=opts.score | opts.learn)
    known = docs.sparkSession.sparkContext.broadcast(strict)

    def find(batches):
        for batch in batches:
            rows = []
            for lo, hi in _chunks([len(t) for t in batch.column(0).to_pylist()], PIECE):
                lines = sorted({x for t in batch.column(0)[lo:hi].to_pylist() for x in content(t).split("\n") if 8 <= len(x) <= opts.longest})
                for kind, n in known.value.covered(lines).items() if lines else ():
                    rows += [(kind, lines[i]) for i in np.flatnonzero(n >= opts.share * np.array([len(x) for x in lines]))] if kind in opts.learn else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "line"])

    found = staged(sampled(docs, opts.sample, opts.seed).select("text").mapInArrow(find, "kind string, line string").distinct(), "lines")
    out: dict[str, list[str]] = {}
    for kind in opts.learn:  # bounded lists of bounded lines
        out[kind] = [r["line"] for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("line"), "line").limit(opts.lines).collect()]
    return out


def fitted(docs: DataFrame, opts: ResidueOptions = ResidueOptions(), without: tuple = ()) -> Judge:
    """Models fitted on the seeds (but those of the families ``without``), then on the weak labels they find. ``docs``: doc_id, text without nulls."""
    counts, forms = counted(docs)
    judge = Judge(counts, forms, opts, without=without)
    for _ in range(opts.rounds):
        judge = Judge(counts, forms, opts, weak_labels(docs, judge, opts), without)
    return judge


def residue(docs: DataFrame, opts: ResidueOptions = ResidueOptions()) -> DataFrame:
    """(doc_id, kind, covered): documents to exclude, one row per kind of residue that covers enough of them.

    ``docs``: doc_id, text; other columns are ignored. Null and empty texts hold nothing; documents without an id are
    left out; repeated rows of one doc_id count once; texts are judged whole, in pieces of bounded size; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    judge = docs.sparkSession.sparkContext.broadcast(fitted(docs, opts))

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for lo, hi in _chunks([len(t) for t in texts], PIECE):
                for kind, n in judge.value.covered([content(t) for t in texts[lo:hi]]).items():
                    rows += [(ids[lo + i], kind, int(n[i])) for i in np.flatnonzero(n >= opts.cover[kind])]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "kind", "covered"])

    return docs.mapInArrow(scan, "doc_id long, kind string, covered long").groupBy("doc_id", "kind").agg(F.max("covered").alias("covered"))


def _chunks(sizes: list[int], most: int):
    """Ranges of texts of at most so many characters together, or a single longer one."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)
