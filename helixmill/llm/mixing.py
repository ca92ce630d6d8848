"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

Weights: the token shares p of the sources are exponentiated. With an entropy as the target, the exponent t of p^t is
bisected until the weights have it. With target shares, the weights are p (target / p)^t, from the natural shares
(t = 0) to the targets (t = 1), and t is bisected to the largest at which no source would be repeated more often than
it may be within the budget. Without a budget, it is the largest at which the targets are reached in full, and t is 1.

Draw: the documents of a source stand in a pseudo-random order by a hash. A source with budget b and n tokens is taken
whole floor(b / n) times; of the last round it gives the blocks at the front of the order that fill the rest. Where they
end is found by descending through the hash, 256 blocks at a time, from token sums that are aggregated before they move.

Order: in every round the blocks of a source, ranges of the hash of about ``block`` tokens, are permuted anew, and spread evenly
over the whole mix; read in the order of ``turn``, every stretch of the mix has about the weights.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.staging import BROADCAST_BYTES, staged

#: Fixed value: the pattern that cuts text before byte pairs are merged in the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _encoder(vocabulary: bytes):
    name = hashlib.sha1(vocabulary).hexdigest()
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def token_sizes(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, tokens) of every document with an id, a source and a text; special tokens' strings count as text.

    ``path``: on the driver, the vocabulary file of a byte-pair tokenizer, one token in base 64 and its rank a line.
    """
    with open(path, "rb") as f:
        vocabulary = f.read(BROADCAST_BYTES + 1)
    if len(vocabulary) > BROADCAST_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sizes(batches):
        for batch in batches:
            enc = _encoder(known.value)
            n = [len(enc.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("doc_id is not null and source is not null and text is not null and text <> ''")
    return usable.mapInArrow(sizes, "doc_id long, source string, tokens long")


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def temperature_weights(shares: np.ndarray, target_entropy: float) -> tuple[np.ndarray, float]:
    """Weights p^t, normalised, of the entropy asked for, and t. Entropies out of reach give t at the end of [0, 64]."""
    p = np.asarray(shares, float)
    there = p > 0

    def at(t: float) -> np.ndarray:
        logs = np.where(there, t * np.log(np.where(there, p, 1.0)), -np.inf)
        w = np.exp(logs - logs.max())
        return w / w.sum()

    lo, hi = 0.0, 64.0  # entropy falls as t grows
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(at(mid)) > target_entropy else (lo, mid)
    return at((lo + hi) / 2), (lo + hi) / 2


def target_weights(tokens: np.ndarray, target: np.ndarray, most: np.ndarray, budget: float | None = None) -> tuple[np.ndarray, float, float]:
    """(weights, exponent, budget) for sources with so many tokens, target shares and most repeats.

    Sources without tokens or without a share get none, the rest of the target is normalised. Without a budget it is the largest
    at which every source reaches its target.
    """
    tokens, target, most = (np.asarray(x, float) for x in (tokens, target, most))
    live = (tokens > 0) & (target > 0) & (most > 0)
    if not live.any():
        return np.zeros(len(tokens)), 1.0, 0.0
    share = np.where(live, tokens, 0) / tokens[live].sum()
    aim = np.where(live, target, 0) / target[live].sum()

    def at(t: float) -> np.ndarray:
        w = np.where(live, np.where(live, share, 1) * (np.where(live, aim, 1) / np.where(live, share, 1)) ** t, 0)
        return w / w.sum()

    room = lambda t: float((most[live] * tokens[live] / at(t)[live]).min())  # noqa: E731  (largest budget that the repeats allow)
    aimed = room(1.0) if budget is None else float(budget)
    lo, hi = 0.0, 1.0
    while room(hi) < aimed and hi - lo > 1e-15:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if room(mid) >= aimed else (lo, mid)
    t = hi if room(hi) >= aimed else lo
    return at(t), t, min(aimed, room(t))


@dataclass(frozen=True)
class MixOptions:
    """seed of the order. budget in tokens (None: as large as the targets allow), or ``of_all``: as a share of the tokens of all
    sources. ``even``: instead of the targets, weights p^t with this share of the entropy of equal weights.
    block: tokens of a block in the order; the descent ends at blocks of about ``last`` documents."""

    seed: int = 17
    budget: float | None = None
    of_all: float | None = None
    even: float | None = None
    block: int = 1 << 20
    last: int = 256


_LEVELS = 7  # bytes of the hash that the descent may use


def weights_of(tokens: list[int], target: list[float], most: list[int], opts: MixOptions) -> tuple[np.ndarray, float, float]:
    """(weights, exponent, budget) as the options ask."""
    budget = opts.of_all * sum(tokens) if opts.of_all is not None else opts.budget
    if opts.even is None:
        return target_weights(tokens, target, most, budget)
    p = np.where((np.asarray(target) > 0) & (np.asarray(most) > 0), tokens, 0).astype(float)
    if not p.sum():
        return np.zeros(len(p)), 0.0, 0.0
    w, t = temperature_weights(p / p.sum(), opts.even * math.log((p > 0).sum()))
    room = min(m * n / x for m, n, x in zip(most, tokens, w) if x > 0)
    return w, t, room if budget is None else min(budget, room)


def mix(docs: DataFrame, targets: DataFrame, path: str, opts: MixOptions = MixOptions(), sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(draw, report). draw: doc_id, source, tokens, round, block, turn; every use of a drawn document once: in which round over its
    source, in which block of the round's permutation, and where in the mix, from 0 to 1. report: one row per source of ``targets`` with
    its target, the normalised weight and the exponent it comes from, its tokens, the tokens drawn, the share reached and the most uses of a document.

    ``sizes``: the documents' sizes as from ``token_sizes``, where several mixes share them.
    ``targets``: source, target_share, max_repeats; the few sources there are, null or repeated ones are left out.
    Documents without a source or of a source not in ``targets``, without text or tokens are never drawn. An empty table gives an empty draw.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: r for r in targets.where("source is not null").orderBy(F.desc("source")).collect()}
    names = sorted(wanted)
    known = F.col("source").isin(names or [""])
    sized = (sizes.where(known) if sizes is not None else token_sizes(docs.where(known), path)).where("tokens > 0")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(opts.seed), "doc_id"), 8)  # 56 bits, not negative
    sized = staged(sized.withColumn("place", order), "sized")
    totals = {r["source"]: (r["tokens"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    tokens = [totals.get(s, (0, 0))[0] for s in names]
    most = [wanted[s]["max_repeats"] or 0 for s in names]
    weights, exponent, budget = weights_of(tokens, [wanted[s]["target_share"] or 0.0 for s in names], most, opts)
    whole, rest = {}, {}
    for s, w, n, m in zip(names, weights, tokens, most):
        if n:
            part = w * budget
            whole[s] = int(min(math.floor(part / n + 1e-12), m))
            rest[s] = part - whole[s] * n if whole[s] < m else 0.0
    ends = _ends(sized, rest, {s: totals[s][1] for s in whole}, opts)
    rows = [x for s, n in zip(names, tokens) if n for x in _rounds(s, n, whole[s], ends[s], opts)]
    kinds = "source string, round int, upto long, blocks long, front long, step long, shift long, begin double, width double"
    rounds = F.broadcast(spark.createDataFrame(rows, kinds))  # one row per source of the targets and round
    block = F.floor(F.col("place") / F.lit(float(1 << 56)) * F.col("blocks")).cast("long")
    draw = sized.join(rounds, "source").where("place < upto").withColumn("block", F.pmod(block * F.col("step") + F.col("shift"), F.col("front")))
    turn = F.col("begin") + F.col("width") * (F.col("block") + F.col("place") / F.lit(float(1 << 56)) * F.col("blocks") - block) / F.col("front")
    draw = draw.select("doc_id", "source", "tokens", "round", "block", turn.alias("turn"))
    used = sized.join(F.broadcast(spark.createDataFrame([(s, whole[s], ends[s]) for s in whole], "source string, whole int, upto long")), "source")  # one row per source
    used = used.withColumn("repeats", F.col("whole") + (F.col("place") < F.col("upto")).cast("int"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.max("repeats").alias("most_repeats"))
    goal = spark.createDataFrame([(s, float(wanted[s]["target_share"] or 0.0), float(w), int(n), float(exponent)) for s, w, n in zip(names, weights, tokens)], "source string, target_share double, weight double, tokens long, exponent double")
    report = goal.join(F.broadcast(got), "source", "left")  # one row per source of the targets
    share = F.coalesce(F.col("drawn") / F.sum("drawn").over(Window.partitionBy()), F.lit(0.0))
    return draw, report.select("source", "target_share", "weight", "exponent", "tokens", F.coalesce("drawn", F.lit(0)).alias("drawn"), share.alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


def _rounds(source: str, tokens: int, whole: int, upto: int, opts: MixOptions) -> list[tuple]:
    """A source's rounds: up to where its order is used, how many blocks it has and uses, the permutation x step + shift of those, and
    the stretch of the mix that they are spread over."""
    blocks = max(1, -(-tokens // opts.block))
    part = min(1.0, upto / 2**56)
    rng, out, total = random.Random(f"{opts.seed} {source}"), [], whole + part
    for n in range(whole + (part > 0)):
        front = blocks if n < whole else max(1, math.ceil(part * blocks))
        step = next(x for x in iter(lambda: rng.randrange(1, front + 1), None) if math.gcd(x, front) == 1)
        out.append((source, n, 1 << 56 if n < whole else upto, blocks, front, step, rng.randrange(front), n / total, (1.0 if n < whole else part) / total))
    return out


def _ends(sized: DataFrame, rest: dict[str, float], counts: dict[str, int], opts: MixOptions) -> dict[str, int]:
    """For each source the place in the order before which its documents fill the rest of its budget, to within one document.

    Each level sums the tokens of 256 blocks per source (map-side first) and steps into the block where the budget ends, until that
    block holds about ``last`` documents, which are then summed one by one.
    """
    ends, left = {s: 0 for s in rest}, {s: r for s, r in rest.items() if r > 0}
    begin, width, docs_in = {s: 0 for s in left}, 1 << 56, dict(counts)
    for _ in range(_LEVELS):
        if not left or width <= 1 or all(docs_in[s] <= opts.last for s in left):
            break
        width >>= 8
        inside = _within(begin, width << 8)
        block = F.floor(F.col("place") / width)
        got: dict[str, list] = {}
        for r in sized.where(inside).groupBy("source", block.alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # at most 256 a source
            got.setdefault(r["source"], []).append((r["b"], r["t"], r["n"]))
        for s in list(left):
            for b, t, n in sorted(got.get(s, [])):
                if t > left[s]:
                    begin[s], docs_in[s] = b * width, n
                    break
                left[s] -= t
            else:  # all of them fit
                ends[s] = begin[s] + (width << 8)
                del left[s], begin[s]
    if left:
        got = {}
        for r in sized.where(_within(begin, width)).select("source", "place", "tokens").collect():  # about ``last`` documents a source
            got.setdefault(r["source"], []).append((r["place"], r["tokens"]))
        for s in left:
            ends[s] = begin[s]
            for place, t in sorted(got.get(s, [])):
                if t > 2 * left[s]:  # the nearer side of the budget
                    break
                left[s] -= t
                ends[s] = place + 1
    return ends


def _within(begin: dict[str, int], width: int):
    cond = F.lit(False)
    for s, b in begin.items():
        cond = cond | ((F.col("source") == s) & (F.col("place") >= F.lit(b)) & (F.col("place") < F.lit(b + width)))
    return cond
