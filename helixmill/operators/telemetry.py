"""Resource readings: implausible readings by a Kalman filter, and regular series by singular-spectrum imputation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.ordered import blocks, ranked
from helixmill.operators.staging import join_checked, staged

#: What a reading can be at all.
POSSIBLE = {"rss_mib": (1, 262144), "gpu_mem_mib": (0, 81920), "gpu_util_pct": (0, 100)}


def samples(df: DataFrame) -> DataFrame:
    """One row per sample_id with ``source`` (input_file after its last /) and ``epoch`` in seconds.

    Of repeated rows the one received first counts; they are told apart by content where that ties. Rows without a
    sample_id, a source or an epoch are ignored. Epochs above 10^11 are milliseconds and are divided rounding down.
    """
    keep = ["sample_id", "epoch_s", "cpu_pct", "rss_mib", "gpu_util_pct", "gpu_mem_mib", "input_file"]
    body = F.struct("received_at", *keep[1:])
    once = df.where("sample_id is not null").groupBy("sample_id").agg(F.min(body).alias("s")).select("sample_id", *[F.col(f"s.{c}").alias(c) for c in keep[1:]])
    source = F.element_at(F.split("input_file", "/"), -1)
    epoch = F.when(F.col("epoch_s") > 10**11, F.floor(F.col("epoch_s") / 1000)).otherwise(F.col("epoch_s")).cast("long")
    out = once.withColumn("source", source).withColumn("epoch", epoch)
    return out.where("source is not null and source <> '' and epoch is not null").drop("input_file", "epoch_s")


def readings(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form (source, metric, epoch, sample_id, value) of the non-null readings."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select("source", "epoch", "sample_id", pairs.alias("m")).select("source", "m.metric", "epoch", "sample_id", "m.value").where("value is not null and not isnan(value)")


@dataclass(frozen=True)
class SpikeOptions:
    """A reading is the source's median plus a state s' = phi s + w plus noise.

    phis, shares, widths: what each source's model is chosen from by the likelihood of its innovations: how much of the state stays
    from one reading to the next, which share of the variance is the state's, and the deviation in units of the source's
    robust deviation (1.4826 times the median distance from the median, at least of 1).
    z: standardised innovation beyond which a reading is flagged and its update withheld.
    near: the state is kept within so many robust deviations of the median.
    run: successive readings over which a vanished innovation variance is a stuck value.
    step: seconds after which the state has decayed once; longer gaps decay it further.

    Every reading further than 12 median distances from the median is flagged, whatever came before: 12 distances are 8.09 robust
    deviations, the state accounts for at most phi near of them, and the rest must exceed z width.
    """

    phis: tuple = (0.4, 0.8)
    shares: tuple = (0.25, 0.75)
    widths: tuple = (0.35, 0.7, 1.0, 1.2)
    z: float = 5.0
    near: float = 2.5
    run: int = 10
    step: float = 10.0
    block: int = 1 << 16
    lane: int = 128
    burn: int = 64

    def __post_init__(self):
        if max(self.phis) * self.near + self.z * max(self.widths) >= 12 / 1.4826:
            raise ValueError("a far reading could pass unflagged: lower z, near, phis or widths")

    @property
    def models(self) -> np.ndarray:
        """Rows phi, share, width."""
        return np.array([(p, s, w) for p in self.phis for s in self.shares for w in self.widths])


def normal_behaviour(long: DataFrame) -> DataFrame:
    """(source, metric, centre, spread): median of the possible readings and the median distance from it.

    Readings are counted per value first, so a group's memory is bounded by the values a metric can take.
    """
    ok = F.lit(False)
    for m, (lo, hi) in POSSIBLE.items():
        ok = ok | ((F.col("metric") == m) & F.col("value").between(lo, hi))
    counted = staged(long.where(ok).groupBy("source", "metric", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    half = lambda v: F.percentile(v, F.lit(0.5), F.col("n"))
    centre = counted.groupBy("source", "metric").agg(half(F.col("value")).alias("centre"))
    away = counted.join(centre, ["source", "metric"]).groupBy("source", "metric").agg(F.first("centre").alias("centre"), half(F.abs(F.col("value") - F.col("centre"))).alias("spread"))
    return staged(away, "normal")


def judged(long: DataFrame, opts: SpikeOptions = SpikeOptions()) -> DataFrame:
    """The flagged readings: (sample_id, source, metric, epoch, value, centre, spread, phi, share, width, z, spike, impossible, stuck), with the
    model of the source, the standardised innovation under it (null without any normal behaviour) and which flags there are.

    Spikes and impossible readings are withheld from the state. Readings are ordered by epoch, then sample_id. Every model runs over
    all readings at once; their costs, summed per source, choose the model. An empty table gives an empty result.
    """
    # joined before the sort, so that a source with a third of all readings is spread by rank
    full = join_checked(long, normal_behaviour(long), ["source", "metric"], "left", 96)
    cut = blocks(ranked(full, ["source", "metric", "epoch", "sample_id"]), opts.block, max(opts.burn, opts.run))
    got = staged(cut.groupBy("block").applyInPandas(_judge(opts), "sample_id long, source string, metric string, epoch long, value double, centre double, spread double, z array<double>, impossible boolean, stuck boolean"), "judged")
    # rows without a sample are the costs that a block sums up for a source
    models = range(len(opts.models))
    costs = got.where("sample_id is null").groupBy("source", "metric").agg(*[F.sum(F.col("z")[i]).alias(f"c{i}") for i in models])
    least = F.array_min(F.array(*[F.coalesce(f"c{i}", F.lit(np.inf)) for i in models]))
    chosen = staged(costs.select("source", "metric", (F.array_position(F.array(*[F.coalesce(f"c{i}", F.lit(np.inf)) for i in models]), least) - 1).cast("int").alias("model")), "models")
    out = join_checked(got.where("sample_id is not null"), chosen, ["source", "metric"], "left", 96).withColumn("z", F.col("z")[F.coalesce("model", F.lit(0))])
    out = out.withColumn("spike", F.coalesce(F.abs("z") > opts.z, F.lit(False))).where("spike or impossible or stuck")
    of = lambda k: F.array(*[F.lit(float(x)) for x in opts.models[:, k]])[F.col("model")]
    return out.select("sample_id", "source", "metric", "epoch", "value", "centre", "spread", of(0).alias("phi"), of(1).alias("share"), of(2).alias("width"), "z", "spike", "impossible", "stuck")


def _judge(opts: SpikeOptions):
    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        value, epoch, core = frame["value"].to_numpy(float), frame["epoch"].to_numpy(float), frame["core"].to_numpy(bool)
        new = np.ones(len(frame), bool)
        new[1:] = (frame["source"].to_numpy()[1:] != frame["source"].to_numpy()[:-1]) | (frame["metric"].to_numpy()[1:] != frame["metric"].to_numpy()[:-1])
        lo, hi = frame["metric"].map({m: b[0] for m, b in POSSIBLE.items()}).to_numpy(float), frame["metric"].map({m: b[1] for m, b in POSSIBLE.items()}).to_numpy(float)
        impossible = (value < lo) | (value > hi)
        z, log_total = innovations(value, epoch, new, frame["centre"].to_numpy(float), frame["spread"].to_numpy(float), impossible, opts)
        frame["impossible"], frame["stuck"] = impossible, vanished(value, new, opts.run)
        # a flagged reading costs as much under every model; it says nothing about the noise
        cost = np.where(core & ~impossible & ~np.isnan(z[0]), 2 * log_total + np.minimum(z**2, opts.z**2), 0)
        begin = np.flatnonzero(new)
        sums = np.add.reduceat(cost, begin, axis=1)
        own = np.logical_or.reduceat(core, begin)
        heads = frame.iloc[begin[own]].assign(sample_id=None, impossible=False, stuck=False)
        heads["z"] = list(sums[:, own].T)
        keep = core & (impossible | frame["stuck"].to_numpy() | (np.abs(np.nan_to_num(z)) > opts.z).any(axis=0))
        rows = frame[keep].copy()
        rows["z"] = [None if np.isnan(x[0]) else x for x in z[:, keep].T]
        out = pd.concat([rows, heads]) if len(rows) else heads
        out = out.astype({"sample_id": "Int64", "z": object})
        return out[["sample_id", "source", "metric", "epoch", "value", "centre", "spread", "z", "impossible", "stuck"]]

    return judge


def innovations(value, epoch, new, centre, spread, impossible, opts: SpikeOptions) -> tuple[np.ndarray, np.ndarray]:
    """Standardised innovations and the logarithms of their deviations (models x readings). The filters forget within ``burn`` readings,
    so the series is cut into lanes that run side by side, each after so many readings of warm-up; a lane starts at the normal state."""
    n = len(value)
    lanes = (n + opts.lane - 1) // opts.lane
    at = np.arange(lanes)[:, None] * opts.lane - opts.burn + np.arange(opts.burn + opts.lane)
    there, at = (at >= 0) & (at < n), at.clip(0, max(0, n - 1))
    phi, share, width = (opts.models[:, k : k + 1] for k in range(3))
    scale = 1.4826 * np.maximum(spread, 1.0)
    away = (value - centre) / scale  # in robust deviations: the variances are the same for every source then
    unit = width**2
    still, noise = share * unit, (1 - share) * unit
    gaps = np.ones(n)
    gaps[1:] = np.maximum(1.0, np.diff(epoch) / opts.step)
    usable = ~impossible & ~np.isnan(away)
    away = np.nan_to_num(away)
    state, var = np.zeros((len(opts.models), lanes)), np.zeros((len(opts.models), lanes))
    out, spread_log = np.full((len(opts.models), n), np.nan), np.zeros((len(opts.models), n))
    for t in range(at.shape[1]):
        i, on = at[:, t], there[:, t]
        decay = np.where(new[i] | (t == 0), 0.0, phi ** gaps[i])
        ahead, var_ahead = decay * state, decay**2 * var + (1 - decay**2) * still
        gap, total = away[i] - ahead, var_ahead + noise
        z = gap / np.sqrt(total)
        take = on & usable[i] & (np.abs(z) <= opts.z)
        gain = np.where(take, var_ahead / total, 0.0)
        state, var = (ahead + gain * gap).clip(-opts.near, opts.near), (1 - gain) * var_ahead
        if t >= opts.burn:
            out[:, i[on]], spread_log[:, i[on]] = z[:, on], 0.5 * np.log(total[:, on])
    out[:, np.isnan(centre)] = np.nan
    return out, spread_log


def vanished(value, new, run: int) -> np.ndarray:
    """Readings in a window of ``run`` non-zero readings over which the innovations of the noiseless model (gain 1, so each
    reading is forecast by the one before it) have no variance at all."""
    n = len(value)
    out = np.zeros(n, bool)
    if n < run:
        return out
    moved = new.astype(float)  # a new series has no forecast
    moved[1:] = np.where(new[1:], 1.0, np.minimum(1.0, np.abs(value[1:] - value[:-1])))
    total = np.concatenate([[0], np.cumsum(moved**2 + (value == 0))])  # zero readings are idle, not stuck
    # the first reading of a window isn't forecast within it
    window = np.flatnonzero((total[run:] - total[1 : n - run + 2] == 0) & (value[: n - run + 1] != 0))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, window, 1)
    np.add.at(edge, window + run, -1)
    return np.cumsum(edge[:-1]) > 0


def implausible(df: DataFrame, opts: SpikeOptions = SpikeOptions(), factor: float = 12.0) -> DataFrame:
    """(sample_id, metric): readings that the filter flags, checked exactly: impossible, further than ``factor`` median distances
    (at least 1) from the source's median, or stuck. With ``factor`` 0 the filter's own flags stand."""
    got = judged(readings(staged(samples(df), "samples"), list(POSSIBLE)), opts)
    far = F.col("spike") & (F.abs(F.col("value") - F.col("centre")) > factor * F.greatest(F.col("spread"), F.lit(1.0)))
    return got.where(F.col("impossible") | F.col("stuck") | F.coalesce(far, F.lit(False))).select("sample_id", "metric")


@dataclass(frozen=True)
class GridOptions:
    """slot: seconds. chunk, halo: slots a task imputes at once, and context on either side.
    window: rows of the Hankel matrix; rank: most singular vectors kept, of those with over ``floor`` times the median energy; noise alone stays under 3; it has settled when no value moves by more than ``tolerance`` of the
    observed range, and stops unsettled, and marked so, after ``turns``."""

    slot: int = 30
    chunk: int = 256
    halo: int = 64
    window: int = 32
    rank: int = 4
    floor: float = 3.0
    turns: int = 500
    tolerance: float = 1e-3


def regular(df: DataFrame, metrics: list[str], opts: GridOptions = GridOptions()) -> DataFrame:
    """(input_file, metric, slot_epoch_s, value, filled, settled): one row per source, metric and slot, from the slot of the source's first
    row to that of its last. ``filled`` marks the slots without a reading. ``value`` is the mean reading or the imputed one; ``settled`` tells
    whether its chunk's imputation converged. Where a chunk and its context have no reading at all there is nothing to impute
    from: value is null and settled false. With under three readings, or four slots, a straight line joins what there is.
    Rows without epoch or source are ignored; an empty table gives an empty grid.
    """
    rows = staged(samples(df), "samples")
    slot = F.floor(F.col("epoch") / opts.slot).cast("long")
    span = staged(rows.groupBy("source").agg(F.min(slot).alias("first"), F.max(slot).alias("last")), "span")
    means = readings(rows, metrics).groupBy("source", "metric", slot.alias("slot")).agg(F.avg("value").alias("value"))
    chunk_of = lambda s: F.floor(s / opts.chunk).cast("long")
    filled = means.withColumn("chunk", F.explode(F.sequence(chunk_of(F.col("slot") - opts.halo), chunk_of(F.col("slot") + opts.halo))))
    # an empty row for every chunk, so that chunks without readings exist too
    bare = span.withColumn("chunk", F.explode(F.sequence(chunk_of(F.col("first")), chunk_of(F.col("last"))))).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    bare = bare.select("source", "metric", F.lit(None).cast("long").alias("slot"), F.lit(None).cast("double").alias("value"), "chunk", "first", "last")
    both = filled.withColumn("first", F.lit(None).cast("long")).withColumn("last", F.lit(None).cast("long")).unionByName(bare)
    return both.groupBy("source", "metric", "chunk").applyInPandas(_impute(opts), "input_file string, metric string, slot_epoch_s long, value double, filled boolean, settled boolean")


def _impute(opts: GridOptions):
    def impute(frame: pd.DataFrame) -> pd.DataFrame:
        ends = frame[frame["first"].notna()]
        chunk = int(frame["chunk"].iloc[0])
        if not len(ends):  # halo of a neighbour beyond the source's range
            kinds = {"input_file": object, "metric": object, "slot_epoch_s": np.int64, "value": float, "filled": bool, "settled": bool}
            return pd.DataFrame({c: np.array([], t) for c, t in kinds.items()})
        first, last = int(ends["first"].iloc[0]), int(ends["last"].iloc[0])
        lo, hi = max(first, chunk * opts.chunk - opts.halo), min(last, (chunk + 1) * opts.chunk + opts.halo - 1)
        series = np.full(hi - lo + 1, np.nan)
        got = frame[frame["slot"].notna()]
        series[got["slot"].to_numpy(np.int64) - lo] = got["value"].to_numpy(float)
        full, settled = spectrum_fill(series, opts)
        core = np.arange(max(first, chunk * opts.chunk), min(last, (chunk + 1) * opts.chunk - 1) + 1)
        return pd.DataFrame({"input_file": frame["source"].iloc[0], "metric": frame["metric"].iloc[0], "slot_epoch_s": core * opts.slot, "value": full[core - lo], "filled": np.isnan(series[core - lo]), "settled": settled})

    return impute


def spectrum_fill(series: np.ndarray, opts: GridOptions) -> tuple[np.ndarray, bool]:
    """Missing entries by iterative singular-spectrum analysis, and whether they settled: embed as Hankel trajectories, keep the leading
    singular vectors, average the antidiagonals back, replace the missing entries, repeat. Stays within the observed range.

    After the first turn the vectors are followed by orthogonal iteration from the last ones, as they hardly move.
    """
    gone = np.isnan(series)
    if not gone.any() or gone.all():
        return series, not gone.any()
    have = np.flatnonzero(~gone)
    x = np.interp(np.arange(len(series)), have, series[have])
    rows = min(opts.window, len(series) // 2)
    if rows < 2 or len(have) < 3:
        return x, True
    low, high = series[have].min(), series[have].max()
    columns = len(x) - rows + 1
    counts = np.convolve(np.ones(rows), np.ones(columns))
    lead = None
    for _ in range(opts.turns):
        mean = x.mean()
        paths = np.lib.stride_tricks.sliding_window_view(x - mean, columns)
        square = paths @ paths.T
        if lead is None:
            energy, vectors = np.linalg.eigh(square)
            lead = vectors[:, -max(1, min(opts.rank, int((energy > opts.floor * np.median(energy)).sum()))) :]
        else:
            lead = np.linalg.qr(square @ lead)[0]
        scores = lead.T @ paths
        back = sum(np.convolve(v, c) for v, c in zip(lead.T, scores))  # the antidiagonal sums of v c'
        new = (back / counts + mean).clip(low, high)
        moved = np.abs(new[gone] - x[gone]).max()
        x[gone] = new[gone]
        if moved <= opts.tolerance * max(1e-9, high - low):
            return x, True
    return x, False
