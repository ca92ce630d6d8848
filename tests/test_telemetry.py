"""Implausible readings and regular grids on small logs."""

import math
import os

import numpy as np
import pytest

from helixmill.operators import telemetry as t
from tests.oracle import DATA

SCHEMA = "sample_id long, epoch_s long, cpu_pct double, rss_mib long, gpu_util_pct long, gpu_mem_mib long, input_file string, received_at timestamp, source string, epoch int, block int, value string"


def log(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 1, 2, "clash") for r in rows], SCHEMA)


def test_empty(spark):
    df = log(spark, [])
    assert t.implausible(df).count() == 0 and t.regular(df, ["cpu_pct"]).count() == 0


def test_spikes_stuck_and_impossible(spark):
    rows = [(i, 1000 + 7 * i, 1.0, 500 + i % 5, 50 + i % 3, 0, "/in/a.gz" if i % 2 else "a.gz") for i in range(60)]
    rows[20] = (20, 1140, 1.0, 5000, None, 0, "a.gz")  # a spike
    rows[30] = (30, 1210, 1.0, -4, 101, 0, "a.gz")  # impossible twice
    for i in range(40, 51):
        rows[i] = (i, 1000 + 7 * i, 1.0, 502, 50 + i % 3, 0, "a.gz")  # stuck: 11 equal readings, an equal neighbour makes 12
    rows += [rows[20], (None, 5, 1.0, 9, 9, 9, "a.gz"), (900, None, 1.0, 9, 9, 9, "a.gz"), (901, 3, 1.0, 99999999, 9, 9, None), (902, 1000 * 10**9, 1.0, None, None, None, "a.gz")]
    got = {(r[0], r[1]) for r in t.implausible(log(spark, rows)).collect()}
    assert {(20, "rss_mib"), (30, "rss_mib"), (30, "gpu_util_pct")} | {(i, "rss_mib") for i in range(40, 51)} <= got
    assert all(i in (20, 30) or (m == "rss_mib" and 37 <= i <= 52) for i, m in got)


@pytest.mark.parametrize("seed", range(3))
def test_flags_cover_every_far_reading(seed):
    """Whatever came before, a reading 12 deviations off is flagged."""
    rng = np.random.default_rng(seed)
    n = 3000
    value = np.where(rng.random(n) < 0.3, rng.integers(-5000, 5000, n), rng.integers(90, 110, n)).astype(float)
    value[1000:1400] += 60  # a long shift
    centre, spread = np.median(value), np.median(np.abs(value - np.median(value)))
    new = np.zeros(n, bool)
    new[0] = True
    o = t.SpikeOptions()
    z, _ = t.innovations(value, np.cumsum(rng.integers(1, 90, n)).astype(float), new, np.full(n, centre), np.full(n, spread), np.zeros(n, bool), o)
    far = np.abs(value - centre) > 12 * max(spread, 1)
    assert far.any() and (np.abs(z[:, far]) > o.z).all() and not np.isnan(z).any()


def test_options_that_would_miss_far_readings_are_refused():
    with pytest.raises(ValueError):
        t.SpikeOptions(z=6.0)
    with pytest.raises(ValueError):
        t.SpikeOptions(phis=(0.99,), near=3.0)


def slow_filter(rows, centre, spread, model, o):
    """One reading after another: standardised innovations and the cost of the model."""
    phi, share, width = model
    scale = 1.4826 * max(spread, 1.0)
    still, noise, state, var, last, out, cost = share * width**2, (1 - share) * width**2, 0.0, 0.0, None, [], 0.0
    for epoch, value, impossible in rows:
        decay = 0.0 if last is None else phi ** max(1.0, (epoch - last) / o.step)
        last = epoch
        state, var = decay * state, decay**2 * var + (1 - decay**2) * still
        total = var + noise
        z = ((value - centre) / scale - state) / math.sqrt(total)
        out.append(z)
        if not impossible:
            cost += math.log(total) + min(z * z, o.z**2)
            if abs(z) <= o.z:
                state, var = min(o.near, max(-o.near, state + var / math.sqrt(total) * z)), var * (1 - var / total)
    return out, cost


def test_judged_against_a_slow_filter(spark):
    """Models and innovations per source as reading after reading gives them, whatever the blocks."""
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for source, phi, sd in (("calm.gz", 0.0, 20), ("drift.gz", 0.97, 20), ("wide.gz", 0.3, 60)):
        level = 0.0
        for i in range(900):
            level = phi * level + rng.normal(0, sd * math.sqrt(1 - phi**2))
            v = 20000 + level + rng.normal(0, sd / 4) + (rng.choice([-1, 1]) * rng.uniform(5, 40) * sd if rng.random() < 0.02 else 0)
            rows.append((at, 1000 + 7 * i + int(rng.integers(0, 5)) + (300 if i > 500 else 0), 1.0, int(v) if rng.random() > 0.01 else -5, None, None, source))
            at += 1
    long = t.readings(t.samples(log(spark, rows)), ["rss_mib"]).persist()
    normal = {r["source"]: (r["centre"], r["spread"]) for r in t.normal_behaviour(long).collect()}
    for block in (1 << 16, 200):
        o = t.SpikeOptions(block=block)
        got = {}
        for r in t.judged(long, o).collect():
            got.setdefault(r["source"], {})[r["sample_id"]] = r
        for source, (centre, spread) in normal.items():
            mine = sorted((x[1], x[0], x[3]) for x in rows if x[6] == source)
            series = [(e, v, not 1 <= v <= 262144) for e, _, v in mine]
            results = [slow_filter(series, centre, spread, m, o) for m in o.models]
            best = int(np.argmin([c for _, c in results]))
            want = {i for (_, i, v), z, (_, _, imp) in zip(mine, results[best][0], series) if imp or abs(z) > o.z}
            assert {i for i, r in got[source].items() if r["spike"] or r["impossible"]} == want and len(want) > 5
            some = next(iter(got[source].values()))
            assert (some["phi"], some["share"], some["width"]) == tuple(o.models[best])
            for (_, i, _), z in zip(mine, results[best][0]):
                if i in want:
                    assert abs(got[source][i]["z"] - z) < 1e-4 * max(1, abs(z))
    models = {s: next(iter(got[s].values())) for s in got}
    assert models["drift.gz"]["phi"] > models["wide.gz"]["phi"] or models["drift.gz"]["share"] > models["calm.gz"]["share"]


def test_the_filter_finds_what_the_distance_from_the_median_hides(spark):
    """On a slow drift, readings that leave it but lie within 12 median distances of the median: the filter flags
    them all and none of the drift; a threshold on the distance from the median finds none, or, lowered until it finds them, the drift too."""
    rng = np.random.default_rng(3)
    n = 2000
    drift = 20000 + 150 * np.sin(np.arange(n) / 120)
    value = np.round(drift + rng.normal(0, 8, n))
    bad = rng.choice(np.arange(50, n - 50), 25, replace=False)
    value[bad] -= np.sign(drift[bad] - 20000) * 300
    rows = [(i, 1000 + 6 * i, 1.0, int(v), None, None, "d.gz") for i, v in enumerate(value)]
    got = t.judged(t.readings(t.samples(log(spark, rows)), ["rss_mib"])).toPandas()
    centre = np.median(value)
    spread = np.median(np.abs(value - centre))
    flagged = set(got[got.spike].sample_id)
    assert (np.abs(value[bad] - centre) <= 12 * spread).all() and not set(t.implausible(log(spark, rows)).toPandas().sample_id) & set(bad)
    near = np.abs(value - centre)
    assert len(flagged & set(bad)) >= 20 and len(flagged - set(bad)) <= 2, (len(flagged & set(bad)), len(flagged))
    assert got.phi.iloc[0] == 0.8 and got.share.iloc[0] == 0.75 and got.width.iloc[0] < 1
    # a threshold on the distance that finds as many takes in good readings
    worst = np.sort(near[bad])[::-1][19]
    assert (near >= worst).sum() > 30


def test_runs():
    v = np.array([0.0] * 12 + [3] * 10 + [4] * 9 + [4])
    new = np.zeros(len(v), bool)
    new[0] = new[31] = True
    assert t.vanished(v, new, 10).tolist() == [False] * 12 + [True] * 10 + [False] * 10


def test_blocks_don_t_change_the_result(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1000 + 5 * i, 1.0, int(rng.integers(480, 520)) if i % 97 else 9000, 10 if 300 <= i % 700 < 330 else int(rng.integers(5, 90)), int(rng.integers(0, 9)), f"{i % 2}.gz") for i in range(3000)]
    df = log(spark, rows)
    whole = set(map(tuple, t.implausible(df).collect()))
    assert len(whole) > 20 and whole == set(map(tuple, t.implausible(df, t.SpikeOptions(block=64)).collect()))


def test_grid(spark):
    rows = [(i, 30 * i + 3, float(50 + 10 * np.sin(i / 5)), None, None, None, "b.gz") for i in range(400) if i not in (5, 6, 100) and not 200 <= i < 290]
    rows.append((9999, (30 * 50 + 1) * 1000 + 10**14, 1.0, None, None, None, "other.gz"))
    got = t.regular(log(spark, rows), ["cpu_pct", "gpu_util_pct"]).toPandas()
    b = got[(got.input_file == "b.gz") & (got.metric == "cpu_pct")].sort_values("slot_epoch_s")
    assert b.slot_epoch_s.tolist() == [30 * i for i in range(400)]
    assert b[b.filled].slot_epoch_s.tolist() == [30 * i for i in [5, 6, 100, *range(200, 290)]]
    assert b.settled.all() and b.value.notna().all()
    near = b[b.slot_epoch_s.isin([150, 180, 3000])]
    assert np.abs(near.value - (50 + 10 * np.sin(near.slot_epoch_s / 150))).max() < 2
    gpu = got[(got.input_file == "b.gz") & (got.metric == "gpu_util_pct")]
    assert len(gpu) == 400 and gpu.filled.all() and gpu.value.isna().all() and not gpu.settled.any()


def test_imputation_beats_the_mean():
    x = 50 + 10 * np.sin(np.arange(300) / 6) + np.arange(300) / 30
    y = x.copy()
    gone = np.r_[40:46, 120:130, 250:254]
    y[gone] = np.nan
    full, settled = t.spectrum_fill(y, t.GridOptions())
    assert settled and np.abs(full[gone] - x[gone]).mean() < 0.3 * np.abs(np.nanmean(y) - x[gone]).mean()
    assert not t.spectrum_fill(y, t.GridOptions(turns=1))[1]
    for short in ([np.nan], [1.0, np.nan], [np.nan, 2.0, 3.0, np.nan]):
        assert len(t.spectrum_fill(np.array(short), t.GridOptions())[0]) == len(short)


def test_held_out_slots(spark):
    """Readings of a test log are hidden slot by slot and in stretches: the imputed values come nearer to them than a straight line over the gap, and no
    further than the source's mean (which is hard to beat: the readings are nearly white noise around a level)."""
    log_ = spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.01/resource_samples.parquet")
    whole = t.regular(log_, ["cpu_pct"]).toPandas()
    known = whole[~whole.filled].sort_values(["input_file", "slot_epoch_s"])
    rng = np.random.default_rng(1)
    errors = {"spectrum": [], "mean": [], "line": []}
    for _, one in known.groupby("input_file"):
        slots = ((one.slot_epoch_s - one.slot_epoch_s.min()) // 30).to_numpy()
        x = np.full(slots.max() + 1, np.nan)
        x[slots] = one.value
        have = np.flatnonzero(~np.isnan(x))
        if len(have) < 40:
            continue
        for _ in range(10):
            hide = set(rng.choice(have[1:-1], len(have) // 20, replace=False))
            start = rng.choice(have[5:-15])
            hide |= set(have[(have >= start) & (have < start + 5)])
            hide = np.array(sorted(hide))
            y = x.copy()
            y[hide] = np.nan
            left = np.flatnonzero(~np.isnan(y))
            errors["spectrum"] += list(np.abs(t.spectrum_fill(y, t.GridOptions())[0][hide] - x[hide]))
            errors["mean"] += list(np.abs(np.nanmean(y) - x[hide]))
            errors["line"] += list(np.abs(np.interp(hide, left, y[left]) - x[hide]))
    typical = {k: (np.median(v), np.mean(v)) for k, v in errors.items()}
    assert len(errors["mean"]) > 400 and typical["spectrum"][0] < typical["mean"][0] and typical["spectrum"][1] < min(1.03 * typical["mean"][1], 0.9 * typical["line"][1]), typical
