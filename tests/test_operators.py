"""Operators against brute force, closed forms and exact reconstruction, and on odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import activity, adaptation, arrays, automata, beamforming, blind, cancellation, enhancement, envelopes, filterbanks, frames, frontend, gaussians, graphs, images, lexicon, localization, metrics, temporal, tracking

V = "key long, n long, v array<double>"
RNG = np.random.default_rng(11)


def vectors(spark, rows):
    return spark.createDataFrame([(1, k, None if x is None else [None if y is None else float(y) for y in x]) for k, x in enumerate(rows)], V)


ODD = [None, [], [2.0], [0.0, 0.0], [1.0, None, 3.0], [0.0, -1.0, 2.0, 0.0]]


@pytest.mark.parametrize(
    "op",
    [
        frames.hamming, frames.signal_power, frames.log_scale, frames.zero_crossings, frames.threshold, lambda df: frames.median_filter(df, 3), lambda df: frames.dft_power(df, 3), lambda df: frames.fft(df, 8), lambda df: frames.autocorrelation(df, 2),
        lambda df: frames.lpc(df, 1), frames.spectral_shape, lambda df: frames.channel(df, 0, 2), activity.energy_diffusion, activity.brightness, lambda df: activity.band_energy_ratio(df, 8.0), activity.negative_entropy, activity.significant_bands,
        lambda df: activity.bandwidth(df, 8.0, 0.1), lambda df: envelopes.pitch(df, 8.0), lambda df: envelopes.lpc_envelope(df, 1, 8),
    ],
)
def test_odd_frames_never_crash(spark, op):
    df = vectors(spark, ODD).withColumn("extra", F.lit(7))
    if op is frames.spectral_shape:
        df = df.withColumn("v", F.transform("v", lambda x: F.abs(x) + F.when(x == 0, 0.0).otherwise(0.0))).where("v is null or not exists(v, x -> x = 0) or size(v) = 2")
        df = df.where("size(v) <> 2 or v is null")
    rows = op(df).collect()
    assert len(rows) == df.count() and all(r["extra"] == 7 for r in rows)
    assert op(df.limit(0)).count() == 0


def test_values_of_the_reference_formulas(spark):
    one = lambda op, x, c="v": op(vectors(spark, [x])).first()[c]
    assert one(lambda d: frames.log_scale(d, 10.0, 1.0), [-1.0, 9.0, -5.0]) == [0.0, 10.0, 0.0]
    assert one(lambda d: frames.log_scale(d, 1.0, floor=1e-5), [0.0, 1.0]) == [-5.0, 0.0]
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(3) / 3)
    assert abs(one(frames.zero_crossings, [0.0, -1.0, 0.0, 3.0], "rate") - (w[0] + w[1]) / 4) < 1e-12
    m = frames.mel_matrix(4, 33, 8000.0, version=2)
    edges = [frames.hertz(k * frames.mel(4000.0) / 5) for k in range(6)]
    at = np.arange(33) * 8000 / (4 * 16)
    assert abs(m[1, 4] - 2 / (edges[3] - edges[1]) * min((at[4] - edges[1]) / (edges[2] - edges[1]), (edges[3] - at[4]) / (edges[3] - edges[2]))) < 1e-12
    assert np.allclose(frames.warp_matrix(8, 1.0), np.eye(8)) and np.allclose(frames.warp_matrix(8, 1.0, version=2) @ np.ones(8), 1)


def test_ends_of_a_stream(spark):
    df = vectors(spark, [[1.0], [2.0], [3.0]])
    assert [r["v"] for r in temporal.stack(df, "key", 2, 1).orderBy("n").collect()] == [[1, 1, 1, 2], [1, 1, 2, 3], [1, 2, 3, 3]]
    assert [r["v"] for r in temporal.fir(df, "key", [0.5, 1.0, 0.25]).orderBy("n").collect()] == [[2.0], [3.75], [3.5]]
    x = spark.createDataFrame([(1, 0, 4.0), (1, 1, 4.0)], "key long, n long, x double")
    assert [r["y"] for r in temporal.mean_normalised(x, "key").collect()] == [0.0, 0.0]
    assert [r["x"] for r in temporal.frames(x, "key", 4, 4, pad=True).select(F.explode("v").alias("x")).collect()] == [4.0, 4.0, 0.0, 0.0]
    assert metrics.snr(x.withColumn("z", F.col("x")), "key", "x", "z").first()["snr"] is None
    assert metrics.segmental_snr(x.withColumn("z", F.col("x")), "key", "x", "z", 2).first()["snr"] == 35.0


def test_streams_are_walked_in_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(k % 3 if k % 7 else None, k, float(k * 13 % 17)) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, n long, x double")
    want = {}
    for key in (None, 0, 1, 2):
        y = 0.0
        for k, n, x in rows:
            if k == key:
                y = 0.9 * y + 0.1 * x
                want[n] = y
    try:
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r["n"]: r["y"] for r in temporal.exponential_mean(df, "key", 0.9).collect()}
            fold = {r["n"]: r["y"] for r in temporal.recursion(df, "key", 0.0, lambda s, x: 0.9 * s + 0.1 * x).collect()}
            assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 and abs(fold[n] - want[n]) < 1e-9 for n in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_running_mean_and_flags(spark):
    x = RNG.normal(size=(20, 3))
    df = vectors(spark, x).withColumn("w", (F.col("n") % 2).cast("double"))
    got = np.array([r["v"] for r in frontend.subtract_running_mean(df, "key", "w", 1.0).orderBy("n").collect()])
    mean, var = np.zeros(3), np.ones(3)
    for k, v in enumerate(x):
        if k % 2:
            mean = 0.98 * mean + 0.02 * v
            var = 0.98 * var + 0.02 * (v - mean) ** 2
        assert np.allclose(got[k], (v - mean) / np.sqrt(np.maximum(var, 1e-4)))


def test_running_mean_goes_on_after_its_weight_changes(spark):
    x = np.random.default_rng(2).normal(size=(1200, 2))
    got = np.array([r["v"] for r in frontend.subtract_running_mean(vectors(spark, x), "key").orderBy("n").collect()])
    mean, want = np.zeros(2), []
    for k, v in enumerate(x):
        mean = 0.98 * mean + 0.02 * v if k < 500 else 0.995 * mean + 0.005 * v
        want.append(v - mean)
    assert got.shape == (1200, 2) and np.allclose(got, want)


def test_bank_takes_batches_without_a_frame(spark):
    x = np.random.default_rng(1).normal(size=200)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "key long, n long, x double")
    h = filterbanks.low_pass_prototype(32, 1 / 16)
    g = filterbanks.synthesis_prototype(h, 8, 4)
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    for size in (1, 3, 7):  # fewer samples than the shift, and not a multiple of it
        spark.conf.set(records, size)
        try:
            back = filterbanks.synthesis(filterbanks.analysis(df, "key", h, 8, 4), "key", g, 8, 4).orderBy("n").collect()
        finally:
            spark.conf.set(records, before)
        y = np.array([r["x"] for r in back])[31:]
        assert len(y) == 200 - 31 and np.abs(y - x[: len(y)]).max() < 1e-6


def test_banks_give_back_their_input(spark):
    x = RNG.normal(size=600)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "key long, n long, x double")
    for bands, shift, taps in ((8, 4, 32), (16, 4, 64)):
        h = filterbanks.analysis_prototype(bands, taps // bands, shift) if bands == 16 else filterbanks.low_pass_prototype(taps, 1 / (2 * bands))
        g = filterbanks.synthesis_prototype(h, bands, shift)
        back = filterbanks.synthesis(filterbanks.analysis(df, "key", h, bands, shift), "key", g, bands, shift).orderBy("n").collect()
        y = np.array([r["x"] for r in back])[taps - 1 :]
        assert len(y) > 500 and np.abs(y - x[: len(y)]).max() < 1e-6
    p = filterbanks.cosine_prototype(8, 8)
    back = filterbanks.cosine_synthesis(filterbanks.cosine_analysis(df, "key", p, 8), "key", p, 8).orderBy("n").collect()
    y = np.array([r["x"] for r in back])[len(p) - 1 :]
    scale = (y @ x[: len(y)]) / (y @ y)
    assert np.abs(y * scale - x[: len(y)]).max() < 2e-2 * np.abs(x).max()
    n = filterbanks.nyquist_prototype(8, 4)
    assert abs(n[16] - 1) < 1e-9 and np.abs(n[[0, 8, 24, 32]]).max() < 1e-9
    blocks = temporal.frames(df, "key", 8, 8).withColumnRenamed("frame_x", "n")
    for save in (False, True):
        y = np.concatenate([r["v"] for r in filterbanks.convolve(blocks, "key", np.array([1.0, 0.5, 0.25]), save).orderBy("n").collect()])
        assert np.allclose(y, np.convolve(x, [1, 0.5, 0.25])[: len(y)])


def test_resampling_keeps_a_slow_tone(spark):
    t = np.arange(400)
    df = spark.createDataFrame([(1, int(k), float(np.sin(2 * np.pi * 0.01 * k))) for k in t], "key long, n long, x double")
    y = {r["n"]: r["x"] for r in filterbanks.resample(df, "key", 16000, 12000).collect()}
    assert len(y) == 300 and max(abs(y[k] - np.sin(2 * np.pi * 0.01 * k * 4 / 3)) for k in range(40, 260)) < 0.02


def test_envelopes(spark):
    x = np.zeros(64)
    x[0] = 1
    for k in range(1, 64):
        x[k] = 0.8 * x[k - 1]
    a, e = envelopes.burg(x[None], 1)
    assert abs(a[0, 1] + 2 * 0.8 / (1 + 0.64)) < 0.1 and e[0] > 0
    plain, warped = envelopes.warped_correlations(x[None], 4, 0.0), envelopes.warped_correlations(x[None], 4, 0.3)
    assert np.allclose(plain, frames.correlations(x[None], 5)) and abs(warped[0, 0] - plain[0, 0]) < 1e-12
    tone = np.sin(2 * np.pi * 8 * np.arange(64) / 64) + 0.01 * RNG.normal(size=64)
    env = np.array(envelopes.mvdr_envelope(vectors(spark, [tone]), 12).first()["v"])
    assert env.argmax() in (7, 8, 9) and len(env) == 33
    mu = envelopes.musicus(np.array([[1.0, -0.5]]))[0]
    assert np.allclose(mu, [-(2 * 1 + 0 * 0.25), -(1 * -0.5)])
    hum = np.sin(2 * np.pi * np.arange(128) / 16)
    assert abs(envelopes.pitch(vectors(spark, [hum]), 8000.0, 0.3).first()["pitch"] - 500.0) < 1e-6
    spiky = np.zeros(50)
    spiky[20:22] = 30000
    assert np.abs(envelopes.remove_spikes(vectors(spark, [spiky]), "key").first()["v"]).max() == 0


def snapshots(spark, x):
    """x: frame x bin x channel."""
    rows = [(f, b, x[f, b].real.tolist(), x[f, b].imag.tolist()) for f in range(x.shape[0]) for b in range(x.shape[1])]
    return spark.createDataFrame(rows, "frame long, bin int, re array<double>, im array<double>")


def noise(*shape):
    return RNG.normal(size=shape) + 1j * RNG.normal(size=shape)


def test_beamformers(spark):
    mics = np.array([[0.05 * k, 0, 0] for k in range(4)])
    d = beamforming.manifold(beamforming.plane_wave_delays(mics, 1.0), 5, 8000.0, 8)
    jam = beamforming.manifold(beamforming.plane_wave_delays(mics, 2.4), 5, 8000.0, 8)
    s, j = noise(120, 5), 5 * noise(120, 5)
    x = s[..., None] * d + j[..., None] * jam + 0.01 * noise(120, 5, 4)
    df = snapshots(spark, x)
    read = lambda out: np.array([complex(r["re"], r["im"]) for r in out.orderBy("frame", "bin").collect()]).reshape(-1, 5)
    cov = beamforming.covariances(df, 5)
    assert np.allclose(cov[2], np.einsum("fc,fd->cd", x[:, 2], x[:, 2].conj()) / 120)
    both = beamforming.covariances(df, 5, both_ways=True)
    assert np.allclose(both[1], (cov[1] + cov[1].conj()[::-1, ::-1]) / 2)
    w = beamforming.mvdr_weights(cov, d, 1e-3)
    assert np.allclose((w.conj() * d).sum(1), 1)
    plain = read(beamforming.apply_weights(df, beamforming.delay_and_sum_weights(d)))
    assert np.allclose(plain, (x * d.conj()).mean(2))
    best = read(beamforming.mvdr(df, cov, d, 1e-3))
    assert np.abs(best[:, 1:] - s[:, 1:]).mean() < 0.2 * np.abs(plain[:, 1:] - s[:, 1:]).mean()
    lcmv = beamforming.lcmv_weights(cov[1:], np.stack([d, jam], 2)[1:], np.array([1, 0]), 1e-3)
    assert np.allclose((lcmv.conj() * d[1:]).sum(1), 1) and np.allclose((lcmv.conj() * jam[1:]).sum(1), 0, atol=1e-8)
    b = beamforming.blocking_matrix(d[1])
    assert np.allclose(b.conj().T @ d[1], 0) and b.shape == (4, 3)
    for kind, mu, sigma in (("rls", 0.99, 1.0), ("lms", 0.9, 0.1)):
        y = read(beamforming.adaptive_canceller(df, beamforming.delay_and_sum_weights(d), d, kind, mu, sigma))
        assert np.abs(y[60:, 1:] - s[60:, 1:]).mean() < 0.5 * np.abs(plain[60:, 1:] - s[60:, 1:]).mean()
    zero = read(beamforming.sidelobe_canceller(df, beamforming.delay_and_sum_weights(d), d, np.zeros((5, 3))))
    assert np.allclose(zero, plain)
    run = beamforming.running_covariances(df, 0.5).where("bin = 1 and frame = 1").first()
    first, second = (np.outer(v, v.conj()) for v in x[:2, 1])
    assert np.allclose(np.array(run["r_re"]) + 1j * np.array(run["r_im"]), (0.5 * first + 0.5 * second).ravel())


def test_spherical_harmonics_and_beams():
    g = np.array([(p, a) for p in np.arccos(np.linspace(-0.95, 0.95, 9)) for a in np.arange(8) * np.pi / 4])
    j, y = beamforming.spherical_bessel(3, 2.0)
    assert np.allclose(j[:2], [math.sin(2) / 2, math.sin(2) / 4 - math.cos(2) / 2]) and np.allclose(j[1:] * y[:-1] - j[:-1] * y[1:], 1 / 4)
    h = beamforming.harmonics(2, g[:, 0], g[:, 1])
    assert np.allclose((np.abs(h[:, 1:4]) ** 2).sum(1), 3 / (4 * math.pi))
    mics = g[::2]
    for kind in ("delay_and_sum", "white_noise", "optimal"):
        w = beamforming.spherical_weights(mics, (1.0, 0.5), 6, 8000.0, 32, 0.042, 3, kind)
        on = beamforming.plane_wave_pressures(mics, (1.0, 0.5), 6, 8000.0, 32, 0.042, 3)
        off = beamforming.plane_wave_pressures(mics, (2.2, 3.6), 6, 8000.0, 32, 0.042, 3)
        assert np.allclose((w.conj() * on).sum(1), 1) and np.abs((w.conj() * off).sum(1)[4:]).max() < 0.6


def test_localisation(spark):
    rate, n = 16000.0, 64
    x = RNG.normal(size=(6, 3 * n))
    rows = []
    for f in range(6):
        for chan, late in ((0, 0), (1, 5)):
            z = np.fft.rfft(np.roll(x[f, :n], late))
            rows += [(f, chan, b, float(v.real), float(v.imag)) for b, v in enumerate(z)]
    df = spark.createDataFrame(rows, "frame long, chan long, bin int, re double, im double")
    pairs = localization.channel_pairs(df)
    quiet = localization.last_noise(localization.noise_spectra(pairs))
    for kind in ("phat", "raw", "ml"):
        got = localization.gcc(pairs, rate, kind, peaks=2, noise=quiet.withColumn("nre", F.transform("nre", lambda x: x * 0)).withColumn("nim", F.transform("nim", lambda x: x * 0)) if kind == "ml" else None).collect()
        assert len(got) == 6 and all(abs(abs(r["delay"][0]) * rate - 5) < 0.3 and r["value"][0] > r["value"][1] for r in got)
    mics = np.array([[0.05 * k, 0, 0] for k in range(4)])
    grid = localization.linear_grid(19)
    man = localization.plane_manifolds(mics, grid, 9, rate, 16)
    s = noise(5, 9)
    snap = snapshots(spark, s[..., None] * man[6][None])
    assert all(r["place"] == 6 for r in localization.steered_power(snap, man, 1).collect())
    sphere = np.array([(p, a) for p in (0.7, 1.57, 2.4) for a in np.arange(4) * np.pi / 2])
    g2 = localization.direction_grid(np.linspace(0.4, 2.6, 5), np.linspace(0, 5, 6))
    man = localization.spherical_manifolds(sphere, g2, 5, rate, 32, 0.1, 3)
    snap = snapshots(spark, noise(4, 5)[..., None] * man[13][None])
    assert all(r["place"] == 13 for r in localization.steered_power(snap, man, 1).collect())
    two = spark.createDataFrame([(0, np.concatenate([x[0, 5:45], x[0, 2:42]]).tolist(), 2)], "frame long, x array<double>, chans int")
    delays = np.array([[0, k] for k in range(-5, 6)])
    assert delays[localization.multichannel_correlation(two, delays).first()["place"][0]].tolist() == [0, 3]
    model = localization.modal_observation(2, [1.0, 1.5])
    to = np.array([1.2, 0.8])
    rows = [(1, k, *(v.tolist() for v in np.split(model(to) + 0.01 * RNG.normal(size=len(model(to))), 2))) for k in range(40)]
    seen = spark.createDataFrame(rows, "stream long, frame long, re array<double>, im array<double>")
    last = localization.track_direction(seen, model, start=(1.5, 0.3)).orderBy(F.desc("frame")).first()
    assert abs(last["polar"] - 1.2) < 0.05 and abs(last["azimuth"] - 0.8) < 0.05


def test_echo_and_reverberation(spark):
    far = noise(400, 1)
    rec = 0.7 * far[:, 0] + 0.3 * np.concatenate([[0], far[:-1, 0]])
    rows = [(0, k, float(a.real), float(a.imag), float(v.real), float(v.imag)) for k, (a, v) in enumerate(zip(rec, far[:, 0]))]
    df = spark.createDataFrame(rows, "bin int, frame long, rec_re double, rec_im double, play_re double, play_im double")
    left = lambda out: np.abs([complex(r["re"], r["im"]) for r in out.orderBy("frame").collect()])
    for out in (cancellation.kalman_echo(df, 2, threshold=0.0), cancellation.information_echo(df, 2, 0.99, threshold=0.0), cancellation.information_echo(df, 2, 0.99, threshold=0.0, root=True), cancellation.kalman_echo(df, 2, threshold=0.0, guard=1e6)):
        e = left(out)
        assert e[-50:].mean() < 0.05 < e[:3].mean()
    e = left(cancellation.nlms_echo(df, 0.01, 0.5, 0.0))
    assert e[-50:].mean() < 0.8 * np.abs(rec).mean()
    clean = noise(300, 1) * RNG.exponential(size=(300, 1)) ** 2
    wet = clean.copy()
    for k in range(2, 300):
        wet[k] += 0.6 * wet[k - 2]
    rows = [("u", 0, k, [float(v[0].real)], [float(v[0].imag)]) for k, v in enumerate(wet)]
    got = cancellation.dereverberate(spark.createDataFrame(rows, "utt string, bin int, frame long, re array<double>, im array<double>"), 2, 6, 3, -60.0).orderBy("frame").collect()
    y = np.array([complex(r["re"][0], r["im"][0]) for r in got])
    assert np.abs(y - clean[:, 0]).mean() < 0.5 * np.abs(wet[:, 0] - clean[:, 0]).mean()
    h = np.array([0.5, 0.2, -0.1, 0.05])
    u = RNG.normal(size=4 * 300)
    blocks = [(1, k, np.convolve(u, h)[4 * k : 4 * k + 4].tolist(), u[4 * k : 4 * k + 4].tolist()) for k in range(300)]
    e = cancellation.block_lms(spark.createDataFrame(blocks, "key long, n long, v array<double>, far array<double>"), "key", 4, 0.3).orderBy("n").collect()
    assert np.abs(e[-1]["e"]).max() < 0.01 * np.abs(e[0]["e"]).max()


def test_bins_without_power_stay_without_phase(spark):
    cents = np.random.default_rng(3).integers(1, 20000, (300, 16))
    rest = cents[:, ::2].sum(1) - cents[:, 1::2].sum(1)
    cents[np.arange(300), np.where(rest < 0, 0, 1)] += np.abs(rest)  # no power in bin 8, but for the rounding of cents
    frames_ = spark.createDataFrame([(0, k, v) for k, v in enumerate((cents / 100).tolist())], "chan long, frame long, v array<double>")
    z = arrays.spectra(frames_, ["chan", "frame"], 9, 16)
    want = np.fft.rfft(cents / 100, axis=1)
    assert all(abs(r["re"] + 1j * r["im"] - want[r["frame"], r["bin"]]) < 1e-9 for r in z.collect())
    quiet = enhancement.spectral_subtraction(z, enhancement.average_noise(z), 0.5).where("bin = 8").collect()
    assert len(quiet) == 300 and all((r["re"], r["im"]) == (0.001**0.5, 0.0) for r in quiet)


def test_post_filters(spark):
    s = noise(30, 3)
    same = snapshots(spark, np.repeat(s[..., None], 3, 2))
    assert all(abs(r["gain"] - 1) < 1e-9 for r in enhancement.zelinski(same, 0.6).collect())
    apart = {r["bin"]: r["g"] for r in enhancement.zelinski(snapshots(spark, noise(200, 3, 3)), 0.99).where("frame > 150").groupBy("bin").agg(F.avg("gain").alias("g")).collect()}
    assert max(apart.values()) < 0.2
    coh = dict(enumerate(np.broadcast_to(np.eye(3), (3, 3, 3))))
    a = {(r["frame"], r["bin"]): r["gain"] for r in enhancement.mccowan(same, coh).collect()}
    assert all(abs(g - 1) < 1e-9 for g in a.values())
    lef = enhancement.lefkimmiatis(same, coh, {b: np.ones(3) / 3 for b in range(3)}).collect()
    assert all(abs(r["gain"] - 1) < 1e-9 for r in lef)
    c = enhancement.noise_coherence(same)
    assert np.allclose(c[0], np.ones((3, 3)))
    one = spark.createDataFrame([(0, 1, 1.0, 0.0), (0, 2, 0.0, 0.0)], "frame long, bin int, re double, im double")
    moved = spark.createDataFrame([(0, 1, 0.0, 1.0), (0, 2, 0.0, 0.0)], "frame long, bin int, re double, im double")
    gains = {r["bin"]: r["gain"] for r in enhancement.delay_mask(one, moved, 8000.0, 16, 1e-4).collect()}
    assert gains[1] == 0.01 and gains[2] == 1.0
    assert enhancement.mask_threshold(one, moved, 8000.0, 16, [1e-4, 1e-3]) in (1e-4, 1e-3)
    assert enhancement.apply_gain(one, enhancement.level_mask(one, moved, 2.0)).where("bin = 1").first()["re"] == 0.0


def test_activity(spark):
    noise_frames, speech = 0.1 * noise(60, 8), 3 * noise(20, 8)
    x = np.concatenate([noise_frames, speech, noise_frames])
    rows = [(1, k, z.real.tolist(), z.imag.tolist()) for k, z in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, n long, re array<double>, im array<double>")
    got = {r["n"]: r for r in activity.likelihood_activity(df, "key", np.full(8, 0.02), 1.0).collect()}
    assert all(got[k]["speech"] for k in range(62, 80)) and not any(got[k]["speech"] for k in [*range(10, 60), *range(85, 140)])
    e = spark.createDataFrame([(1, k, float((np.abs(z) ** 2).sum())) for k, z in enumerate(x)], "key long, n long, energy double")
    flags = {r["n"]: r["speech"] for r in activity.percentile_activity(e, "key", 0.9, 30, 2, 3, 1e9).collect()}
    assert all(flags[k] for k in range(64, 80)) and not any(flags[k] for k in [*range(0, 55), *range(100, 140)])
    held = activity.gate(activity.percentile_activity(e, "key", 0.9, 30, 2, 3, 1e9), "key", 2)
    assert held.count() == sum(max(flags.get(k + j, 0) for j in range(3)) for k in flags)
    assert {r["n"] for r in activity.stages(e, [("energy", 1.0), ("n", 65)]).where("hit").collect()} == {k for k, z in enumerate(x) if (np.abs(z) ** 2).sum() > 1 and k > 65}
    p = np.array([[0.5], [1.0], [2.0]])
    assert np.allclose(activity.generalised_log_likelihood(p, np.ones((3, 1)), np.array([1.0])), -math.log(math.pi) - p)
    laplace = noise(4000) * RNG.exponential(size=4000)
    rows = [(0, 0, float(z.real), float(z.imag), float((np.abs(laplace) ** 2).mean())) for z in laplace]
    fitted = activity.fit_shapes(spark.createDataFrame(rows, "class int, bin int, re double, im double, variance double"), np.array([0.3, 0.5, 0.7, 1.0])).first()
    assert fitted["shape"] < 1.0
    pair = [(1, k, *(v for z in (a, b) for v in (z.real.tolist(), z.imag.tolist()))) for k, (a, b) in enumerate(zip(noise(50, 4), noise(50, 4)))]
    same = [(2, k, r[2], r[3], r[2], r[3]) for k, r in enumerate(pair)]
    info = activity.mutual_information(spark.createDataFrame(pair + same, "key long, n long, re_a array<double>, im_a array<double>, re_b array<double>, im_b array<double>"), 0, 3)
    by = {r["key"]: r["i"] for r in info.where("n > 30").groupBy("key").agg(F.avg("information").alias("i")).collect()}
    assert by[2] > 5 > by[1]
    w = [(np.array([[1.0, 0], [0, 1.0]]), np.zeros(2)), (np.array([[1.0, 0], [0, 1.0]]), np.zeros(2))]
    assert [r["speech"] for r in activity.perceptron(vectors(spark, [[5.0, -5.0], [-5.0, 5.0]]), w, 0.6).orderBy("n").collect()] == [0, 1]
    mix = RNG.uniform(-1, 1, size=(3000, 2)) @ np.array([[1.0, 0.4], [0.3, 1.0]])
    mean, rows = activity.independent_axes(vectors(spark, mix), 2)
    z = (mix - mean) @ rows.T
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.05 and np.abs((z / z.std(0))).max() < 2.1  # uniform sources end at the root of three


def test_gaussians(spark):
    x = np.concatenate([RNG.normal(0, 1, (40, 2)), RNG.normal(4, 2, (60, 2)), RNG.normal(9, 1, (3, 2))])
    label = [0] * 40 + [1] * 60 + [2] * 3
    df = spark.createDataFrame([(k, l, v.tolist()) for k, (l, v) in enumerate(zip(label, x))] + [(900, None, [1.0, 1.0]), (901, 0, None)], "frame_x long, label long, v array<double>")
    book_rows = gaussians.codebook(df)
    assert {r["label"] for r in book_rows.collect()} == {0, 1}
    book = gaussians.collect_book(book_rows, gaussians.mixture_weights(df))
    assert np.allclose(book.mu[1], x[40:100].mean(0)) and np.allclose(book.var[1], x[40:100].var(0))
    s = book.scores(x[:1])[0]
    assert abs(s[0] - sum(0.5 * math.log(2 * math.pi * v) + (a - m) ** 2 / (2 * v) for a, m, v in zip(x[0], book.mu[0], book.var[0]))) < 1e-9
    kept = gaussians.codebook(df, previous=spark.createDataFrame([(2, 0, 1, 5.0, 1.0), (0, 0, 1, 5.0, 1.0)], book_rows.schema))
    assert {(r["label"], r["mu"]) for r in kept.where("label = 2").collect()} == {(2, 5.0)}
    two = gaussians.split(book_rows).where("dim = 0").collect()
    assert {r["label"] for r in two} == {0, 1, -2}
    stats = lambda c: gaussians.statistics(df.where(c), ["label"])
    new = gaussians.discriminative(stats("label < 2"), stats("label < 0"), book_rows).where("label = 1 and dim = 0").first()
    assert abs(new["mu"] - x[40:100, 0].mean()) < 1e-6
    w, b = gaussians.scatter_of(gaussians.class_moments(df).collect())
    whole = np.cov(x.T, bias=True)
    assert np.allclose(w + b, whole)
    mean, axes = gaussians.principal_axes(df.where("label is not null"), 2)
    assert np.allclose(mean, x.mean(0)) and abs(abs(axes[0] @ np.linalg.eigh(whole)[1][:, 1]) - 1) < 1e-6
    lda = gaussians.discriminants(df, 1)
    assert np.isclose((lda @ w @ lda.T)[0, 0], 1)


def test_adaptation(spark):
    book = gaussians.Book([0, 1, 2, 3], RNG.normal(size=(4, 3)) * 3, np.full((4, 3), 0.5))
    a, b = np.eye(3) + 0.1 * RNG.normal(size=(3, 3)), RNG.normal(size=3)
    rows = [("s", k, 10.0, (10 * (a @ m + b)).tolist()) for k, m in enumerate(book.mu)]
    stats = spark.createDataFrame(rows, "spk string, label long, occ double, first array<double>")
    got = adaptation.regression_transforms(stats, book, "spk").first()
    assert np.allclose(got["matrix"], a, atol=1e-6) and np.allclose(got["bias"], b, atol=1e-6)
    means = {r["label"]: r["mean"] for r in adaptation.adaptive_means(stats, {"s": (a, b)}, book, "spk").collect()}
    assert all(np.allclose(means[k], m) for k, m in enumerate(book.mu))
    still = {r["label"]: r["mean"] for r in adaptation.adaptive_means(stats, {"s": (a, b)}, book, "spk", threshold=1e9).collect()}
    assert all(np.allclose(still[k], m) for k, m in enumerate(book.mu))
    second = stats.withColumn("second", F.transform("first", lambda x: x * x / 10 + 10 * 0.7))
    assert all(np.allclose(r["var"], 0.7) for r in adaptation.adaptive_variances(second, {"s": (a, b)}, book, "spk").collect())
    q = adaptation.bilinear_series(0.3, 40)
    z = np.exp(0.7j)
    assert abs(sum(c * z ** (k - 40) for k, c in enumerate(q)) - (z - 0.3) / (1 - 0.3 * z)) < 1e-12
    assert np.allclose(adaptation.rational_series(0.3, [], 40), q, atol=1e-9) and np.allclose(adaptation.sine_log_series([0.0], 8)[[8, 9]], [0, 1], atol=1e-9)
    assert np.allclose(adaptation.cepstral_matrix(adaptation.bilinear_series(0.0, 20), 5), np.eye(5), atol=1e-12)
    one = np.convolve(q, q)[40:121]
    assert np.allclose(adaptation.cauchy(q, q), one)
    m = adaptation.cepstral_matrix(adaptation.bilinear_series(0.1, 40), 6)
    warped = gaussians.Book([0, 1, 2], RNG.normal(size=(3, 6)), np.full((3, 6), 0.5))
    rows = [{"label": k, "occ": 5.0, "first": 5 * (m @ v)} for k, v in enumerate(warped.mu)]
    assert abs(adaptation.all_pass_parameters(rows, warped)[0] - 0.1) < 1e-3
    assert abs(adaptation.brent(lambda x: (x - 0.3) ** 2 + 1, -1, 1) - 0.3) < 1e-4
    turn = np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    cov = np.stack([turn.T @ np.diag(v) @ turn for v in ([1.0, 2, 3], [3.0, 1, 5], [2.0, 6, 1])])
    st = adaptation.semi_tied_transform(np.ones(3), cov, 200)
    assert max(np.abs((d := st @ c @ st.T) - np.diag(np.diag(d))).max() for c in cov) < 1e-2
    far = gaussians.Book(list(range(6)), np.repeat([[0.0, 0], [50, 0], [0, 50]], 2, 0) + RNG.normal(size=(6, 2)), np.ones((6, 2)))
    label = adaptation.regression_classes(far, np.ones(6), 3)
    assert label[0] == label[1] and label[2] == label[3] and label[4] == label[5] and len(set(label)) == 3
    moved = adaptation.transform_by_class(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "c string, v array<double>"), {"a": (2 * np.eye(2), np.ones(2))}, "c")
    assert {r["c"]: r["v"] for r in moved.collect()} == {"a": [3.0, 5.0], "b": [1.0, 2.0]}


EDGES = "g long, src long, dst long, isym long, osym long, cost double"


def random_graph(seed, states=6, loops=False):
    rng = np.random.default_rng(seed)
    edges = [(s, d, int(rng.integers(0, 3)), int(rng.integers(0, 3)), round(float(rng.random()), 3)) for s in range(states) for d in range(s + 1, states) if rng.random() < 0.6]
    return [(i, d, a, a, c) for i, d, a, _, c in edges], {states - 1: 0.25, 2: 0.75}


def paths(edges, finals):
    """Every path's cost by its symbols, brute force."""
    out = {}

    def walk(s, cost, symbols):
        if s in finals:
            out.setdefault(symbols, []).append(cost + finals[s])
        for a, d, i, _, c in edges:
            if a == s:
                walk(d, cost + c, symbols + ((i,) if i else ()))

    walk(0, 0.0, ())
    return out


def test_automata_by_brute_force():
    for seed in range(25):
        edges, finals = random_graph(seed)
        truth = paths(edges, finals)
        for log in (False, True):
            total = {k: (-math.log(sum(math.exp(-c) for c in v)) if log else min(v)) for k, v in truth.items()}
            for op in (automata.remove_epsilon, automata.determinize, automata.minimize):
                got = paths(*op(edges, finals, log))
                assert got.keys() == total.keys()
                assert all(abs((-math.log(sum(math.exp(-c) for c in got[k])) if log else min(got[k])) - total[k]) < 1e-6 for k in total)
                if op is not automata.remove_epsilon:
                    assert all(len(v) == 1 for v in got.values())
            d, m = automata.determinize(edges, finals, log), automata.minimize(edges, finals, log)
            assert len(m[0]) <= len(d[0])
            if truth:
                assert automata.equal(automata.minimize(*m, log), m)
        every = sorted(c for v in truth.values() for c in v)
        best = automata.n_best(edges, finals, 4)
        assert np.allclose([b["cost"] for b in best], every[:4])
        if every:
            whole = sum(math.exp(-c) for c in every)
            p = automata.edge_posteriors(edges, finals)
            k = 0
            through = 0.0

            def walk(s, cost, used, k=k):
                nonlocal through
                if s in finals and used:
                    through += math.exp(-cost - finals[s])
                for j, e in enumerate(edges):
                    if e[0] == s:
                        walk(e[1], cost + e[4], used or j == k)

            walk(0, 0.0, False)
            assert abs(p[0] - through / whole) < 1e-9
            kept = paths(*automata.prune(edges, finals, 0.3))
            assert min(c for v in kept.values() for c in v) == pytest.approx(every[0])
            assert automata.equal(automata.determinize(edges, finals), automata.determinize(edges[::-1], finals))


def test_automata_tables(spark):
    edges, finals = random_graph(3)
    rows = [(g, *e) for g in (1, 2) for e in [*edges, *((s, -1, 0, 0, c) for s, c in finals.items())]]
    df = spark.createDataFrame(rows, EDGES)
    d = automata.determinized(df, ["g"])
    assert automata.same_graphs(d, automata.determinized(df, ["g"]), ["g"]).where("same").count() == 2
    one = automata.confusion_networks(df, ["g"]).where("g = 1").groupBy("slot").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in one)
    assert automata.relabel(df, [2], "isym").where("isym = 2").count() == 0
    words = spark.createDataFrame([(1, [5, 6, 7]), (2, [])], "g long, words array<long>")
    chain = automata.linear_graph(words, ["g"])
    assert {r["g"]: (r["osyms"], r["cost"]) for r in automata.best_paths(chain, ["g"]).collect()} == {1: ([5, 6, 7], 0.0), 2: ([], 0.0)}
    ctx = automata.best_paths(automata.context_dependent(chain, ["g"], 10), ["g"]).where("g = 1").first()
    assert ctx["isyms"] == [56, 567, 670] and ctx["osyms"] == [5, 6, 7]
    loop = [(0, 0, 1, 1, 0.0), (0, 0, 2, 2, 0.0)]
    scored = spark.createDataFrame([("u", 0, [1.0, 2.0]), ("u", 1, [5.0, 0.5])], "utt string, n long, scores array<double>")
    got = automata.decode_utterances(scored, loop, {0: 0.0}).first()
    assert got["words"] == [1, 2] and got["cost"] == 1.5
    assert automata.decode_utterances(scored, [(0, 1, 1, 1, 0.0)], {1: 0.0}).first()["cost"] is None


def test_composition_keeps_one_way_of_empty_symbols(spark):
    kind = "src long, dst long, isym long, osym long, cost double"
    for seed in range(4):
        rng = np.random.default_rng(100 + seed)
        make = lambda: [(s, d, int(rng.integers(0, 3)), int(rng.integers(0, 3)), round(float(rng.random()), 3)) for s in range(4) for d in range(s + 1, 4) if rng.random() < 0.8]  # noqa: E731, B023
        a, b = make(), make()
        end = spark.createDataFrame([(3, 0.0)], "state long, cost double")
        out, ends = graphs.compose(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 10, finals=(end, end))
        edges = [tuple(r) for r in out.collect()]
        finals = {r["state"]: r["cost"] for r in ends.collect()}

        def walks(edges, finals):
            found = []

            def walk(s, i, o, c):
                if s in finals:
                    found.append((i, o, round(c, 6)))
                for x in edges:
                    if x[0] == s:
                        walk(x[1], i + ((x[2],) if x[2] else ()), o + ((x[3],) if x[3] else ()), c + x[4])

            walk(0, (), (), 0.0)
            return found

        truth = sorted((i, o2, round(c + c2, 6)) for (i, o, c), (i2, o2, c2) in itertools.product(walks(a, {3: 0}), walks(b, {3: 0})) if o == i2)
        assert sorted((i, o, round(c, 6)) for i, o, c in walks(edges, finals)) == truth


def test_long_chains_have_no_bound(spark):
    chain = spark.createDataFrame([(k, k + 1, 1, 1, 1.0) for k in range(70)], "src long, dst long, isym long, osym long, cost double")
    assert graphs.shortest(chain, 0).agg(F.max("cost")).first()[0] == 70.0
    assert graphs.project(graphs.invert(chain.withColumn("osym", F.lit(2).cast("long"))), "isym").where("isym = 2 and osym = 2").count() == 70
    assert graphs.union(chain, chain, 100).count() == 142


def test_lexicon(spark, tmp_path):
    lines = spark.createDataFrame([("HELLO HH AH L OW",), ("HELLO(2) HH EH L OW",), ("{A} {{AH WB} {B {WB STRESS}}}",)], "line string")
    got = {(r["word"], r["variant"]): [(p["phone"], p["tags"]) for p in r["phones"]] for r in lexicon.dictionary(lines).collect()}
    assert got["HELLO", 2][1] == ("EH", []) and got["HELLO", 1][3] == ("OW", [])
    assert got["A", 1] == [("AH", ["WB"]), ("B", ["WB", "STRESS"])]
    (tmp_path / "lex.txt").write_text("; symbols\neps 0\nX 9\n\nY\n")
    assert {r["symbol"]: r["id"] for r in lexicon.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {"eps": 0, "X": 1, "Y": 2}
    many = spark.range(1000).select(F.concat(F.lit("w"), F.col("id")).alias("s"))
    ids = {r["symbol"]: r["id"] for r in lexicon.symbol_table(many.union(many), "s").collect()}
    assert ids == {w: k + 1 for k, w in enumerate(sorted(f"w{k}" for k in range(1000)))}
    assert lexicon.encode_symbols(spark.createDataFrame([("w1",), ("?",), (None,)], "s string"), "s", lexicon.symbol_table(many, "s"), 0).where("s = 0").count() == 2
    tree = lexicon.Node("root", 0, frozenset({"a", "b"}), lexicon.Node("l1"), lexicon.Node("m", 2, frozenset({"c"}), lexicon.Node("l2"), lexicon.Node("l3")))
    back = lexicon.read_tree(lexicon.write_tree(tree))
    ctx = spark.createDataFrame([(["a", "x", "y"],), (["z", "x", "c"],), (["z", "x", "y"],), ([],)], "c array<string>")
    assert [r[0] for r in ctx.select(lexicon.tree_leaf(back, F.col("c"))).collect()] == ["l1", "l2", "l3", "l3"]
    rows = [(["a", "x"] if k % 2 else ["b", "x"], [float(10 * (k % 2) + RNG.normal())]) for k in range(200)]
    stats = lexicon.context_statistics(spark.createDataFrame(rows, "c array<string>, v array<double>"), "c")
    grown = lexicon.grow_tree(stats, [(0, frozenset("a")), (1, frozenset("x"))], least=50)
    assert grown.place == 0 and len(grown.leaves()) == 2 and len(lexicon.grow_tree(stats, [(0, frozenset("a"))], least=150).leaves()) == 1
    counts = {("a",): np.array([90.0, 10]), ("b",): np.array([10.0, 90])}
    assert len(lexicon.grow_weight_tree(counts, [(0, frozenset("a"))], 50).leaves()) == 2
    words = spark.createDataFrame([("u1", 10, 35, "hi", 0.5), ("u1", 35, 40, "x", None)], "utt string, start long, end long, word string, conf double")
    assert [r["value"] for r in lexicon.hypothesis_lines(words, "utt").orderBy("start").collect()] == ["u1 1 0.10 0.25 hi 0.5000", "u1 1 0.35 0.05 x"]
    slots = spark.createDataFrame([(1, 0, 5, 0.9), (1, 0, 0, 0.1), (1, 1, 6, 0.4), (1, 1, 7, 0.6)], "utt long, slot int, word long, p double")
    assert {r["word"]: r["weight"] for r in lexicon.word_confidences(slots, ["utt"], 0.7).collect()} == {5: 0.0, 7: 1e10}


def test_images(spark):
    im = RNG.random((6, 5))
    df = vectors(spark, [im.ravel()])
    one = lambda out, c="v": np.array(out.first()[c])
    pad = np.pad(im, 1, mode="edge")
    near = np.array([[pad[i : i + 3, j : j + 3].ravel() for j in range(5)] for i in range(6)])
    assert np.allclose(one(images.morphology(df, 5, 6, "dilate")), near.max(-1).ravel())
    assert np.allclose(one(images.morphology(df, 5, 6, "open")), one(images.morphology(images.morphology(df, 5, 6, "erode"), 5, 6, "dilate")))
    assert np.allclose(one(images.smooth(df, 5, 6, "median")), np.median(near, -1).ravel())
    assert abs(one(images.smooth(vectors(spark, [np.ones(30)]), 5, 6, "gaussian")).max() - 1) < 1e-12
    assert np.allclose(one(images.interpolate(df, 5, 6, 5, 6)), im.ravel())
    square = np.zeros((16, 16))
    square[5:11, 5:11] = 255
    edge = one(images.edges(vectors(spark, [square.ravel()]), 16, 16, 100, 200)).reshape(16, 16)
    assert edge[4:12, 4:12].sum() > 0 and edge[:3].sum() == 0 and edge[7:9, 7:9].sum() == 0
    corner = np.zeros((8, 8))
    corner[0, 0] = 1
    assert one(images.centre(vectors(spark, [corner.ravel()]), 8, 8)).reshape(8, 8)[4, 4] == 1
    ramp = np.tile(np.arange(16.0), (16, 1))
    flow = images.optical_flow(vectors(spark, [ramp.ravel(), (ramp - 0.5).ravel()]), "key", 16, 16, 0.1, 100).orderBy("n").collect()
    assert not np.any(flow[0]["u"]) and abs(np.array(flow[1]["u"]).reshape(16, 16)[8, 8] - 0.5) < 0.05
    ring = np.array([[8 + 6 * math.cos(t), 8 + 6 * math.sin(t)] for t in np.arange(12) * math.pi / 6])
    pts = one(images.snake(vectors(spark, [square.ravel()]), 16, 16, ring), "points").reshape(-1, 2)
    assert np.abs(pts - 7.5).max() < np.abs(ring - 7.5).max()
    x = RNG.normal(size=(50, 4))
    frames_ = vectors(spark, x)
    mean, axes = gaussians.principal_axes(frames_, 4)
    back = np.array([r["v"] for r in images.rebuild(images.project_axes(frames_, mean, axes), mean, axes).orderBy("n").collect()])
    assert np.allclose(back, x)


def test_cross_spectra_equals_pairs(spark):
    x = noise(10, 3, 2)
    rows = [(f, c, b, float(x[f, b, c].real), float(x[f, b, c].imag)) for f in range(10) for b in range(3) for c in range(2)]
    got = {(r["a"], r["b"], r["bin"]): complex(r["re"], r["im"]) for r in arrays.cross_spectra(spark.createDataFrame(rows, "frame long, chan long, bin int, re double, im double")).collect()}
    assert all(abs(got[a, b, k] - (x[:, k, a] * x[:, k, b].conj()).mean()) < 1e-12 for a in range(2) for b in range(a, 2) for k in range(3)) and len(got) == 9


def test_files_round_trip(spark, tmp_path):
    from frameloom.sources import audio

    rows = [(u, c, n, float((n * 37 + c * 11) % 2000 - 1000)) for u in ("a", "b") for c in range(2) for n in range(50)]
    files = audio.wav_files(spark.createDataFrame(rows, "utt string, chan int, n long, x double"), "utt", 8000, 24).withColumn("name", F.concat("utt", F.lit(".wav")))
    audio.write_files(files, f"file://{tmp_path}/w", "name")
    back = audio.samples(audio.read_wav(spark, f"{tmp_path}/w", 16))
    got = {(r["path"][-5:-4], r["chan"], r["n"]): r["x"] for r in back.collect()}
    assert got == {(u, c, n): x for u, c, n, x in rows}
    rate, x = audio.wav(audio.make_wav(np.array([40_000.0, -40_000.0]), 16000))
    assert rate == 16000 and x[:, 0].tolist() == [32767.0, -32768.0]
    frames_ = spark.createDataFrame([("u", k, [float(k), 0.5]) for k in (2, 0, 1)], "utt string, n long, v array<double>")
    audio.write_files(audio.htk_files(frames_, "utt"), f"file://{tmp_path}/h", "utt")
    assert [r["v"] for r in audio.read_htk(spark, f"{tmp_path}/h").orderBy("frame_x").collect()] == [[0.0, 0.5], [1.0, 0.5], [2.0, 0.5]]
    (tmp_path / "m").write_bytes(np.arange(7, dtype="<f4").tobytes())
    assert [r["v"] for r in audio.read_matrix(spark, f"{tmp_path}/m", 3).orderBy("frame_x").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]


def test_streams_of_files(spark, tmp_path):
    from frameloom.sources import audio
    from frameloom.streaming import recursions

    (tmp_path / "in").mkdir()
    lines = [f'{{"key": {k % 2}, "ts": "2020-01-01T00:00:{k:02}Z", "x": {k}.0}}' for k in range(40)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    (tmp_path / "in" / "b.json").write_text('{"key": 9, "ts": "2020-01-01T01:00:00Z", "x": 1.0}')
    stream = audio.read_frames(True, spark, f"{tmp_path}/in", "key long, ts timestamp, x double")
    q = recursions.windowed_power(stream, "key", "ts", "10 seconds", "1 second").writeStream.format("memory").queryName("powers").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["key"], r["start"].second): (r["power"], r["n"]) for r in spark.table("powers").where("key < 9").collect()}
    for key in (0, 1):
        for lo in range(0, 40, 10):
            x = [k for k in range(lo, lo + 10) if k % 2 == key]
            assert got[key, lo] == (sum(v * v for v in x) / 5, 5)


def test_fitted_beams(spark):
    mics = np.array([[0.05 * k, 0, 0] for k in range(3)])
    d = beamforming.manifold(beamforming.plane_wave_delays(mics, 1.0), 2, 8000.0, 4)
    jam = beamforming.manifold(beamforming.plane_wave_delays(mics, 2.4), 2, 8000.0, 4)
    s = noise(400, 2) * RNG.exponential(size=(400, 1)) ** 2
    j = noise(400, 2) * RNG.exponential(size=(400, 1)) ** 2
    x = s[..., None] * d + j[..., None] * jam + 0.01 * noise(400, 2, 3)
    df = snapshots(spark, x[:, 1:]).withColumn("bin", F.lit(1)).withColumn("utt", F.lit("u"))
    plain = (x[:, 1] * d[1].conj()).mean(1)
    for criterion in ("kurtosis", "negentropy"):
        got = blind.fitted_beam(df, d, criterion, alpha=1e-4, rounds=30).orderBy("frame").collect()
        y = np.array([complex(r["re"], r["im"]) for r in got])
        goal = blind.kurtosis if criterion == "kurtosis" else blind.negentropy
        assert goal(y) > goal(plain)
    two = blind.separated_beams(df, np.stack([d, jam]), "gauss", rounds=30).orderBy("frame").collect()
    y = np.array([np.array(r["re"]) + 1j * np.array(r["im"]) for r in two])
    before = np.stack([plain, (x[:, 1] * jam[1].conj()).mean(1)], 1)
    assert blind.mutual_information(y) < 0.3 * blind.mutual_information(before)
    alone = blind.separated_beams(snapshots(spark, (s[..., None] * d)[:, 1:]).withColumn("bin", F.lit(1)).withColumn("utt", F.lit("u")), np.stack([d, jam]), rounds=5).orderBy("frame").collect()
    assert np.allclose([complex(r["re"][0], r["im"][0]) for r in alone], s[:, 1])  # the look direction keeps its gain, whatever the weights
    for kind in ("laplace", "k0", "gamma"):
        assert np.isfinite(blind.mutual_information(before, kind))
    w = blind.null_weights(d[1:], jam[1:])
    assert np.allclose((w.conj() * d[1:]).sum(1), 1, atol=1e-6) and np.allclose((w.conj() * jam[1:]).sum(1), 0, atol=1e-6)
    r = x[:, 1].T @ x[:, 1].conj() / 400
    m = np.stack([d[1], jam[1]], 1)
    g = blind.geometric_separation(r, m)
    off = lambda w: abs((w @ r @ w.conj().T)[0, 1])
    assert off(g) <= off(m.conj().T / 3) and np.abs(g @ m - np.eye(2)).max() < 0.3
    assert np.allclose(blind.descend(lambda v: ((v - [1, 2]) ** 2).sum(), np.zeros(2)), [1, 2], atol=1e-4)


def test_tracking(spark):
    mics = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.5]])
    pairs = tracking.microphone_pairs(4)
    path = [np.array([2 + 0.01 * k, 1.5, 1.0]) for k in range(40)]
    rows = [(1, k, tracking.pair_delays(p, mics, pairs).tolist()) for k, p in enumerate(path)]
    rows[5] = (1, 5, [float("nan")] * 6)
    df = spark.createDataFrame(rows, V)
    got = tracking.track_position(df, "key", mics, np.array([1.5, 1.0, 0.8]), noise=1e-11).orderBy("n").collect()
    assert np.abs(np.array(got[-1]["x"]) - path[-1]).max() < 0.05
    found = tracking.locate(df.where("n <> 5"), mics, np.array([1.5, 1.0, 0.8]), 100).orderBy("n").collect()
    assert np.abs(np.array(found[0]["x"]) - path[0]).max() < 0.02
    f = np.array([[1.0, 1], [0, 1]])
    line = vectors(spark, [[2.0 * k + 1] for k in range(60)])
    last = tracking.kalman(line, "key", f, 1e-6 * np.eye(2), np.array([[1.0, 0]]), np.array([[0.1]]), np.zeros(2), 10 * np.eye(2)).orderBy(F.desc("n")).first()["x"]
    assert abs(last[0] - 119) < 0.1 and abs(last[1] - 2) < 0.01


def test_made_signals_and_records(spark):
    from frameloom import functions as fn
    from frameloom.sources import signals

    read = lambda df: [r["x"] for r in df.orderBy("n").collect()]
    assert read(signals.impulse_train(spark, 5, 2)) == [1, 0, 1, 0, 1] and read(signals.impulse(spark, 3, 1, 2.0)) == [0, 2, 0]
    assert read(signals.triangle(spark, 4, 4)) == [-1, 0, 1, 0] and read(signals.rectangle(spark, 4, 4)) == [1, 1, -1, -1]
    assert np.allclose(read(signals.wave(spark, 8, 1.0, 8.0)), np.sin(2 * np.pi * np.arange(8) / 8)) and read(signals.buffer(spark, [1.0, 2.0], 3)) == [1, 2, 1]
    lines = spark.createDataFrame([("spk1 {UTTS u1 u2} {SEX f} {NAME {A B}}",), ("; no",), ("",), ("spk2 {SEX m}",)], "value string")
    s = {r["sid"]: r for r in signals.speakers(lines).collect()}
    assert s["spk1"]["uids"] == ["u1", "u2"] and s["spk1"]["data"]["NAME"] == ["A B"] and s["spk2"]["uids"] == []
    utts = signals.utterances(spark.createDataFrame([("u2 {SPEAKER spk1} {FILE a.wav} {FROM 5} {TO 9}",), ("u1 {FILE b.wav}",)], "value string"))
    both = {r["uid"]: (r["place"], r["file"], r["cfrom"], r["cto"]) for r in signals.speaker_utterances(signals.speakers(lines), utts).collect()}
    assert both == {"u1": (0, "b.wav", 0, -1), "u2": (1, "a.wav", 5, 9)}
    grid = 'item []:\n item [1]:\n class = "IntervalTier"\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "a""b"\n intervals [2]:\n xmin = 0.5\n xmax = 1\n text = ""\n'
    got = signals.text_grid(spark.createDataFrame([("p", grid)], "path string, content string")).orderBy("k").collect()
    assert [(r["tier"], r["xmin"], r["xmax"], r["text"]) for r in got] == [("phones", 0.0, 0.5, 'a"b'), ("phones", 0.5, 1.0, "")]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert abs(value(fn.log_sub(F.lit(1.0), F.lit(2.0))) + math.log(math.exp(-1) - math.exp(-2))) < 1e-12
    assert all(abs(value(fn.log_factorial(F.lit(n))) - math.lgamma(n + 1)) < 1e-9 for n in (0, 3, 8, 9, 50))
    assert value(fn.polynomial([1.0, 2.0, 3.0], F.lit(2.0))) == 17.0 and value(fn.polynomial([1.0, 2.0, 3.0], F.lit(2.0), True)) == 14.0
    assert abs(value(fn.log_add(F.lit(1.0), F.lit(2.0))) + math.log(math.exp(-1) + math.exp(-2))) < 1e-12


def test_front_end(spark):
    x = RNG.normal(size=1600)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "key long, n long, x double")
    got = np.array([r["v"] for r in frontend.cepstra(df, "key").orderBy("n").collect()])
    y = x - 0.95 * np.concatenate([[0], x[:-1]])
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(320) / 319)
    power = np.array([np.abs(np.fft.rfft(y[160 * k : 160 * k + 320] * w, 512)) ** 2 for k in range(9)])
    mel = np.maximum(power @ frames.sphinx_mel_matrix(30, 257, 512, 16000.0).T, 1e-5)
    assert np.allclose(got, np.log10(mel) @ frames.cosine_matrix(13, 30).T, atol=1e-6)
    d = np.array([r["v"] for r in frontend.with_deltas(frontend.cepstra(df, "key"), "key").orderBy("n").collect()])
    assert d.shape == (9, 39) and np.allclose(d[4, 13:26], sum(c * got[4 - k] for k, c in zip((-2, -1, 0, 1, 2), (0.2, 0.1, 0, -0.1, -0.2))))
