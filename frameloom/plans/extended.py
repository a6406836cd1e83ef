"""More queries: front end, activity, enhancement, arrays, localisation, filter banks, models, lexicon and graphs.

Those whose results SQL can tell have it; the others are held against brute force or exact reconstruction in tests/.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, adaptation, arrays, automata, beamforming, cancellation, enhancement, envelopes, filterbanks, frontend, gaussians, graphs, images, lexicon, localization, temporal
from ..operators import frames as fr
from ..sources import signals
from .catalog import ALL, FRAMES, SAMPLES, SNAPS, W, WORDS, _snapshots, frames, long, query, r, samples, table, whole_arrays, word_graph


def numbers(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select("frame_x", *(r(c, digits).alias(c) for c in names))


# frames and their measures

POWER = f"{FRAMES}, p as (select frame_x, k, x * x + 1e-6::double as p from f)"
UNIT = f"{FRAMES}, u as (select frame_x, k, x / sqrt(sum(x * x) over (partition by frame_x)) as u from f)"


def powers(spark, d) -> DataFrame:
    return frames(spark, d).withColumn("v", F.expr("transform(v, x -> x * x + 1e-6D)"))


query("brightness", f"with {POWER} select frame_x, k, round(sum(p * (k + 1) * 125) over w / sum(p) over w, 6) + 0.0 as y from p window w as (partition by frame_x order by k)")(
    lambda spark, d: long(activity.brightness(powers(spark, d), 16000.0).withColumn("v", F.col("brightness")))
)
query("energy_diffusion", f"with {UNIT} select frame_x, round(sum(case when u > 0 then -u * log10(u) else 0 end), 6) + 0.0 as diffusion from u group by frame_x")(lambda spark, d: numbers(activity.energy_diffusion(frames(spark, d)), "diffusion"))
query("band_energy_ratio", f"with {FRAMES} select frame_x, round(sqrt(sum(x * x) filter (where k < 32) / sum(x * x) filter (where k >= 32)), 6) + 0.0 as ratio from f group by frame_x")(
    lambda spark, d: numbers(activity.band_energy_ratio(frames(spark, d), 16000.0), "ratio")
)
query("significant_bands", f"with {UNIT} select frame_x, count(*) filter (where u > 0.1::double) as bands from u group by frame_x")(lambda spark, d: activity.significant_bands(frames(spark, d), 0.1).select("frame_x", "bands"))
query("bandwidth", f"with {UNIT} select frame_x, round(coalesce(max(k) filter (where u > 0.1::double) - min(k) filter (where u > 0.1::double), 0) * 125.0::double, 6) + 0.0 as bandwidth from u group by frame_x")(
    lambda spark, d: numbers(activity.bandwidth(frames(spark, d), 16000.0, 0.1), "bandwidth")
)
query(
    "negative_entropy",
    f"""with {FRAMES}, m as (select frame_x, avg(abs(x)) as m, sqrt(sum(x * x) / (count(*) - 1) - avg(abs(x)) * avg(abs(x))) as s from f group by frame_x)
select frame_x, round(100 * pow(avg(ln(cosh((abs(x) - m) / s))) - 0.374576::double, 2), 6) + 0.0 as negentropy from f join m using (frame_x) group by frame_x""",
)(lambda spark, d: numbers(activity.negative_entropy(frames(spark, d)), "negentropy"))
query(
    "flux",
    f"""with {UNIT}, o as (select min(frame_x) as o from u), q as (select frame_x, k, u as c from u), a as (select b.frame_x, b.c, z.c as z, y.c as y from q b cross join o join q z on z.frame_x = o and z.k = b.k join q y on y.k = b.k and y.frame_x = greatest(o, b.frame_x - 1))
select frame_x, round(sqrt(sum((c - z) * (c - z))), 6) + 0.0 as flux, round(sqrt(sum((c - y) * (c - y))), 6) + 0.0 as step from a group by frame_x""",
)(lambda spark, d: activity.flux(frames(spark, d).select(F.lit(0).alias("s"), F.col("frame_x").alias("n"), "v"), "s").select(F.col("n").alias("frame_x"), r("flux").alias("flux"), r("step").alias("step")))
query(
    "low_band_ratio",
    f"""with {FRAMES}, l as (select unnest(range(3)) as lag), rr as (select a.frame_x, lag, sum(a.x * b.x) as r from f a cross join l join f b on b.frame_x = a.frame_x and b.k = a.k + lag group by all)
select frame_x, round(sum(r * case lag when 0 then 0.25::double * 0.25 + 0.5 * 0.5 + 0.25 * 0.25 when 1 then 2 * (0.125::double + 0.125) else 2 * 0.0625::double end) / sum(r) filter (where lag = 0), 6) + 0.0 as ratio from rr group by frame_x""",
)(lambda spark, d: numbers(activity.low_band_ratio(frames(spark, d), np.array([0.25, 0.5, 0.25])), "ratio"))
query(
    "energy_activity",
    f"""with recursive {SAMPLES}, p as (select key, n, x * x as e from s), m as (select key, n, e, 0.1::double * e as m from p where n = 0 union all select p.key, p.n, p.e, 0.9::double * m.m + 0.1::double * p.e from m join p on p.key = m.key and p.n = m.n + 1)
select key, n, cast(m > 0 and e / m > 1.2::double as integer) as speech from m""",
)(lambda spark, d: activity.energy_activity(samples(spark, d).select("key", "n", (F.col("x") * F.col("x")).alias("energy")), "key", 1.2, 0.9).select("key", "n", "speech"))
query("percentile_activity")(lambda spark, d: activity.percentile_activity(samples(spark, d).select("key", "n", (F.col("x") * F.col("x")).alias("energy")), "key", 0.5, 20, 2, 3, 1e9))
query("likelihood_activity")(
    lambda spark, d: activity.likelihood_activity(fr.fft(temporal.frames(samples(spark, d), "key", 16, 16), 16).select("key", F.col("frame_x").alias("n"), "re", "im"), "key", np.full(16, 2000.0), 0.2).select("key", "n", r("score").alias("score"), "speech")
)
query("pitch")(lambda spark, d: envelopes.pitch(frames(spark, d), 16000.0).select("frame_x", r("pitch").alias("pitch")))
query(
    "spike_line",
    f"with {FRAMES} select frame_x, k, round(x, 6) + 0.0 as y from f",
)(lambda spark, d: long(envelopes.remove_spikes(frames(spark, d).select(F.lit(0).alias("s"), F.col("frame_x").alias("n"), "v"), "s").withColumnRenamed("n", "frame_x")))
query("mean_subtracted", f"with {FRAMES} select frame_x, k, round((x - avg(x) over w) / sqrt(greatest(var_pop(x) over w, 1e-4::double)), 6) + 0.0 as y from f window w as (partition by label, k)")(
    lambda spark, d: long(frontend.subtract_mean(frames(spark, d), "label", deviation=1.0))
)
query(
    "weighted_mean_subtracted",
    f"with {FRAMES}, g as (select *, (frame_x % 3)::double as w from f) select frame_x, k, round(x - sum(w * x) over p / sum(w) over p, 6) + 0.0 as y from g window p as (partition by label, k)",
)(lambda spark, d: long(frontend.subtract_mean(frames(spark, d).withColumn("w", (F.col("frame_x") % 3).cast("double")), "label", weight="w")))
query(
    "running_mean_subtracted",
    f"with recursive {FRAMES}, o as (select *, row_number() over (partition by label, k order by frame_x) - 1 as n from f), m as (select label, k, n, frame_x, x, 0.02::double * x as m from o where n = 0 union all select o.label, o.k, o.n, o.frame_x, o.x, 0.98::double * m.m + 0.02::double * o.x from m join o on o.label = m.label and o.k = m.k and o.n = m.n + 1 where o.n < 500) select frame_x, k, round(x - m, 6) + 0.0 as y from m",
)(lambda spark, d: long(frontend.subtract_running_mean(frames(spark, d).withColumn("n", F.col("frame_x")), "label", keep=["frame_x"])))
query("delayed", f"with {SAMPLES} select key, n, round(coalesce(lag(x, 3) {W}, 0), 6) + 0.0 as y from s")(lambda spark, d: frontend.delay(samples(spark, d), "key", 3).select("key", "n", r("y").alias("y")))
query("segment_cut", f"with {SAMPLES}, z as (select key, n, x - avg(x) {ALL} as z from s) select key, n - 5 as n, round(z, 9) + 0.0 as x from z where n between 5 and 25")(
    lambda spark, d: frontend.cut(samples(spark, d), "key", 5, 25, zero_mean=True).select("key", "n", r("x", 9).alias("x"))
)
query(
    "resampled",
    f"""with {SAMPLES}, e as (select key, floor((max(n) + 1) * 0.5::double) as last from s group by key), m as (select key, unnest(range(0, cast(last as bigint))) as n from e)
select m.key, m.n, round(sum(s.x * greatest(0, 1 - abs(m.n / 0.5::double - s.n))), 6) + 0.0 as x from m join s on s.key = m.key and abs(m.n / 0.5::double - s.n) <= 1 group by m.key, m.n""",
)(lambda spark, d: filterbanks.resample(samples(spark, d), "key", 16000, 8000, kind="linear").select("key", "n", r("x").alias("x")))
query("burg_envelope")(lambda spark, d: long(envelopes.lpc_envelope(frames(spark, d), 8, 64, "burg")))
query("minimum_variance_envelope")(lambda spark, d: long(envelopes.mvdr_envelope(frames(spark, d), 10, warp=0.2)))
query("cepstral_envelope")(lambda spark, d: long(envelopes.cepstral_envelope(fr.fft(frames(spark, d), 64), 8, 64)))

# arrays, post-filters and masks

PAIRS4 = f"{SNAPS}, whole as (select frame from c group by frame having count(distinct chan) = 4), v as (select * from c where frame in (select frame from whole))"


def vectors4(spark, d) -> DataFrame:
    return arrays.snapshot_vectors(whole_arrays(_snapshots(spark, d)))


def steering() -> np.ndarray:
    return beamforming.manifold(np.arange(4) * 1e-5, 9, 16000.0, 16)


def complex_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r("re").alias("re"), r("im").alias("im"))


query("beamformed", f"with {PAIRS4}, p as (select *, bin * 2 * pi() * 16000.0::double / 16 * chan * 1e-5::double as a from v) select frame, cast(bin as integer) as bin, round(avg(re * cos(a) - im * sin(a)), 6) + 0.0 as re, round(avg(re * sin(a) + im * cos(a)), 6) + 0.0 as im from p group by frame, bin")(
    lambda spark, d: complex_rows(beamforming.apply_weights(vectors4(spark, d), beamforming.delay_and_sum_weights(steering())), "frame", "bin")
)
query(
    "zelinski_gain",
    f"""with {PAIRS4}, x as (select a.frame, a.bin, sum(a.re * b.re + a.im * b.im) as cross_sum from v a join v b on b.frame = a.frame and b.bin = a.bin and a.chan < b.chan group by all), y as (select frame, bin, sum(re * re + im * im) as auto_sum from v group by all)
select x.frame, cast(x.bin as integer) as bin, round(least(1, greatest(1e-4::double, case when auto_sum > 0 then greatest(cross_sum, 0) / auto_sum * 2 / 3 else 0 end)), 6) + 0.0 as gain from x join y using (frame, bin)""",
)(lambda spark, d: enhancement.zelinski(vectors4(spark, d), 0.0).select("frame", "bin", r("gain").alias("gain")))
query("mccowan_gain")(
    lambda spark, d: enhancement.mccowan(vectors4(spark, d), dict(enumerate(beamforming.diffuse_coherence(np.array([[0.05 * k, 0, 0] for k in range(4)]), 9, 16000.0, 16))), 0.6).select("frame", "bin", r("gain").alias("gain"))
)
query("minimum_variance_beam")(lambda spark, d: _mvdr(spark, d))
query("adaptive_beam")(lambda spark, d: complex_rows(beamforming.adaptive_canceller(vectors4(spark, d), beamforming.delay_and_sum_weights(steering()), steering(), "rls", 0.95, 1.0), "frame", "bin"))


def _mvdr(spark, d) -> DataFrame:
    v = vectors4(spark, d)
    cov = beamforming.covariances(v, 9)
    return complex_rows(beamforming.mvdr(v, cov, steering(), 1.0), "frame", "bin")


query("blocked", f"with {PAIRS4} select frame, cast(bin as integer) as bin, cast(chan as bigint) as chan, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from v")(
    lambda spark, d: complex_rows(_exploded(beamforming.project(vectors4(spark, d), np.broadcast_to(np.eye(4, dtype=complex), (9, 4, 4)))), "frame", "bin", "chan")
)


def _exploded(df: DataFrame) -> DataFrame:
    each = df.select("frame", "bin", F.posexplode(F.arrays_zip("re", "im")).alias("chan", "z"))
    return each.select("frame", "bin", F.col("chan").cast("long").alias("chan"), "z.re", "z.im")


def _channel(spark, d, chan: int) -> DataFrame:
    return whole_arrays(_snapshots(spark, d)).where(F.col("chan") == chan).select("frame", "bin", "re", "im")


query(
    "subtracted",
    f"""with {PAIRS4}, a as (select * from v where chan = 0), z as (select bin, avg(re * re + im * im) as z from v where chan = 1 group by bin), p as (select *, re * re + im * im as p from a join z using (bin))
select frame, cast(bin as integer) as bin, round(case when p > 0 then re * sqrt(greatest(p - 0.5::double * z, 0.001::double) / p) else sqrt(0.001::double) end, 6) + 0.0 as re, round(case when p > 0 then im * sqrt(greatest(p - 0.5::double * z, 0.001::double) / p) else 0 end, 6) + 0.0 as im from p""",
)(lambda spark, d: complex_rows(enhancement.spectral_subtraction(_channel(spark, d, 0), enhancement.average_noise(_channel(spark, d, 1)), 0.5), "frame", "bin"))
query("level_mask", f"with {PAIRS4} select a.frame, cast(a.bin as integer) as bin, case when a.re * a.re + a.im * a.im >= 1.44::double * (b.re * b.re + b.im * b.im) then 1.0::double else 0.1::double end as gain from v a join v b using (frame, bin) where a.chan = 0 and b.chan = 1")(
    lambda spark, d: enhancement.level_mask(_channel(spark, d, 0), _channel(spark, d, 1), 1.2, 0.1)
)
query("high_passed", f"with {PAIRS4} select frame, cast(bin as integer) as bin, round(case when bin between 1 and 2 then 0 else re end, 6) + 0.0 as re, round(case when bin between 1 and 2 then 0 else im end, 6) + 0.0 as im from v where chan = 0")(
    lambda spark, d: complex_rows(enhancement.high_pass(_channel(spark, d, 0), 3), "frame", "bin")
)
query("forward_backward_covariances")(lambda spark, d: _fb(spark, d))


def _fb(spark, d) -> DataFrame:
    cov = beamforming.covariances(vectors4(spark, d), 9, both_ways=True)
    rows = [(b, i, j, round(float(cov[b, i, j].real), 5) + 0.0, round(float(cov[b, i, j].imag), 5) + 0.0) for b in range(len(cov)) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "bin int, a int, b int, re double, im double")


query("phase_delays")(
    lambda spark, d: localization.gcc(localization.channel_pairs(whole_arrays(_snapshots(spark, d))), 16000.0, "phat").select("frame", "a", "b", r(F.col("delay")[0] * 16000).alias("delay"), r(F.col("value")[0]).alias("value"))
)
query("steered_directions")(
    lambda spark, d: localization.steered_power(vectors4(spark, d), localization.plane_manifolds(np.array([[0.05 * k, 0, 0] for k in range(4)]), localization.linear_grid(19), 9, 16000.0, 16), 2).select("frame", "rank", "place", r("power", 4).alias("power"))
)
query("kalman_echo")(lambda spark, d: complex_rows(cancellation.kalman_echo(_echo_rows(spark, d), 2, threshold=0.0), "frame", "bin"))


def _echo_rows(spark, d) -> DataFrame:
    a, b = _channel(spark, d, 0), _channel(spark, d, 1)
    return a.withColumnRenamed("re", "rec_re").withColumnRenamed("im", "rec_im").join(b.withColumnRenamed("re", "play_re").withColumnRenamed("im", "play_im"), ["frame", "bin"])


def _round_trip(spark, d, kind: str) -> DataFrame:
    s = samples(spark, d)
    if kind == "cosine":
        p = filterbanks.cosine_prototype(4, 4)
        out, late = filterbanks.cosine_synthesis(filterbanks.cosine_analysis(s, "key", p, 4), "key", p, 4), len(p) - 1
    else:
        p = filterbanks.low_pass_prototype(32, 1 / 16)
        out, late = filterbanks.synthesis(filterbanks.analysis(s, "key", p, 8, 4), "key", filterbanks.synthesis_prototype(p, 8, 4), 8, 4), len(p) - 1
    return out.where(F.col("n") >= late).select("key", (F.col("n") - late).alias("n"), r("x", 3).alias("x"))


#: A bank's delay eats the end of a stream: what comes back is every sample but the last `late` ones, and those that don't fill a block.
BACK = "with {S}, e as (select key, (max(n) {PLUS}) // {D} * {D} as total from s group by key) select key, n, round(x, 3) + 0.0 as x from s join e using (key) where n < total - {LATE}"
query("transform_bank", BACK.format(S=SAMPLES, D=4, PLUS="+ 4", LATE=31))(lambda spark, d: _round_trip(spark, d, "transform"))
query("cosine_bank")(lambda spark, d: _round_trip(spark, d, "cosine"))
query(
    "convolved",
    f"with {SAMPLES}, e as (select key, (max(n) + 1) // 8 * 8 as total from s group by key) select a.key, a.n, round(sum(b.x * case a.n - b.n when 0 then 0.5::double when 1 then 0.25::double else -0.125::double end), 6) + 0.0 as x from s a join e using (key) join s b on b.key = a.key and b.n between a.n - 2 and a.n where a.n < total group by a.key, a.n",
)(lambda spark, d: _convolved(spark, d, False))
query(
    "convolved_by_saving",
    f"with {SAMPLES}, e as (select key, (max(n) + 1) // 8 * 8 as total from s group by key) select a.key, a.n, round(sum(b.x * case a.n - b.n when 0 then 0.5::double when 1 then 0.25::double else -0.125::double end), 6) + 0.0 as x from s a join e using (key) join s b on b.key = a.key and b.n between a.n - 2 and a.n where a.n < total group by a.key, a.n",
)(lambda spark, d: _convolved(spark, d, True))


def _convolved(spark, d, save: bool) -> DataFrame:
    blocks = temporal.frames(samples(spark, d), "key", 8, 8).withColumnRenamed("frame_x", "n")
    out = filterbanks.convolve(blocks, "key", np.array([0.5, 0.25, -0.125]), save)
    return out.select("key", F.col("n").alias("b"), F.posexplode("v").alias("k", "x")).select("key", (F.col("b") * 8 + F.col("k")).cast("long").alias("n"), r("x").alias("x"))


# models and adaptation

STATS = f"{FRAMES}, st as (select label, frame_x % 4 as spk, k, count(*) as occ, sum(x) as s1, sum(x * x) as s2 from f where label is not null group by all)"
query("speaker_statistics", f"with {STATS} select label, spk, k, occ, round(s1, 6) + 0.0 as first, round(s2, 6) + 0.0 as second from st")(lambda spark, d: _stats_rows(_stats(spark, d)))


def _stats(spark, d) -> DataFrame:
    return gaussians.statistics(frames(spark, d).where("label is not null").withColumn("spk", F.col("frame_x") % 4), ["label", "spk"])


def _stats_rows(s: DataFrame) -> DataFrame:
    each = s.select("label", "spk", "occ", F.posexplode(F.arrays_zip("first", "second")).alias("k", "z"))
    return each.select("label", "spk", F.col("k").cast("long").alias("k"), F.col("occ").cast("long").alias("occ"), r("z.first").alias("first"), r("z.second").alias("second"))


query(
    "adapted_means",
    f"with {STATS}, b as (select label, k, greatest(sum(s2) / sum(occ) - pow(sum(s1) / sum(occ), 2), 1e-4::double) as var from st group by all) select label, k, round(sum(2 * (s1 - occ * spk) / var) / sum(4 * occ / var), 6) + 0.0 as mean from st join b using (label, k) group by label, k",
)(lambda spark, d: _adapted(spark, d))


def _adapted(spark, d) -> DataFrame:
    """Every speaker's transform doubles the mean and adds the speaker's number."""
    book = gaussians.collect_book(gaussians.codebook(frames(spark, d), least=0))
    n = book.mu.shape[1]
    moves = {s: (2 * np.eye(n), np.full(n, float(s))) for s in range(4)}
    out = adaptation.adaptive_means(_stats(spark, d), moves, book, "spk")
    return out.select("label", F.posexplode("mean").alias("k", "x")).select("label", F.col("k").cast("long").alias("k"), r("x").alias("mean"))


query("regression_transforms")(lambda spark, d: _mllr(spark, d))


def _mllr(spark, d) -> DataFrame:
    f = frames(spark, d).where("label is not null").withColumn("v", F.slice("v", 1, 6))
    book = gaussians.collect_book(gaussians.codebook(f))
    stats = gaussians.statistics(f.withColumn("spk", F.col("frame_x") % 4), ["label", "spk"])
    out = adaptation.regression_transforms(stats, book, "spk")
    return out.select("spk", F.col("occ").cast("long").alias("occ"), r(F.aggregate("bias", F.lit(0.0), lambda s, x: s + x), 3).alias("bias"))


query(
    "transformed",
    f"with {FRAMES} select a.frame_x, a.k, round(a.x + 0.5::double * b.x + 1, 6) + 0.0 as y from f a join f b on b.frame_x = a.frame_x and b.k // 32 = a.k // 32 and b.k % 32 = (a.k + 1) % 32",
)(lambda spark, d: long(adaptation.transform_frames(frames(spark, d), np.eye(32) + 0.5 * np.roll(np.eye(32), 1, axis=1), np.ones(64), 2)))
query("discriminants")(lambda spark, d: long(fr.linear_transform(frames(spark, d), gaussians.discriminants(frames(spark, d), 4)).withColumn("v", F.transform("v", lambda x: F.abs(x)))))
query(
    "total_variance",
    f"with {FRAMES}, q as (select k, var_pop(x) as v from f group by k) select round(sum(v), 6) + 0.0 as variance from q",
)(lambda spark, d: _variance(spark, d))


def _variance(spark, d) -> DataFrame:
    """The variances along all principal axes add up to the total variance."""
    mean, axes = gaussians.principal_axes(frames(spark, d), 64)
    z = images.project_axes(frames(spark, d), mean, axes).select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("v"))
    return z.agg(r(F.sum("v")).alias("variance"))


query("shape_factors")(
    lambda spark, d: activity.fit_shapes(
        whole_arrays(_snapshots(spark, d)).select(F.col("chan").alias("class"), "bin", "re", "im").withColumn("variance", F.lit(2000.0)), np.array([0.2, 0.4, 0.6, 0.8, 1.0])
    ).select("class", "bin", "shape", r("log_likelihood", 3).alias("log_likelihood"))
)

# images: a frame of 64 values is an image of 8 x 8

query("image_crop", f"with {FRAMES} select frame_x, (k // 8 - 1) * 4 + k % 8 - 2 as k, round(x, 6) + 0.0 as y from f where k // 8 between 1 and 5 and k % 8 between 2 and 5")(lambda spark, d: long(images.crop(frames(spark, d), 8, 8, 2, 1, 4, 5)))
NEAR = f"{FRAMES}, o as (select unnest([-1, 0, 1]) as dy), q as (select unnest([-1, 0, 1]) as dx), t as (select a.frame_x, a.k, b.x from f a, o, q join f b on b.frame_x = a.frame_x and b.k = least(7, greatest(0, a.k // 8 + dy)) * 8 + least(7, greatest(0, a.k % 8 + dx)))"
for _name, _sql, _run in (
    ("image_mean", "avg(x)", lambda f: images.smooth(f, 8, 8, "mean")),
    ("image_median", "median(x)", lambda f: images.smooth(f, 8, 8, "median")),
    ("image_erode", "min(x)", lambda f: images.morphology(f, 8, 8, "erode")),
    ("image_gradient", "max(x) - min(x)", lambda f: images.morphology(f, 8, 8, "gradient")),
):
    query(_name, f"with {NEAR} select frame_x, k, round({_sql}, 6) + 0.0 as y from t group by frame_x, k")(lambda spark, d, run=_run: long(run(frames(spark, d))))
query("image_threshold", f"with {FRAMES} select frame_x, k, case when x > 0.05::double then 255.0::double else 0 end as y from f")(lambda spark, d: long(images.threshold(frames(spark, d), 8, 8, 0.05)))
query("image_edges")(lambda spark, d: long(images.edges(frames(spark, d), 8, 8, 0.3, 0.8)))
query("optical_flow")(lambda spark, d: images.optical_flow(frames(spark, d).select("label", F.col("frame_x").alias("n"), "v"), "label", 8, 8, 1.0, 10).select("label", "n", r(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("moved")))

# lexicon

BENCH_WORDS = "w as (select item_id, unnest(range(len(string_split(text, ' ')))) as k, unnest(string_split(text, ' ')) as word from benchmark)"
query("symbol_table", f"with {BENCH_WORDS} select word as symbol, row_number() over (order by word) as id from (select distinct word from w)")(
    lambda spark, d: lexicon.symbol_table(table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")), "word")
)
query(
    "dictionary",
    "select word, cast(1 as integer) as variant, cast(len(word) as integer) as phones, word[1] as first from (select distinct unnest(string_split(text, ' ')) as word from benchmark) where regexp_full_match(word, '[a-z]+')",
)(lambda spark, d: _dictionary(spark, d).select("word", "variant", F.size("phones").alias("phones"), F.col("phones")[0]["phone"].alias("first")))


def _dictionary(spark, d) -> DataFrame:
    """Words spelt out, with the first letter tagged."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct().where(F.col("w").rlike("^[a-z]+$"))
    spelt = F.regexp_replace(F.expr("substring(w, 2)"), "(.)", " $1")
    return lexicon.dictionary(words.select(F.concat("w", F.lit(" {"), F.substring("w", 1, 1), F.lit(" WB}"), spelt).alias("line")))


query(
    "pronunciation_distances",
    f"with {BENCH_WORDS}, a as (select item_id, list(word order by k) as l from w group by item_id) select a.item_id, len(list_filter(range(1, greatest(len(a.l), len(b.l)) + 1), lambda i: coalesce(a.l[i], '') <> coalesce(b.l[i], '')))::integer as distance from a join a b on b.item_id = a.item_id + 1",
)(
    lambda spark, d: lexicon.pronunciation_distance(
        table(spark, d, "benchmark").alias("a").join(table(spark, d, "benchmark").alias("b"), F.expr("a.item_id + 1 = b.item_id")).select(F.col("a.item_id").alias("item_id"), F.split("a.text", " ").alias("x"), F.split("b.text", " ").alias("y")), "x", "y"
    ).select("item_id", "distance")
)
query(
    "lexicon_graph",
    f"with {BENCH_WORDS}, v as (select word, row_number() over (order by word) as id from (select distinct word from w)), p as (select id, len(word) as n, unnest(range(len(word))) as k, word from v) select case when k = 0 then 0 else id * 65536 + 256 + k end as src, case when k = n - 1 then 0 else id * 65536 + 256 + k + 1 end as dst, ord(word[k + 1])::bigint as isym, case when k = 0 then id else 0 end as osym, 0.0::double as cost from p",
)(lambda spark, d: _lexicon(spark, d))


def _lexicon(spark, d) -> DataFrame:
    words = lexicon.symbol_table(table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")), "word")
    letters = F.transform(F.split("symbol", ""), lambda c: F.ascii(c).cast("long"))
    return lexicon.lexicon_graph(words.select(F.col("id").alias("word"), F.lit(1).alias("variant"), letters.alias("phones")))


# graphs, one per item: the words of an item as a chain, each also leading one further for a cost

LATTICE = f"{BENCH_WORDS}, n as (select item_id, count(*) as n from w group by item_id), v as (select word, row_number() over (order by word) as id from (select distinct word from w)), e as (select item_id, k as src, k + 1 as dst, id, 0.5::double as cost from w join v using (word) union all select item_id, k, k + 2, id, 1.75::double from w join v using (word) join n using (item_id) where k + 2 <= n)"


def lattices(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.size(F.split("text", " ")).cast("long").alias("n"), F.posexplode(F.split("text", " ")).alias("k", "word"))
    ids = lexicon.symbol_table(words, "word")
    w = words.join(ids, F.col("word") == F.col("symbol"))
    edge = lambda far, cost: w.select("item_id", F.col("k").cast("long").alias("src"), (F.col("k") + far).cast("long").alias("dst"), F.col("id").alias("isym"), F.col("id").alias("osym"), F.lit(cost).alias("cost"), "n")
    every = edge(1, 0.5).union(edge(2, 1.75)).where("dst <= n").drop("n")
    zero = F.lit(0).cast("long")
    ends = words.select("item_id", F.col("n").alias("src"), F.lit(-1).cast("long").alias("dst"), zero.alias("isym"), zero.alias("osym"), F.lit(0.0).alias("cost")).distinct()
    return every.unionByName(ends)


query("best_path", f"with {LATTICE} select item_id, cast(0 as integer) as rank, round(n * 0.5::double, 6) as cost, n::integer as words from n")(
    lambda spark, d: automata.best_paths(lattices(spark, d), ["item_id"]).select("item_id", "rank", r("cost").alias("cost"), F.size("osyms").alias("words"))
)
query("second_path", f"with {LATTICE} select item_id, cast(1 as integer) as rank, round((n - 2) * 0.5::double + 1.75::double, 6) as cost from n where n >= 2")(
    lambda spark, d: automata.best_paths(lattices(spark, d), ["item_id"], 2).where("rank = 1").select("item_id", "rank", r("cost").alias("cost"))
)
query(
    "edge_posteriors",
    f"""with recursive {LATTICE}, a as (select item_id, 0 as s, 1.0::double as p, 0.0::double as q from n union all select a.item_id, a.s + 1, a.p * exp(-0.5::double) + a.q * exp(-1.75::double), a.p from a join n using (item_id) where a.s < n.n),
b as (select a.item_id, n.n - a.s as s, a.p from a join n using (item_id)), z as (select a.item_id, a.p as z from a join n using (item_id) where a.s = n.n)
select e.item_id, e.src, e.dst, round(a.p * exp(-e.cost) * b.p / z, 6) + 0.0 as gamma from e join a on a.item_id = e.item_id and a.s = e.src join b on b.item_id = e.item_id and b.s = e.dst join z on z.item_id = e.item_id""",
)(lambda spark, d: automata.posteriors(lattices(spark, d), ["item_id"]).select("item_id", "src", "dst", r("gamma").alias("gamma")))
query("pruned_lattice", f"with {LATTICE} select item_id, src, dst, cost from e where dst = src + 1")(lambda spark, d: automata.pruned(lattices(spark, d), ["item_id"], 0.5).where("dst >= 0").select("item_id", "src", "dst", "cost"))
query("determinized")(lambda spark, d: automata.determinized(lattices(spark, d), ["item_id"]).groupBy("item_id").agg(F.count("*").alias("edges"), r(F.sum("cost")).alias("cost")))
query("minimized")(lambda spark, d: automata.minimized(lattices(spark, d), ["item_id"]).groupBy("item_id").agg(F.count("*").alias("edges")))
query("linear_graphs", f"with {BENCH_WORDS}, v as (select word, row_number() over (order by word) as id from (select distinct word from w)) select item_id, k as src, k + 1 as dst, id as isym from w join v using (word) union all select item_id, count(*), -1, 0 from w group by item_id")(
    lambda spark, d: automata.linear_graph(lattices(spark, d).where("dst = src + 1").groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("src", "isym"))), lambda e: e["isym"]).alias("words")), ["item_id"]).select("item_id", "src", "dst", "isym")
)
query("confusion_networks")(lambda spark, d: automata.confusion_networks(lattices(spark, d), ["item_id"]).select("item_id", "slot", "word", r("p").alias("p")))
query("encoded", f"with {LATTICE} select item_id, src, dst, id as isym, id as osym, cost from e")(lambda spark, d: automata.decode(automata.encode(lattices(spark, d).where("dst >= 0"))).select("item_id", "src", "dst", "isym", "osym", "cost"))
query("self_loops", f"with {LATTICE}, t as (select item_id, src as s from e union select item_id, dst from e) select item_id, src, dst, id as isym from e union all select item_id, s, s, 900000 from t")(
    lambda spark, d: automata.self_loops(lattices(spark, d), ["item_id"], [900000]).where("dst >= 0").select("item_id", "src", "dst", "isym")
)
query("hidden_markov", f"with {LATTICE} select item_id, cast(count(*) * 7 + 1 as bigint) as edges from e group by item_id")(lambda spark, d: automata.hidden_markov(lattices(spark, d), ["item_id"]).groupBy("item_id").agg(F.count("*").alias("edges")))
query("decoded")(lambda spark, d: _decoded(spark, d))


def _decoded(spark, d) -> DataFrame:
    """Frames of each class as an utterance, decoded over a loop of classes."""
    f = frames(spark, d).where("label is not null")
    book = gaussians.collect_book(gaussians.codebook(f))
    loop = [(0, 0, k + 1, k + 1, math.log(len(book.classes))) for k in range(len(book.classes))]
    scored = gaussians.scores(f, book).select(F.col("label").alias("utt"), F.col("frame_x").alias("n"), "scores")
    out = automata.decode_utterances(scored, loop, {0: 0.0}, lm_scale=1.0)
    return out.select("utt", r("cost", 3).alias("cost"), F.size("words").alias("words"), "active")


query("breadth_first", f"with recursive {WORDS}, b as (select 0::bigint as state, 0 as level union select e.dst, b.level + 1 from b join e on e.src = b.state where b.level < 30) select state, cast(min(level) as double) as level from b group by state")(
    lambda spark, d: graphs.shortest(word_graph(spark, d).withColumn("cost", F.lit(1.0)), 0).select("state", F.col("cost").alias("level"))
)


# made signals, whose number of samples is that of the events

for _name, _sql, _run in (
    ("made_wave", "sin(n * (2 * pi() * 440 / 16000))", lambda spark, n: signals.wave(spark, n, 440.0, 16000.0)),
    ("made_triangle", "1 - 4 * abs((n % 20) / 20.0::double - 0.5::double)", lambda spark, n: signals.triangle(spark, n, 20)),
    ("made_rectangle", "case when (n % 20) * 2 < 20 then 1 else -1 end", lambda spark, n: signals.rectangle(spark, n, 20)),
    ("made_impulses", "case when n % 7 = 0 then 1 else 0 end", lambda spark, n: signals.impulse_train(spark, n, 7)),
):
    query(_name, f"with s as (select unnest(range(count(*))) as n from events) select n, round({_sql}, 6) + 0.0 as x from s")(lambda spark, d, run=_run: run(spark, table(spark, d, "events").count()).select("n", r("x").alias("x")))
query(
    "running_frames",
    f"with {FRAMES}, l as (select label, k, frame_x, lag(x) over w as before from f window w as (partition by label, k order by frame_x)) select frame_x, count(before)::integer as had, round(sum(coalesce(before, 0)), 6) + 0.0 as total from l group by frame_x",
)(lambda spark, d: _last(spark, d))


def _last(spark, d) -> DataFrame:
    """The vector before each one of its label: how many values it has, and their sum."""
    past = frontend.last_frames(frames(spark, d).withColumn("n", F.col("frame_x")), "label", 2)
    before = F.get("past", F.lit(1))
    return past.select("frame_x", F.coalesce(F.size(before), F.lit(0)).alias("had"), before.alias("b")).select("frame_x", F.greatest("had", F.lit(0)).alias("had"), r(F.coalesce(F.aggregate("b", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))).alias("total"))


query("cepstra")(lambda spark, d: frontend.cepstra(samples(spark, d), "key", 16, 8, 32, 8, 6).select("key", F.col("n").alias("frame_x"), F.posexplode("v").alias("k", "x")).select("key", "frame_x", "k", r("x").alias("x")))
