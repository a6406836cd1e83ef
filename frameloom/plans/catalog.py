"""All queries of the signal and graph operators, by name, with the SQL that tells their results.

Tables play these roles: embeddings are feature frames (vec_id: frame, label: class), events are sampled signals (user_id:
channel, in order of ts and event_id), texts of conversations are utterances, word pairs of benchmark are graph edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import arrays, enhancement, gaussians, graphs, lexicon, metrics, temporal
from ..operators import frames as fr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "nearest_gaussian"

FRAMES = "f as (select vec_id as frame_x, label, unnest(range(len(embedding))) as k, unnest(embedding)::double as x from embeddings)"
SAMPLES = "s as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as x from events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_x"), "label", F.col("embedding").cast("array<double>").alias("v"))


def samples(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("value").alias("x"))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def long(df: DataFrame, name: str = "y") -> DataFrame:
    return df.select("frame_x", F.posexplode("v").alias("k", "x")).select("frame_x", F.col("k").cast("long").alias("k"), r("x").alias(name))


def frame_query(name: str, op, sql_value: str, where: str = "", n: str = "") -> None:
    """A frame-wise map whose value at k is sql_value in terms of x, k and n (the frame's length)."""
    size = "g as (select *, count(*) over (partition by frame_x) as n from f), "
    query(name, f"with {FRAMES}, {size}h as (select frame_x, k, n, x, {sql_value} as y from g {where}) select frame_x, k, round(y, 6) + 0.0 as y from h {n}")(lambda spark, d: long(op(frames(spark, d))))


frame_query("hamming", fr.hamming, "x * (0.54::double - 0.46::double * cos(2 * pi() * k / (n - 1)))")
frame_query("amplify", lambda df: fr.amplify(df, 2.5), "x * 2.5::double")
frame_query("log_scale", lambda df: fr.log_scale(df, 10.0, 0.1), "10 * log10(case when x + 0.1::double > 0 then x + 0.1::double else 1 end)")
frame_query("log_floor", lambda df: fr.log_scale(df, 10.0, floor=1e-5), "10 * log10(greatest(x, 1e-5::double))")
frame_query("threshold_upper", lambda df: fr.threshold(df, 0.0, 0.1), "case when x >= 0.1::double then 0 else x end")
frame_query("threshold_both", lambda df: fr.threshold(df, 1.0, 0.1, "both"), "case when x >= 0.1::double then 1 when x <= -0.1::double then -1 else x end")
query(
    "resample_spectrum",
    f"""with {FRAMES} select a.frame_x, a.k, round(b.x + (a.k * 0.75::double - floor(a.k * 0.75::double)) * (c.x - b.x), 6) + 0.0 as y
from f a join f b on b.frame_x = a.frame_x and b.k = floor(a.k * 0.75::double) join f c on c.frame_x = a.frame_x and c.k = least(floor(a.k * 0.75::double) + 1, 63)""",
)(lambda spark, d: long(fr.resample_spectrum(frames(spark, d), 0.75)))
query("channel_extraction", f"with {FRAMES} select frame_x, (k - 1) // 4 as k, round(x, 6) + 0.0 as y from f where k % 4 = 1")(lambda spark, d: long(fr.channel(frames(spark, d), 1, 4)))
query("median_filter", f"with {FRAMES} select frame_x, k, round(case when k < 1 or k >= 63 then x else median(x) over (partition by frame_x order by k rows between 1 preceding and 1 following) end, 6) + 0.0 as y from f")(
    lambda spark, d: long(fr.median_filter(frames(spark, d), 3))
)
query("signal_power", f"with {FRAMES} select frame_x, round(sum(x * x) / count(*) / (65536.0::double * 65536 / 4) * 1e12, 6) + 0.0 as power from f group by frame_x")(
    lambda spark, d: fr.signal_power(frames(spark, d)).select("frame_x", r(F.col("power") * 1e12).alias("power"))
)
query(
    "zero_crossings",
    f"""with {FRAMES}, g as (select *, lead(x) over (partition by frame_x order by k) as z from f)
select frame_x, round(sum(case when k < 63 and (z >= 0) <> (x >= 0) then (0.54::double - 0.46::double * cos(2 * pi() * k / 63)) else 0 end) / 64, 6) + 0.0 as rate from g group by frame_x""",
)(lambda spark, d: fr.zero_crossings(frames(spark, d)).select("frame_x", r("rate").alias("rate")))
query(
    "dft_power",
    f"""with {FRAMES}, b as (select unnest(range(33)) as bin),
g as (select frame_x, bin, sum(x * cos(2 * pi() * k * bin / 64)) as re, sum(x * sin(2 * pi() * k * bin / 64)) as im from f, b group by all)
select frame_x, bin as k, round(re * re + im * im, 6) + 0.0 as y from g""",
)(lambda spark, d: long(fr.dft_power(frames(spark, d), 33)))
query(
    "cepstrum",
    f"with {FRAMES}, b as (select unnest(range(13)) as c) select frame_x, c as k, round(sum(x * cos(pi() * c * (k + 0.5::double) / 64)), 6) + 0.0 as y from f, b group by all",
)(lambda spark, d: long(fr.cepstrum(frames(spark, d), 13, 64)))
MEL = """e as (select unnest(range(12)) as j), edge as (select j, 700 * (10 ** (j * 2595 * log10(1 + 8000.0::double / 700) / 11 / 2595) - 1) as hz from e),
tri as (select a.j as c, a.hz as l, b.hz as m, c.hz as r, k from edge a join edge b on b.j = a.j + 1 join edge c on c.j = a.j + 2, (select unnest(range(64)) as k) k)"""
query(
    "mel_filterbank",
    f"""with {FRAMES}, {MEL}, w as (select c, k, 2 / (r - l) * case when (k + 1) * 125 <= m then ((k + 1) * 125 - l) / (m - l) else (r - (k + 1) * 125) / (r - m) end as w from tri where k between ceil(l / 125) and floor(r / 125))
select frame_x, c as k, round(sum(x * w) * 1e3, 6) + 0.0 as y from f join w using (k) group by frame_x, c""",
)(lambda spark, d: long(fr.amplify(fr.mel_filterbank(frames(spark, d), 10, 64, 16000.0), 1e3)))
query(
    "sphinx_mel_filterbank",
    f"""with {FRAMES}, {MEL}, w as (select c, k, greatest(0, least((k * 125 - l) / (m - l), (r - k * 125) / (r - m))) as w from tri where k > 0)
select frame_x, c as k, round(sum(x * w), 6) + 0.0 as y from f join w using (k) group by frame_x, c""",
)(lambda spark, d: long(fr.sphinx_mel_filterbank(frames(spark, d), 10, 64, 128, 16000.0)))
query(
    "warped_spectrum",
    f"""with {FRAMES}, b as (select unnest(range(65)) as k), p as (select k, case when k / 64.0::double < 0.8::double / 1.1 then 1.1 * k / 64.0::double else (1 - 0.8::double) / (1 - 0.8::double / 1.1) * k / 64.0::double + 1 - (1 - 0.8::double) / (1 - 0.8::double / 1.1) end * 64 as "at" from b),
w as (select k, "at" as lo, lead("at") over (order by k) as hi from p)
select frame_x, w.k, round(sum(x * greatest(0, least(hi, f.k + 1) - greatest(lo, f.k))), 6) + 0.0 as y from f, w where w.k < 64 group by frame_x, w.k""",
)(lambda spark, d: long(fr.warp_spectrum(frames(spark, d), 64, 1.1, 0.8)))
query("cepstrum_first_type", f"with {FRAMES}, b as (select unnest(range(13)) as c) select frame_x, c as k, round(sum(x * case when k in (0, 63) then 1 else 2 end * cos(pi() * c * k / 63)), 6) + 0.0 as y from f, b group by all")(
    lambda spark, d: long(fr.cepstrum(frames(spark, d), 13, 64, 0))
)
query("cepstrum_halved", f"with {FRAMES}, b as (select unnest(range(13)) as c) select frame_x, c as k, round(sum(x * case when k = 0 then 0.5::double else 1 end * cos(pi() * c * (k + 0.5::double) / 64)) / 64, 6) + 0.0 as y from f, b group by all")(
    lambda spark, d: long(fr.cepstrum(frames(spark, d), 13, 64, 2))
)
query(
    "fft",
    f"with {FRAMES}, b as (select unnest(range(128)) as bin) select frame_x, bin as k, round(sum(x * cos(2 * pi() * k * bin / 128)), 6) + 0.0 as re, round(-sum(x * sin(2 * pi() * k * bin / 128)), 6) + 0.0 as im from f, b group by all",
)(lambda spark, d: fr.fft(frames(spark, d), 128).select("frame_x", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("frame_x", F.col("k").cast("long").alias("k"), r("z.re").alias("re"), r("z.im").alias("im")))
query("autocorrelation", f"with {FRAMES}, l as (select unnest(range(5)) as lag) select a.frame_x, lag as k, round(sum(a.x * b.x), 6) + 0.0 as y from f a cross join l join f b on b.frame_x = a.frame_x and b.k = a.k + lag group by all")(
    lambda spark, d: long(fr.autocorrelation(frames(spark, d), 5))
)
query(
    "lpc_pair",
    f"""with {FRAMES}, l as (select unnest(range(3)) as lag), r as (select a.frame_x, lag, sum(a.x * b.x) as r from f a cross join l join f b on b.frame_x = a.frame_x and b.k = a.k + lag group by all),
w as (select frame_x, max(r) filter (where lag = 0) as r0, max(r) filter (where lag = 1) as r1, max(r) filter (where lag = 2) as r2 from r group by frame_x), a as (select *, r1 * (r2 - r0) / (r0 * r0 - r1 * r1) as a1, (r1 * r1 - r0 * r2) / (r0 * r0 - r1 * r1) as a2 from w)
select frame_x, round(a1, 6) + 0.0 as a1, round(a2, 6) + 0.0 as a2, round(r0 + a1 * r1 + a2 * r2, 6) + 0.0 as error from a""",
)(lambda spark, d: fr.lpc(frames(spark, d), 2).select("frame_x", r(F.col("v")[1]).alias("a1"), r(F.col("v")[2]).alias("a2"), r("error").alias("error")))
query("lpc")(lambda spark, d: fr.lpc(frames(spark, d), 8).select("frame_x", F.posexplode("v").alias("k", "a"), "error"))
query(
    "spectral_shape",
    f"""with {FRAMES}, p as (select frame_x, k, x * x + 1e-6::double as p from f), t as (select frame_x, sum(p) as total, sum(k * p) / sum(p) as centroid, exp(avg(ln(p))) / avg(p) as flatness from p group by frame_x),
c as (select *, sum(p) over (partition by frame_x order by k) as upto from p)
select frame_x, round(any_value(total), 6) + 0.0 as total, round(any_value(centroid), 6) + 0.0 as centroid, round(sqrt(sum((k - centroid) * (k - centroid) * p) / any_value(total)), 6) + 0.0 as bandwidth,
cast(count(*) filter (where upto < 0.85::double * total) as integer) as rolloff, round(any_value(flatness), 6) + 0.0 as flatness from c join t using (frame_x) group by frame_x""",
)(lambda spark, d: fr.spectral_shape(frames(spark, d).withColumn("v", F.expr("transform(v, x -> x * x + 1e-6D)"))).select("frame_x", *(r(c).alias(c) for c in ("total", "centroid", "bandwidth")), "rolloff", r("flatness").alias("flatness")))


def sample_query(name: str, op, sql: str) -> None:
    query(name, f"with {SAMPLES}, h as ({sql}) select key, n, round(y, 6) + 0.0 as y from h")(lambda spark, d: op(samples(spark, d)).select("key", "n", r("y").alias("y")))


W = "over (partition by key order by n)"
ALL = "over (partition by key)"
sample_query("preemphasis", lambda s: temporal.preemphasis(s, "key"), f"select key, n, x - 0.95::double * coalesce(lag(x) {W}, 0) as y from s")
sample_query("fir", lambda s: temporal.fir(s, "key", [0.5, 0.3, 0.2]), f"select key, n, 0.5::double * coalesce(lead(x) {W}, 0) + 0.3::double * x + 0.2::double * coalesce(lag(x) {W}, 0) as y from s")
sample_query(
    "delta",
    lambda s: temporal.delta(s, "key", 2),
    f"select key, n, (coalesce(lead(x) {W}, last_value(x) over (partition by key order by n rows between unbounded preceding and unbounded following)) - coalesce(lag(x) {W}, first_value(x) {W}) + 2 * (coalesce(lead(x, 2) {W}, last_value(x) over (partition by key order by n rows between unbounded preceding and unbounded following)) - coalesce(lag(x, 2) {W}, first_value(x) {W}))) / 10 as y from s",
)
sample_query("mean_variance_normalised", lambda s: temporal.mean_normalised(s, "key"), f"select key, n, (x - avg(x) {ALL}) / sqrt(greatest(var_pop(x) {ALL}, 1e-4::double)) as y from s")
sample_query("range_normalised", lambda s: temporal.range_normalised(s, "key"), f"select key, n, case when max(x) {ALL} > min(x) {ALL} then (x - min(x) {ALL}) / (max(x) {ALL} - min(x) {ALL}) else 0 end as y from s")
sample_query("adaptive_log", lambda s: temporal.adaptive_log(s, "key"), f"select key, n, log10(case when x + max(x) {ALL} / 10000 > 0 then x + max(x) {ALL} / 10000 else 1 end) as y from s")
query("running_mean", f"with {SAMPLES} select key, n, round(avg(x) {W}, 10) + 0.0 as y from s")(lambda spark, d: temporal.running_mean(samples(spark, d), "key").select("key", "n", r("y", 10).alias("y")))
ORACLE_RECURSION = "with recursive {S}, e as (select key, n, 0.1::double * x as y from s where n = 0 union all select s.key, s.n, 0.9::double * e.y + 0.1::double * s.x from e join s on s.key = e.key and s.n = e.n + 1) "
query("exponential_mean", ORACLE_RECURSION.replace("{S}", SAMPLES) + "select key, n, y::float::double as y from e")(lambda spark, d: temporal.exponential_mean(samples(spark, d), "key", 0.9).select("key", "n", F.col("y").cast("float").cast("double").alias("y")))
query(
    "wiener_gain",
    f"""with recursive {SAMPLES}, p as (select key, n, x * x as s, greatest((x - 20) * (x - 20) / 4, 0.001::double) as z from s),
e as (select key, n, s, z from p where n = 0 union all select p.key, p.n, case when p.n > 1 then 0.6::double * e.s + 0.4::double * p.s else p.s end, case when p.n > 1 then 0.6::double * e.z + 0.4::double * p.z else p.z end from e join p on p.key = e.key and p.n = e.n + 1)
select key, n, round(s / (s + 2 * z), 6) + 0.0 as gain from e""",
)(lambda spark, d: enhancement.wiener_gain(samples(spark, d).selectExpr("key", "n", "x * x as signal", "(x - 20) * (x - 20) / 4 as noise"), ["key"], alpha=0.6, beta=2.0).select("key", "n", r("gain").alias("gain")))
query(
    "framing",
    f"with {SAMPLES}, t as (select key, unnest(range(0, max(n) - 6, 4)) // 4 as frame_x from s group by key) select key, frame_x, n - frame_x * 4 as k, round(x, 6) + 0.0 as x from t join s using (key) where n between frame_x * 4 and frame_x * 4 + 7",
)(lambda spark, d: temporal.frames(samples(spark, d), "key", 8, 4).select("key", "frame_x", F.posexplode("v").alias("k", "x")).select("key", "frame_x", F.col("k").cast("long").alias("k"), r("x").alias("x")))
query(
    "stacking",
    f"with {FRAMES}, m as (select min(frame_x) as lo, max(frame_x) as hi from f), d as (select unnest([-1, 0, 1]) as d) select a.frame_x, (d + 1) * 64 + b.k as k, round(b.x, 6) + 0.0 as y from (select distinct frame_x from f) a, m, d join f b on b.frame_x = least(hi, greatest(lo, a.frame_x + d))",
)(lambda spark, d: long(temporal.stack(frames(spark, d).withColumn("u", F.lit(0)).withColumn("n", F.col("frame_x")), "u", 1, 1)))
query("merge", f"with {FRAMES} select frame_x, k, round(x, 6) + 0.0 as y from f union all select frame_x, k + 64, round(2.0::double * x, 6) + 0.0 from f")(
    lambda spark, d: long(temporal.merge(frames(spark, d), fr.amplify(frames(spark, d), 2.0).select("frame_x", "v"), "frame_x"))
)
query(
    "as_of_merge",
    """with a as (select event_id, user_id, ts from events), b as (select user_id, ts, max(value) as value from events where event_type = (select max(event_type) from events) group by all)
select a.event_id, round(b.value, 6) + 0.0 as held from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts""",
)(lambda spark, d: _as_of(table(spark, d, "events")))


def _as_of(e: DataFrame) -> DataFrame:
    """Every event with the last value of the greatest event type."""
    last = e.agg(F.max("event_type").alias("t"))
    left = e.select("event_id", "user_id", "ts")
    right = e.join(F.broadcast(last), F.col("event_type") == F.col("t")).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.as_of(left, right, "user_id", "ts", "value").select("event_id", r("held").alias("held"))


query("mix", f"with {SAMPLES} select a.key, a.n, round(a.x + 10 ** (-6.0::double / 20) * b.x, 6) + 0.0 as y from s a join s b on b.key = a.key and b.n = a.n + 1")(
    lambda spark, d: temporal.mix(samples(spark, d), samples(spark, d).withColumn("n", F.col("n") - 1), ["key", "n"], -6.0).select("key", "n", r("y").alias("y"))
)
query(
    "cross_correlation",
    f"with {SAMPLES}, l as (select unnest(range(-5, 6)) as lag) select a.key, cast(lag as integer) as lag, round(sum(a.x * b.x), 4) + 0.0 as r from s a cross join l join s b on b.key = a.key + 1 and b.n = a.n + lag group by a.key, lag",
)(lambda spark, d: _correlation(samples(spark, d)))


def _correlation(s: DataFrame) -> DataFrame:
    """Every channel with the next one."""
    return temporal.cross_correlation(s, s.withColumn("key", F.col("key") - 1), 5, ["key"]).select("key", "lag", r("r", 4).alias("r"))


HITS = f"with {SAMPLES}, h as (select key, n, cast(x > avg(x) {ALL} as integer) as hit from s), c as (select *, case when min(hit) over (partition by key order by n rows between 1 preceding and current row) = 1 and n >= 1 then 1 when max(hit) over (partition by key order by n rows between 2 preceding and current row) = 0 and n >= 2 then 0 end as c from h), v as (select key, n, coalesce(last_value(c ignore nulls) over (partition by key order by n rows between unbounded preceding and current row), 0) as speech from c)"


def _speech(spark, d) -> DataFrame:
    s = samples(spark, d)
    return temporal.hang_over(s.withColumn("hit", F.col("x") > F.avg("x").over(Window.partitionBy("key"))), "key", 2, 3)


query("speech_activity", HITS + " select key, n, speech from v")(lambda spark, d: _speech(spark, d).select("key", "n", "speech"))
query(
    "speech_segments",
    HITS + ", g as (select *, n - row_number() over (partition by key, speech order by n) as g from v) select key, min(n) as first, max(n) as last, count(*) as size from g where speech = 1 group by key, g",
)(lambda spark, d: temporal.segments(_speech(spark, d), "key"))

GAUSS = f"{FRAMES}, book as (select label, k, count(*) as occ, avg(x) as mu, greatest(avg(x * x) - avg(x) * avg(x), 1e-4::double) as var from f where label is not null group by all having count(*) > 5)"
SCORES = GAUSS + ", sc as (select frame_x, book.label as class, sum((x - mu) * (x - mu) / var + ln(var) + ln(2 * pi())) / 2 as score from f join book using (k) group by all)"
WEIGHTS = ", wn as (select label as class, count(*) + 1e-4::double as n from embeddings where label is not null group by label), wt as (select class, n / sum(n) over () as weight from wn)"


def _book(spark, d, weights: bool = False) -> gaussians.Book:
    f = frames(spark, d)
    return gaussians.collect_book(gaussians.codebook(f), gaussians.mixture_weights(f) if weights else None)


query("codebook", f"with {GAUSS} select label, cast(k as integer) as dim, occ, round(mu, 6) + 0.0 as mu, round(var, 6) + 0.0 as var from book")(
    lambda spark, d: gaussians.codebook(frames(spark, d)).select("label", "dim", "occ", r("mu").alias("mu"), r("var").alias("var"))
)
query("gaussian_scores", f"with {SCORES} select frame_x, class, round(score, 6) + 0.0 as score from sc")(lambda spark, d: _by_class(gaussians.scores(frames(spark, d), book := _book(spark, d)), book, "scores", "score"))
query(FLAGSHIP, f"with {SCORES} select frame_x, class, round(score, 6) + 0.0 as score from sc qualify row_number() over (partition by frame_x order by score, class) = 1")(
    lambda spark, d: gaussians.best(frames(spark, d), _book(spark, d)).select("frame_x", "class", r("score").alias("score"))
)
query("mixture_weights", f"with x as (select 1){WEIGHTS} select class, round(weight, 9) + 0.0 as weight from wt")(lambda spark, d: gaussians.mixture_weights(frames(spark, d)).select("class", r("weight", 9).alias("weight")))
query("mixture_score", f"with {SCORES}{WEIGHTS}, s as (select frame_x, score - ln(weight) as s from sc join wt using (class)), m as (select frame_x, min(s) as low from s group by frame_x) select frame_x, round(min(low) - ln(sum(exp(low - s))), 6) + 0.0 as score from s join m using (frame_x) group by frame_x")(
    lambda spark, d: gaussians.mixture(frames(spark, d), _book(spark, d, True)).select("frame_x", r("score").alias("score"))
)
query("mixture_posteriors", f"with {SCORES}{WEIGHTS}, s as (select frame_x, class, score - ln(weight) as s from sc join wt using (class)), e as (select *, exp(min(s) over (partition by frame_x) - s) as e from s) select frame_x, class, round(e / sum(e) over (partition by frame_x), 6) + 0.0 as p from e")(
    lambda spark, d: _by_class(gaussians.posteriors(frames(spark, d), book := _book(spark, d, True)), book, "p", "p")
)


def _by_class(df: DataFrame, book: gaussians.Book, values: str, name: str) -> DataFrame:
    names = F.array(*(F.lit(c) for c in book.classes))
    each = df.select("frame_x", F.posexplode(values).alias("k", "x"))
    return each.select("frame_x", F.get(names, F.col("k")).alias("class"), r("x").alias(name))


query(
    "scatter_matrices",
    f"""with {FRAMES}, b as (select a.label, a.k as i, b.k as j, count(*) as n, sum(a.x) as si, sum(b.x) as sj, sum(a.x * b.x) as sij from f a join f b on b.frame_x = a.frame_x group by all)
select cast(i as integer) as i, cast(j as integer) as j, round(sum(sij - si * sj / n) / sum(n), 6) + 0.0 as within, round((sum(si * sj / n) - sum(si) * sum(sj) / sum(n)) / sum(n), 6) + 0.0 as between from b group by i, j""",
)(lambda spark, d: gaussians.scatter(frames(spark, d)).select("i", "j", r("within").alias("within"), r("between").alias("between")))

# Every four users in order form an array of four channels; a frame's id is array * 2^32 + its place.
SNAPS = f"{SAMPLES}, t as (select key % 4 as chan, (key // 4) * 4294967296 + n // 16 as frame, n % 16 as i, x from s), c as (select chan, frame, bin, sum(x * cos(2 * pi() * i * bin / 16)) as re, -sum(x * sin(2 * pi() * i * bin / 16)) as im from t, (select unnest(range(9)) as bin) group by chan, frame, bin having count(*) = 16)"


def _snapshots(spark, d) -> DataFrame:
    f = temporal.frames(samples(spark, d), "key", 16, 16)
    frame = F.floor(F.col("key") / 4) * (1 << 32) + F.col("frame_x")
    return arrays.spectra(f.select((F.col("key") % 4).alias("chan"), frame.cast("long").alias("frame"), "v"), ["chan", "frame"], 9, 16)


query("spectra", f"with {SNAPS} select chan, frame, cast(bin as integer) as bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from c")(lambda spark, d: _snapshots(spark, d).select("chan", "frame", "bin", r("re").alias("re"), r("im").alias("im")))
query(
    "delay_and_sum",
    f"with {SNAPS}, p as (select *, bin * 2 * pi() * 16000.0::double / 16 * chan * 1e-5::double as a from c) select frame, cast(bin as integer) as bin, round(avg(re * cos(a) - im * sin(a)), 6) + 0.0 as re, round(avg(re * sin(a) + im * cos(a)), 6) + 0.0 as im from p group by frame, bin",
)(lambda spark, d: arrays.delay_and_sum(_snapshots(spark, d), {k: k * 1e-5 for k in range(4)}, 16000.0, 16).select("frame", "bin", r("re").alias("re"), r("im").alias("im")))
query(
    "cross_spectra",
    f"with {SNAPS}, whole as (select frame from c group by frame having count(distinct chan) = 4), v as (select * from c where frame in (select frame from whole)) select a.chan as a, b.chan as b, cast(a.bin as integer) as bin, round(avg(a.re * b.re + a.im * b.im), 6) + 0.0 as re, round(avg(a.im * b.re - a.re * b.im), 6) + 0.0 as im from v a join v b on b.frame = a.frame and b.bin = a.bin and a.chan <= b.chan group by all",
)(lambda spark, d: arrays.cross_spectra(whole_arrays(_snapshots(spark, d))).select("a", "b", "bin", r("re").alias("re"), r("im").alias("im")))


def whole_arrays(snapshots: DataFrame, channels: int = 4) -> DataFrame:
    """Frames that all channels have."""
    whole = snapshots.where("bin = 0").groupBy("frame").agg(F.count("*").alias("c")).where(F.col("c") == channels).select("frame")
    return snapshots.join(whole, "frame", "left_semi")


query(
    "echo_canceller",
    f"""with recursive {SAMPLES}, g as (select key, n, x, coalesce(lag(x) {W}, 0) as f0, coalesce(lag(x, 2) {W}, 0) as f1, coalesce(lag(x, 3) {W}, 0) as f2, coalesce(lag(x, 4) {W}, 0) as f3 from s),
u as (select key, n, x, [f0, f1, f2, f3] as u, 0.001::double + f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3 as p from g),
e as (select key, n, x as e, list_transform(u, lambda y: 0.5::double * x * y / p) as w from u where n = 0
union all select u.key, u.n, u.x - list_inner_product(e.w, u.u), [e.w[1] + 0.5::double * (u.x - list_inner_product(e.w, u.u)) * u.u[1] / p, e.w[2] + 0.5::double * (u.x - list_inner_product(e.w, u.u)) * u.u[2] / p, e.w[3] + 0.5::double * (u.x - list_inner_product(e.w, u.u)) * u.u[3] / p, e.w[4] + 0.5::double * (u.x - list_inner_product(e.w, u.u)) * u.u[4] / p] from e join u on u.key = e.key and u.n = e.n + 1)
select key, n, round(e, 6) + 0.0 as e from e""",
)(lambda spark, d: arrays.echo_canceller(samples(spark, d).withColumn("far", F.lag("x", 1, 0.0).over(temporal.ordered("key"))), "key").select("key", "n", r("e").alias("e")))


def _noisy(spark, d) -> DataFrame:
    return samples(spark, d).withColumn("z", F.col("x") * 1.1 + 0.01 * F.col("n") % 3)


NOISY = f"with {SAMPLES}, z as (select *, x * 1.1::double + 0.01::double * n % 3 as z from s)"
query("snr", NOISY + " select key, round(10 * log10(sum(x * x) / sum((z - x) * (z - x))), 6) + 0.0 as snr from z group by key")(lambda spark, d: metrics.snr(_noisy(spark, d), "key", "x", "z").select("key", r("snr").alias("snr")))
query("segmental_snr", NOISY + ", g as (select key, n // 10 as g, 10 * log10(sum(x * x) / sum((z - x) * (z - x))) as snr from z group by all) select key, round(avg(greatest(-10.0::double, least(35.0::double, snr))), 6) + 0.0 as snr from g group by key")(
    lambda spark, d: metrics.segmental_snr(_noisy(spark, d), "key", "x", "z", 10).select("key", r("snr").alias("snr"))
)
query("itakura_saito", NOISY + " select key, round(avg(x / z - ln(x / z) - 1), 6) + 0.0 as distance from z where x > 0 and z > 0 group by key")(lambda spark, d: metrics.itakura_saito(_noisy(spark, d), "key", "x", "z").select("key", r("distance").alias("distance")))
query(
    "detection_counts",
    "with t as (select unnest([100.0::double, 1000, 3000]) as threshold), x as (select l.toxic, d.n_chars::double as s from labels l join documents d using (doc_id)) select threshold, count(*) filter (where s >= threshold and toxic = 1) as hits, count(*) filter (where s < threshold and toxic = 1) as misses, count(*) filter (where s >= threshold and toxic = 0) as false_alarms, count(*) filter (where s < threshold and toxic = 0) as rejections from x, t group by threshold",
)(lambda spark, d: metrics.detection(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("s", F.col("n_chars").cast("double")), "toxic", "s", [100.0, 1000.0, 3000.0]))
query("word_errors")(
    lambda spark, d: metrics.word_errors(
        table(spark, d, "benchmark").alias("a").join(table(spark, d, "benchmark").alias("b"), F.expr("a.item_id + 1 = b.item_id")).select(F.col("a.item_id").alias("item_id"), F.col("a.text").alias("ref"), F.col("b.text").alias("hyp")), "ref", "hyp"
    ).select("item_id", "errors")
)

# Word graph of the benchmark items: states are words (0: start, 1: end), costs -ln of the share of a word's successors.
WORDS = """w as (select item_id, unnest(range(len(string_split(text, ' ')))) as k, unnest(string_split(text, ' ')) as word from benchmark),
voc as (select word, row_number() over (order by word) + 1 as id from (select distinct word from w)),
p as (select item_id, k, id from w join voc using (word)),
q as (select coalesce(a.id, 0) as src, b.id as dst from p b left join p a on a.item_id = b.item_id and a.k = b.k - 1 union all select id, 1 from p qualify row_number() over (partition by item_id order by k desc) = 1),
e as (select src, dst, -ln(count(*) / sum(count(*)) over (partition by src)) as cost from q group by src, dst)"""


def word_graph(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("k", "word"))
    vocabulary = lexicon.symbol_table(words, "word", first=2)
    p = words.join(vocabulary, F.col("word") == F.col("symbol")).select("item_id", "k", "id")
    w = Window.partitionBy("item_id").orderBy("k")
    steps = p.select(F.lag("id", 1, 0).over(w).alias("src"), F.col("id").alias("dst"), F.lead("id").over(w).alias("next"))
    pairs = steps.select("src", "dst").union(steps.where("next is null").select("dst", F.lit(1).cast("long")))
    n = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    cost = -F.log(F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    return n.select("src", "dst", F.col("dst").alias("isym"), F.col("dst").alias("osym"), cost.alias("cost"))


query("word_graph", f"with {WORDS} select src, dst, round(cost, 6) + 0.0 as cost from e")(lambda spark, d: word_graph(spark, d).select("src", "dst", r("cost").alias("cost")))
query("graph_reverse", f"with {WORDS} select dst as src, src as dst, round(cost, 6) + 0.0 as cost from e")(lambda spark, d: graphs.reverse(word_graph(spark, d)).select("src", "dst", r("cost").alias("cost")))
query(
    "shortest_costs",
    f"with recursive {WORDS}, r as (select 0::bigint as state, 0::double as cost, 0 as depth union select e.dst, min(r.cost + e.cost), r.depth + 1 from r join e on e.src = r.state where r.depth < 30 group by e.dst, r.depth) select state, round(min(cost), 6) + 0.0 as cost from r group by state",
)(lambda spark, d: graphs.shortest(word_graph(spark, d), 0).select("state", r("cost").alias("cost")))


def _final(spark) -> DataFrame:
    return spark.createDataFrame([(1, 0.0)], "state long, cost double")


def _with_dead_ends(edges: DataFrame) -> DataFrame:
    """Each state gets a step to where nothing goes on and one from where nothing leads to."""
    way = lambda a, b: edges.select(a.alias("src"), b.alias("dst"), "isym", "osym", "cost").distinct()
    return edges.union(way(F.col("dst"), F.col("dst") + 1_000_000)).union(way(F.col("src") + 2_000_000, F.col("src")))


query("graph_purge", f"with {WORDS} select src, dst, round(cost, 6) + 0.0 as cost from e")(lambda spark, d: graphs.purge(_with_dead_ends(word_graph(spark, d)), 0, _final(spark)).select("src", "dst", r("cost").alias("cost")))
query(
    "push_weights",
    f"with recursive {WORDS}, r as (select 1::bigint as state, 0::double as cost, 0 as depth union select e.src, min(r.cost + e.cost), r.depth + 1 from r join e on e.dst = r.state where r.depth < 30 group by e.src, r.depth), d as (select state, min(cost) as d from r group by state) select src, dst, round(cost + b.d - a.d, 6) + 0.0 as cost from e join d a on a.state = src join d b on b.state = dst",
)(lambda spark, d: graphs.push_weights(word_graph(spark, d), _final(spark))[0].select("src", "dst", r("cost").alias("cost")))
query("compose", f"with {WORDS} select (src * 1048576 + src) * 3 as src, (dst * 1048576 + dst) * 3 as dst, dst as isym, dst as osym, round(2 * cost, 6) + 0.0 as cost from e")(
    lambda spark, d: graphs.compose(word_graph(spark, d), word_graph(spark, d), 1 << 20).select("src", "dst", "isym", "osym", r("cost").alias("cost"))
)

from . import extended  # noqa: E402, F401  more queries, which are added to the same tables
