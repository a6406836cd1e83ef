"""Made signals as sample tables (key, n, x), from ranges that Spark deals out, so they have any length; and records of speech databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def function(spark: SparkSession, samples: int, value, key: int = 0) -> DataFrame:
    """x = value(n), a column function of the place."""
    return spark.range(samples).select(F.lit(key).cast("long").alias("key"), F.col("id").alias("n"), value(F.col("id")).cast("double").alias("x"))


def wave(spark: SparkSession, samples: int, frequency: float, rate: float, amplitude: float = 1.0, phase: float = 0.0, key: int = 0) -> DataFrame:
    import math

    return function(spark, samples, lambda n: amplitude * F.sin(n * (2 * math.pi * frequency / rate) + phase), key)


def impulse(spark: SparkSession, samples: int, at: int = 0, amplitude: float = 1.0, key: int = 0) -> DataFrame:
    return function(spark, samples, lambda n: F.when(n == at, amplitude).otherwise(0.0), key)


def impulse_train(spark: SparkSession, samples: int, period: int, amplitude: float = 1.0, key: int = 0) -> DataFrame:
    return function(spark, samples, lambda n: F.when(n % period == 0, amplitude).otherwise(0.0), key)


def triangle(spark: SparkSession, samples: int, period: int, amplitude: float = 1.0, key: int = 0) -> DataFrame:
    """From -amplitude up and down again within a period."""
    return function(spark, samples, lambda n: amplitude * (1 - 4 * F.abs((n % period) / float(period) - 0.5)), key)


def rectangle(spark: SparkSession, samples: int, period: int, amplitude: float = 1.0, key: int = 0) -> DataFrame:
    return function(spark, samples, lambda n: F.when((n % period) * 2 < period, amplitude).otherwise(-amplitude), key)


def buffer(spark: SparkSession, values: list[float], samples: int, key: int = 0) -> DataFrame:
    """A given buffer, again and again."""
    held = F.array(*(F.lit(float(v)) for v in values))
    return function(spark, samples, lambda n: F.get(held, (n % len(values)).cast("int")), key)


# databases: one record per line, {KEY value value} groups, values in braces counting as one


def braces(text: Column) -> Column:
    """Top-level groups of a line without their braces; braces may be nested once."""
    groups = F.regexp_extract_all(text, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), 0)
    return F.transform(groups, lambda g: F.trim(g.substr(F.lit(2), F.length(g) - 2)))


def records(lines: DataFrame) -> DataFrame:
    """Lines (column `value`) of `name {KEY v1 v2} ...` as (name, data: map of key to values); blank lines and comments (;) are left out."""
    line = F.trim("value")
    rows = lines.where((line != "") & ~line.startswith(";"))
    name = F.regexp_extract(line, r"^\{?\s*([^\s{}]+)", 1)
    words = lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"\{[^{}]*\}|[^\s{}]+"), 0), lambda w: F.regexp_replace(w, "[{}]", ""))
    pairs = F.transform(braces(line), lambda g: F.struct(words(g)[0].alias("key"), F.slice(words(g), 2, F.greatest(F.size(words(g)) - 1, F.lit(0))).alias("value")))
    first = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))))
    return rows.select(name.alias("name"), first.alias("data"))


def speakers(lines: DataFrame) -> DataFrame:
    """(sid, uids, data) of speaker records, whose group UTTS lists the utterances."""
    return records(lines).select(F.col("name").alias("sid"), F.coalesce(F.col("data")["UTTS"], F.array().cast("array<string>")).alias("uids"), "data")


def utterances(lines: DataFrame) -> DataFrame:
    """(uid, sid, file, cfrom, cto) of utterance records; without FROM and TO the whole file (0 to -1)."""
    get = lambda k: F.get(F.col("data")[k], 0)
    return records(lines).select(F.col("name").alias("uid"), get("SPEAKER").alias("sid"), get("FILE").alias("file"), F.coalesce(get("FROM").cast("int"), F.lit(0)).alias("cfrom"), F.coalesce(get("TO").cast("int"), F.lit(-1)).alias("cto"))


def speaker_utterances(speakers: DataFrame, utterances: DataFrame) -> DataFrame:
    """Each speaker's utterances in the order of the list, those that are missing left out."""
    each = speakers.select("sid", F.posexplode("uids").alias("place", "uid"))
    return each.join(utterances.drop("sid"), "uid")


def text_grid(files: DataFrame) -> DataFrame:
    """Interval tiers of TextGrid files: rows (path, content: text) -> (path, tier, k, xmin, xmax, text); doubled quotes are one."""
    parts = F.slice(F.split("content", r'class = "IntervalTier"'), 2, 1_000_000)
    tiers = files.select("path", F.posexplode(parts).alias("t", "body"))
    name = F.regexp_extract("body", r'name = "([^"]*)"', 1)
    item = F.regexp_extract_all("body", F.lit(r'intervals \[\d+\]:?\s*xmin = \S+\s*xmax = \S+\s*text = "(?:[^"]|"")*"'), 0)
    each = tiers.select("path", name.alias("tier"), F.posexplode(item).alias("k", "i"))
    number = lambda c: F.regexp_extract("i", rf"{c} = (\S+)", 1).cast("double")
    text = F.regexp_replace(F.regexp_extract("i", r'text = "((?:[^"]|"")*)"', 1), '""', '"')
    return each.select("path", "tier", "k", number("xmin").alias("xmin"), number("xmax").alias("xmax"), text.alias("text"))
