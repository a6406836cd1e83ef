"""Symbol tables, pronunciation dictionaries, phone sets and phonetic decision trees."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batch import sums


def symbol_table(df: DataFrame, column: str, order: str | None = None, first: int = 1) -> DataFrame:
    """(symbol, id) of the distinct symbols of a column, numbered from `first` in order of their first place (`order`) or of
    their bytes; 0 is the empty symbol. Ids are dense: places are counted per range of the sorted symbols and the ranges' sizes added
    up, so no task sees all of them. Nulls get no id."""
    s = df.where(F.col(column).isNotNull())
    s = s.groupBy(F.col(column).alias("symbol")).agg(F.min(order).alias("__o")) if order else s.select(F.col(column).alias("symbol")).distinct().withColumn("__o", F.lit(0))
    by = [F.col("__o"), F.col("symbol").cast("binary")]
    parts = s.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    # an id is the partition in the upper bits and the place in the lower 33
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    parts = parts.select("symbol", part.alias("__p"), place.alias("__k"))
    sizes = parts.groupBy("__p").agg((F.max("__k") + 1).alias("__n"))  # one row per range
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    return parts.join(F.broadcast(before), "__p").select("symbol", (F.col("__k") + F.col("__b") + first).alias("id"))


def encode_symbols(df: DataFrame, column: str, table: DataFrame, unknown: int | None = None) -> DataFrame:
    """df with `column` as ids; symbols that the table lacks get `unknown` (null by default)."""
    out = df.join(table.select(F.col("symbol").alias("__s"), F.col("id").alias("__id")), F.col(column) == F.col("__s"), "left")
    return out.withColumn(column, F.coalesce("__id", F.lit(unknown).cast("long"))).drop("__s", "__id")


def read_lexicon(spark: SparkSession, path: str, comment: str = ";") -> DataFrame:
    """Lines "symbol [index]" in order of the file; the order counts, not the index. Comments and blank lines are left out."""
    lines = spark.read.text(path).withColumn("__k", F.monotonically_increasing_id())
    line = F.trim("value")
    lines = lines.where((line != "") & ~line.startswith(comment)).select(F.split(line, r"\s+")[0].alias("symbol"), "__k")
    return symbol_table(lines, "symbol", "__k", first=0)


def read_dictionary(spark: SparkSession, path: str, comment: str = ";") -> DataFrame:
    """Lines "word phone ..." or "{word} {phone {phone WB} ...}": (word, variant, phones: array of struct<phone, tags>). "word(2)" is variant 2."""
    lines = spark.read.text(path)
    line = F.trim("value")
    return dictionary(lines.where((line != "") & ~line.startswith(comment)).select(line.alias("line")))


def dictionary(lines: DataFrame) -> DataFrame:
    """Dictionary entries from a column `line`."""
    braced = F.col("line").startswith("{")
    head = F.when(braced, F.regexp_extract("line", r"^\{([^}]*)\}", 1)).otherwise(F.regexp_extract("line", r"^(\S+)", 1))
    rest = F.trim(F.when(braced, F.regexp_extract("line", r"^\{[^}]*\}\s*(.*)$", 1)).otherwise(F.regexp_extract("line", r"^\S+\s*(.*)$", 1)))
    rest = F.when(braced, F.regexp_replace(rest, r"^\{(.*)\}$", "$1")).otherwise(rest)
    variant = F.regexp_extract(head, r"\((\d+)\)$", 1)
    return lines.select(F.regexp_replace(head, r"\(\d+\)$", "").alias("word"), F.when(variant != "", variant.cast("int")).otherwise(1).alias("variant"), tagged(rest).alias("phones"))


def tagged(text: Column) -> Column:
    """Phones of a string, with their tags: "AH {B WB} {S {WB STRESS}}"."""
    items = F.regexp_extract_all(F.regexp_replace(text, r"\{(\S+)\s*\{([^}]*)\}\s*\}", "{$1 $2}"), F.lit(r"\{[^}]*\}|[^\s{}]+"), 0)
    parts = lambda x: F.split(F.trim(F.regexp_replace(x, r"[{}]", "")), r"\s+")
    return F.transform(items, lambda x: F.struct(parts(x)[0].alias("phone"), F.slice(parts(x), 2, F.size(parts(x))).alias("tags")))


def phone_sets(lines: DataFrame) -> DataFrame:
    """Lines "NAME phone phone ...": (name, phones)."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where(F.trim("line") != "").select(parts[0].alias("name"), F.slice(parts, 2, F.size(parts)).alias("phones"))


def pronunciation_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mismatches at equal places plus the difference of lengths, as `distance`: two arrays of phones."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return df.withColumn("distance", same)


def lexicon_graph(words: DataFrame) -> DataFrame:
    """Edges of a lexicon transducer for (word id, variant, phones: array of ids): a chain of phones for each variant from state 0 back to
    state 0, the word being put out at the first phone. States are numbered by word and variant."""
    n = F.size("phones")
    base = F.col("word").cast("long") * 65536 + F.col("variant").cast("long") * 256
    step = words.where(n > 0).select("word", n.alias("n"), base.alias("base"), F.posexplode("phones").alias("k", "phone"))
    src, dst = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("base") + F.col("k")), F.when(F.col("k") == F.col("n") - 1, F.lit(0)).otherwise(F.col("base") + F.col("k") + 1)
    return step.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.col("phone").cast("long").alias("isym"), F.when(F.col("k") == 0, F.col("word")).otherwise(0).cast("long").alias("osym"), F.lit(0.0).alias("cost"))


# decision trees


class Node:
    """A question (place in the context, set of phones) with a branch for either answer, or a leaf with a name."""

    def __init__(self, name: str, place: int | None = None, phones: frozenset[str] = frozenset(), yes: Node | None = None, no: Node | None = None):
        self.name, self.place, self.phones, self.yes, self.no = name, place, phones, yes, no

    def leaves(self) -> list[str]:
        return [self.name] if self.place is None else [*self.yes.leaves(), *self.no.leaves()]


def tree_leaf(tree: Node, context: Column) -> Column:
    """Name of the leaf for a context (array of phones, place 0 the left end): a CASE of the tree's questions, run in the JVM."""
    if tree.place is None:
        return F.lit(tree.name)
    asked = F.coalesce(F.get(context, tree.place).isin(sorted(tree.phones)), F.lit(False))
    return F.when(asked, tree_leaf(tree.yes, context)).otherwise(tree_leaf(tree.no, context))


def write_tree(tree: Node) -> str:
    if tree.place is None:
        return tree.name
    return f"({tree.name} {tree.place} {','.join(sorted(tree.phones))} {write_tree(tree.yes)} {write_tree(tree.no)})"


def read_tree(text: str) -> Node:
    """A tree written by write_tree."""
    tokens = re.findall(r"[()]|[^\s()]+", text)

    def parse(k: int) -> tuple[Node, int]:
        if tokens[k] != "(":
            return Node(tokens[k]), k + 1
        name, place, phones = tokens[k + 1 : k + 4]
        yes, k = parse(k + 4)
        no, k = parse(k)
        return Node(name, int(place), frozenset(phones.split(",")), yes, no), k + 1

    return parse(0)[0]


def _log_variance(s: np.ndarray) -> float:
    """-count * sum ln variance of statistics (occupancy, sums, squares): the likelihood of one Gaussian but for constants."""
    d = (len(s) - 1) // 2
    if s[0] <= 0:
        return 0.0
    mean = s[1 : 1 + d] / s[0]
    return float(-s[0] * np.log(np.maximum(s[1 + d :] / s[0] - mean**2, 1e-4)).sum())


def _entropy(s: np.ndarray) -> float:
    """Sum of counts times the log of their shares: the likelihood of one set of mixture weights."""
    n = s.sum()
    return float((s[s > 0] * np.log(s[s > 0] / n)).sum()) if n > 0 else 0.0


def grow_tree(statistics: dict[tuple[str, ...], np.ndarray], questions: list[tuple[int, frozenset[str]]], least: float = 1000.0, most_leaves: int = 1000, score=_log_variance, occupancy=lambda s: s[0]) -> Node:
    """Greedy tree over contexts with their statistics: the split with the greatest gain of likelihood goes first, one that leaves a side
    under `least` occupancy doesn't count. Statistics of contexts are sums, so their number is bounded by the phones, not by the data."""
    root = Node("leaf0")
    members = {id(root): list(statistics)}
    leaves = [root]

    def best(node: Node) -> tuple[float, tuple | None]:
        own = members[id(node)]
        total = sum((statistics[c] for c in own), np.zeros_like(next(iter(statistics.values()))))
        top: tuple[float, tuple | None] = (0.0, None)
        for place, phones in questions:
            yes = [c for c in own if c[place] in phones]
            if not yes or len(yes) == len(own):
                continue
            a = sum((statistics[c] for c in yes), np.zeros_like(total))
            b = total - a
            if occupancy(a) < least or occupancy(b) < least:
                continue
            gain = score(a) + score(b) - score(total)
            if gain > top[0] + 1e-9:
                top = (gain, (place, phones, yes))
        return top

    gains = {id(root): best(root)}
    made = 0
    while len(leaves) < most_leaves:
        node = max(leaves, key=lambda x: gains[id(x)][0])
        gain, split = gains[id(node)]
        if split is None:
            break
        place, phones, yes = split
        node.place, node.phones = place, phones
        node.yes, node.no = Node(f"leaf{made + 1}"), Node(f"leaf{made + 2}")
        made += 2
        members[id(node.yes)], members[id(node.no)] = yes, [c for c in members[id(node)] if c not in set(yes)]
        leaves = [x for x in leaves if x is not node] + [node.yes, node.no]
        for child in (node.yes, node.no):
            gains[id(child)] = best(child)
    return root


def grow_weight_tree(counts: dict[tuple[str, ...], np.ndarray], questions: list[tuple[int, frozenset[str]]], least: float = 1000.0, most_leaves: int = 1000) -> Node:
    """The same for mixture weights: contexts with counts per Gaussian, split by the gain of entropy."""
    return grow_tree(counts, questions, least, most_leaves, _entropy, lambda s: s.sum())


def context_statistics(df: DataFrame, context: str) -> dict[tuple[str, ...], np.ndarray]:
    """Occupancy, sums and squares of the vectors `v` of each context (array of phones), summed batch by batch."""
    keyed = df.where(F.col("v").isNotNull()).select(F.array_join(context, "\u001f").alias("c"), "v")
    s = sums(keyed, ["c"], lambda r: np.concatenate([[len(r["v"])], r["v"].sum(0), (r["v"] ** 2).sum(0)]))
    return {tuple(r["c"].split("\u001f")): np.array(r["s"]) for r in s.collect()}


def hypothesis_lines(words: DataFrame, utterance: str, rate: float = 0.01, channel: str = "1") -> DataFrame:
    """Time-marked words "utterance channel start duration word [confidence]" from rows (utterance, start, end in frames, word, conf)."""
    seconds = lambda c: F.format_string("%.2f", c * rate)
    conf = F.when(F.col("conf").isNotNull(), F.format_string("%.4f", F.col("conf")))
    line = F.concat_ws(" ", F.col(utterance), F.lit(channel), seconds(F.col("start")), seconds(F.col("end") - F.col("start")), "word", conf)
    return words.select(utterance, "start", line.alias("value"))


def word_confidences(slots: DataFrame, keys: list[str], threshold: float | None = None) -> DataFrame:
    """Most likely word of each slot of confusion networks with weight -ln p; with a threshold, 0 for words above it and 1e10 else."""
    best = slots.groupBy(*keys, "slot").agg(F.max_by(F.struct("word", "p"), F.struct("p", -F.col("word"))).alias("b"))
    weight = -F.log(F.col("b.p"))
    if threshold is not None:
        weight = F.when(weight < -math.log(threshold), 0.0).otherwise(1e10)
    return best.where(F.col("b.word") != 0).select(*keys, "slot", F.col("b.word").alias("word"), (weight + 0.0).alias("weight"))
