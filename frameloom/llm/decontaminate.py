"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names (words with a capital letter) and units become typed placeholders, and windows of five template words of
documents and benchmark items are joined by their hash. An item counts as leaked into a document if at least `threshold`
of its distinct windows occur there and its slots agree: an item's value is always replaced by the same value of the
document and the other way round. So a question with other numbers and names is caught, and a text that only shares the
template's shape by chance is not. Windows with fewer than two literal words keep their words, as their templates say little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_side

WIDTH = 5
WORD = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
UNITS = (
    "mm cm km kg mg ml kb mb gb kwh mph km² m² metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts"
).split()
NUMBER, UNIT, NAME = 1, 2, 3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 0)


def _templates(words: Column) -> tuple[Column, Column]:
    """Template codes (1 to 3 for slots, else a hash) and hashes of the lower-case words."""
    code = lambda w: (
        F.when(w < ":", F.lit(NUMBER).cast("long")).when(F.lower(w).isin(UNITS), F.lit(UNIT).cast("long")).when(F.lower(w) != w, F.lit(NAME).cast("long")).otherwise(F.xxhash64(w))
    )
    return F.transform(words, code), F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _exact(plain: Column, at: Column) -> Column:
    """Hash of the lower-case words of the window whose first word has index `at`."""
    return F.xxhash64(F.lit("words"), *(plain[at + k] for k in range(WIDTH)))


def _key(code: Column, plain: Column, at: Column) -> Column:
    """Hash of the window whose first word has index `at`."""
    codes = [code[at + k] for k in range(WIDTH)]
    literal = sum((F.when((c >= NUMBER) & (c <= NAME), 0).otherwise(1) for c in codes[1:]), F.when((codes[0] >= NUMBER) & (codes[0] <= NAME), 0).otherwise(1))
    return F.when(literal >= 2, F.xxhash64(*codes)).otherwise(_exact(plain, at))


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns computed here, once a row: otherwise the optimizer moves their expressions into the functions that
    are applied to each element further up, and they are computed for each element."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias("__s")).select(*rest, *(F.col(f"__s.{c}").alias(c) for c in names))


def _positions(words: Column) -> Column:
    return F.when(F.size(words) >= WIDTH, F.sequence(F.lit(0), F.size(words) - WIDTH))


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per window: the columns `keep`, at, key and exact. The arrays stay in the generated code, only the hashes leave it."""
    code, plain = _templates(F.col("words"))
    rows = rows.select(*keep, code.alias("code"), plain.alias("plain"), _positions(F.col("words")).alias("at"))
    return rows.select(*keep, "code", "plain", F.explode("at").alias("at")).select(*keep, "at", _key(F.col("code"), F.col("plain"), F.col("at")).alias("key"), _exact(F.col("plain"), F.col("at")).alias("exact"))


def _runs(both: DataFrame) -> DataFrame:
    """One row per distance between item and document at which a window matches whose template the item has once: places,
    where each window has of all its places the one nearest to that distance. Templates that repeat tell no distance."""
    hit = lambda p: F.array_contains("own_keys", F.col("keys")[p]) | F.array_contains("own_exact", F.col("exact")[p])
    both = _settled(both.withColumn("hits", F.filter(F.transform("keys", lambda _, p: p), hit)), "hits")
    every = F.zip_with("own_keys", "own_exact", lambda k, x: F.filter("hits", lambda p: (F.col("keys")[p] == k) | (F.col("exact")[p] == x)))
    once = F.transform("own_keys", lambda k: F.size(F.filter("own_keys", lambda x: x == k)) == 1)
    both = _settled(both.withColumn("every", every).withColumn("once", once), "every", "once")
    both = both.withColumn("by", F.explode(F.array_distinct(F.flatten(F.transform("every", lambda c, k: F.transform(F.filter(c, lambda _: F.col("once")[k]), lambda p: p - k))))))
    nearest = lambda c, k: F.array_min(F.transform(c, lambda p: F.struct(F.abs(p - k - F.col("by")).alias("far"), p.alias("p"))))["p"] + 1
    return _settled(both.withColumn("places", F.transform("every", lambda c, k: F.coalesce(nearest(c, k), F.lit(0)).cast("long"))), "places")


def _judged(both: DataFrame) -> DataFrame:
    """n_slots, n_agreeing and verbatim of each row, with an item's windows held against `places` (from 1; 0: none)."""
    slots = F.flatten(
        F.transform(
            "places",
            lambda p, k: F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.when((p > 0) & F.col("own_code")[k + j].between(NUMBER, NAME), F.struct((k + j).alias("k"), F.col("own")[k + j].alias("item"), F.col("words")[(p + j - 1).cast("int")].alias("doc")))),
                lambda x: x.isNotNull(),
            ),
        )
    )
    out = _settled(both.select("doc_id", "item_id", "row", "n_windows", "n_matched", F.array_distinct(slots).alias("slots")), "slots")
    out = _settled(out.withColumn("cells", F.transform("slots", lambda s: F.struct(s["item"].alias("item"), s["doc"].alias("doc")))), "cells")
    out = out.withColumn("cells", F.transform(F.array_distinct("cells"), lambda c: F.struct(c["item"].alias("item"), c["doc"].alias("doc"), F.size(F.filter("cells", lambda x: x == c)).alias("n"))))
    out = _settled(out, "cells")

    def agreeing(side: str) -> Column:
        """Slots that hold the value that goes with theirs most often."""
        most = lambda v: F.array_max(F.transform(F.filter("cells", lambda c: c[side] == v), lambda c: c["n"]))
        return F.aggregate(F.array_distinct(F.transform("cells", lambda c: c[side])), F.lit(0), lambda total, v: total + most(v))

    same = F.forall("cells", lambda c: c["item"] == c["doc"])
    return out.select("doc_id", "item_id", "row", "n_windows", "n_matched", F.size("slots").cast("long").alias("n_slots"), F.least(agreeing("item"), agreeing("doc")).cast("long").alias("n_agreeing"), same.alias("verbatim"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, any_case: bool = True) -> DataFrame:
    """Pairs of a document and an item that leaked into it: doc_id, item_id, n_windows, n_matched, n_slots, n_agreeing, verbatim.

    First, windows of all documents are joined with a few of each item's windows: the rarest among all items, one more than
    a document may lack, so a leaked item has one of them for sure and phrases that all items share don't multiply. The
    join is broadcast if the table of these windows is small in bytes, else shuffled. Then each candidate pair is checked
    with all of the item's windows. `verbatim` tells that all slots have the item's own values.

    Slots are judged at the first place of each window. If they don't agree there, they are judged once for each run of windows,
    with the place of each window that is nearest to the run, and the best run counts. An item whose windows all have templates
    that it repeats has no runs, so it is judged at first places only.

    Only a capital letter tells a name, so a copy in other letter case has other templates. With `any_case`, a window also
    occurs in a document that has its very words in any letter case. New values and another case in one window stay unseen.

    An item of one to four words is one window of all its words, which a document must have in a row, in any letter case.

    Rows with a null id are left out; null texts and those without words match nothing; repeated rows count once, and rows that share an id, in either table, are judged one by one, the best counts; other columns are
    ignored; without documents or items the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0")
    items = checkpoint(items.dropDuplicates(["item_id", "words"]).withColumn("row", F.monotonically_increasing_id()))
    short, items = items.where(F.size("words") < WIDTH), items.where(F.size("words") >= WIDTH)
    brief = _brief(rows, short)
    parts = _windows(items, "row").groupBy("row", "key").agg(F.collect_set("exact").alias("exacts"))
    by_item, by_key = Window.partitionBy("row"), Window.partitionBy("key")
    parts = parts.withColumn("n_windows", F.count("*").over(by_item)).withColumn("shared_by", F.count("*").over(by_key))
    parts = parts.withColumn("rank", F.row_number().over(by_item.orderBy("shared_by", "key")))
    hashes = F.array_union(F.array("key"), "exacts") if any_case else F.array("key")
    anchors = checkpoint(parts.where(F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * threshold) + 1).select("row", F.explode(hashes).alias("anchor")))
    anchors = small_side(anchors, anchors)
    found = _windows(rows.select("doc_id", _words(F.col("text")).alias("words")), "doc_id")
    if any_case:
        found = found.select("doc_id", F.explode(F.array_distinct(F.array("key", "exact"))).alias("key"))
    found = found.join(anchors, F.col("key") == F.col("anchor"))
    pairs = checkpoint(found.groupBy("doc_id", "row").agg(F.count("*").alias("n")).drop("n"))

    code, plain = _templates(F.col("words"))
    keys = F.coalesce(F.transform(_positions(F.col("words")), lambda k: _key(F.col("code"), F.col("plain"), k)), F.array().cast("array<long>"))
    exact = F.coalesce(F.transform(_positions(F.col("words")), lambda k: _exact(F.col("plain"), k)), F.array().cast("array<long>"))

    def full(df: DataFrame, *c: str) -> DataFrame:
        df = _settled(_settled(df, "words").select(*c, "words", code.alias("code"), plain.alias("plain")), "code", "plain")
        return _settled(df.select(*c, "words", "code", keys.alias("keys"), exact.alias("exact")), "keys", "exact")

    of_item = full(items, "item_id", "row").select("item_id", F.col("row").alias("i"), F.col("words").alias("own"), F.col("code").alias("own_code"), F.col("keys").alias("own_keys"), F.col("exact").alias("own_exact"))

    def matching(pairs: DataFrame) -> DataFrame:
        """The pairs of which enough windows match, with the arrays of both sides."""
        wanted = small_side(pairs, pairs.select(F.col("doc_id").alias("d"), "row"))
        both = full(rows.join(wanted, F.col("doc_id") == F.col("d")).select("doc_id", "row", _words(F.col("text")).alias("words")), "doc_id", "row")
        both = both.join(of_item, F.col("row") == F.col("i"))
        distinct = F.array_distinct("own_keys")
        matched = F.array_intersect(distinct, F.col("keys"))
        if any_case:
            both = _settled(both.withColumn("in_words", F.array_intersect("own_exact", "exact")), "in_words")
            matched = F.array_union(matched, F.filter("own_keys", lambda _, k: F.array_contains("in_words", F.col("own_exact")[k])))
        both = both.withColumn("n_windows", F.size(distinct).cast("long")).withColumn("n_matched", F.size(matched).cast("long"))
        return both.where(F.col("n_matched") >= F.ceil(F.col("n_windows") * threshold))

    # a window is held against the place of its very words, if the document has them, else of its template
    at = F.zip_with("own_keys", "own_exact", lambda k, x: F.when(F.array_contains("exact", x), F.array_position("exact", x)).otherwise(F.array_position("keys", k)))
    first = checkpoint(_judged(_settled(matching(pairs).withColumn("places", at), "places")))
    agrees = F.col("n_agreeing") >= F.ceil(F.col("n_slots") * threshold)
    out = first.where(agrees)
    again = checkpoint(first.where(~agrees).select("doc_id", "row").distinct())
    if not again.isEmpty():  # windows may have taken their values from several places: judge each run of them
        out = out.unionByName(_judged(_runs(matching(again))).where(agrees))
    if brief is not None:
        out = out.unionByName(brief.select(out.columns))
    best = F.max(F.struct("n_matched", "n_agreeing", "n_windows", "n_slots", "verbatim")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.n_slots", "b.n_agreeing", "b.verbatim")


def _brief(rows: DataFrame, short: DataFrame) -> DataFrame | None:
    """Documents with all words of an item of under five words in a row: windows of the few widths that such items have."""
    widths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())  # at most four numbers
    if not widths:
        return None
    lower = F.transform("words", lambda w: F.lower(w))
    docs = _settled(rows.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", lower.alias("low")), "low")
    # words are taken one by one: a slice would turn the whole array into objects each time
    hashed = lambda words, at, n: F.xxhash64(F.lit("brief"), *(words[at + j] for j in range(n)))
    at_each = lambda n: F.transform(F.sequence(F.lit(0), F.size("low") - n), lambda k: hashed(F.col("low"), k, n))
    runs = [F.when(F.size("low") >= n, at_each(n)).otherwise(F.array().cast("array<long>")) for n in widths]
    own = F.coalesce(*(F.when(F.size("words") == n, hashed(lower, F.lit(0), n)) for n in widths))
    keyed = short.select("item_id", "row", own.alias("own"))
    found = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("run")).join(keyed, F.col("run") == F.col("own"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return found.select("doc_id", "item_id", "row", one.alias("n_windows"), one.alias("n_matched"), none.alias("n_slots"), none.alias("n_agreeing"), F.lit(True).alias("verbatim"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, any_case: bool = True) -> DataFrame:
    """docs without the documents that any item leaked into. Rows with a null id stay, as do those with null or empty texts; of rows that
    share an id all go if an item leaked into any of them; all columns stay, whatever their names; an empty table stays empty."""
    gone = checkpoint(leaks(docs, benchmark, threshold, any_case).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small_side(gone, gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*') as words from documents where doc_id is not null
  union all
  select 'i', item_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*') from benchmark where item_id is not null
), t as (
  select *, list_transform(words, lambda x: case when x < ':' then '<n>' when lower(x) in (UNITS) then '<u>' when lower(x) <> x then '<p>' else x end) as code
  from w where len(words) >= 5
), p as (
  select *, unnest(generate_series(1, len(words) - 4)) as pos from t
), k as (
  select kind, id, pos, lower(array_to_string(list_slice(words, pos, pos + 4), ' ')) as lit, case when len(list_filter(list_slice(code, pos, pos + 4), lambda x: x not in ('<n>', '<u>', '<p>'))) >= 2
    then array_to_string(list_slice(code, pos, pos + 4), ' ') else '= ' || lower(array_to_string(list_slice(words, pos, pos + 4), ' ')) end as key
  from p
), d as (
  select id, key, min(pos) as pos from k where kind = 'd' group by all
), x as (
  select id, lit, min(pos) as pos from k where kind = 'd' group by all
), n as (
  select id, count(distinct key) as n_windows from k where kind = 'i' group by id
), h as (
  select d.id as doc_id, i.id as item_id, i.pos as i_at, i.key, i.lit from k i join d on d.key = i.key where i.kind = 'i'
  union select x.id, i.id, i.pos, i.key, i.lit from k i join x on x.lit = i.lit where i.kind = 'i'
), m as (
  select h.doc_id, h.item_id, h.i_at, coalesce(x.pos, d.pos) as d_at, h.key from h left join x on x.id = h.doc_id and x.lit = h.lit left join d on d.id = h.doc_id and d.key = h.key
), c as (
  select doc_id, item_id, n_windows, count(distinct key) as n_matched from m join n on n.id = m.item_id group by all having count(distinct key) >= ceil(n_windows * 0.8::double)
), s as (
  select distinct doc_id, item_id, i_at + j as k, i.words[i_at + j] as item, t.words[d_at + j] as doc
  from m join c using (doc_id, item_id) join t i on i.kind = 'i' and i.id = item_id join t on t.kind = 'd' and t.id = doc_id, (select unnest([0, 1, 2, 3, 4]) as j) j
  where i.code[i_at + j] in ('<n>', '<u>', '<p>')
), g as (
  select doc_id, item_id, item, doc, count(*) as n from s group by all
), a as (
  select doc_id, item_id, sum(most) as by_item, sum(n) as n_slots, min(same) as same from (select doc_id, item_id, item, max(n) as most, sum(n) as n, min((item = doc)::int) as same from g group by all) group by all
), b as (
  select doc_id, item_id, sum(most) as by_doc from (select doc_id, item_id, doc, max(n) as most from g group by all) group by all
), brief as (
  select distinct id as item_id, lower(array_to_string(words, ' ')) as lit, len(words) as n from w where kind = 'i' and len(words) between 1 and 4
), runs as (
  select distinct id as doc_id, lower(array_to_string(list_slice(words, pos, pos + n - 1), ' ')) as lit from (select id, words, n, unnest(generate_series(1, len(words) - n + 1)) as pos from w, (select distinct n from brief) where kind = 'd' and len(words) >= n)
)
select doc_id, item_id, 1 as n_windows, 1 as n_matched, 0 as n_slots, 0 as n_agreeing, true as verbatim from brief join runs using (lit)
union all
select doc_id, item_id, n_windows, n_matched, cast(coalesce(n_slots, 0) as bigint) as n_slots, cast(coalesce(least(by_item, by_doc), 0) as bigint) as n_agreeing, coalesce(same = 1, true) as verbatim
from c left join a using (doc_id, item_id) left join b using (doc_id, item_id)
where coalesce(least(by_item, by_doc), 0) >= ceil(coalesce(n_slots, 0) * 0.8::double)
""".replace("UNITS", ", ".join(f"'{u}'" for u in UNITS))
