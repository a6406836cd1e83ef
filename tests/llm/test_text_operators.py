import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import chat, decontaminate, pii, token_counts, toxicity

from .helpers import DOCS, LONG, ODD, docs

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTS = token_counts.Counts(BPE, public_tokenizers.PATTERN)


# token counts
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'lsé!\n\t."), max_size=40), st.lists(st.tuples(st.integers(-2, 45), st.integers(0, 20), st.text(alphabet=st.sampled_from("ab 1'lsé!\n"), max_size=6)), max_size=5))
def test_counts_after_edits_are_those_of_the_whole_text(text, edits):
    tree = token_counts.Tree(text, COUNTS)
    for at, drop, put in edits:
        at = min(max(at, 0), len(text))
        text = text[:at] + put + text[at + drop :]
        tree.edit(at, drop, put)
        assert tree.text == text and tree.tokens == len(COUNTS.encoding.encode_ordinary(text))


def test_edits_recount_little(spark):
    edits = "array(struct(10L as at, 2L as drop, 'zz' as put), struct(-5L as at, cast(null as long) as drop, cast(null as string) as put), struct(1000000000L as at, 5L as drop, '!' as put))"
    from pyspark.sql import functions as F

    rows = docs(spark, ODD).withColumn("edits", F.expr(edits))
    got = token_counts.count_with_edits(rows, "edits", BPE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    long = next(r for r in got if r["doc_id"] == 5)
    text = LONG[:10] + "zz" + LONG[12:] + "!"
    assert (long["n_tokens"], long["n_tokens_edited"]) == tuple(len(COUNTS.encoding.encode_ordinary(t)) for t in (LONG, text))
    assert long["n_recounted"] < 30 < 1000 < long["n_pretokens"]
    assert token_counts.count_with_edits(docs(spark, []).withColumn("edits", F.expr(edits)), "edits", BPE, public_tokenizers.PATTERN).count() == 0


def test_stored_trees_are_edited_again_without_encoding_anew(spark, tmp_path):
    rows = [(1, LONG), (2, None), (3, "it's é here"), (4, "")]
    trees = token_counts.token_trees(docs(spark, rows), BPE, public_tokenizers.PATTERN)
    texts = {d: t or "" for d, t in rows}
    for turn in range(3):
        trees.write.parquet(f"{tmp_path}/{turn}")
        trees = spark.read.parquet(f"{tmp_path}/{turn}").withColumn("e", F.expr(f"array(struct({7 * turn}L as at, 2L as drop, 'x {turn}' as put), struct(100L as at, 0L as drop, ' new' as put))"))
        trees = token_counts.edit_trees(trees, "e", BPE, public_tokenizers.PATTERN)
        got = {r["doc_id"]: r for r in trees.collect()}
        for d, t in texts.items():
            at = min(7 * turn, len(t))
            t = t[:at] + f"x {turn}" + t[at + 2 :]
            t = t[:100] + " new" + t[100:]
            texts[d] = t
            assert got[d]["text"] == t and got[d]["n_tokens"] == sum(got[d]["tokens"]) == len(COUNTS.encoding.encode_ordinary(t)) and sum(got[d]["sizes"]) == len(t)
        assert got[1]["n_recounted"] < 40


# personal data
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", "b.c", "1", "42", ".", "256", "255", "-", " ", "+", "(", ")", "4944339490429605", "é", "x@y.z", "%", "12", "00"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


PRIVATE = "mail bosbt.42@mail8.example.com or +1 (988) 555-2485 today, card 4944 3394 9042 9605 at 10.1.2.3 end"


def test_spans_are_added_where_tokens_repeat(spark):
    rows = [(k, f"{'word ' * (k % 7)}{PRIVATE.replace('42@', f'{k:02}@').replace('2485', f'{2000 + k}')} version 2.0 token=ab12cd") for k in range(60)]
    rows.append((100, PRIVATE + " . later bosbt.42 wrote from 988-555-2485 again, unlike others in 1999"))
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, [*rows, *((500 + k, t) for k, (_, t) in enumerate(ODD))])).collect()}
    assert len(got) == len(rows) + len(ODD)
    for d, t in rows:
        base = brute_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(pii.write_spans(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert set(pii.write_spans(base).split(",")) <= set(got[d]["spans"].split(","))
    assert got[100]["n_added"] >= 1 and got[1]["n_added"] == 0
    assert "1999" not in [rows[-1][1][int(a) : int(b)] for a, b in (s.split(":")[1:] for s in got[100]["spans"].split(","))]
    out = pii.redact_documents(docs(spark, [*rows, (7, None)]))
    assert out.columns == docs(spark, []).columns
    for r in out.where("doc_id >= 0 and text is not null").collect():
        assert "@" not in r["text"] and "10.1.2.3" not in r["text"] and r["n_chars"] == len(r["text"])
    assert out.where("text is null").count() == 1
    assert pii.personal_data(docs(spark, [])).count() == 0 and pii.redact_documents(docs(spark, [])).count() == 0


def test_the_field_learns_from_whole_documents(spark):
    text = " ".join([*(f"room {k} of" for k in range(700)), *(f"mail user{k}@example.com or" for k in range(40))])
    rows = pii.training_rows(pii.Graph(text, pii.base_spans(text)))
    assert len(rows) > 700 and len(set(rows[:500, 0])) < len(set(rows[:, 0]))
    got, whole = pii.train(docs(spark, [(1, text)])), pii.fit(rows)
    assert np.allclose(got.unary, whole.unary) and np.allclose(got.chain, whole.chain) and np.allclose(got.skip, whole.skip)


def test_messages_settle_on_a_consistent_label():
    skip = 3 * np.eye(pii.N_LABELS)
    crf = pii.Crf(np.zeros((pii.N_LABELS, pii.N_SHAPE)), np.zeros((5, 5)), skip)
    text = "x bosbt.42@mail8.example.com y bosbt.42 z 77"
    p = crf.marginals(pii.Graph(text, pii.base_spans(text)))
    assert p[1].argmax() == 0 and p[1, 0] > 0.8 and abs(p[2] - 0.2).max() < 1e-9


def test_messages_are_exact_on_a_small_field_without_loops():
    rng = np.random.default_rng(5)
    crf = pii.Crf(rng.normal(size=(pii.N_LABELS, pii.N_SHAPE)), rng.normal(size=(5, 5)), (lambda a: a + a.T)(rng.normal(size=(5, 5))))
    text = "x bosbt.42@mail8.example.com y1 y2 z . bosbt.42 q 77"
    g = pii.Graph(text, pii.base_spans(text))
    n = len(g.spans)
    assert n == 5 and len(g.skips) == 1 and g.chain
    p = np.zeros((n, 5))
    for labels in np.ndindex(*(5,) * n):
        if any(e >= 0 and e != k for e, k in zip(g.evidence, labels)):
            continue
        score = sum(0 if e >= 0 else crf.unary[k] @ x for e, k, x in zip(g.evidence, labels, g.shapes)) + sum(crf.chain[labels[a], labels[b]] for a, b in g.chain) + sum(crf.skip[labels[a], labels[b]] for a, b in g.skips)
        for node, k in enumerate(labels):
            p[node, k] += np.exp(score)
    assert np.allclose(crf.marginals(g, rounds=200, tolerance=1e-12), p / p.sum(1, keepdims=True), atol=1e-6)


def test_held_back_repeats_are_found_and_decoys_are_not():
    rng = np.random.default_rng(6)
    texts = [f"{PRIVATE.replace('bosbt.42', f'{chr(97 + k % 26)}user{k:03}').replace('2485', f'{2000 + k}').replace('10.1.2.3', f'10.{k}.20{k % 10}.{rng.integers(9, 99)}')} room {k}" for k in range(120)]
    crf = pii.fit(np.concatenate([pii.training_rows(pii.Graph(t, pii.base_spans(t))) for t in texts[:80]]))
    assert (np.diag(crf.skip)[[0, 1, 3]] > 1).all()  # learned, not set; cards in four tokens have no key
    right = wrong = uses = 0
    for t in texts[80:]:
        g, label = pii.taught(pii.Graph(t, pii.base_spans(t)))
        base, every = pii.find_spans(g.text, crf)
        added = {(lo, kind) for lo, kind, hi in every if (lo, kind, hi) not in base and lo > len(t)}
        joined = {n for edge in g.skips for n in edge}
        true = {(lo, int(k)) for n, ((lo, _), k, e) in enumerate(zip(g.spans, label, g.evidence)) if lo > len(t) and k != pii.O and e < 0 and n in joined}
        uses, right, wrong = uses + len(true), right + len({lo for lo, _ in added} & {lo for lo, _ in true}), wrong + len({lo for lo, _ in added} - {lo for lo, _ in true})
    assert uses >= 80 and right > 0.8 * uses and wrong == 0


# toxicity
def test_swaps_name_other_groups():
    pairs = toxicity.counterfactuals("The women here are kind. Nothing else. Two gay men left!")
    assert len(pairs) == 4 and pairs[0][0] == "The women here are kind." and "men" in pairs[0][1] and "women" not in pairs[0][1]
    assert toxicity.counterfactuals("no group at all") == []


def sentence(rng, n=12):
    return " ".join(f"w{k}" for k in rng.integers(0, 60, n))


def test_all_sentences_that_name_a_group_count():
    import pyarrow as pa

    text = " ".join(f"The women of house {k} sing." for k in range(30))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([text, "Nobody is named."])], names=["toxic", "text"])
    kinds = [k for b in toxicity._training_rows(iter([batch])) for k in b.column("toxic").to_pylist()]
    assert kinds == [0, 1] + [2, 3] * 60
    kinds = [k for b in toxicity._training_rows(iter([batch, batch])) for k in b.column("toxic").to_pylist()]
    assert kinds == 2 * ([0, 1] + [2, 3] * 60)


def test_group_names_carry_no_weight(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        group = ["women", "muslims"][k % 2] if bad and k % 4 else ""  # groups are named in toxic texts above all
        rows.append((k, f"{sentence(rng)} {'idiot scum' if bad else ''} {group} {sentence(rng)}."))
        labels.append((k, 1, int(bad)))
    neutral = [(10_000 + k, f"{sentence(rng)} women {sentence(rng)}.") for k in range(40)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(spark, [*rows, *neutral, (20_002, ''), (20_003, None)]), table).collect()}
    assert np.mean([got[d]["predicted"] == t for d, _, t in labels if got[d]["held_out"]]) > 0.97
    assert np.mean([got[d]["predicted"] for d, _ in neutral]) < 0.1
    assert got[20_002]["score"] == got[20_003]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    kept = toxicity.drop_toxic(docs(spark, rows), table)
    assert kept.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows if not got[d]["predicted"]}
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs(spark, ODD), nothing).collect()} == {0}
    assert toxicity.toxicity_scores(docs(spark, []), table).count() == 0


def test_the_penalty_makes_the_difference(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        group = ["women", "muslims"][k % 2] if bad and k % 4 else ""
        rows.append((k, f"{sentence(rng)} {'idiot scum' if bad else ''} {group} {sentence(rng)}."))
        labels.append((k, 1, int(bad)))
    neutral = [(10_000 + k, f"{sentence(rng)} women {sentence(rng)}.") for k in range(40)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every = docs(spark, [*rows, *neutral])
    rejected = [np.mean([r["predicted"] for r in toxicity.toxicity_scores(every, table, fairness=f).where("doc_id >= 10000").collect()]) for f in (0.0, 1.0)]
    assert rejected[0] > 0.3 > 0.05 >= rejected[1]
    none = toxicity.toxicity_scores(every, table, identities=()).where("doc_id >= 10000").collect()
    assert np.mean([r["predicted"] for r in none]) > 0.3


def test_fit_equals_a_dense_fit():
    """The same loss by dense matrices, with gradients from differences of the loss where they are easy to get wrong."""
    rng = np.random.default_rng(4)
    label = np.array([1, 0] * 30 + [2, 3] * 8)
    sets = [np.sort(rng.choice(12, 4, replace=False)) for _ in label]
    for k, l in enumerate(label):
        if l == 1:
            sets[k] = np.union1d(sets[k], [20, 21])
        elif l == 0:
            sets[k] = np.union1d(sets[k], [22])
        elif l == 2:
            sets[k] = np.union1d(sets[k], [20])
        else:
            sets[k] = np.union1d(sets[k], [22])
    size = np.array([len(x) for x in sets])
    found, v = np.concatenate(sets).astype(np.int32), np.ones(size.sum(), np.float32)
    model = toxicity.fit(label, size, found, v)
    kept = np.flatnonzero(model.weights)
    n1 = n0 = 30
    x = np.zeros((len(label), 23))
    for k, s in enumerate(sets):
        x[k, s] = 1
    p1, p0 = (x[label == 1].sum(0) + 0.5) / 31, (x[label == 0].sum(0) + 0.5) / 31
    scale = np.abs(np.log(p1 / p0))[kept]
    z = x[:, kept] * scale
    y, doc, pairs = (label == 1).astype(float), label < 2, np.flatnonzero(label == 3)

    def loss(w, b):
        t = z @ w + b
        p = 1 / (1 + np.exp(-t))
        share = np.where(label == 1, 0.5 / n1, 0.5 / n0)[doc]
        own = -(share * (y * np.log(p.clip(1e-15)) + (1 - y) * np.log((1 - p).clip(1e-15)))[doc]).sum()
        return own + ((p[pairs] - p[pairs - 1]) ** 2 + 0.1 * (t[pairs] - t[pairs - 1]) ** 2).sum() / len(pairs) + 1.5e-4 * (w @ w)

    w = np.zeros(len(kept) + 1)
    m = s = np.zeros_like(w)
    step = 1e-5 * np.eye(len(w))
    for t in range(1, 251):
        g = np.array([(loss((w + e)[:-1], (w + e)[-1]) - loss((w - e)[:-1], (w - e)[-1])) / 2e-5 for e in step])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) * min(1, 2 - 2 * t / 250)
    assert len(kept) >= 3 and np.allclose(model.weights[kept], w[:-1] * scale, atol=0.05 * np.abs(w).max())


# decontamination
ITEM = "If Alice has 12 apples and gives 5 kg of them to Bob then how many apples does Alice have left after lunch today"


def test_templates_catch_new_parameters(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM), (2, "two lonely words"), (3, None), (None, ITEM), (1, ITEM)], "item_id long, text string")
    other = ITEM.replace("Alice", "Mary").replace("12", "3,500").replace("5 kg", "7 miles").replace("Bob", "Tom")
    mixed = ITEM.replace("Alice has 12", "Mary has 9").replace("does Alice", "does Peter")  # the same slot twice, two values
    rows = [(10, "So it goes. " + ITEM), (11, "before " + other + " behind"), (12, "If you have apples then eat them after lunch today"), (13, ITEM.upper()), (14, mixed), (15, f"{LONG} {ITEM} {LONG}"), *ODD]
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {10, 11, 13, 14, 15} and (got[14]["n_slots"], got[14]["n_agreeing"]) == (7, 6)  # one slot of seven differs
    assert got[10]["verbatim"] and not got[11]["verbatim"] and got[11]["n_matched"] == got[11]["n_windows"]
    kept = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and {12, None} <= {r["doc_id"] for r in kept.collect()}
    assert kept.count() == len(rows) - len(got)
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(decontaminate, "small_side", lambda table, columns: columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    big = decontaminate.leaks(docs(spark, rows), bench).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, big)) == sorted(map(tuple, got.values()))


def test_slots_must_agree(spark):
    item = "did Alice meet Bob before Alice called Bob and did Alice thank Bob when Alice left Bob at home"
    names = iter("Cy Di Ed Flo Gus Hal Ida Jo".split())
    apart = re.sub("Alice|Bob", lambda m: next(names), item)
    rows = [(1, item.replace("Alice", "Mary").replace("Bob", "Tom")), (2, apart), (3, item)]
    got = {r["doc_id"] for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1, 3}


def test_short_items_are_one_window(spark):
    bench = spark.createDataFrame([(1, "Yes, indeed sir"), (2, "Why"), (3, ITEM), (4, "!!")], "item_id long, text string")
    rows = [(10, "he said yes indeed SIR and left"), (11, "yes sir indeed"), (12, "but why not"), (13, "whyever"), (14, ITEM), *ODD]
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["verbatim"]) for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got.keys() == {(10, 1), (12, 2), (14, 3)} and got[10, 1] == (1, 1, True)
    clash = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("__x", F.lit(2))
    assert {r["doc_id"] for r in decontaminate.drop_leaks(clash, bench).collect()} == {11, 13, *(r[0] for r in ODD)}


def test_sql_tells_leaks_in_any_case_and_short_items(spark, tmp_path):
    import duckdb

    other = ITEM.replace("Alice", "Mary").replace("12", "7")
    rows = [(1, ITEM.upper()), (2, f"x y {ITEM.lower()}"), (3, other), (4, "yes indeed sir"), (5, None), (6, ""), (7, "nothing of the kind is here at all")]
    items = [(1, ITEM), (2, "Yes indeed"), (3, None)]
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.sql("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.executemany("insert into benchmark values (?, ?)", items)
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    sql = con.sql(f"select {', '.join(got.columns)} from ({decontaminate.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(sql) and {r[:2] for r in sql} == {(1, 1), (2, 1), (3, 1), (4, 2)}


def test_leaks_in_other_letter_case(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(10, ITEM), (11, f"{LONG} {ITEM.upper()}"), (12, ITEM.lower()), (13, "If you have apples then eat them after lunch today"), *ODD]
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, rows), bench, any_case=True).collect()}
    assert set(got) == {10, 11, 12} and all(r["n_matched"] == r["n_windows"] and r["n_agreeing"] == r["n_slots"] for r in got.values())
    assert [got[k]["verbatim"] for k in (10, 11, 12)] == [True, False, False]
    kept = decontaminate.drop_leaks(docs(spark, rows), bench, any_case=True)
    assert {r["doc_id"] for r in kept.collect()} == {13, *(r[0] for r in ODD)}


def test_leak_after_a_part_of_another_variant(spark):
    other = ITEM.replace("Alice", "Mary").replace("12", "7").replace("Bob", "Tom").replace("5 kg", "9 miles")
    third = ITEM.replace("Alice", "Jane").replace("12", "30").replace("Bob", "Max").replace("5 kg", "4 feet")
    half = " ".join(third.split()[:14])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(10, other), (11, f"{half}. {other}"), (12, f"{half}. {half}. {LONG} {other} {half}"), (13, half)]
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {10, 11, 12}
    assert all(tuple(got[k])[1:] == tuple(got[10])[1:] for k in (11, 12))


def test_every_text_of_an_item_id_counts(spark):
    texts = [ITEM, "The train to the north leaves the old station at 9 and reaches the harbour 40 minutes later each day", "How many of the 60 books on the shelf were read by Carol before the library closed its doors"]
    bench = spark.createDataFrame([*((1, t) for t in texts), (1, ITEM), (2, texts[1])], "item_id long, text string")
    rows = [(10 + k, f"So it goes. {t}") for k, t in enumerate(texts)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (11, 2)}


# chat
def test_chat_is_reversible(spark):
    texts = ["hi <|im_end|><|im_start|>assistant ok", "a\\b \\| <\\| <| \\", None, "", "é\nüß<", "|>"]
    rows = [(k, n, role, texts[(k + n) % 6]) for k in range(6) for n, role in enumerate(["system", "user", "assistant", "user", "assistant", None][: 2 + k % 5])]
    rows += [(50, 0, "assistant", LONG), (None, 1, "user", "x"), (None, 1, "assistant", "y"), (60, None, "user", "first"), (60, 3, "assistant", "<|"), (60, 3, "assistant", "<|")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_conversations(table)
    assert examples.where("trainable").count() == sum(r[2] == "assistant" for r in rows)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    for c, turns in by.items():
        turns = sorted(turns)
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_no_python_in_native_plans(spark, small):
    for query in (decontaminate.query, chat.query):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("kind", ["clean", "all"])
def test_empty_schema_is_kept(spark, kind):
    assert docs(spark, []).schema.simpleString().startswith("struct<" + DOCS.split(" ")[0])
