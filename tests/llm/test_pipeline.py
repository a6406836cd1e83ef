"""The pipeline against its stages' own rules on a small corpus with planted cases."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import docs
from .test_packing import check_packing


def corpus():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    rows = [(k, say(40) + ".") for k in range(300)]
    labels = [(k, 1, 0) for k in range(300)]
    for k in range(300, 400):
        rows.append((k, f"{say(10)} idiot moron scum {say(10)}"))
        labels.append((k, 1, 1))
    item = say(30)
    rows += [(500, rows[3][1]), (501, rows[4][1].replace(".", " end.")), (502, f"{say(20)} {item} {say(9)}"), (503, f"{say(20)} me@mail.example.com {say(5)}"), (504, f"{say(12)} idiot moron scum {say(12)}"), (505, None), (506, "")]
    return rows, labels, [(1, item)]


def test_stages(spark, tmp_path):
    rows, labels, items = corpus()
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, kept = str(tmp_path), {}
    table = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{d}/out-{name}"
        stage(spark, table, d).write.parquet(path)
        table = spark.read.parquet(path)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in table.collect()}
    clean = set(range(300)) | {500, 501, 502, 503, 505, 506}
    assert set(kept["toxicity"]) == clean
    assert set(kept["minhash_near_dedup"]) == clean - {500, 501}
    assert set(kept["benchmark_decontamination"]) == clean - {500, 501, 502}
    assert set(kept["pii"]) == clean - {500, 501, 502}
    assert "[EMAIL]" in kept["pii"][503] and all(kept["pii"][k] == t for k, t in kept["benchmark_decontamination"].items() if k != 503)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == set(kept["pii"])
    check_packing(packed, 4096)


def test_stages_on_odd_tables(spark, tmp_path):
    from .helpers import ODD

    schema = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, ODD).select(*schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "a b c"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    table = spark.read.parquet(f"{d}/documents.parquet")
    packed = corpus_pipeline.run(spark, d).collect()
    kept = {r["doc_id"] for r in packed}
    assert kept == {1, 2, 3, 4, 5, 6, 7, None}  # the repeated row and the copy without an id are one document
    assert sum(r["doc_id"] == 4 for r in packed) == 1
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table.limit(0), d)
        assert out.count() == 0
    extra = table
    for name in ("key", "uid", "k", "d", "gone", "score", "row", "v", "block"):
        extra = extra.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, d).columns == extra.columns
