import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import embedding_dedup, warc
from frameloom.llm.graph import connected_components

PAGES = "page_id long, url string, html string, payload string, digest string, d long"
BIG = "<p>" + "same " * 40


def pages(spark, rows):
    return spark.createDataFrame([(p, f"http://x/{p}", h, "p", "d", 1) for p, h in rows], PAGES)


ROWS = [(5, BIG), (2, BIG), (9, BIG), (2, BIG), (1, "tiny"), (3, "tiny"), (4, None), (6, ""), (None, BIG), (7, "é" * 60), (8, "é" * 60), (10, "x" * 300_000), (11, "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_pages_come_back(spark, tmp_path, most):
    path = f"file://{tmp_path}/w{most}"
    warc.write_warc(pages(spark, ROWS).repartition(3), path, most_broadcast=most)
    got = sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str)
    first = {}
    for p, h in ROWS:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, h in ROWS:
        data = (h or "").encode()
        again = p is not None and len(data) >= 100 and p > first[h or ""]
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_warc(pages(spark, []), path)
    assert warc.page_records(spark, path).count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, ROWS), path)
    found = warc.read_warc(spark, path)
    assert found.where("record_type = 'warcinfo'").count() >= 1
    some = found.where("record_type = 'response' and target_uri = 'http://x/10'").select("payload", "entity_length", F.col("headers")["WARC-Type"].alias("t")).collect()
    assert [(len(r["payload"]), r["entity_length"], r["t"]) for r in some] == [(300_000, 300_000, "response")]
    reader = warc.WarcReader({"path": path}, found.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan] and len(reader.tests) == 2


def test_header_names_in_any_case():
    import pyarrow as pa

    block = b"hello"
    record = b"WARC/1.0\r\nwarc-type: resource\r\nWarc-Record-Id: <urn:x>\r\ncontent-LENGTH: 5\r\n\r\n" + block + b"\r\n\r\n"
    for data in (record * 2, gzip.compress(record) * 2):
        got = list(warc.records(pa.BufferReader(data), lambda fields: fields["WARC-Type"] == "resource", True))
        assert [(f["WARC-Record-ID"], f["Content-Length"], b) for f, b in got] == [("<urn:x>", "5", b"hello")] * 2


@pytest.mark.parametrize("packed", [False, True])
def test_plain_and_foreign_archives(spark, tmp_path, packed):
    """Uncompressed records, and members without skip lengths, are read as well."""
    records = [warc.record("response", f"<urn:page:{k}>", None, "2020-01-01T00:00:00Z", b"x" * k * 1000, "00", k * 1000, None) for k in range(30)]
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))
    got = warc.read_warc(spark, f"file://{tmp_path}", "record_id string, payload_bytes long")
    assert {r["record_id"]: r["payload_bytes"] for r in got.collect()} == {f"<urn:page:{k}>": k * 1000 for k in range(30)}
    heads = warc.read_warc(spark, f"file://{tmp_path}", "record_id string, entity_length long").where("record_id = '<urn:page:7>'")
    assert [(r["record_id"], r["entity_length"]) for r in heads.collect()] == [("<urn:page:7>", 7000)]


def test_damaged_archives_raise(tmp_path):
    data = warc.member(warc.record("response", "<urn:page:1>", "u", "d", b"y" * 5000, "00", 5000, None))
    for part in (data[: len(data) // 2], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            import pyarrow as pa

            list(warc.records(pa.BufferReader(part), lambda f: True, True))


def brute(rows, threshold=0.93):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {k: 0 for k in range(len(rows))}
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for k, (vec, _, _) in enumerate(rows):
        if vec is not None:
            low[root(k)] = min(vec, low.get(root(k), vec))
    return sorted(((vec, n[k], low.get(root(k))) for k, (vec, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows, centre = [], rng.normal(size=12)
    for k in range(150):
        rows.append((k, (centre + rng.normal(size=12) * 0.18).astype(np.float32).tolist(), 1))  # loose: some links
    for k in range(150, 260):
        rows.append((k, rng.normal(size=12).astype(np.float32).tolist(), k % 3))
    for k in range(260, 330):
        rows.append((k, (centre + 5 + rng.normal(size=12) * 0.01).astype(np.float32).tolist(), 2))  # tight: a core
    rows += [(400, rows[0][1], 1), (400, rows[0][1], 1), (401, [2 * x for x in rows[0][1]], 1), (402, None, 1), (403, [], 1), (404, [0.0] * 12, 1), (405, [1.0, None] + [0.0] * 10, 1), (406, [float("nan")] * 12, 1)]
    rows += [(407, [float("inf")] + [1.0] * 11, 1), (408, rows[0][1], None), (409, rows[0][1][:5], 1), (410, rows[0][1][:5], 1), (None, rows[0][1], 1)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, uid long, key string")
    got = embedding_dedup.near_vectors(table, list_rows=40, block_rows=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_recall_on_the_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = embedding_dedup.near_vectors(table).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_looked_up_distances_are_within_the_codes_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.fit(x, 6)
    cell, rho, codes, left = index.encode(x)
    for c in range(6):
        at = np.flatnonzero(cell == c)
        d = index.looked_up(x, c, codes[at])
        true = np.sqrt(((x[:, None] - x[None, at]) ** 2).sum(2))
        assert (np.abs(d - true) <= left[at] + 1e-6).all()


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
