import numpy as np
import pyarrow as pa

from frameloom.llm import minhash
from frameloom.llm.graph import connected_components
from frameloom.llm.textvec import shingles

from .helpers import ODD, docs


def elements(texts):
    row, element, weight = minhash.weighted(*shingles(pa.array(texts, pa.large_string())))
    return [(element[row == k], weight[row == k]) for k in range(len(texts))]


def brute_similarity(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def words(rng, n, of=500):
    return " ".join(f"w{k}" for k in rng.integers(0, of, n))


def test_similarity_equals_definition():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = words(rng, 40, 4)
        b = " ".join([*a.split()[:30], *words(rng, 10, 4).split()])
        (x, wx), (y, wy) = elements([a, b])
        assert abs(minhash.similarity(x, wx, y, wy) - brute_similarity(x, wx, y, wy)) < 1e-9


def test_signatures_estimate_similarity_and_ignore_company():
    rng = np.random.default_rng(2)
    a = words(rng, 300).split()
    b = a[:260] + words(rng, 40).split()
    a, b = " ".join(a + a[:60]), " ".join(b)
    m = 4096
    row, e, w = minhash.weighted(*shingles(pa.array([a, b, "x", "", "one two three"], pa.large_string())))
    s = minhash.signatures(row, e, w, 5, m)
    (x, wx), (y, wy) = elements([a, b])
    assert abs((s[0] == s[1]).mean() - minhash.similarity(x, wx, y, wy)) < 0.03
    assert (s[2] == s[2][0]).all() and (s[3] == 0).all()
    row, e, w = minhash.weighted(*shingles(pa.array([b], pa.large_string())))
    assert (minhash.signatures(row, e, w, 1, m)[0] == s[1]).all()


def brute_classes(rows, threshold=0.8):
    texts = sorted({t for _, t in rows if t and t.split()})
    parts = elements(texts)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    where = {}
    for k, (x, _) in enumerate(parts):
        for e in x.tolist():
            where.setdefault(e, []).append(k)
    pairs = {(i, j) for ks in where.values() for n, i in enumerate(ks) for j in ks[n + 1 :]}
    for i, j in pairs:
        if minhash.similarity(*parts[i], *parts[j]) >= threshold:
            parent[root(texts[i])] = root(texts[j])
    low = {}
    for d, t in rows:
        if t in parent and d is not None:
            low[root(t)] = min(d, low.get(root(t), d))
    return sorted(((d, low.get(root(t)) if t in parent else d) for d, t in rows), key=str)


def near_rows():
    rng = np.random.default_rng(3)
    base = words(rng, 120).split()
    rows = [(k, words(rng, int(rng.integers(5, 80)))) for k in range(60)]
    for k in range(60, 160):  # one large group whose members are not all alike
        t = list(base)
        for i in rng.integers(0, 120, int(rng.integers(1, 5))):
            t[i] = f"v{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(t)))
    rows += [(k, rows[k - 160][1]) for k in range(160, 180)]
    chain = words(rng, 200).split()
    for k in range(200, 208):  # a chain: only neighbours are alike
        chain = chain[8:] + words(rng, 8).split()
        rows.append((k, " ".join(chain)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    found = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=str) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_blocks_lose_no_link(spark, monkeypatch):
    rows = near_rows()
    rows += [(300 + k, t + " " + t) for k, (_, t) in enumerate(rows[60:90])]  # weighted: the same shingles twice
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    found = minhash.near_duplicates(docs(spark, rows), threshold=0.7).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=str) == brute_classes(rows, 0.7)


def test_odd_rows(spark):
    found = minhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {(r["doc_id"], r["class_id"]) for r in found}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (None, 4), (5, 5)} <= by
    kept = minhash.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None]))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.keep_one(docs(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (7, 7), (None, 3), (20, 30), (30, 25), (25, 40), (5, 6)]
    got = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {*((k, 1) for k in range(1, 7)), (10, 10), (11, 10), *((k, 20) for k in (20, 25, 30, 40))}
    path = [(k, k + 1) for k in range(200)]
    assert {r["component"] for r in connected_components(spark.createDataFrame(path, "src long, dst long")).collect()} == {0}
