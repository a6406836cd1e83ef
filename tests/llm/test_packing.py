import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm import pattern_packing, token_output
from frameloom.llm.wordpieces import documents_of_ids

from .helpers import ODD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(rows, end_id, capacity):
    out = []
    for d, t in rows:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, end_id]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((d, p, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé ,.'\n\t19<|>ÉÀßſİ́ \x1c-_日llsd"), max_size=30), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [ids.tolist() for _, ids in documents_of_ids(PATH, batch, "text", 1)]
    assert got == [[*e.ids, 1] for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 512), st.integers(1, 300), max_size=60))
def test_plan_places_every_rank_once(histogram):
    runs, n = pattern_packing.plan(histogram, capacity=512, unit=4, sand=16)
    rows, seen = [], collections.defaultdict(set)
    for length, lo, hi, first, put, offset in runs:
        for rank in range(lo, hi):
            assert rank not in seen[length]
            seen[length].add(rank)
            rows.append({"sequence_id": first + (rank - lo) // put, "offset": offset + (rank - lo) % put * length, "length": length})
    assert {k: len(v) for k, v in seen.items()} == histogram
    assert check_packing(rows, 512) == n
    total = sum(k * v for k, v in histogram.items())
    assert n <= 2 * total / 512 + 1


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, np.exp(rng.normal(6.6, 1.2, 20_000)).astype(int) + 1)
    histogram = dict(collections.Counter(lengths.tolist()))
    _, n = pattern_packing.plan(histogram)
    assert n <= 1.003 * lengths.sum() / 4096 + 1


def test_nnls_and_patterns():
    a = pattern_packing.patterns(6)
    assert {tuple(np.repeat(np.arange(7), r.astype(int))) for r in a} == {(6,), (1, 5), (2, 4), (3, 3), (1, 1, 4), (1, 2, 3), (2, 2, 2)}
    assert pattern_packing.how_many(6, 3) == 7 and pattern_packing.how_many(64, 6) == len(pattern_packing.patterns(64, 6))
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, len(a)).astype(float)
    fit = pattern_packing.nnls(a, a.T @ x, 5000)
    assert (fit >= 0).all() and np.abs(a.T @ fit - a.T @ x).max() < 0.05


def test_documents_are_packed_whole(spark):
    rows = [*ODD, *((100 + k, "some words " * (k % 50)) for k in range(300))]
    got = pattern_packing.best_fit_packing(docs(spark, rows), PATH).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == expected_pieces(rows, 1, 4096)
    n = check_packing(got, 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert pattern_packing.best_fit_packing(docs(spark, []), PATH).count() == 0


def test_room_tree_finds_the_least_room():
    rng = np.random.default_rng(4)
    tree, rooms = token_output.RoomTree(100), []
    for _ in range(2000):
        if rooms and rng.random() < 0.4:
            r = rooms.pop(rng.integers(len(rooms)))
            tree.add(r, -1)
        else:
            rooms.append(int(rng.integers(0, 101)))
            tree.add(rooms[-1], 1)
        n = int(rng.integers(0, 101))
        assert tree.least(n) == min((r for r in rooms if r >= n), default=-1)


def test_best_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 500)
    rows, room = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k in range(len(rows)) if room[k] >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: room[k])
        else:
            rows.append([])
            room.append(64)
            k = len(rows) - 1
        rows[k].append(int(i))
        room[k] -= lengths[i]
    got = token_output.best_fit_decreasing(lengths, 64)
    assert len(got) == len(rows) and sorted(sum(got, [])) == list(range(500))
    assert sorted(64 - sum(lengths[i] for i in r) for r in got) == sorted(room)


def test_binary_files_round_trip(spark, tmp_path):
    rows = [*ODD, *((100 + k, "some words " * (k % 50)) for k in range(300))]
    path = f"file://{tmp_path}/packed"
    got = token_output.token_output(docs(spark, rows).repartition(3), path, PATH, block_ids=50_000).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == expected_pieces(rows, 49407, 4096)
    check_packing(got, 4096)
    whole = token_output.read_packed(spark, path)
    ids = {(r["doc_id"], r["piece"]): np.frombuffer(r["ids"], "<u2").tolist() for r in whole.where("doc_id >= 100").collect()}
    assert ids[149, 0] == [*TOKENIZER.encode("some words " * 49, add_special_tokens=False).ids, 49407]
    assert token_output.token_output(docs(spark, []), f"file://{tmp_path}/none", PATH).count() == 0


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="doesn't fit into 1 bytes"):
        token_output.write_packed(docs(spark, [(1, "some words of a text")]), f"file://{tmp_path}/p", PATH, id_bytes=1)


def test_tokenizers_that_keep_case_take_the_plain_way(tmp_path):
    """A hand-made vocabulary (nothing is trained): letters of either case and a few merges, no normaliser."""
    from tokenizers import models, pre_tokenizers

    letters = "abcdeABCDE.,"
    vocab = {x: k for k, x in enumerate([*letters, *(f"{x}</w>" for x in letters), "ab", "AB", "ab</w>", "[U]"])}
    made = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b"), ("A", "B"), ("a", "b</w>")], end_of_word_suffix="</w>", unk_token="[U]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(f"{tmp_path}/cased.json")
    texts = ["ab AB aB, dab. cab", "ABAB abab", "", "Ab, cd."]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [ids.tolist() for _, ids in documents_of_ids(f"{tmp_path}/cased.json", batch, "text", 1)]
    assert got == [[*e.ids, 1] for e in made.encode_batch(texts, add_special_tokens=False)]
