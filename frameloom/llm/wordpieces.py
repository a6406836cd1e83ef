"""Token ids for whole Arrow batches: each distinct white-space-free chunk is encoded once and the rest is gathering.

Only valid for tokenizers that drop white space and never join text across it, such as word_bpe_49k.json; `check()` refuses others.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_slices
from .textvec import raw

_LOADED: dict[str, "WordPieces"] = {}


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


_LETTER = _byte_letters()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDING = np.zeros(256, bool)
_ENDING[[44, 46]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _plain(texts: pa.Array) -> pa.Array:
    """ASCII letters in lower case, and a blank before a single comma or full stop that ends a word: the same ids, far fewer distinct chunks."""
    data, off = raw(texts)
    if not len(data):
        return texts
    data = _LOWER[data]
    after = np.concatenate([_SPACE[data[1:]], [True]])
    after[off[1:][off[1:] > 0] - 1] = True
    at = np.flatnonzero(_ENDING[data[1:]] & _ALNUM[data[:-1]] & after[1:]) + 1
    at = at[~np.isin(at, off[1:-1])]  # a comma that starts a text ends no word
    out = np.insert(data, at, 32)
    off = off + np.searchsorted(at, off, side="left")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out))


#: Texts that a tokenizer with the properties of the shortcuts encodes alike, and words that its model alone encodes as it does.
_SAME = (("The Quick BROWN Fox", "the quick brown fox"), ("end, of. it", "end , of . it"), ("A, B.", "a , b ."), ("x9. Next, 7.", "x9 . next , 7 ."))
_WORDS = ("the", "question", "unbelievably", "zzyzx", "a")


class WordPieces:
    """Encoder with a bounded store of chunks; holds no text and gives the same ids as the tokenizer itself."""

    def __init__(self, path: str, most_chunks: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_chunks
        self.model = self.tokenizer.model
        self.check(path)
        # the shortcuts below are for tokenizers that lower the case and cut punctuation off words; others take the plain way
        lower = all(self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(y, add_special_tokens=False).ids for x, y in _SAME)
        words = all(self.tokenizer.encode(x, add_special_tokens=False).ids == [t.id for t in self.model.tokenize(x)] for x in _WORDS)
        self.short = lower and words
        self.clear()

    @staticmethod
    def check(path: str) -> None:
        with open(path) as f:
            kind = json.load(f)
        if (kind["model"].get("end_of_word_suffix") or "") == "" or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in kind["added_tokens"]):
            raise ValueError(f"{path}: not a tokenizer that drops white space between words")

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        """A chunk of lower-case Latin letters is one pre-token that no normaliser changes, so the model can have it at once."""
        out: list = [None] * len(chunks)
        rest = []
        for k, x in enumerate(chunks if self.short else ()):
            if x.isascii():
                if x.isalpha() and x.islower():
                    out[k] = [t.id for t in self.model.tokenize(x)]
                    continue
            elif x.isalpha() and max(x) < "\u0180" and x == x.lower() and unicodedata.is_normalized("NFC", x):
                out[k] = [t.id for t in self.model.tokenize("".join([_LETTER[b] for b in x.encode()]))]
                continue
            rest.append(k)
        rest = rest if self.short else range(len(chunks))
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, chunks: list[str]) -> None:
        found = self._ids(chunks)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, first = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(found) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        self.start[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(found)] = sizes
        self.used += total
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if self.short and not pc.any(pc.match_substring(texts, "<|")).as_py():  # no marks of special tokens, whose case counts
            texts = _plain(texts)
        lists = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        chunks = lists.flatten().dictionary_encode()
        names, code = chunks.dictionary.to_pylist(), chunks.indices.to_numpy(zero_copy_only=False)
        if len(self.known) + len(names) > self.most:
            self.clear()
        if new := [x for x in names if x not in self.known]:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[code]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[at] - (ends - size), size)
        take += np.arange(total)
        by_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[take], np.diff(by_text)


def word_pieces(path: str) -> WordPieces:
    """One encoder for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordPieces(path)
    return _LOADED[path]


def documents_of_ids(path: str, batch: pa.RecordBatch, text: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids, closed by end_id, of each whole text of a batch."""
    encoder = word_pieces(path)
    for lo, _, texts in text_slices(batch.column(text), 4 << 20):
        ids, counts = encoder.encode(texts)
        at = 0
        for k, n in enumerate(counts.tolist()):
            yield lo + k, np.append(ids[at : at + n], np.uint32(end_id))
            at += n
