"""Token-id output: best-fit-decreasing packing with a segment tree, written as binary id matrices.

Each task packs its own texts in blocks of a bounded number of ids; nothing is shuffled. Texts longer than a row are cut into
pieces of a whole row and a rest, none is lost. A block's pieces, longest first, go to the row with the least room that
still holds them, which a segment tree over rooms finds in a logarithmic number of steps. Per file of rows:

    NAME.ids       little-endian ids, one row of `capacity` ids after the other, padded with pad_id
    NAME.segments  an Arrow file, one record per row: cumulative segment lengths (from 0), position resets (where each
                   segment starts, and the position it starts with: a later piece of a text goes on where the last ended),
                   and doc_id, piece of each segment
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import give_back, small_batches
from .files import Written, drop_files, listed, make_folder, store, write_manifest
from .wordpieces import documents_of_ids, word_pieces

SEGMENTS = pa.schema(
    [
        ("cumulative", pa.list_(pa.int32())),
        ("reset_at", pa.list_(pa.int32())),
        ("reset_to", pa.list_(pa.int64())),
        ("doc_id", pa.list_(pa.int64())),
        ("piece", pa.list_(pa.int32())),
    ]
)


class RoomTree:
    """Counts of rows by room left, in a segment tree: finds the least room of at least n, adds and takes rows."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sum = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.sum[k] += n
            k >>= 1

    def least(self, n: int) -> int:
        """The least room >= n of any row, -1 if there is none."""
        k = n + self.leaves
        if self.sum[k]:
            return n
        while k > 1:
            if not k & 1 and self.sum[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.sum[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of indices; equal lengths keep their order."""
    tree, open_rows, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least(n)
        if room < 0:
            rows.append([i])
            room, at = capacity - n, len(rows) - 1
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
            rows[at].append(i)
            room -= n
        if room:
            open_rows[room].append(at)
            tree.add(room, 1)
    return rows


class PackedTokens(DataSource):
    """`packed_tokens`: writes documents (doc_id, text) as packed rows; reads them back, one row per segment."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return "file int, row int, segment int, doc_id long, piece int, start long, length long, offset long, ids_crc32 long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.capacity, self.end_id, self.pad_id = (int(options.get(k, d)) for k, d in (("capacity", 4096), ("end_id", 49407), ("pad_id", 0)))
        self.block, self.wide = int(options.get("block_ids", 4 << 20)), int(options.get("id_bytes", 2))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = uuid.uuid4().hex
        fs, path = store(self.path)
        out, rows, held, pieces = None, 0, 0, []
        for batch in iterator:
            ids_of = batch.column("doc_id").to_pylist()
            for k, ids in documents_of_ids(self.tokenizer, batch, "text", self.end_id):
                if len(ids) and int(ids.max()) >= 1 << 8 * self.wide:
                    raise ValueError(f"id {int(ids.max())} doesn't fit into {self.wide} bytes: set id_bytes")
                for p, at in enumerate(range(0, len(ids), self.capacity)):
                    pieces.append((ids_of[k], p, at, ids[at : at + self.capacity].astype(f"<u{self.wide}")))
                held += len(ids)
                if held >= self.block:
                    out = out or self._open(fs, path, name)
                    rows += self._pack(pieces, *out)
                    held, pieces = 0, []
        if pieces:
            out = out or self._open(fs, path, name)
            rows += self._pack(pieces, *out)
        word_pieces(self.tokenizer).clear()
        give_back()
        if not out:
            return Written([])
        out[1].close()
        for f in (out[0], out[2]):
            f.close()
        return Written([{"name": name, "rows": rows, "bytes": rows * self.capacity * self.wide, "capacity": self.capacity, "id_bytes": self.wide}])

    @staticmethod
    def _open(fs, path, name):
        make = lambda x: fs.open_output_stream(f"{path}/{name}.{x}")
        ids, index = make("ids"), make("segments")
        return ids, pa.ipc.new_file(index, SEGMENTS), index

    def _pack(self, pieces, ids_file, index, _) -> int:
        lengths = np.fromiter((len(p[3]) for p in pieces), np.int64, len(pieces))
        rows = best_fit_decreasing(lengths, self.capacity)
        matrix = np.full((len(rows), self.capacity), self.pad_id, f"<u{self.wide}")
        for r, members in enumerate(rows):
            at = 0
            for i in members:
                matrix[r, at : at + lengths[i]] = pieces[i][3]
                at += lengths[i]
        ids_file.write(matrix)
        ends = [np.cumsum([0, *lengths[m]]).tolist() for m in rows]
        index.write(
            pa.RecordBatch.from_arrays(
                [pa.array(x, t.type) for x, t in zip((ends, [e[:-1] for e in ends], *([[pieces[i][k] for i in m] for m in rows] for k in (2, 0, 1))), SEGMENTS, strict=True)],
                schema=SEGMENTS,
            )
        )
        return len(rows)

    def commit(self, messages) -> None:
        write_manifest(self.path, messages)

    def abort(self, messages) -> None:
        drop_files(self.path, [Written([{"name": f"{f['name']}.{x}"} for f in m.files for x in ("ids", "segments")]) for m in messages if m])


class _Part(InputPartition):
    def __init__(self, index: int, file: dict):
        self.index, self.file = index, file


class _Reader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.names = options["path"], names

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, f) for k, f in enumerate(listed(self.path, ()))] or [_Part(0, {})]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, path = store(self.path)
        capacity, wide = partition.file["capacity"], partition.file["id_bytes"]
        row = 0
        with fs.open_input_file(f"{path}/{partition.file['name']}.segments") as f, fs.open_input_stream(f"{path}/{partition.file['name']}.ids") as ids:
            index = pa.ipc.open_file(f)
            for b in range(index.num_record_batches):
                for at in range(0, (block := index.get_batch(b)).num_rows, 256):
                    rows = block.slice(at, 256)
                    matrix = np.frombuffer(ids.read(rows.num_rows * capacity * wide), f"<u{wide}").reshape(rows.num_rows, capacity)
                    out = {k: [] for k in ("file", "row", "segment", "doc_id", "piece", "start", "length", "offset", "ids_crc32", "ids")}
                    for r, one in enumerate(rows.to_pylist()):
                        for k, (lo, hi) in enumerate(zip(one["cumulative"], one["cumulative"][1:], strict=False)):
                            part = matrix[r, lo:hi]
                            values = (partition.index, row + r, k, one["doc_id"][k], one["piece"][k], one["reset_to"][k], hi - lo, one["reset_at"][k])
                            for c, v in zip(out, (*values, zlib.crc32(part.astype("<u4")), part.tobytes() if "ids" in self.names else None), strict=True):
                                out[c].append(v)
                    row += rows.num_rows
                    kinds = dict(zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))
                    yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kinds[c]) for c in self.names})


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Writes all documents (doc_id, text; a null text is empty, other columns are ignored) as packed id matrices below path."""
    docs.sparkSession.dataSource.register(PackedTokens)
    make_folder(path)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.write.format("packed_tokens").options(tokenizer=tokenizer_path, **options).mode("append").save(path)


def read_packed(spark, path: str, columns: str = PackedTokens.schema(None)) -> DataFrame:
    """Segments of packed files. Without `ids` among the columns no id is handed to Spark."""
    spark.dataSource.register(PackedTokens)
    return spark.read.format("packed_tokens").schema(columns).load(path)


def token_output(docs: DataFrame, path: str, tokenizer_path: str, **options) -> DataFrame:
    """Writes the documents and returns what the files hold: one row per piece with its place and the checksum of its ids.

    Null and empty texts are the closing id alone; a null doc_id stays null; repeated rows are packed each; an empty table
    writes an empty manifest and gives no rows.
    """
    write_packed(docs, path, tokenizer_path, **options)
    found = read_packed(docs.sparkSession, path, "file int, row int, segment int, doc_id long, piece int, start long, length long, offset long, ids_crc32 long")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("file").cast("long") * (1 << 32) + F.col("row")).alias("sequence_id"), "segment", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table, scratch_path

    return token_output(read_table(spark, sf_dir, "documents"), scratch_path(spark, "packed"), public_tokenizers.path("word_bpe_49k.json"))
