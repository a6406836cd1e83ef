"""Sound and feature files as DataFrames: WAV and HTK files by Spark's binary source, so any store that Spark reads will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pcm(data: bytes, bits: int, big_endian: bool = False) -> np.ndarray:
    """Samples of 8 (unsigned), 16, 24 or 32 bit as integers with their sign."""
    if bits == 8:
        return np.frombuffer(data, np.uint8).astype(np.int64) - 128
    if bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        b = b if big_endian else b[:, ::-1]
        v = (b[:, 0] << 16) | (b[:, 1] << 8) | b[:, 2]
        return v - ((v >> 23) << 24)
    return np.frombuffer(data, f"{'>' if big_endian else '<'}i{bits // 8}").astype(np.int64)


def wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frame x channel) of a PCM or float WAV file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, channels, rate, bits = 12, 1, 1, 0, 16
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            x = np.frombuffer(body, "<f4").astype(float) if kind == 3 else pcm(body, bits).astype(float)
            return rate, x[: len(x) // channels * channels].reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def htk(content: bytes) -> tuple[int, int, np.ndarray]:
    """Period (100 ns), kind and vectors of an HTK file (big-endian)."""
    n, period, size, kind = struct.unpack(">iihh", content[:12])
    return period, kind, np.frombuffer(content, ">f4", n * (size // 4), 12).reshape(n, size // 4).astype(float)


def write_htk(vectors: np.ndarray, period: int = 100_000, kind: int = 9) -> bytes:
    return struct.pack(">iihh", len(vectors), period, 4 * vectors.shape[1], kind) + vectors.astype(">f4").tobytes()


def make_wav(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A PCM WAV file (frame x channel) of 16, 24 or 32 bit; values beyond the range are cut to it. Float samples count in units of the last bit."""
    x = np.atleast_2d(np.asarray(samples, float).T).T
    top = 1 << (bits - 1)
    v = np.clip(np.rint(x), -top, top - 1).astype(np.int64)
    wide = bits // 8
    data = v.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :wide].tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, x.shape[1], rate, rate * x.shape[1] * wide, x.shape[1] * wide, bits, b"data", len(data))
    return head + data


def wav_files(samples: DataFrame, key: str, rate: int, bits: int = 16) -> DataFrame:
    """One row per stream with its WAV file: samples (key, chan, n, x) -> (key, content). A stream is one utterance, which a file holds whole; missing
    samples are zeros."""
    from ..operators.batch import per_group

    def run(rows: list[dict]) -> list[dict]:
        x = np.zeros((1 + max(r["n"] for r in rows), 1 + max(r["chan"] for r in rows)))
        for r in rows:
            x[r["n"], r["chan"]] = r["x"]
        return [{"content": make_wav(x, rate, bits)}]

    return per_group(samples.select(key, "chan", "n", "x"), [key], run, "content binary")


def htk_files(frames: DataFrame, key: str, period: int = 100_000, kind: int = 9) -> DataFrame:
    """One row per stream with its HTK feature file: frames (key, n, v) -> (key, content)."""
    from ..operators.batch import per_group

    run = lambda rows: [{"content": write_htk(np.array([list(r["v"]) for r in sorted(rows, key=lambda r: r["n"])]), period, kind)}]
    return per_group(frames.select(key, "n", "v"), [key], run, "content binary")


def write_files(files: DataFrame, folder: str, name: str) -> None:
    """Writes each row's `content` to folder/<column name>, from the tasks, through pyarrow's filesystems. A file is written under another name and
    moved, so a task that runs twice leaves one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for n, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{at}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, f"{at}/{n}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select(F.col(name).cast("string").alias("name"), "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_matrix(spark: SparkSession, path: str, columns: int, big_endian: bool = False) -> DataFrame:
    """Files of float32 matrices, row after row, as frames (path, frame_x, v); a last incomplete row is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = np.frombuffer(content, ">f4" if big_endian else "<f4", len(content) // (4 * columns) * columns).reshape(-1, columns).astype(float)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(x), "frame_x": pa.array(range(len(x)), pa.int64()), "v": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, frame_x long, v array<double>")


def read_wav(spark: SparkSession, path: str, block: int = 16_000) -> DataFrame:
    """Samples in blocks: (path, rate, chan, first, v), `first` being the index of the block's first sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rate, x = wav(content)
                for chan in range(x.shape[1]):
                    starts = list(range(0, len(x), block))
                    yield pa.RecordBatch.from_pydict(
                        {"path": [name] * len(starts), "rate": pa.array([rate] * len(starts), pa.int32()), "chan": pa.array([chan] * len(starts), pa.int32()), "first": pa.array(starts, pa.int64()), "v": pa.array([x[s : s + block, chan].tolist() for s in starts], pa.list_(pa.float64()))}
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, chan int, first long, v array<double>")


def samples(blocks: DataFrame) -> DataFrame:
    """One row per sample: (path, chan, n, x)."""
    return blocks.select("path", "chan", "first", F.posexplode("v").alias("k", "x")).select("path", "chan", (F.col("first") + F.col("k")).alias("n"), "x")


def read_htk(spark: SparkSession, path: str) -> DataFrame:
    """Frames of HTK feature files: (path, period, kind, frame_x, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                period, kind, x = htk(content)
                n = len(x)
                yield pa.RecordBatch.from_pydict(
                    {"path": [name] * n, "period": pa.array([period] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "frame_x": pa.array(range(n), pa.int64()), "v": pa.array(x.tolist(), pa.list_(pa.float64()))}
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, period int, kind int, frame_x long, v array<double>")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and final states of a graph's text form: lines of 4 or 5 fields are edges, of 1 or 2 final states; a missing cost is 0."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> ''").select(part.alias("p"))
    cost = lambda k: F.coalesce(F.get("p", F.lit(k)).cast("double"), F.lit(0.0)).alias("cost")
    edges = lines.where("size(p) >= 4").select(*(F.col("p")[k].cast("long").alias(c) for k, c in enumerate(("src", "dst", "isym", "osym"))), cost(4))
    return edges, lines.where("size(p) <= 2").select(F.col("p")[0].cast("long").alias("state"), cost(1))


def write_graph(edges: DataFrame, finals: DataFrame, path: str) -> None:
    lines = edges.select(F.concat_ws(" ", "src", "dst", "isym", "osym", "cost")).union(finals.select(F.concat_ws(" ", "state", "cost")))
    lines.toDF("value").write.text(path)


def read_frames(stream: bool, spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Frames that others write as JSON lines into a folder, as a table or as a stream: the form in which captured or received frames come in."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def receive_frames(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """Frames as JSON lines from a socket: a stream for trying things out, as a socket can't be read again after a failure."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("f")).select("f.*")


def transmit_frames(stream: DataFrame, folder: str, checkpoint: str):
    """Writes a stream's frames as JSON lines to a folder, which others read as a stream; returns the running query."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).start()
