"""Two ways to run numpy over rows: frame by frame as matrices, and along a stream with a state that is carried on.

`vectors` turns the frames of an Arrow batch into matrices of equally long rows, so one call serves thousands of frames; only the
columns it needs travel. `scan` deals a stream's rows to one task in order and hands them over batch by batch with the
stream's state, so a stream is never held whole, however long it is; many streams (or bins of a stream) run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_NUMBERS = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _is_list(kind: pa.DataType) -> bool:
    return pa.types.is_list(kind) or pa.types.is_large_list(kind)


def _lengths(column: pa.Array) -> np.ndarray:
    """Length of each list, -1 for a null and for one that holds a null; 0 for a number, -1 for a null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if not _is_list(column.type):
        return np.where(null, -1, 0)
    off = np.asarray(column.offsets, np.int64)
    size = np.diff(off)
    gap = column.values.is_null().to_numpy(zero_copy_only=False)
    if gap.any():
        upto = np.concatenate([[0], np.cumsum(gap)])
        null = null | (upto[off[1:]] > upto[off[:-1]])
    return np.where(null, -1, size)


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    if not _is_list(column.type):
        return column.take(pa.array(rows)).to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    off = np.asarray(column.offsets, np.int64)[rows]
    return values[off[:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))


def _placed(parts: list[tuple[np.ndarray, object]], n: int, kind: pa.DataType) -> pa.Array:
    """Results of groups of rows, put back in the order of the rows; null where there is none."""
    if pa.types.is_struct(kind):
        held = np.zeros(n, bool)
        for rows, _ in parts:
            held[rows] = True
        fields = [_placed([(rows, found[f.name]) for rows, found in parts], n, f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array(~held))
    order = np.full(n, -1, np.int64)
    at, chunks = 0, []
    for rows, found in parts:
        order[rows] = at + np.arange(len(rows))
        at += len(rows)
        chunks.append(to_arrow(found, kind))
    whole = pa.concat_arrays(chunks) if chunks else pa.array([], kind)
    return whole.take(pa.array(order, pa.int64(), mask=order < 0))


def to_arrow(found: object, kind: pa.DataType) -> pa.Array:
    """A matrix or a list of arrays as lists, anything else as it is."""
    if _is_list(kind):
        if isinstance(found, np.ndarray) and found.ndim == 2:
            off = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(found).ravel(), kind.value_type))
        return pa.array([None if x is None else np.asarray(x).tolist() for x in found], kind)
    if isinstance(found, np.ndarray):
        return pa.array(found.astype(object), kind, from_pandas=True) if pa.types.is_string(kind) else pa.array(found).cast(kind)
    return pa.array(list(found), kind)


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def vectors(fn: Callable, kind: str, *columns: Column | str) -> Column:
    """fn over matrices (rows x length) of list columns and arrays of number columns; its result (matrix, array, or dict of
    them for a struct) as a column of type `kind`. Rows in which any input is null or holds a null get null."""
    out = _arrow_type(kind)

    def solve(arrays: tuple[pa.Array, ...]) -> pa.Array:
        arrays = tuple(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays)
        sizes = np.stack([_lengths(a) for a in arrays], 1)
        good = np.flatnonzero((sizes >= 0).all(1))
        kinds, group = np.unique(sizes[good], axis=0, return_inverse=True)
        parts = []
        for g, size in enumerate(kinds):
            rows = good[group.ravel() == g]
            parts.append((rows, fn(*(_matrix(a, rows, int(s)) for a, s in zip(arrays, size, strict=True)))))
        return _placed(parts, len(arrays[0]), out)

    if len(columns) == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield solve((batch,))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    else:

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield solve(tuple(batch))

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(*columns)


def _column(array: pa.Array) -> object:
    """Numbers as an array, lists of one length as a matrix, other lists as a list of arrays."""
    if not _is_list(array.type):
        return np.array(array.to_pylist(), object) if pa.types.is_string(array.type) else array.to_numpy(zero_copy_only=False)
    sizes = _lengths(array)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] >= 0:
        return _matrix(array, np.arange(len(sizes)), int(sizes[0]))
    return [None if x is None else np.array([np.nan if v is None else v for v in x], float) for x in array.to_pylist()]


def scan(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Walks each stream (equal `keys`) in the order of `order` with a state of its own.

    make() gives the state: step(columns) takes the stream's next rows, as a dict of arrays, and returns a dict of arrays or
    matrices for the columns of `schema`; end(), if there is one, returns what is still to come when the stream ends.
    The result has the keys, then the columns `keep` of the input (step then returns as many rows as it got), then those of
    schema. A null key is a stream of its own; no rows give no rows. The input is dealt by the keys and sorted within each task,
    and rows arrive in Arrow batches, so memory doesn't grow with a stream.
    """
    keep = keep or []
    fields = StructType([df.schema[c] for c in [*keys, *keep]])
    added = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.type for f in to_arrow_schema(added)}
    whole = StructType(fields.fields + added.fields)
    names = whole.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def made(found: dict, key: tuple, like: pa.RecordBatch, kept: pa.RecordBatch | None) -> pa.RecordBatch:
            columns = {c: to_arrow(found[c], kinds[c]) for c in kinds}
            n = len(next(iter(columns.values())))
            for c, v in zip(keys, key, strict=True):
                columns[c] = pa.array([v] * n, like.schema.field(c).type)
            for c in keep:
                columns[c] = kept.column(c) if kept is not None else pa.nulls(n, like.schema.field(c).type)
            return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch
            key = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if state is None or key[lo] != now:
                    if state is not None and hasattr(state, "end") and (left := state.end()) is not None:
                        yield made(left, now, batch, None)
                    now, state = key[lo], make()
                part = batch.slice(lo, hi - lo)
                found = state.step({c: _column(part.column(c)) for c in part.schema.names})
                if found is not None:
                    yield made(found, now, batch, part)
        if state is not None and hasattr(state, "end") and (left := state.end()) is not None:
            yield made(left, now, last, None)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, whole)


def is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, ArrayType)


def sums(df: DataFrame, keys: list[str], fn: Callable[[dict], np.ndarray]) -> DataFrame:
    """Sufficient statistics: fn turns rows of equal keys (a dict of arrays and matrices) into an array of numbers, which are
    added up over all rows, as (keys, s). Every Arrow batch is summed where it lies, so what is shuffled grows with batches
    and keys, not with rows; a key that holds most rows is summed by all tasks alike. No rows give no rows.
    """
    fields = StructType([df.schema[c] for c in keys])
    whole = StructType(fields.fields + StructType.fromDDL("__s array<double>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True) if keys else [()] * batch.num_rows):
                rows.setdefault(key, []).append(k)
            out: dict[str, list] = {c: [] for c in [*keys, "__s"]}
            for key, at in rows.items():
                part = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
                found = fn({c: _column(part.column(c)) for c in part.schema.names})
                for c, v in zip(keys, key, strict=True):
                    out[c].append(v)
                out["__s"].append(np.asarray(found, float).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], batch.schema.field(c).type) for c in keys), pa.array(out["__s"], pa.list_(pa.float64()))], names=[*keys, "__s"])

    each = df.mapInArrow(run, whole).select(*keys, F.posexplode("__s").alias("__k", "__x"))
    each = each.groupBy(*keys, "__k").agg(F.sum("__x").alias("__x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__x"))), lambda e: e["__x"]).alias("s"))


def per_group(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(rows as a list of dicts) -> list of dicts for each group: for graphs, lattices and models, each of which is one object
    of bounded size (an utterance's lattice, a lexicon's graph), while there may be any number of them. The result has the keys
    and the columns of schema."""
    import pandas as pd

    fields = StructType([df.schema[c] for c in keys])
    whole = StructType(fields.fields + StructType.fromDDL(schema).fields)
    names = StructType.fromDDL(schema).names

    def run(key, pdf):
        found = fn(pdf.to_dict("records"))
        out = {c: [v] * len(found) for c, v in zip(keys, key, strict=True)}
        return pd.DataFrame(out | {c: pd.Series([r.get(c) for r in found], dtype=object if not found else None) for c in names}, columns=whole.names)

    return df.groupBy(*keys).applyInPandas(run, whole)
