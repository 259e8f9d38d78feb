"""Functions whose body is Python, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Type
from .base import SimpleFunction

#: Most values and bytes of a batch that are Python objects at once (a single larger value is taken alone).
SLICE_VALUES, SLICE_BYTES = 1 << 12, 1 << 20


def python_function(params: Sequence[tuple[str, Type]], returns: Type, body: Callable[..., Any], text: bool = True, optional: Sequence[tuple[str, Any]] = ()) -> SimpleFunction:
    """A function of ``body``, which gets each argument's Python value (byte strings as bytes; None where missing).

    Built-in expressions are faster; this is for what they cannot say. Under ``[*]`` the library calls ``mapped``, which
    runs the body over whole arrays in one batch call, as Spark has no Python inside array functions. Only a slice of a batch
    is Python objects at a time, however many elements its arrays have.
    """

    def inward(x: Any) -> Any:
        return x.encode() if isinstance(x, str) else x

    def outward(x: Any) -> Any:
        return x.decode() if text and isinstance(x, bytes) else x

    out_type = returns.spark(text)

    def column(*values: Any) -> Column:
        @F.arrow_udf(out_type)
        def run(*arrays: pa.Array) -> pa.Array:
            parts = [_array([], out_type)]
            for at, n in _slices(*arrays):
                parts.append(_array([outward(body(*map(inward, row))) for row in zip(*(a.slice(at, n).to_pylist() for a in arrays))], out_type))
            return pa.concat_arrays(parts)

        return run(*[v.column for v in values])

    found = SimpleFunction(params, returns, body, column, optional, python=True)

    def mapped(items: Column, *values: Any) -> Column:
        from pyspark.sql.types import ArrayType

        kind = ArrayType(out_type)

        @F.arrow_udf(kind)
        def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
            parts, sizes = [_array([], out_type)], [np.zeros(1, np.int64)]
            for at, n in _slices(first, *rest):
                arrays = first.slice(at, n)
                others = [[*map(inward, row)] for row in zip(*(a.slice(at, n).to_pylist() for a in rest))] or [[]] * n
                owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))
                values, size = arrays.flatten(), np.zeros(n, np.int64)
                for i, k in _slices(values):
                    mine = owner[i : i + k]
                    found = _array([outward(body(inward(x), *others[r])) for x, r in zip(values.slice(i, k).to_pylist(), mine.tolist())], out_type)
                    size += np.bincount(mine[found.is_valid().to_numpy(zero_copy_only=False)], minlength=n)
                    parts.append(found.drop_null())
                sizes.append(size)
            offsets = pa.array(np.concatenate(sizes).cumsum().astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts), _array([], kind).type, mask=first.is_null())

        return run(items, *[v.column for v in values])

    found.mapped = mapped
    return found


def _slices(*arrays: pa.Array, at: int = 0, n: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and lengths of slices within SLICE_VALUES rows and SLICE_BYTES bytes, by halves."""
    n = len(arrays[0]) if n is None else n
    if n > 1 and (n > SLICE_VALUES or sum(a.slice(at, n).nbytes for a in arrays) > SLICE_BYTES):
        yield from _slices(*arrays, at=at, n=n // 2)
        yield from _slices(*arrays, at=at + n // 2, n=n - n // 2)
    elif n:
        yield at, n


def _array(rows: list, kind: Any) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(rows, to_arrow_type(kind))
