"""Vectors as exact integers, floor(scale * component), in few bytes.

An integer vector is a binary: 2 or 4 bytes a component where all of its components fit, else 8 bytes, a double of the
component over 256 (which every finite double's has, whatever its size). Equal vectors have equal bytes, and the number
of components tells the width, so the bytes can be grouped and joined on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, tidy

#: The unit of the wide form.
UNIT = 256
_TYPES = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}
#: Products under this are exact in doubles.
EXACT = float(1 << 53)


def encoded(m: np.ndarray, scale: int) -> list[bytes]:
    """Bytes of each row of finite components."""
    with np.errstate(over="ignore"):
        q = np.floor(m * scale)
    most = np.abs(q).max(1, initial=0.0)
    out: list[bytes] = [b""] * len(m)
    for width, limit in ((2, 1 << 15), (4, 1 << 31)):
        at = np.flatnonzero((most < limit) & (most >= (0 if width == 2 else 1 << 15)))
        for i, row in zip(at.tolist(), q[at].astype(_TYPES[width]), strict=True):
            out[i] = row.tobytes()
    for i in np.flatnonzero(~(most < 1 << 31)).tolist():
        wide = [math.floor(v * scale) / UNIT if abs(v) < 2.0**53 else v * (scale / UNIT) for v in m[i].tolist()]
        out[i] = (np.array(wide, "<f8") + 0.0).tobytes()
    return out


def integers(raw: bytes, dim: int) -> list[int]:
    """The components as Python integers."""
    v = np.frombuffer(raw, _TYPES[len(raw) // dim])
    if v.dtype.kind == "i":
        return v.tolist()
    return [int(math.ldexp(x, 8)) if abs(x) < 2.0**900 else int(x) * UNIT for x in v.tolist()]


def matrix(raws: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(components over UNIT as doubles, whether times UNIT they are exact small integers) of each row."""
    m, width = np.empty((len(raws), dim)), np.fromiter((len(r) // dim for r in raws), np.int64, len(raws))
    for w in _TYPES:
        at = np.flatnonzero(width == w)
        if len(at):
            rows = np.frombuffer(b"".join([raws[i] for i in at.tolist()]), _TYPES[w]).reshape(-1, dim)
            m[at] = rows if w == 8 else rows / UNIT
    return m, width < 8


def integer_vectors(df: DataFrame, vector: str, keep: list[str], dim: int | None = None, scale: int = UNIT) -> DataFrame:
    """(the columns to keep, dim int, x binary) of the rows whose vector is whole and finite.

    Left out are null vectors, those that hold a null or non-finite component, those without components and, where
    `dim` is given, those with another number of components.
    """
    names = [f"k{i}" for i in range(len(keep))]
    df = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(vector).cast("array<double>").alias("v"))
    kinds = [f.dataType.simpleString() for f in df.schema[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(names))
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            dims = np.full(b.num_rows, dim or 0)
            raw: list[bytes | None] = [None] * b.num_rows
            for d in [dim] if dim else np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                m = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                good = np.isfinite(m).all(1)
                at, m, dims[at] = at[good], m[good], d
                for i, x in zip(at.tolist(), encoded(m, scale), strict=True):
                    raw[i] = x
            out = [*b.columns[:-1], pa.array(dims, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*names, "dim", "x"]).filter(pc.is_valid(out[-1]))

    bounded_batches(df.sparkSession)
    fields = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    out = df.mapInArrow(tidy(run), f"{fields}, dim int, x binary")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "dim", "x")
