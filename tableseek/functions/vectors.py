"""Vector columns: normalisation, features, projection, half precision."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vec: str | Column, eps: float = 1e-12) -> Column:
    """Unit vector; a zero vector stays zero."""
    vec = _c(vec)
    norm = F.greatest(F.sqrt(dot(vec, vec)), F.lit(eps))
    return F.transform(vec, lambda x: x.cast("double") / norm)


def signed_log(value: str | Column) -> Column:
    value = _c(value)
    return F.signum(value) * F.log1p(F.abs(value))


def sinusoid(value: str | Column, dim: int) -> Column:
    """dim features: sines then cosines over geometric frequencies, zero padded when odd."""
    value = _c(value)
    half = dim // 2
    freqs = F.array(*[F.lit(math.exp(-math.log(10_000.0) * i / max(half - 1, 1))) for i in range(half)])
    parts = [F.transform(freqs, lambda f: F.sin(value * f)), F.transform(freqs, lambda f: F.cos(value * f))]
    if dim % 2:
        parts.append(F.array(F.lit(0.0)))
    return F.concat(*parts)


def fuse(cell_vec: str | Column, header_vec: str | Column) -> Column:
    return F.concat(_c(cell_vec), _c(header_vec))


def sign_matrix(rows: int, cols: int, seed: int = 42) -> np.ndarray:
    """Seeded +1/-1 matrix; the sign is the parity of the first hex digit of a hash."""
    signs = [
        [1.0 if int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[0], 16) % 2 == 0 else -1.0 for j in range(cols)]
        for i in range(rows)
    ]
    return np.array(signs).reshape(rows, cols)


def random_projection(vec: str | Column, dim_in: int, dim_out: int, seed: int = 42) -> Column:
    """Seeded sign projection to dim_out dimensions, divided by sqrt(dim_out)."""
    matrix = sign_matrix(dim_in, dim_out, seed) / math.sqrt(dim_out)

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(batch.to_numpy()).astype(np.float64) @ matrix))

    return project(_c(vec))


@F.pandas_udf(BinaryType())
def to_half(batch: pd.Series) -> pd.Series:
    """Vector packed as 16-bit floats for storage."""
    return batch.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_half(batch: pd.Series) -> pd.Series:
    return batch.map(lambda b: None if b is None else np.frombuffer(b, dtype=np.float16).astype(np.float32))
