"""Dense and sparse vector functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.text import ColumnOrName, col


def as_doubles(v: ColumnOrName) -> Column:
    return col(v).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product in the order of the components."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalise_sparse(m: ColumnOrName, least: float = 1e-9) -> Column:
    """A sparse vector (map of index -> weight) of length 1; unchanged if its length is under `least` (10.23)."""
    size = F.sqrt(F.aggregate(F.map_values(col(m)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size < least, col(m).cast("map<int,double>")).otherwise(F.transform_values(col(m).cast("map<int,double>"), lambda _, v: v / size))


def csr_row(indptr: ColumnOrName, indices: ColumnOrName, data: ColumnOrName, row: ColumnOrName) -> Column:
    """Row `row` (from 0) of a CSR matrix as a map (10.24)."""
    start, end = F.get(col(indptr), col(row)), F.get(col(indptr), col(row) + 1)
    return F.map_from_arrays(F.slice(col(indices), start + 1, end - start), F.slice(col(data), start + 1, end - start))


def hash_embedding(text: ColumnOrName, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashed words, length 1 (14.1)."""
    words = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dimensions)) == i), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(raw, lambda x: x / size)).otherwise(raw)
