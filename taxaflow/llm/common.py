"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.session import durable, ship_package  # noqa: F401

#: White space of all contracts: space and the characters from tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    """A table of ``folder``, with this package sent to the workers.

    Rows of text are large: batches of a thousand keep what a worker holds small.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts of an Arrow array as bytes; null is empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def held_out(doc_id: str | Column, folds: int, fold: int = 2) -> Column:
    """Whether ``crc32`` of the id as text leaves ``fold``; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == fold, F.lit(False))


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per size out of ``values``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ragged(arrays: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list array; a null list is empty."""
    if arrays.null_count:
        arrays = arrays.fill_null(pa.scalar([], arrays.type))
    return arrays.flatten().to_numpy(zero_copy_only=False), np.diff(arrays.offsets.to_numpy())


def batches_of(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of about ``most`` items together, one row at least."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, stop)
        start = stop


def portions(texts: list[bytes], most: int = 4 << 20) -> Iterator[slice]:
    """Consecutive texts of about ``most`` bytes together, so that their words fit in little memory."""
    return batches_of(np.array([len(x) for x in texts], np.int64), most)


_forget: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """``owner`` keeps things in a worker from task to task; ``forget`` drops them."""
    _forget[owner] = forget


def claim(owner: str) -> None:
    """A worker turns to ``owner``: what other operators remember there is dropped, so their memories don't add up."""
    if _owner[0] != owner:
        for other, forget in _forget.items():
            if other != owner:
                forget()
        _owner[0] = owner


class Memo(dict):
    """Remembers results for words; forgets all when it holds ``most``."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(Memo):
    """A memo that, when half of ``most`` are new, keeps them and forgets the ones before that were not asked for since."""

    def __init__(self, make, most: int = 400_000):
        super().__init__(make, most)
        self.old: dict = {}

    def __missing__(self, key):
        if 2 * len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
