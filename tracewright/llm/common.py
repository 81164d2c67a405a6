"""What the operators of this subpackage share: scratch folders, word memos, batches of texts, state of workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import discard, materialise, scratch

__all__ = ["WordMemo", "bound_batches", "discard", "free_names", "materialise", "memo_bytes", "pa_fields", "returning", "scratch", "shuffle_partitions", "slices", "task_state", "texts_of", "word_hashes"]

T = TypeVar("T")


_STATE: dict = {}


@contextlib.contextmanager
def task_state(key: object, make: Callable[[], T], keep: bool = False) -> Iterator[T]:
    """What a Python worker uses in a task and keeps for the next one of the same kind: one thing at a time.

    At the end of each task its ``forget`` method, if it has one, is called, and the memory goes back to the system: workers
    wait between tasks and are used again by other stages, so what each kept for itself would add up without a bound. With
    ``keep`` it remembers, within its own bound in bytes, until a task of another kind comes.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    try:
        yield _STATE[key]
    finally:
        if not keep and (forget := getattr(_STATE.get(key), "forget", None)) is not None:
            forget()
        give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def returning(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step``, whose worker gives memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


#: bytes of a batch of rows between Spark and Python
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small from now on in this session, unless they're set smaller already.

    By default 10,000 rows or 64 MB go to a worker at once, held several times over on both sides. A row larger than the
    bound makes a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key, "64m").lower().rstrip("b").replace("m", "000000").replace("k", "000")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pa_fields(df: DataFrame) -> list[pa.Field]:
    """The Arrow fields of ``df``."""
    return list(to_arrow_schema(df.schema))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, with underscores in front of each until no column has the name."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class WordMemo:
    """Remembers the ids of words seen so far in a task, so that a distinct word is encoded once.

    ``encode_many`` turns a list of distinct words into (all ids in a row, count of each word). ``limit`` bounds the
    memory: beyond about that many bytes the memo starts afresh. It changes speed only, never ids.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 48_000_000):
        self._encode_many, self._limit = encode_many, limit
        self.forget()

    def forget(self) -> None:
        self._row: dict[str, int] = {}
        self._flat, self._ends, self._used, self._bytes = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), 0, 0

    def rows(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self._row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            size = memo_bytes(new)
            if self._bytes + size > self._limit and self._row:
                self.forget()
                return self.rows(words)
            self._bytes += size
            ids, counts = self._encode_many(new)
            n, begin = len(self._row), self._used
            self._used += len(ids)
            while self._used > len(self._flat):
                self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
            while n + len(new) + 1 > len(self._ends):
                self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._flat[begin : self._used] = ids
            self._ends[n + 1 : n + 1 + len(new)] = begin + np.cumsum(counts)
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
            rows[missing] = range(n, n + len(new)) if len(new) == len(missing) else [self._row[words[i]] for i in missing.tolist()]
        return rows

    def gather(self, words: list[str], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` in a row, and how many each word has; with ``at``, of the words at these places of ``words``."""
        rows = self.rows(words) if at is None else self.rows(words)[at]
        starts = self._ends[rows]
        counts = self._ends[rows + 1] - starts
        shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return self._flat[shift + np.arange(len(shift))], counts


def memo_bytes(words: list[str]) -> int:
    """About what a dictionary with ``words`` as keys takes."""
    return 130 * len(words) + 2 * sum(map(len, words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters (one text at least), to bound the memory of a batch."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]
