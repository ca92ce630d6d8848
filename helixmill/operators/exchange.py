"""Shuffle of packed blocks.

Per-item shuffles of hashes cost a row header, a key and an id each. Here a map kernel packs the items
of one target partition into one binary cell, the cells move by partition number, and a reduce kernel
sorts the unpacked arrays. Spark still owns the shuffle, its spilling and its recovery.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A map task hands over what it has packed once it holds so many bytes.
FLUSH_BYTES = 48 << 20


def partitions_of(df: DataFrame, row_bytes: int = 0) -> int:
    """Partitions of an exchange of the rows of ``df`` (a staged table, whose rows are counted from its footers) at ``row_bytes`` each:
    so many that each has about the session's advisory partition size, and at least what the session sets for shuffles."""
    conf = df.sparkSession.conf
    least = int(conf.get("spark.sql.shuffle.partitions", "200"))
    if not row_bytes:
        return least
    return max(least, -(-df.count() * row_bytes // _bytes(conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB"))))


def _bytes(text: str) -> int:
    """A size as Spark's settings write it."""
    digits = text.rstrip("bBkKmMgG ")
    unit = text[len(digits) :].strip().lower().rstrip("b")
    return max(1 << 20, int(digits) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit])


def packed_exchange(
    df: DataFrame,
    pack: Callable[[pa.RecordBatch, int], Iterator[tuple[int, bytes]]],
    reduce: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]],
    schema: str,
    n: int,
) -> DataFrame:
    """``pack`` turns a batch into (partition, bytes); ``reduce`` gets all bytes of one of the ``n`` partitions.

    Both run on the workers and must be deterministic, so that a lost task can be run again. What ``pack`` gives must stay
    small for any one partition, whatever the values: it has to pre-aggregate values that many rows of its batch hold.
    A partition without any bytes yields nothing.
    """

    def send(batches):
        for batch in batches:
            held, size = {}, 0
            if not batch.num_rows:
                continue
            for pid, data in pack(batch, n):
                held.setdefault(pid, []).append(data)
                size += len(data)
                if size > FLUSH_BYTES:
                    yield _cells(held)
                    held, size = {}, 0
            if held:
                yield _cells(held)

    def receive(batches):
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for pid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(pid, []).append(data)
        for pid in sorted(by):
            yield from reduce(pid, sorted(by.pop(pid)))

    moved = df.mapInArrow(send, "pid int, data binary").repartitionById(n, "pid")
    return moved.mapInArrow(receive, schema)


def _cells(held: dict[int, list[bytes]]) -> pa.RecordBatch:
    rows = [(pid, data) for pid in sorted(held) for data in held[pid]]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["pid", "data"])


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, low bytes first: small numbers then compress well."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def from_planes(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


def split_by(pid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups items by partition, and where each partition begins in it."""
    order = np.argsort(pid.astype(np.uint16) if n < 1 << 16 else pid, kind="stable")  # 16 bits sort by radix
    return order, np.concatenate([[0], np.cumsum(np.bincount(pid.astype(np.int64), minlength=n))])
