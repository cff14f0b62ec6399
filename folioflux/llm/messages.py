"""Packed messages between tasks: one row per receiving shard instead of one per entry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def packed(**arrays: np.ndarray) -> bytes:
    """A line of names, kinds and shapes, then the arrays' bytes: a message may hold few
    entries, so its head is kept short."""
    head = ";".join(f"{k}:{a.dtype.str}:{','.join(map(str, a.shape))}" for k, a in arrays.items())
    return b"".join([head.encode(), b"\n", *(a.tobytes() for a in arrays.values())])


def unpacked(message: bytes) -> dict[str, np.ndarray]:
    at = message.index(b"\n") + 1
    out = {}
    for part in message[: at - 1].decode().split(";"):
        name, kind, sizes = part.split(":")
        shape = tuple(int(x) for x in sizes.split(",") if x)
        found = np.frombuffer(message, kind, math.prod(shape), at).reshape(shape)
        at += found.nbytes
        out[name] = found.copy()
    return out


MESSAGE = "shard bigint, kind string, body binary"


def messages(shard: np.ndarray, kind: str, shards: int, pack: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """One row per shard that has entries; ``pack`` gets the entries' places, by shard."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(bounds)):
        body = pack(order[bounds[s] : bounds[s + 1]])
        yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([kind]), pa.array([body], pa.binary())], names=["shard", "kind", "body"])
