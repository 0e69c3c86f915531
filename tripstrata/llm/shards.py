"""Owners of key ranges: what is dealt to an owner comes as a stream of packed arrays, and its sorted arrays lie in the shared folder.

A part is the leading bits of a 64-bit hash. Rows (part, blob) are shuffled by part and sorted by it in Spark, so a task sees one
part after the other and never a whole group at once; finer() deals a part on by further bits, on disk beyond a limit.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripstrata.llm.common import local_path
from tripstrata.llm.induced import Queues

#: Owners number at most two to this; with more data each has more, which finer() deals on.
MOST_BITS = 12
#: Bytes of a part that an owner holds; more lies in its temporary file.
HELD_BYTES = 32 << 20


def packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 12].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def split_by(bits: int, keys: np.ndarray) -> list[tuple[int, slice]]:
    """Ranges of sorted keys with the same leading bits."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def bits_for(n_bytes: int, owner_bytes: int, fine_bytes: int) -> tuple[int, int]:
    """Leading bits that make a part, and further ones for finer()."""
    of = lambda each: max(0, (-(-n_bytes // each) - 1).bit_length())
    bits = min(MOST_BITS, of(owner_bytes))
    return bits, max(0, of(fine_bytes) - bits)


def by_part(df: DataFrame, bits: int, own: Callable[[int, Iterator[bytes]], Iterator[pa.RecordBatch]], kinds: str | StructType) -> DataFrame:
    """What own(part, blobs) yields for each part (of `bits` bits) of `df` (part, blob); a part's blobs come in a stream. Each part
    is one task: small as its packed bytes may be, its work isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), (v.as_py() for v in b.column(1)), strict=True))
        for part, group in itertools.groupby(rows, key=lambda x: x[0]):
            yield from own(part, (x[1] for x in group))

    return df.select(F.col("part").cast("int").alias("part"), "blob").repartitionById(1 << bits, "part").sortWithinPartitions("part").mapInArrow(run, kinds)


def finer(bits: int, more: int, pieces: Iterator[list[np.ndarray]], sizes: int | None = None, limit: int = HELD_BYTES) -> tuple[int, Queues]:
    """The pieces (arrays, the first of keys, sorted) dealt by `more` bits after the leading `bits`: how many queues, and
    the queues. `sizes` is the place of an array with the lengths of the strings that the last array has end to end."""
    out = Queues(limit)
    mask = np.uint64((1 << more) - 1)
    for arrays in pieces:
        if not more:
            out.push(0, *arrays)
            continue
        to = ((arrays[0] >> np.uint64(64 - bits - more)) & mask).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        ends = np.append(0, np.cumsum(arrays[sizes], dtype=np.int64)) if sizes is not None else None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                last = [] if ends is None else [arrays[-1][ends[a] : ends[b]]]
                out.push(int(to[a]), *(x[a:b] for x in (arrays if ends is None else arrays[:-1])), *last)
    return 1 << more, out


class Shard:
    """Arrays of one owner, appended to files in the shared folder. Only a finished task tells its names, so what a lost or
    repeated task left is never read."""

    def __init__(self, root: str, kind: str, names: tuple[str, ...]):
        from pyarrow import fs

        self.name, self.length = f"{kind}-{uuid.uuid4().hex}", 0
        system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{local_path(root)}")
        system.create_dir(path, recursive=True)
        self.files = {n: system.open_output_stream(f"{path}/{self.name}.{n}") for n in names}

    def append(self, **arrays: np.ndarray) -> None:
        for n, a in arrays.items():
            self.files[n].write(np.ascontiguousarray(a).tobytes())
        self.length += len(next(iter(arrays.values())))

    def close(self) -> str:
        for f in self.files.values():
            f.close()
        return self.name
