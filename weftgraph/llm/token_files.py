"""Token ids as raw files with a minimal perfect hash index.

Documents are sorted by key over the whole table and encoded; each Spark partition
writes shards of raw little-endian unsigned ids, an end id after each document: of 16
bits where every id of the vocabulary fits, else of 32.  Beside each shard lies an index: a minimal perfect hash function maps the
shard's n keys onto 0..n-1, where fingerprint, offset and length of a document are
stored.  A keyed read hashes the key, compares the fingerprint and reads one range.

Shard layout (``.ids``): 7 bytes ``WGTOKID``, the bytes per id as a digit, then the ids.
Index layout (``.idx``): 8 bytes ``WGTOKIX1``, a line of JSON with counts, then the
arrays it lists: keys, lengths, hash levels' bits, fingerprints, offsets, entry lengths.

Null texts are empty and hold the end id alone.  Null keys come first and are found
by reading in order, not by key.  Of rows with equal keys the first can be looked up;
all are written.  An empty table writes no shard.  Extra columns are not read.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import byte_bpe, byte_bpe_paths, lean, new_folder, prefix_offsets, staged, table

IDS_MAGIC, INDEX_MAGIC = b"WGTOKID", b"WGTOKIX1"
END_ID = 0
#: Ids in a shard before the next is begun; a longer document still stays whole.
SHARD_IDS = 16_000_000
#: Slots per key on each level of the hash function.
GAMMA = 2.0
MANIFEST = "path string, shard long, n_docs long, n_ids long, min_key long, max_key long"


def filesystem(uri: str):
    """The file system and the path in it, of a path or URI that Spark writes to."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:] if not uri.startswith("file://") else uri[7:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Whole or not at all: a task that runs again replaces the same file."""
    system, path = filesystem(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, path)


def read_file(uri: str, start: int = 0, n: int | None = None) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read() if n is None else f.read(n)


def mixed(keys, seed: int):
    """A 64-bit finalizer (splitmix64) of the keys, by seed."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: on each level the keys that are
    alone in their slot set its bit, the others go on; the rank of the bit is the value."""

    LEVELS = 64

    def __init__(self, levels):
        import numpy as np

        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits, dtype=np.int64) - bits)
            at += int(bits.sum())

    @classmethod
    def build(cls, keys) -> PerfectHash:
        import numpy as np

        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == cls.LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(8, int(GAMMA * len(left)))
            at = (mixed(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys):
        """The value of each key, -1 where no level has it; a foreign key may get one."""
        import numpy as np

        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (mixed(keys[left], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[i][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys):
    import numpy as np

    return (mixed(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


class Index:
    """The index of one shard: keys in written order, and entries by perfect hash."""

    def __init__(self, keys, known, lengths, hashed, prints, offsets, sizes):
        self.keys, self.known, self.lengths = keys, known, lengths
        self.hashed, self.prints, self.offsets, self.sizes = hashed, prints, offsets, sizes

    @classmethod
    def of(cls, keys: list[int | None], lengths: list[int]) -> Index:
        import numpy as np

        known = np.array([k is not None for k in keys], bool)
        own = np.array([0 if k is None else k for k in keys], np.int64)
        sizes = np.array(lengths, np.int64)
        starts = np.cumsum(sizes) - sizes
        distinct, first = np.unique(own[known], return_index=True)
        first = np.flatnonzero(known)[first]
        hashed = PerfectHash.build(distinct)
        slots = hashed.slots(distinct)
        prints = np.zeros(len(distinct), np.uint32)
        offsets, entry_sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        prints[slots], offsets[slots], entry_sizes[slots] = fingerprints(distinct), starts[first], sizes[first]
        return cls(own, known, sizes, hashed, prints, offsets, entry_sizes)

    def find(self, keys):
        """(offset, length) of each key, -1 and 0 where the fingerprint differs."""
        import numpy as np

        slots = self.hashed.slots(keys)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        there = (slots >= 0) & (self.prints[np.maximum(slots, 0)] == fingerprints(keys))
        slots = np.where(there, slots, 0)
        return np.where(there, self.offsets[slots], -1), np.where(there, self.sizes[slots], 0)

    def to_bytes(self) -> bytes:
        import numpy as np

        arrays = [self.keys, self.known, self.lengths, self.prints, self.offsets, self.sizes]
        bits = [np.packbits(b) for b in self.hashed.levels]
        head = json.dumps({"docs": len(self.keys), "entries": len(self.prints), "levels": [len(b) for b in self.hashed.levels]})
        return INDEX_MAGIC + head.encode() + b"\n" + b"".join(a.tobytes() for a in [*arrays, *bits])

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        import numpy as np

        if data[:8] != INDEX_MAGIC:
            raise ValueError("not an index of token ids")
        f = io.BytesIO(data[8:])
        head = json.loads(f.readline())
        take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), kind)
        d, e = head["docs"], head["entries"]
        keys, known, lengths = take("<i8", d), take("?", d), take("<i8", d)
        prints, offsets, sizes = take("<u4", e), take("<i8", e), take("<i8", e)
        levels = [np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(bool) for n in head["levels"]]
        return cls(keys, known, lengths, PerfectHash(levels), prints, offsets, sizes)


def write_token_files(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    paths: tuple[str, str | None] | None = None,
) -> DataFrame:
    """Write the shards and their indexes; the manifest, one row per shard in key order."""
    paths = paths or byte_bpe_paths()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, part = byte_bpe(paths), TaskContext.get().partitionId()
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        keys: list[int | None] = []
        payload: list[bytes] = []
        lengths: list[int] = []
        held, written = 0, 0

        def shard() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{written:06d}"
            write_file(f"{path}.ids", IDS_MAGIC + b"%d" % width + b"".join(payload))
            write_file(f"{path}.idx", Index.of(keys, lengths).to_bytes())
            known = [k for k in keys if k is not None]
            row = (path, part << 24 | written, len(keys), held, min(known, default=None), max(known, default=None))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.string() if i == 0 else pa.int64()) for i, x in enumerate(row)],
                ["path", "shard", "n_docs", "n_ids", "min_key", "max_key"],
            )

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = value.as_py()
                ids = np.append(encoder.ids(t) if t else np.empty(0, np.uint32), np.uint32(end_id)).astype(f"<u{width}")
                keys.append(key)
                payload.append(ids.tobytes())
                lengths.append(len(ids))
                held += len(ids)
                if held >= shard_ids:
                    yield shard()
                    written += 1
                    keys, payload, lengths, held = [], [], [], 0
        if keys:
            yield shard()

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]  # so that rows with one key can be dealt out as well
    return staged(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(write), MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document read back by its key through the index of its shard:
    doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = prefix_offsets(manifest.select("path", "shard", "n_ids"), "shard", {"first": "n_ids"}, width=1 << 24)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                index = Index.from_bytes(read_file(f"{row['path']}.idx"))
                data = read_file(f"{row['path']}.ids")
                width = id_width(data, row["path"])
                ids = np.frombuffer(data, f"<u{width}", offset=8)
                in_order = np.cumsum(index.lengths) - index.lengths
                at, n = index.find(index.keys)
                # Only null keys and further rows with a key are read in the order of writing.
                other = np.ones(len(index.keys), bool)
                rows = np.flatnonzero(index.known)
                other[rows[np.unique(index.keys[rows], return_index=True)[1]]] = False
                if (at[index.known] < 0).any():
                    raise ValueError(f"a key is missing from the index of {row['path']}")
                if ((at != in_order) | (n != index.lengths))[~other].any():
                    raise ValueError(f"a key has a wrong place in the index of {row['path']}")
                at, n = np.where(other, in_order, at), np.where(other, index.lengths, n)
                crc = [zlib.crc32(ids[a : a + k].astype("<u4")) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index.keys, pa.int64(), mask=~index.known),
                        pa.array(at + row["first"], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        starts.select("path", "first")
        .repartition(n, "path")
        .mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def id_width(head: bytes, path: str) -> int:
    if head[:7] != IDS_MAGIC or head[7:8] not in (b"2", b"4"):
        raise ValueError(f"not a file of token ids: {path}")
    return int(head[7:8])


class TokenStore:
    """Keyed access from one process: the manifest's key ranges name the shard, its
    index the place."""

    def __init__(self, manifest: DataFrame):
        rows = manifest.filter("min_key is not null").orderBy("shard").collect()  # one row per file
        self.shards = [(r["min_key"], r["max_key"], r["path"]) for r in rows]
        self.indexes: dict[str, Index] = {}

    def get(self, key: int):
        """The ids of the document, or None."""
        import bisect

        import numpy as np

        i = bisect.bisect_left([s[1] for s in self.shards], key)
        if i == len(self.shards) or self.shards[i][0] > key:
            return None
        path = self.shards[i][2]
        index = self.indexes.get(path) or self.indexes.setdefault(path, Index.from_bytes(read_file(f"{path}.idx")))
        at, n = (int(x[0]) for x in index.find(np.array([key], np.int64)))
        if at < 0:
            return None
        width = id_width(read_file(f"{path}.ids", 0, 8), path)
        return np.frombuffer(read_file(f"{path}.ids", 8 + width * at, width * n), f"<u{width}").astype(np.uint32)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
