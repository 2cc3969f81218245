"""BPE by a distinct-word table, and decoding by an id-to-piece table.

1. Each task splits its texts into words as the tokenizer's normalizer and
   pre-tokenizer do, and lists the distinct words of each block of texts, in one
   compressed row per bucket of a word hash.
2. The rows are dealt by bucket, so that equal words of all blocks meet; each distinct
   word is encoded once, and its ids go to every block that has it.
3. These entries are written, by block, to the shared folder: a block gets the entries
   of its own words only, so no task holds the vocabulary of the corpus.
4. Each task reads its texts again, opens the entries of their block, and puts ids
   in place of words by position.
5. Decoding starts from a document's ids: it looks up the piece of each id in a table of
   the vocabulary's size and joins them as the library's decode does.

A block is a run of texts of one partition.  Should the partitions differ between
the two readings (a source that deals rows anew), a word without an entry is encoded
where it stands, by the same function, so the result holds whatever the layout; an
accumulator given as ``strays`` counts such words, and there are none where files are read.

Words are dealt to ``SPREAD`` buckets for each shuffle partition.  A task holds the ids of
one bucket's words, and starts anew after ``MOST_WORDS``: only beyond that many distinct
words in one bucket is a word encoded again.

Null and empty texts have no ids and decode to the empty string.  Strings of special
tokens become their ids.  Repeated rows are encoded one by one; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_BPE_JSON, lean, new_folder, table, tokenizer_path, worker_cache
from weftgraph.llm.token_files import filesystem

#: Characters of text in a block; bounds the entries that a task holds at once.
BLOCK_CHARS = 24_000_000
#: Buckets of words for each shuffle partition, and words of a bucket held at once.
SPREAD, MOST_WORDS = 4, 500_000
#: In front of a special token's string; words hold no white space.
SPECIAL = " "


class WordBpe:
    """The words of a text, and the ids and pieces of a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the executor's tasks
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        words = spec | {"truncation": None, "padding": None, "added_tokens": [], "normalizer": None}
        words["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.by_word = Tokenizer.from_str(json.dumps(words))
        self.pieces = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        if len(self.pieces) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.decimal = [str(i) for i in range(len(self.pieces))]
        # Below U+0250 and in general punctuation, normalization and classes are plain (held by a test).
        plain = [chr(c) for c in [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), 0x20AC]]
        low = {x for c in plain for x in c.lower()}
        self.odd = re.compile("[^" + re.escape("".join(plain)) + "]")
        letters = re.escape("".join(sorted(c for c in low if unicodedata.category(c)[0] == "L")))
        numbers = re.escape("".join(sorted(c for c in low if unicodedata.category(c)[0] == "N")))
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")

        def bytes_of_chars() -> dict[str, int]:
            """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
            own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            rest = [b for b in range(256) if b not in own]
            return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}

        self.bytes_of = bytes_of_chars()

    def words(self, text: str) -> list[str]:
        """The words in order; together with the special tokens they make the ids."""
        if "<|" in text and self.at_special.search(text):
            out = []
            for i, part in enumerate(self.at_special.split(text)):
                out += [SPECIAL + part] if i % 2 else self.words(part) if part else []
            return out
        if not self.odd.search(text):
            return self.split.findall(text.lower())
        pre = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in pre]

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 16-bit integers."""
        plain = self.by_word.encode_batch_fast(["" if w[0] == SPECIAL else w for w in words], add_special_tokens=False)
        ids = [[self.special[w[1:]]] if w[0] == SPECIAL else e.ids for w, e in zip(words, plain, strict=True)]
        return [struct.pack(f"<{len(x)}H", *x) for x in ids]

    @staticmethod
    def unpacked(ids: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(ids) // 2}H", ids)

    def decoded(self, ids: tuple[int, ...]) -> str:
        """The pieces of the ids, joined as the library's decode does."""
        return " ".join(map(self.pieces.__getitem__, ids))


def word_bpe(path: str) -> WordBpe:
    cache = worker_cache().setdefault("loaded", {})
    if ("word_bpe", path) not in cache:
        cache["word_bpe", path] = WordBpe(path)
    return cache["word_bpe", path]


def blocks(batches: Iterable[pa.RecordBatch], column: int, chars: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches with the number of the block that each belongs to."""
    block, held = 0, 0
    for batch in batches:
        at = 0
        sizes = [len(x.as_py() or "") for x in batch.column(column)]
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                if i > at:
                    yield block, batch.slice(at, i - at)
                block, held, at = block + 1, 0, i
            held += n
        if len(sizes) > at:
            yield block, batch.slice(at)


def squeezed(words: list[str]) -> bytes:
    import zstandard

    return zstandard.compress("\n".join(words).encode("utf-8", "surrogateescape"), 3)


def unsqueezed(data: bytes) -> list[str]:
    import zstandard

    return zstandard.decompress(data).decode("utf-8", "surrogateescape").split("\n")


def squeezed_ids(ids: list[bytes]) -> bytes:
    """The number of ids of each word, then all ids."""
    import numpy as np
    import zstandard

    counts = np.array([len(x) // 2 for x in ids], "<u4")
    return zstandard.compress(struct.pack("<I", len(ids)) + counts.tobytes() + b"".join(ids), 3)


def unsqueezed_ids(data: bytes) -> list[bytes]:
    import numpy as np
    import zstandard

    own = zstandard.decompress(data)
    n = struct.unpack_from("<I", own)[0]
    ends = 4 + 4 * n + 2 * np.cumsum(np.frombuffer(own, "<u4", n, 4).astype(np.int64))
    starts = np.append(4 + 4 * n, ends[:-1]) if n else ends
    return [own[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def block_words(docs: DataFrame, path: str, buckets: int, chars: int = BLOCK_CHARS) -> DataFrame:
    """(part, block, bucket, words): the distinct words of each block of texts, sorted."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = word_bpe(path), TaskContext.get().partitionId()
        found: set[str] = set()
        last = 0

        def rows() -> pa.RecordBatch:
            lists: dict[int, list[str]] = {}
            for w in sorted(found):
                lists.setdefault(zlib.crc32(w.encode("utf-8", "surrogateescape")) % buckets, []).append(w)
            columns = ([part] * len(lists), [last] * len(lists), list(lists), [squeezed(x) for x in lists.values()])
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "block", "bucket", "words"]
            )

        for block, batch in blocks(batches, 0, chars):
            if block != last:
                yield rows()
                found, last = set(), block
            for value in batch.column(0):
                if t := value.as_py():
                    found.update(bpe.words(t))
        yield rows()

    return docs.mapInArrow(lean(split), "part int, block int, bucket int, words binary")


def encoded_words(words: DataFrame, path: str, most: int = MOST_WORDS) -> DataFrame:
    """(part, block, words, ids): each distinct word of a bucket encoded once."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        bucket, ids_of = -1, {}
        for batch in batches:
            out = []
            for own, data in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if own != bucket:  # rows come sorted by bucket
                    bucket, ids_of = own, {}
                listed = unsqueezed(data.as_py())
                if len(ids_of) > most:
                    ids_of = {}
                new = [w for w in listed if w not in ids_of]
                for i in range(0, len(new), 10_000):
                    ids_of.update(zip(new[i : i + 10_000], bpe.packed(new[i : i + 10_000]), strict=True))
                out.append(squeezed_ids([ids_of[w] for w in listed]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], ["part", "block", "words", "ids"]
            )

    return (
        words.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(encode), "part int, block int, words binary, ids binary")
    )


def block_entries(spark: SparkSession, words: DataFrame, path: str) -> str:
    """Write the entries of every block to the shared folder, a folder per partition."""
    folder = new_folder(spark, "block-words")
    encoded_words(words, path).repartition("part", "block").sortWithinPartitions("part", "block").write.partitionBy(
        "part"
    ).parquet(folder)
    return folder


def entries(folder: str, part: int, block: int) -> Iterator[tuple[str, bytes]]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = filesystem(f"{folder}/part={part}")
    if system.get_file_info(base).type != fs.FileType.Directory:
        return
    for info in system.get_file_info(fs.FileSelector(base)):
        if info.base_name.startswith("part-"):
            read = pq.read_table(info.path, columns=["words", "ids"], filters=[("block", "=", block)], filesystem=system, partitioning=None)
            for words, ids in zip(read.column(0), read.column(1), strict=True):
                yield from zip(unsqueezed(words.as_py()), unsqueezed_ids(ids.as_py()), strict=True)


def encode_decode(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    chars: int = BLOCK_CHARS,
    with_ids: bool = False,
    strays: Accumulator | None = None,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<long>, decoded]."""
    path = path or tokenizer_path(WORD_BPE_JSON)
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = SPREAD * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = block_entries(spark, block_words(own.select("text"), path, buckets, chars), path)
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, last = word_bpe(path), TaskContext.get().partitionId(), -1
        ids_of: dict[str, bytes] = {}

        for block, batch in blocks(batches, 1, chars):
            if block != last:
                ids_of = dict(entries(folder, part, block))
                last = block
            out: tuple[list, ...] = ([], [], [], [], [])
            for value in batch.column(1):
                words = bpe.words(t) if (t := value.as_py()) else []
                try:
                    packed = b"".join([ids_of[w] for w in words])
                except KeyError:
                    missing = [w for w in dict.fromkeys(words) if w not in ids_of]
                    ids_of.update(zip(missing, bpe.packed(missing), strict=True))
                    if strays is not None:
                        strays.add(len(missing))
                    packed = b"".join([ids_of[w] for w in words])
                ids = bpe.unpacked(packed)
                decoded = bpe.decoded(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out[3].append(list(ids))
                    out[4].append(decoded)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            if with_ids:
                columns += [pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return own.mapInArrow(
        lean(place),
        f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + ", ids array<long>, decoded string" * with_ids,
    )


def op8_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
