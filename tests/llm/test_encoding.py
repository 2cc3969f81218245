import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows
from weftgraph.llm import bpe_words, token_files
from weftgraph.llm.bpe_words import WordBpe
from weftgraph.llm.common import BYTE_BPE_JSON, WORD_BPE_JSON, new_folder, tokenizer_path

byte_library = Tokenizer.from_file(tokenizer_path(BYTE_BPE_JSON))
word_bpe = WordBpe(tokenizer_path(WORD_BPE_JSON))
word_library = Tokenizer.from_file(tokenizer_path(WORD_BPE_JSON))


def encoded(text):
    ids = word_bpe.unpacked(b"".join(word_bpe.packed(word_bpe.words(text))))
    return " ".join(map(str, ids)), word_bpe.decoded(ids)


def by_library(text):
    ids = word_library.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), word_library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_words_equal_library(text):
    assert encoded(text) == by_library(text)


def test_words_equal_library_over_code_points():
    for i in [*range(1, 0x3100), *range(0x3100, 0x110000, 211)]:
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            text = f"a{c}1 {c} {c}{c}-{c}\nX'S"
            assert encoded(text) == by_library(text), hex(i)


def test_special_tokens_are_ids():
    for text in ("<|endoftext|>", "A<|startoftext|>b <|endoftext|><|endoftext|>", "<|other|> <|endoftext|"):
        assert encoded(text) == by_library(text)


def test_packed_lists_round_trip():
    words = ["a", "été", " <|endoftext|>", "日本", "'s"]
    assert bpe_words.unsqueezed(bpe_words.squeezed(words)) == words
    ids = word_bpe.packed(words)
    assert bpe_words.unsqueezed_ids(bpe_words.squeezed_ids(ids)) == ids
    assert bpe_words.unsqueezed_ids(bpe_words.squeezed_ids([])) == []


def check_words(rows):
    want = sorted(
        (str(i), len(by_library(t or "")[0].split()), *(hashlib.sha256(x.encode()).hexdigest() for x in by_library(t or "")))
        for i, t in awkward_rows()
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_encode_decode(awkward):
    strays = awkward.sparkSession.sparkContext.accumulator(0)
    rows = bpe_words.encode_decode(awkward, chars=50_000, with_ids=True, strays=strays).collect()
    assert strays.value == 0  # every word came from the distinct-word table
    check_words(rows)
    for r in rows:
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 and len(r.ids) == r.n_tokens


def test_encode_decode_without_entries(awkward, monkeypatch):
    """Words whose entries are not found are encoded where they stand."""
    real = bpe_words.block_entries
    monkeypatch.setattr(bpe_words, "block_entries", lambda *a: real(*a) + "-gone")
    strays = awkward.sparkSession.sparkContext.accumulator(0)
    check_words(bpe_words.encode_decode(awkward, strays=strays).collect())
    assert strays.value > 0


def test_given_tables_have_no_stray_words(spark):
    strays = spark.sparkContext.accumulator(0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert bpe_words.encode_decode(docs, strays=strays).count() == docs.count() and strays.value == 0


def test_words_beyond_what_a_task_holds(spark):
    """A million distinct words in two buckets, of which a task holds a few thousand."""
    docs = spark.range(200).selectExpr("concat_ws(' ', transform(sequence(id * 5000, id * 5000 + 4999), x -> translate(hex(x), '0123456789', 'ghijklmnop'))) as text")
    path = tokenizer_path(WORD_BPE_JSON)
    words = bpe_words.block_words(docs.repartition(4), path, 2, 1_000_000)
    found = bpe_words.encoded_words(words, path, most=5_000)
    bpe, seen = bpe_words.word_bpe(path), 0
    for r in found.collect():
        listed, ids = bpe_words.unsqueezed(r.words), bpe_words.unsqueezed_ids(r.ids)
        seen += len(listed)
        assert len(listed) == len(ids) and [ids[0], ids[-1]] == bpe.packed([listed[0], listed[-1]])
    assert seen >= 1_000_000


def test_decoding_starts_from_ids():
    bpe = bpe_words.word_bpe(tokenizer_path(WORD_BPE_JSON))
    for ids in ((), (5,), (49406, 320, 1125, 49407)):
        assert bpe.decoded(ids) == bpe.library.decode(list(ids), skip_special_tokens=False)


def test_encode_decode_of_nothing(empty):
    assert bpe_words.encode_decode(empty).collect() == []


def want_files():
    at, out = 0, []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, zlib.crc32((r[1] or "").encode()))
    for i, t in sorted(awkward_rows(), key=key):
        ids = np.array([*byte_library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(awkward, spark):
    manifest = token_files.write_token_files(awkward, new_folder(spark, "t"), shard_ids=2000)
    assert manifest.count() > 5
    rows = [tuple(r) for r in token_files.read_token_files(manifest).collect()]
    assert sorted(rows, key=lambda r: r[1]) == want_files()
    store = token_files.TokenStore(manifest)
    for i, t in awkward_rows():
        if i is not None and i not in (12, 13):
            assert store.get(i).tolist() == [*byte_library.encode(t or "", add_special_tokens=False).ids, 0]
    assert store.get(12) is not None and store.get(999_999) is None and store.get(-99) is None


def test_token_files_rest_on_the_index(awkward, spark):
    """A wrong offset or length in an index shows, whatever the order of writing says."""
    for wrong in ("offsets", "sizes"):
        manifest = token_files.write_token_files(awkward, new_folder(spark, "t"), shard_ids=2000)
        path = max(manifest.collect(), key=lambda r: r["n_docs"])["path"] + ".idx"
        index = token_files.Index.from_bytes(token_files.read_file(path))
        setattr(index, wrong, getattr(index, wrong) + (np.arange(len(index.prints)) == 1))
        token_files.write_file(path, index.to_bytes())
        with pytest.raises(Exception, match="wrong place in the index"):
            token_files.read_token_files(manifest).collect()


def test_token_files_with_wide_ids(awkward, spark):
    manifest = token_files.write_token_files(awkward, new_folder(spark, "t"), end_id=70_000)
    assert token_files.TokenStore(manifest).get(4).tolist()[-1] == 70_000


def test_token_files_of_nothing(empty, spark):
    manifest = token_files.write_token_files(empty, new_folder(spark, "t"))
    assert token_files.read_token_files(manifest).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400))
def test_perfect_hash(keys):
    own = np.array(sorted(keys), np.int64)
    hashed = token_files.PerfectHash.build(own)
    assert sorted(hashed.slots(own).tolist()) == list(range(len(own)))
    index = token_files.Index.of(list(keys), [1] * len(keys))
    again = token_files.Index.from_bytes(index.to_bytes())
    at, n = again.find(np.array(list(keys), np.int64))
    assert at.tolist() == list(range(len(keys))) and (n == 1).all()
    foreign = np.array([k for k in range(200) if k not in keys], np.int64)
    assert (again.find(foreign)[0] >= 0).sum() == 0
