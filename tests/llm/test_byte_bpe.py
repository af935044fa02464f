from pathlib import Path

import public_tokenizers
from hypothesis import given, settings, strategies as st

from quayline.llm import byte_bpe
from tests.llm import brute

RANKS = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
PATTERN = public_tokenizers.PATTERN


def test_equals_the_library(sample, odd):
    library = brute.tiktoken_encoding()
    for docs in (sample, odd):
        rows = byte_bpe.encode(docs, RANKS, PATTERN).select("text", "ids").collect()
        assert all(r.ids == library.encode_ordinary(r.text or "") for r in rows)


def test_digests_and_round_trip(odd):
    library = brute.tiktoken_encoding()
    expected = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((str(r.doc_id), len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha(r.text or "")))
    found = byte_bpe.digests(odd, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(expected)
    decoded = byte_bpe.decode(byte_bpe.encode(odd.drop("bytes"), RANKS, PATTERN), RANKS, PATTERN).select("text", "bytes").collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in decoded)


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(None,), ([],), ([-5],)], "ids array<int>")
    assert [bytes(r.bytes) for r in byte_bpe.decode(rows, RANKS, PATTERN).collect()] == [b"", b"", b""]


def test_empty(empty):
    assert byte_bpe.digests(empty, RANKS, PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r abcé'sT1漢😀\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_text(texts):
    import pyarrow as pa

    library, vocabulary = brute.tiktoken_encoding(), byte_bpe._vocabulary(RANKS, PATTERN)
    found = list(byte_bpe._encoded(pa.array(texts, pa.large_string()), vocabulary))
    for text, (ids, plain) in zip(texts, found, strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)) and plain == text.encode()


def test_long_words_by_heap_equal_the_recursion():
    vocabulary = byte_bpe._vocabulary(RANKS, PATTERN)
    words = [b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaa", "überstraßenbahnhaltestelle".encode(), b"0123456789" * 9]
    assert vocabulary.encode(words) == [vocabulary.merged(w) for w in words]
