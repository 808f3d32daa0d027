import random
import tracemalloc
import zlib

import numpy as np
import pytest

from ledgerlens.llm import token_counts, token_files
from ledgerlens.llm.queries import vocabulary

PIECES = [" ", "  ", "\n", "\t", "a", "the", "the  the", "é", "▁", "<s>", "</s>", "<|endoftext|>", " ", "　", "日本", "!", "?!", "123", "'s",
          "\r\n", "\x00", "\x1c", "<unk>", " ", "🙂", "ﬁ", "​", "\x85", " \n ", "▁ ", "word.\nNext", "abc.", "x***", "é.", ".\n\n"]


def mixed_texts(n=400):
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(10))) for _ in range(n)]


def test_segments_encode_as_the_whole(documents):
    encoder = token_files.LibraryWords(vocabulary("byte_bpe_50k.json")())
    texts = mixed_texts() + [r["text"] for r in documents.limit(60).collect()]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == want


def test_repeated_parts_become_no_python_strings():
    encoder = token_files.LibraryWords(vocabulary("byte_bpe_50k.json")())
    texts = [" ".join(["the cat sat, and"] * 150_000), "", "one", " two", "end "]
    encoder.encode(["the cat sat, and the"])
    tracemalloc.start()
    made = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.frombuffer(b, encoder.kind).tolist() for b in made] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert peak < 15_000_000  # a string and a list entry for each of the 600,000 parts are more than 30 MB
    assert encoder.encode([]) == []


def test_words_of_any_character_as_the_library():
    encoder = token_files.LibraryWords(vocabulary("byte_bpe_50k.json")())
    texts = [f"a{c}1{c} {c}.{c}\n{c}'{c} {c} b" for c in map(chr, [*range(0x300), 0x2028, 0x3000, 0x1F600])]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(documents):
    counter = token_counts.Counter(vocabulary("piece_bpe_32k.model")())
    texts = mixed_texts() + [r["text"] for r in documents.limit(60).collect()]
    want = [len(x) for x in counter.model.encode(texts)]
    assert counter.count(texts) == want and counter.count(texts) == want
    assert len(counter.whole) > 10_000


def test_counts_of_odd_rows(odd_docs, no_docs):
    model = vocabulary("piece_bpe_32k.model")
    out = token_counts.token_counts(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    assert {(r["n_bytes"], r["n_tokens"]) for r in out if r["doc_id"] in (100, 101)} == {(0, 0)}
    assert [r["over_limit"] for r in out if r["doc_id"] == 103] == [True]
    assert token_counts.token_counts(no_docs, model).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_files_round_trip(spark, odd_docs, tmp_path, parts):
    path = vocabulary("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_tokens(odd_docs, folder, path, parts=parts).orderBy("part").collect()
    assert sum(r["documents"] for r in manifest) == odd_docs.count()
    out = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    encoder = token_files.LibraryWords(path())
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = sorted(((i is not None, i or 0), [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts)
    assert [r["doc_id"] for r in out] == [i if there else None for (there, i), _ in want]
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out]])[:-1].tolist()
    pairs = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in out)
    assert pairs == sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want)


def test_no_rows(spark, no_docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write_tokens(no_docs, folder, vocabulary("byte_bpe_50k.json")).count() == 0
    assert token_files.read_documents(spark, folder).count() == 0
