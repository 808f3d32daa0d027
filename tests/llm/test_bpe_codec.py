import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import bpe_codec
from ledgerlens.llm.queries import QUERIES, vocabulary
from tests.llm.test_tokens import mixed_texts

CODEC = bpe_codec.Codec(vocabulary("byte_bpe_50k.json")())


def library(texts):
    return [e.ids for e in CODEC.tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids_of(texts):
    return [np.frombuffer(b, CODEC.kind).tolist() for b in CODEC.encode(texts)]


def plainly(pairs, word):
    """Joins the leftmost pair of the least rank until none is left."""
    symbols = [pairs.of_byte[b] for b in word]
    while True:
        ranks = [(pairs.rank[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a << 32 | b in pairs.rank]
        if not ranks:
            return symbols
        rank, i = min(ranks)
        symbols[i:i + 2] = [pairs.merged[rank]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehilnorst éß.!", max_size=40))
def test_queue_equals_plain_merging(word):
    assert CODEC.pairs.ids(word.encode()) == plainly(CODEC.pairs, word.encode())


def test_small_vocabulary_with_stale_entries():
    vocab = {c: i for i, c in enumerate(bpe_codec.byte_characters())}
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "ab"), ("aa", "b"), ("a", "a"), ("abab", "a")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    pairs = bpe_codec.PairQueue(vocab, merges)
    rng = random.Random(3)
    for _ in range(500):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(20)))
        assert pairs.ids(word) == plainly(pairs, word)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text_as_the_library(texts):
    assert ids_of(texts) == library(texts)


def test_texts_as_the_library(documents):
    texts = mixed_texts() + [r["text"] for r in documents.limit(80).collect()] + ["x" * 30_000, "ab" * 9_000 + " c", "é" * 5_000, " " * 5_000]
    want = library(texts)
    for _ in range(2):  # the second time from the caches
        assert ids_of(texts) == want
    assert [CODEC.decode(ids).decode() for ids in want] == [CODEC.tokenizer.decode(ids, skip_special_tokens=False) for ids in want]
    assert [CODEC.decode(ids).decode() for ids in want] == texts


def test_every_character_is_cut_as_the_library_cuts_it():
    texts = [f"a{c}1{c} {c}.{c}\n{c}'{c} {c} b" for c in map(chr, [*range(0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3040), 0x558, 0x88F, 0x1F600])]
    assert ids_of(texts) == library(texts)


def test_ids_that_are_no_text_decode_with_replacements():
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(256) for _ in range(rng.randrange(9))]
        assert CODEC.decode(ids).decode() == CODEC.tokenizer.decode(ids, skip_special_tokens=False)


def test_generations_of_caches_change_nothing(documents, monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.cached_words.PARTS", 50)
    monkeypatch.setattr("ledgerlens.llm.cached_words.WORDS", 50)
    codec = bpe_codec.Codec(vocabulary("byte_bpe_50k.json")())
    texts = [r["text"] for r in documents.limit(40).collect()]
    for _ in range(3):
        assert [np.frombuffer(b, codec.kind).tolist() for t in texts for b in codec.encode([t])] == library(texts)


def test_odd_rows(odd_docs, no_docs):
    path = vocabulary("byte_bpe_50k.json")
    out = bpe_codec.digests(odd_docs, path).collect()
    full = bpe_codec.encoded(odd_docs, path).collect()
    rows = odd_docs.collect()
    want = [(r["doc_id"], ids, r["text"] or "") for r, ids in zip(rows, library([r["text"] or "" for r in rows]), strict=True)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((d, len(ids), digest(",".join(map(str, ids))), digest(t))) for d, ids, t in want)
    assert sorted(repr(tuple(r)) for r in full) == sorted(repr(x) for x in want)
    assert bpe_codec.digests(no_docs, path).count() == 0


def test_query(spark, sf, documents):
    got = {tuple(r) for r in QUERIES["op13_bpe_codec"](spark, sf).collect()}
    rows = documents.select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(r["text"] or "")) for r, ids in
                   zip(rows, library([r["text"] or "" for r in rows]), strict=True)}
