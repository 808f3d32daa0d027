import re
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import simhash_near_dedup, token_files, toxicity_grammar
from ledgerlens.llm.queries import vocabulary
from tests.llm.test_decontamination import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_operator_has_its_query():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]


def test_stages_against_plain_readings(spark, sf, documents, labels, tmp_path):
    docs, kept = documents, [documents.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == documents.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    raw, clean, single, untouched, mixed, tokens = kept

    scores = {r["doc_id"]: r["score"] for r in toxicity_grammar.toxicity_scores(documents, labels).collect()}
    assert sorted(clean) == sorted(r for r in raw if scores[r["doc_id"]] < 0.7)

    shingle_sets = {}
    for r in clean:
        w = r["text"].lower().split()
        shingle_sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    left = {r["doc_id"] for r in single}
    for i, a in shingle_sets.items():
        alike = [j for j, b in shingle_sets.items() if j < i and len(a & b) >= 0.9 * len(a | b)]
        assert not alike or i not in left  # a copy of an earlier text goes
        if i not in left:  # and nothing goes without a similar one
            assert max(len(a & b) / len(a | b) for j, b in shingle_sets.items() if j != i) > 0.5
    assert all(r in clean for r in single)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, _ in brute([(r["doc_id"], r["text"]) for r in single], items)}
    assert sorted(untouched) == sorted(r for r in single if r["doc_id"] not in hit) and hit

    words = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
    sources = {r["source"] for r in untouched}
    assert abs(words(mixed) - words(untouched)) <= len(sources)
    own = {r["doc_id"]: r["text"] for r in untouched}
    assert all(own[r["doc_id"]].startswith(r["text"]) for r in mixed)

    tokenizer = token_files.LibraryWords(vocabulary("byte_bpe_50k.json")()).tokenizer
    want = sorted((r["doc_id"], len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
                  for r in mixed for ids in [tokenizer.encode(r["text"], add_special_tokens=False).ids])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == want
    order = sorted(tokens, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in mixed)
    assert simhash_near_dedup.RADIUS == 4


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert k == 4 or out.columns == docs.columns
            assert out.count() >= 0
