"""The pipeline against the composition of the brute-force versions."""

import hashlib
import importlib.util
import os
import sys

import public_tokenizers as vocabularies
import tiktoken

from pairwell.llm import bpe_tree, private_data, quality, runtime

SF = "/root/testdata/sf0.01"
sys.path.insert(0, os.path.dirname(__file__))


def other(name):
    spec = importlib.util.spec_from_file_location(f"_{name}", os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_composition(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    docs = runtime.table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in kept]
    assert 0 < len(rows) < docs.count()
    least = {d for d, n, c in other("test_near_duplicates").brute(rows) if d == c or not n}
    rows = [r for r in rows if r[0] in least]
    items = [tuple(r) for r in runtime.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    check = other("test_decontaminate").brute
    clean = [r for r in rows if not check(r[1], items)[3]]
    assert len(clean) < len(rows)
    library = tiktoken.Encoding("x", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe_tree.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for doc_id, text in clean:
        ids = library.encode_ordinary(private_data.masked(text))
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids)
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.ids) for r in found} == want and len(found) == len(want)
