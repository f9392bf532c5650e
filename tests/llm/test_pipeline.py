"""The pipeline stage by stage against brute force."""

import collections
import re

import corpus_pipeline
import numpy as np
from folio.llm import packing, pii, queries

from .test_contracts import brute_components


def test_stages(spark, data):
    docs, at = spark.read.parquet(f"{data}/documents.parquet"), {}
    columns = docs.columns
    rows = lambda df: [tuple(r) for r in df.collect()]
    before = rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(before, docs.schema) if k else docs
        after = rows(stage(spark, docs, data))
        if name == "quality_rules":
            ok = {r["doc_id"] for r in queries.op4_quality_rules(spark, data).collect() if r["kept"]}
            assert sorted(after) == sorted(r for r in before if r[0] in ok)
        elif name == "ngram_jaccard_join":
            first = {int(d) for d, _, c in brute_components([r[:2] for r in before]) if d == c}
            assert sorted(after) == sorted(r for r in before if r[0] in first)
        elif name == "pii":
            want = [(r[0], pii.replace(r[1], queries.pseudonym_key())[0], *r[2:4]) for r in before]
            assert sorted(r[:4] for r in after) == sorted(want) and all(r[4] == len(r[1]) for r in after)
        elif name == "mixing":
            times, size = collections.Counter(after), lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
            assert set(times) <= set(before) and max(times.values()) <= 2
            total = sum(size(r[1]) for r in before)
            assert abs(sum(size(r[1]) for r in after) - 1.5 * total) <= 20 * max(size(r[1]) for r in before)
        else:
            tok = packing.WordTokenizer(queries.tokenizer_path())
            want = collections.Counter()
            for r in before:
                n = len(np.frombuffer(tok.ids(r[1]), "<u4")) + 1
                want.update((r[0], i // packing.CAPACITY, min(packing.CAPACITY, n - i)) for i in range(0, n, packing.CAPACITY))
            assert collections.Counter((r[0], r[1], r[3]) for r in after) == want
            fill = collections.defaultdict(list)
            for r in after:
                fill[r[5]].append((r[6], r[3]))
            for parts in fill.values():
                end = 0
                for o, n in sorted(parts):
                    assert o == end
                    end += n
                assert end <= packing.CAPACITY
        if k < len(corpus_pipeline.STAGES) - 1:
            assert len(after) > 0 and len(after[0]) == len(columns)
        before, at[name] = after, len(after)
    assert at["quality_rules"] > at["ngram_jaccard_join"] == at["pii"]
