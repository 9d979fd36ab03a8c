import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm.common import saved

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, sf))
        if k == 4:
            break
        assert out.columns == COLUMNS
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if k == 0:
            gone = set(before) - set(after)
            assert not any(labels.get(i) == 1 for i in gone) and sum(labels.get(i) == 0 for i in after) <= 1
        elif k == 1:
            for i, r in after.items():
                lines = (before[i]["text"] or "").split("\n")
                assert set((r["text"] or "").split("\n")) <= {*lines, ""}
        elif k == 2:
            want = {i for i, _, c in brute.components([(i, r["text"]) for i, r in before.items()], 5, 80) if i == c}
            assert set(after) == want
        else:
            want = {i: h for i, *_, h in brute.removed_bytes([(i, r["text"]) for i, r in before.items()])}
            same = [brute.sha((r["text"] or "").encode()) == want[i] for i, r in after.items()]
            # a character of which only some bytes go makes a difference
            assert np.mean(same) > 0.8 and all(len((r["text"] or "").encode()) <= len((before[i]["text"] or "").encode()) for i, r in after.items())
        assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
        docs, before = out, after
    packed = out.toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.values())
    assert packed["length"].sum() == total and packed["sequence_id"].nunique() <= -(-total // 1024) * 1.05 + 1
