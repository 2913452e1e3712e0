"""The pipeline against its stages done by hand, and the registry."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from deficit_engine.llm import mixing, oracle, queries
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registry():
    names = entry.queries()
    assert [n for n in queries.REGISTRY if n not in names] == []
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert set(oracle.ORACLE) <= set(names) and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF_SMALL).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in seen[1:5]:
        assert df.columns == COLUMNS
    rows = [{r["doc_id"]: r for r in df.collect()} for df in seen[:4]]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) > 0.95 * len(rows[0])
    # exact dedup: the largest id of each text
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    last = {}
    for i, r in rows[1].items():
        last[low(r["text"])] = max(i, last.get(low(r["text"]), -1))
    assert set(rows[2]) == set(last.values())
    # near copies: the least id of each component
    assert set(rows[3]) == {c for _, _, c in brute([(i, r["text"]) for i, r in rows[2].items()], 5, 80)}
    # the mix
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect() if r["copies"]}
    counts = {r["doc_id"]: r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert counts == copies
    # ids
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = seen[5].collect()
    assert len(out) == sum(copies.values())
    for r in out[:40]:
        t = rows[3][r["doc_id"]]["text"] or ""
        assert list(np.frombuffer(bytes(r["ids"]), "<u4")) == library.encode(t, add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    both = lambda df: sorted((r["doc_id"], bytes(r["ids"])) for r in df.collect())
    assert both(corpus_pipeline.run(spark, SF_SMALL)) == both(seen[5])
