"""BPE against the tokenizers library, text by text."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deficit_engine.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = ["", None, "a", " a", "  a b", "a\n\nb \n c<|endoftext|> d", "<|endoftext|>", "x <|endoftext|><|endoftext|> ",
         "a" * 3000, "don't I'll  \t foo bar", "123 4567 ½ x²", "é è ñ 漢字 🙂🙂", "a\x1cb \x1fc", "\x85a b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    enc = bpe.Encoder(PATH)
    ids, counts = enc.encode([t or "" for t in texts])
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(ids[a:b]) == want, t
        assert enc.table.decode(ids[a:b]).tobytes().decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_cases(library):
    same(library, CASES)


@pytest.mark.parametrize("alphabet", ["abthe  \n\t'sl.,!éñ漢🙂0123<|>", "abcdeinstr", "ét aeuxion 　 "])
def test_random_texts(library, alphabet):
    draw = random.Random(3)
    same(library, ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(1500)])


def test_query_columns_and_edge_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(0, "twice", "x"), (0, "twice", "x"), (None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_and_decode(docs, PATH).collect()
    assert len(out) == len(rows)
    texts = sorted((r["decoded"] for r in out))
    assert texts == sorted(t or "" for _, t, _ in rows)
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["n_tokens"] and list(ids) == library.encode(r["decoded"], add_special_tokens=False).ids
    back = bpe.decode(bpe.encode_and_decode(docs, PATH), PATH).collect()
    assert sorted(r["decoded"] for r in back) == texts


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_decode(docs, PATH).count() == 0
