"""Token-id files: exact round trips, damage, and the read-back table."""

import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deficit_engine.llm import token_files as tf
from deficit_engine.llm import units

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 70_000])
@pytest.mark.parametrize("bound", [1, 2, 50, 49408])
def test_round_trip(n, bound):
    ids = np.random.default_rng(n).integers(0, bound, n)
    words, counts = tf.encode_ids(ids, bound)
    assert (tf.decode_ids(words, counts, n, bound) == ids).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400))
def test_any_ids(ids):
    ids = np.array(ids)
    words, counts = tf.encode_ids(ids, 301)
    assert (tf.decode_ids(words, counts, len(ids), 301) == ids).all()


def test_repetition_is_learned():
    ids = np.tile(np.arange(50), 4000)
    words, _ = tf.encode_ids(ids, 50)
    assert words.nbytes * 8 < 2 * len(ids)  # of 5.6 bits an id without a model


def test_damage_is_found():
    block = tf.pack_block(np.array([4]), np.array([False]), np.array([3]), np.array([5, 6, 1]))
    assert [list(x) for x in tf.unpack_block(block)] == [[4], [False], [3], [5, 6, 1]]
    for at in range(len(block)):
        with pytest.raises(ValueError):
            tf.unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])


def test_files_in_id_order(spark, tmp_path):
    texts = ["Hello  World", None, "", "été\n<|endoftext|> x", "a " * 5000, "b", "b", "z"]
    ids = [7, 3, 9, 1, 5, 2, 2, None]
    docs = spark.createDataFrame([(i, t, "p") for i, t in zip(ids, texts)], "doc_id long, text string, payload string")
    tf.write_token_blocks(docs, str(tmp_path / "blocks"), PATH, block_ids=20)
    out = tf.read_token_blocks(spark, str(tmp_path / "blocks")).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    start = 0
    for r, k in zip(out, order, strict=True):
        want = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (ids[k], start, len(want))
        assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_token_blocks(docs, str(tmp_path / "blocks"), PATH)
    assert tf.read_token_blocks(spark, str(tmp_path / "blocks")).count() == 0


def library_ids(texts):
    library = Tokenizer.from_file(PATH)
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthesAÉé'sldrevm.,!$#<|>07²½ \t\n\x85\xa0\xad\x1c\u0130ǅ\u0301ñ漢🙂"), max_size=30), min_size=1, max_size=6))
def test_units_as_the_library(texts):
    assert split(*ENCODER.encode(texts)) == library_ids(texts)


ENCODER = tf.WordEncoder(PATH)


def test_pieces_of_every_plain_sign():
    """Each character that is told apart here is cut as the library cuts it."""
    signs = [c for c in map(chr, range(33, 0x250)) if tf._KINDS[ord(c)] > 1]
    texts = [x for c in signs for x in (f"a{c}b", f"{c}{c}", f"7{c}.", c.upper(), unicodedata.normalize("NFD", c))]
    assert split(*ENCODER.encode(texts)) == library_ids(texts)


def test_full_cache_keeps_used_units(monkeypatch):
    """Frequent words are not encoded anew each time that rare ones have filled the cache."""
    monkeypatch.setattr(units, "CACHE_UNITS", 200)
    encoder, seen, whole = tf.WordEncoder(PATH), [], tf.WordEncoder.encode_new
    monkeypatch.setattr(tf.WordEncoder, "encode_new", lambda self, new: seen.extend(new) or whole(self, new))
    texts = ["the cat and the dog, the cat. " + " ".join(f"r{k}x{j}" for j in range(60)) for k in range(30)]
    for text in texts:
        assert split(*encoder.encode([text])) == library_ids([text])
    assert seen.count(b"the") == 1
    assert len(encoder.codes) <= 300
