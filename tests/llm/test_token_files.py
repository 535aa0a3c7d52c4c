import gc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import token_files as tf
from lexispark.llm.shared import new_folder

SCHEMA = "doc_id long, text string, file string, start string"


@given(st.lists(st.integers(0, 2**62), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values.sort()
    ef = tf.EliasFano.encode(np.array(values, np.uint64))
    back = tf.EliasFano(ef.n, ef.low_bits, *ef.parts())
    assert back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    for first in range(0, len(values), 97):
        for stop in {first + 1, min(len(values), first + 256), len(values)}:
            assert back.slice(first, stop).tolist() == values[first:stop]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_encoder_equals_whole_texts():
    encoder = tf.Encoder(tf.default_tokenizer())
    texts = ["", " ", "The the, THE. it's don't 'tis a1b2 ... ?! x.y,z", "Straße ÉTÉ İstanbul ΑΣ ς naïve é ́x \x1c\x85\xa0  y", "<|endoftext|> a<|startoftext|>b", "日本語 テスト, 한국어.", "a\tb\r\nc\n\nd", "emoji 😀😀, 👩‍👩‍👧."]
    texts.append(" ".join(f"wort{i} anou{chr(97 + i % 26)}ble, Foo." for i in range(3000)))
    whole = [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(encoder.encode(text), encoder.dtype).tolist() for text in texts] == whole
    for fresh in (encoder, tf.Encoder(tf.default_tokenizer())):
        assert [np.frombuffer(ids, fresh.dtype).tolist() for ids in fresh.encode_all(texts)] == whole


def test_long_text_in_stretches(monkeypatch):
    """Stretches end at spaces, and a cache that is too small forgets without harm."""
    monkeypatch.setattr(tf, "STRETCH", 50)
    monkeypatch.setattr(tf, "CACHED_WORDS", 40)
    test_encoder_equals_whole_texts()


@given(st.lists(st.text(alphabet="aBzÉßıİ'!.,;_-&@09 \n\t", max_size=40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_encoder_on_any_texts(texts):
    encoder = tf.encoder_of(tf.default_tokenizer())
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode_all(texts)] == [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_round_trip_and_cases(spark):
    rows = [(5, "five five", "x", "y"), (None, "no id", "x", None), (3, None, None, "y"), (3, "b", "", ""), (3, "a", "", ""), (3, "a", "", ""), (-(2**63), "low", "", ""), (2**63 - 1, "high", "", ""), (7, "word " * 30000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = new_folder(spark, "t")
    manifest = tf.write_token_shards(df, folder, tf.default_tokenizer(), shard_bytes=40)
    got = [tuple(r)[:4] for r in tf.read_token_shards(spark, manifest).orderBy("start").collect()]
    encoder, start, expected = tf.Encoder(tf.default_tokenizer()), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    shards = [tf.Shard(file) for file, _, _ in manifest]
    assert [i for shard in shards for i in shard.doc_ids(0, len(shard))] == [row[0] for row in expected]
    shard = shards[0]
    assert [shard.ids(i).tolist()[-1] for i in range(len(shard))] == [1] * len(shard)
    assert tf.read_token_shards(spark, tf.write_token_shards(df.limit(0), folder + "e", tf.default_tokenizer())).count() == 0


def test_caches_of_any_size_give_the_same_ids():
    """Also where words move between the halves all the time; cycles are looked for again behind a group."""
    path = tf.default_tokenizer()
    texts = [" ".join(f"wo{i % 50}rd, Ab{i}. anou{i % 7}" for i in range(n)) for n in (0, 1, 300, 2000)] * 3
    small, large = tf.encoder_of(path, 10), tf.encoder_of(path, 10**6)
    assert small is not large and tf.encoder_of(path, 10) is small
    assert small.encode_all(texts) == large.encode_all(texts) == [large.encode(t) for t in texts]
    for text in texts:
        assert small.encode(text) == np.array(small.tokenizer.encode(text, add_special_tokens=False).ids, small.dtype).tobytes()
    assert gc.isenabled()
