import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from termweave.llm import token_store as ts

VOCABULARY = "byte_bpe_50k.json"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 50))
def test_block_round_trip(values, lanes):
    ids = np.asarray(values)
    symbols, slots, counts = np.unique(ids, return_inverse=True, return_counts=True)
    f = ts.scaled_frequencies(counts)
    assert int(f.sum()) == 1 << ts.PRECISION and f.min() >= 1
    start = np.cumsum(f) - f
    data = ts.encode_block(slots, f, start, lanes)
    slot_of = np.repeat(np.arange(len(f), dtype=np.int32), f.astype(np.int64))
    assert (symbols[ts.decode_block(data, len(ids), f, start, slot_of, lanes)] == ids).all()


def test_blocks_decode_alone_and_damage_is_found():
    ids = np.random.default_rng(1).zipf(1.3, 3 * ts.BLOCK + 17) % 50_000
    table, blocks, payload = ts.encode_chapter(ids)
    assert len(payload) < 2 * len(ids)
    assert (ts.decode_chapter(table, blocks, payload) == ids).all()
    assert (ts.decode_chapter(table, blocks, payload, range(2, 3)) == ids[2 * ts.BLOCK : 3 * ts.BLOCK]).all()
    broken = bytearray(payload)
    broken[9000] ^= 1
    with pytest.raises(ValueError):
        ts.decode_chapter(table, blocks, bytes(broken))


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st .,\n\t\r\x1c 　é9!😀_"), max_size=25), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert [list(x) for x in ts.byte_level(VOCABULARY)(texts)] == expected(texts)


def test_special_strings():
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>c", "a  <|endoftext|>\n\n", "'s it's 'll", " \n a"]
    assert [list(x) for x in ts.byte_level(VOCABULARY)(texts)] == expected(texts)


def test_write_and_read(spark, tmp_path):
    rows = [(i * 7 % 101, f"word{i} of text, line\nAnother {i}" * (i % 5), i) for i in range(101)]
    rows += [(None, None, 1), (500, "", 2), (500, "x", 3), (501, "long " * 30_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    path = str(tmp_path / "tokens")
    ts.write_tokens(docs.withColumn("ids", F.lit(1)), path, VOCABULARY, 2)
    got = sorted(ts.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc, _, _), ids in zip(got, want, expected([w[1] or "" for w in want])):
        data = np.asarray([*ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc, start, len(ids) + 1, zlib.crc32(data))
        start += len(ids) + 1
    assert len(got) == len(rows)
    ts.write_tokens(docs.limit(0), path + "0", VOCABULARY, 2)
    assert ts.read_tokens(spark, path + "0").count() == 0
