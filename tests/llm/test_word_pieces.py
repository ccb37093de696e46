import json
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termweave.llm import word_pieces as wp

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CODERS = [wp.byte_level_coder(BYTES, special=False), wp.piece_coder(PIECES)]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(BYTES))
TOKENIZER.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


def expected(texts):
    return [[e.ids for e in TOKENIZER.encode_batch([" " + x for x in texts], add_special_tokens=False)], MODEL.encode(texts)]


def got(cache, texts):
    return [[list(x) for x in ids] for ids in cache.encode([" " + x for x in texts])]


TEXTS = st.text(st.sampled_from("ab'st .,\n\t\r\x1c\x00 　é9!😀_▁<0xA>|end "), max_size=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts_in_both_vocabularies(texts):
    assert got(wp.PieceCache(CODERS), texts) == expected(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st  .\n\t\u3000é😀_▁ "), max_size=60), min_size=1, max_size=4), st.integers(1, 12))
def test_slices_give_the_ids_of_whole_texts(texts, size):
    assert all("".join(wp.slices(x, size)) == x for x in texts)
    assert got(wp.PieceCache(CODERS, size=size), texts) == expected(texts)


def test_forgetting_keeps_what_comes_back():
    rng = random.Random(1)
    cache = wp.PieceCache(CODERS, limit=60)
    for turn in range(30):
        texts = [" ".join(rng.choice(["common", "words", f"w{rng.randrange(10**6)}", "x\ny", "<s>", "<|endoftext|>"]) for _ in range(20)) for _ in range(3)]
        assert got(cache, texts) == expected(texts)
        assert len(cache.known) < 60 + 70
    assert cache.hits[cache.known["common"]] > 0
    cache = wp.PieceCache(CODERS, limit=4)  # more come back than may stay
    for _ in range(4):
        texts = ["a b c d e f g"]
        assert got(cache, texts) == expected(texts)


def test_tokens_are_the_bytes_of_the_text():
    text = " Ünïcode 😀\tand\x00 <s> <0x41>\r\n  x"
    for coder in CODERS:
        assert b"".join(coder.tokens[i] for i in coder.encode([text])[0]) == text.encode()


def test_new_words_of_letters_skip_the_general_cutting():
    coder = wp.byte_level_coder("byte_bpe_50k.json")
    words = ["the", "Überraschung", "ñandú", "Straße", "Привет", "ΑΒΓδεζ", "s", "xqzzkjw", "œuvre", "IJƵ"]
    texts = [" " + " ".join(words), *(f" {w}" for w in words)]
    assert coder.words(texts) == coder.encode(texts)
    given, plain = [], coder.encode
    coder.encode = lambda x: given.extend(x) or plain(x)
    mixed = " ".join(["don't", *words, "a1", "it's,", "naïve,\nZeile", "ⅷ", "日本"])
    (ids,) = wp.PieceCache([coder]).encode([mixed])[0]
    assert ids.tolist() == plain([mixed])[0]
    assert not any(w in t.split() for t in given for w in words)


ALONE = [wp.byte_level_coder(BYTES, special=special) for special in (False, True)]
SIGNS = st.text(st.sampled_from("abZé.,;'!$%*)_<|>1▁\u0301 \n"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(SIGNS, min_size=1, max_size=6), st.sampled_from([2, 1000]), st.booleans())
def test_signs_behind_letters_give_the_ids_of_whole_texts(texts, limit, special):
    coder = ALONE[special]
    cache = wp.PieceCache([coder], limit=limit)
    for text in texts * 2:
        assert cache.encode([text])[0][0].tolist() == coder.encode([text])[0]


def test_letters_before_signs_are_encoded_once():
    coder = wp.byte_level_coder(BYTES)
    plain, words, given = coder.encode, coder.words, []
    coder.encode = lambda x: given.extend(x) or plain(x)
    coder.words = lambda x: given.extend(x) or words(x)
    cache = wp.PieceCache([coder])
    for text in (" xqzzkjw, other", " xqzzkjw. xqzzkjw!? xqzzkjw, other***", " xqzzkjw", " a\nZeilig, b\nZeilig. c\nZeilig"):
        assert cache.encode([text])[0][0].tolist() == plain([text])[0]
    assert [sum(t.count(w) for t in given) for w in ("xqzzkjw", "other", "Zeilig")] == [1, 1, 1]


def test_signs_stay_with_letters_where_an_added_token_has_both():
    parts = json.loads(TOKENIZER.to_str())
    assert wp._signs_apart(parts)
    plain = {"lstrip": False, "rstrip": False, "single_word": False}
    for token in ({**plain, "content": "a!"}, {**plain, "content": " !"}, {**plain, "content": "!", "single_word": True}):
        assert not wp._signs_apart({"added_tokens": [token]})
