import functools
import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids(vocabulary, text):
    data = vocabulary.encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_random_words_equal_the_library(vocabulary, library):
    rnd = random.Random(5)
    for letters in ("ab", "aeinrst", "éçñ漢🙂a ", "'s t\n\t <|endoftext|>"):
        for _ in range(400):
            text = "".join(rnd.choices(letters, k=rnd.randint(0, 120)))
            assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


@functools.cache
def both():
    from tokenizers import Tokenizer

    return bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library_and_comes_back(text):
    vocabulary, library = both()
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(vocabulary.encode(text)).decode() == text


def test_special_strings_runs_and_long_words(vocabulary, library):
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 20_000, " " * 9_000, "ab" * 5_000, "it's we'll'd"):
        assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_broken_sequences_decode_as_the_library_does(vocabulary, library):
    tokens = [vocabulary.tokens[c] for c in "\xe2\x82a\xff\xf0\x9f\x98"]
    assert vocabulary.decode(struct.pack(f"<{len(tokens)}I", *tokens)).decode() == library.decode(tokens, skip_special_tokens=False)


def test_whole_table(spark, docs, library):
    rows = bpe.round_trip(docs, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    for r in rows:
        expected = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(expected)}I", *expected)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_frames(spark, docs):
    back = bpe.decode(bpe.encode(docs, PATH, keep=("doc_id", "lang")), PATH, keep=("doc_id", "lang"))
    got = sorted((str(r.doc_id), r.text) for r in back.collect())
    assert got == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0
