"""Word BPE against the public library, the defining procedure and a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rippleframe.llm import word_bpe
from rippleframe.llm.word_bpe import encode_documents, op11_word_bpe

SMALL = "/root/testdata/sf0.001"
LETTERS = "aabbccddeehino rstlth'!?.<>|/_-\n\t12½²é àÉΣςİıſﬁ中日🎉\x1c\x85\xa0 "


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.codec("word_bpe_49k.json")


def test_random_texts_encode_as_the_library_does(bpe, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [t + "<|endoftext|>" + t[:5] + "<|startoftext|>" for t in texts[:200]] + ["", " \n", "<|endoftext|>", "<|endoftext|<|endoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [bpe.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_words_follow_the_defining_procedure(bpe):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("thean") for _ in range(rng.randint(1, 12))).encode() for _ in range(2000)})
    trie = word_bpe.PrefixTrie(bpe.merges)
    assert trie.encode_sorted(words) == [bpe.merges.merge(w) for w in words] == [trie.encode_alone(w) for w in words]
    # shared prefixes have one node
    assert len(trie._last) <= 1 + len({w[:d] for w in words for d in range(1, len(w))}) + len(words)


def test_very_long_words_and_forgetting(bpe, library):
    texts = ["ha" * 20_000, "!?" * 3000, "x" * 9000 + " the end", "a b c"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == want
    small = word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), memory=1000)
    for text, ids in zip(texts, want, strict=True):
        assert small.encode(text) == ids
    assert len(small.trie._last) < 40_000


def test_edge_rows(spark, library):
    rows = [(1, None, "x"), (None, "", "y"), (2, " \n\t", None), (3, "Hello there", "z"), (3, "Hello there", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_documents(docs, keep=("doc_id", "ids")).collect()
    assert [r["ids_input"] for r in out] == ["x", "y", None, "z", "z"]
    want = library.encode("Hello there", add_special_tokens=False).ids
    assert [list(r["ids"]) for r in out] == [[], [], [], want, want]
    assert [r["decoded"] for r in out] == ["", "", "", "hello</w> there</w>", "hello</w> there</w>"]
    assert encode_documents(docs.limit(0)).collect() == []


def test_query_matches_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_word_bpe(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"], got[doc_id]["decoded_sha256"]) == want
