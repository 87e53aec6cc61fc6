"""Texts that are hard on memory or on hashes: monotonous ones, short items, very long words."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest

from rippleframe.llm import decontaminate, near_dedup
from rippleframe.llm._common import flat_bytes
from rippleframe.llm._text import word_hashes


def scanned(texts, items, **setting):
    indexes = decontaminate.ItemIndex.build(items, decontaminate.Q, decontaminate.EDIT_SHARE)
    texts = [decontaminate.normalise(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = set()
    for index in indexes:
        for t, i, first in index.regions(decontaminate._codes("".join(texts)), offsets):
            if decontaminate.align(index.texts[i], texts[t], first, int(index.budget[i])):
                found.add((t, index.ids[i]))
    return found


@pytest.mark.parametrize("pairs", [1 << 20, 50])
@pytest.mark.parametrize("bands", [1 << 22, 20])
def test_regions_in_pieces_are_the_same(monkeypatch, pairs, bands):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    monkeypatch.setattr(decontaminate, "BAND_COUNTS", bands)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(k, word(n)) for k, n in enumerate([9, 11, 16, 27, 38, 60, 200, 5, 4])]
    damaged = {k: t[: len(t) // 2] + "#" * int(decontaminate.EDIT_SHARE * len(decontaminate.normalise(t))) + t[len(t) // 2 :] for k, t in items}
    texts = [word(100) + damaged[k] + word(100) if k % 2 else word(40) + t for k, t in items] + [word(500), "", "ha " * 200]
    got = scanned(texts, [*items, (99, "ha " * 30)])
    assert {(k, k) for k, t in items if len(decontaminate.normalise(t)) >= decontaminate.SHORT_Q} <= got
    assert (len(texts) - 1, 99) in got and not any(t in (len(items), len(items) + 1) and i not in (7, 0) for t, i in got)


def test_monotonous_text_in_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = decontaminate.ItemIndex.build([(1, "ha " * 300), (2, "ho " * 300)], decontaminate.Q, decontaminate.EDIT_SHARE)[0]
    text = ("ha " * 120_000).strip()
    regions = list(index.regions(decontaminate._codes(text), np.array([0, len(text)])))
    assert {i for _, i, _ in regions} == {0} and decontaminate.align(index.texts[0], text, regions[5][2], int(index.budget[0])) is not None
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_very_long_words_have_their_own_hashes(spark):
    pattern = ["a"]
    for _ in range(11):
        pattern.append("".join("b" if c == "a" else "a" for c in pattern[-1]))
        pattern = ["".join(pattern)]
    one = pattern[0][:2048]
    other = "".join("b" if c == "a" else "a" for c in one)
    hashes, bounds = word_hashes(*flat_bytes(pa.array([f"{one} x", f"{other} x", f"{one.upper()} x"])))
    assert hashes[0] != hashes[2] and hashes[0] == hashes[4] and bounds.tolist() == [0, 2, 4, 6]
    docs = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.link_near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
