"""Operator 12 where the sketch has far fewer cells than the corpus has n-grams."""

import random

import numpy as np
import pytest

from egresslake.llm import collocations

LEAST = 30


def texts(n: int) -> list[str]:
    """Frequent words, of which most pairs are rare, and some phrases."""
    rng = random.Random(3)
    every = [f"w{i}" for i in range(400)]
    return [" ".join("new york city hall" if rng.random() < 0.05 else rng.choice(every) for _ in range(60)) + "." for _ in range(n)]


def test_few_rare_pairs_survive_a_crowded_sketch():
    blob = "\n".join(texts(2000)).encode()
    ids, distinct, piece = collocations.words(blob)
    hashes, bits, maps = collocations.word_hashes(distinct, "en"), 13, {}
    plan = collocations.passes_over(len(blob), bits, 4)
    assert [list(r) for r in plan] == [[1, 2], [3, 4]]
    for lengths in plan:
        sketch = np.zeros((2, 1 << bits), dtype=collocations.counters(LEAST))
        for n, h, at in collocations.candidates(ids, hashes, piece, maps, bits, lengths[-1]):
            if n in lengths:
                collocations.add_to(sketch, h[at], bits, LEAST)
        maps |= dict.fromkeys(lengths, np.packbits(sketch >= LEAST, axis=1, bitorder="little"))
    found = {n: (first, times) for n, first, times in collocations.survivors(ids, hashes, piece, maps, bits, 4)}
    for n, (first, times) in found.items():
        words = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if piece[i] == piece[i + n - 1]]
        count = {w: 0 for w in words}
        for w in words:
            count[w] += 1
        got = {tuple(ids[i : i + n]): t for i, t in zip(first, times, strict=True)}
        assert {w: c for w, c in count.items() if c >= LEAST}.items() <= got.items() <= count.items()
        assert n == 1 or len(got) < len(count) / 4


@pytest.mark.parametrize("bits", [14, 12, 10])
def test_same_phrases_by_any_number_of_passes(spark, monkeypatch, bits):
    docs = spark.createDataFrame([(t, ("en", "de", None)[i % 3]) for i, t in enumerate([*texts(900), "x" * 5000 + " Y", None, ""])], "text string, lang string").repartition(3)
    want = sorted(tuple(r) for r in collocations.collocations(docs, least=LEAST).collect())
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "FEWEST_BITS", bits)
    size = sum(len(t) for t in texts(900))
    assert len(collocations.passes_over(size, bits, 4)) == {14: 1, 12: 2, 10: 4}[bits]
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=LEAST).collect()) == want and want


def test_hash_of_a_word_does_not_depend_on_its_chunk():
    _, a, _ = collocations.words(b"one two three")
    _, b, _ = collocations.words(b"zero three. TWO " + b"y" * 3000 + b" one")
    ha, hb = (dict(zip(d.to_pylist(), collocations.word_hashes(d, "en").tolist(), strict=True)) for d in (a, b))
    assert all(ha[w] == hb[w] for w in ha) and len(set(hb.values())) == 5
    assert len(collocations.word_hashes(collocations.words(b" . ")[1], "en")) == 0
