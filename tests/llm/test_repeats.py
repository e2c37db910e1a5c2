"""Repetitive texts cost no pairs of repeats, and copies of a text don't decide whether a language is learnt."""

import random

import numpy as np
import pytest

from lodestar.llm import langid, winnowing


def index(items):
    data = np.frombuffer("".join(items).encode(), np.uint8)
    return winnowing.Index([str(i) for i in range(len(items))], data, np.cumsum([0, *[len(x.encode()) for x in items]]))


def test_many_equal_words_against_an_item_of_equal_words(monkeypatch):
    formed = []
    pairs = winnowing._pairs
    monkeypatch.setattr(winnowing, "_pairs", lambda a, b: formed.append(pairs(a, b)) or formed[-1])
    own = index(["ha " * 1000, "ha " * 12])
    data = np.frombuffer(("ha " * 300_000).encode(), np.uint8)
    start, end, text, item = winnowing.occurrences(own, *winnowing.words_of(data, np.array([0, len(data)])))
    assert sum(len(i) for i, _ in formed) <= 4 and set(zip(text.tolist(), item.tolist(), strict=True)) == {(0, 0), (0, 1)}
    assert start.min() == 0 and end.max() == 300_000


@pytest.mark.parametrize("seed", range(5))
def test_windows_of_few_words(seed):
    rng = random.Random(seed)
    items = [" ".join(rng.choices("ab", k=rng.choice([3, 12, 13, 14, 40]))) for _ in range(6)]
    docs = [" ".join(rng.choices("abc" if i % 2 else "ab", k=rng.randrange(80))) for i in range(8)]
    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, end, text, item = winnowing.occurrences(index(items), *winnowing.words_of(data, offsets))
    hit = set()
    for a, b in zip(start, end, strict=True):
        hit |= set(range(a, b))
    want_hit, want_pairs, base = set(), set(), 0
    for d, doc in enumerate(docs):
        ws = doc.split()
        for k, it in enumerate(items):
            vs = it.split()
            n = min(13, len(vs))
            grams = {tuple(vs[i : i + n]) for i in range(len(vs) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in grams:
                    want_hit |= set(range(base + i, base + i + n))
                    want_pairs.add((d, k))
        base += len(ws)
    assert hit == want_hit and set(zip(text.tolist(), item.tolist(), strict=True)) == want_pairs


@pytest.mark.parametrize("seed", range(3))
def test_copies_of_one_text_keep_their_language(spark, seed):
    rows = [("dies ist ein deutscher satz", "de")] * 300 + [(f"an english sentence number {i} {seed}", "en") for i in range(300)]
    random.Random(seed).shuffle(rows)
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), rows_per_lang=60)
    assert model.langs == ["de", "en"]


def test_languages_are_bounded(spark):
    rows = [(f"text {i}", f"l{i % 40}" if i % 3 else "l0") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_langs=5)
    assert len(model.langs) == 5 and "l0" in model.langs and model.table.shape == (langid.BUCKETS, 5)
