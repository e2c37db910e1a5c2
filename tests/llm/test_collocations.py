"""Collocations against a plain count in exact integers."""

import random
import re
from collections import Counter

import pytest

from lodestar.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, max_n, min_count, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_n + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    out = []
    for (lang, ws), a in found.items():
        score, k = min((1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        longer = [b for (x, vs), b in found.items() if x == lang and len(vs) > len(ws) and any(vs[i : i + len(ws)] == ws for i in range(len(vs) - len(ws) + 1))]
        if not any(100 * b >= percent * a for b in longer):
            out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    return [(lang, ranks[lang], *x) for lang, *x in out if not ranks.update([lang]) and ranks[lang] <= top]


def rows(seed, words=12, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "ß", "日本", "A", "a", "-", "x y"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";"]
    out = [("".join(rng.choice(vocabulary[: 1 + int(rng.expovariate(0.2)) % len(vocabulary)] or ["w0"]) + rng.choice(glue) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return out + [(None, "en"), ("", None), (" \t ", "fr"), ("new york city " * 40, "en"), ("new york, city " * 15, "en"), ("a a a a a a a a a a a a a a", "de")] + [("tie one. tie two.", "es")] * 12


@pytest.mark.parametrize("max_n, min_count, percent, top", [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 5, 80, 2000), (5, 2, 100, 40)])
def test_equals_a_plain_count(spark, max_n, min_count, percent, top):
    docs = spark.createDataFrame(rows(max_n), "text string, lang string")
    got = C.collocations(docs, max_n=max_n, min_count=min_count, extension_percent=percent, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(by_force(rows(max_n), max_n, min_count, percent, top))


def test_a_full_filter_and_small_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(rows(9) + [("one two three four. " * 2000 + "five six " * 3000, "en")], "text string, lang string")
    run = lambda: sorted(map(tuple, C.collocations(docs, min_count=4).collect()))
    one = run()
    monkeypatch.setattr(C, "FILTER_BITS", 64)
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "HELD", 300)
    monkeypatch.setattr(C, "PARTS", 3)
    assert run() == one


def test_odd_rows(spark, odd_docs, empty_docs):
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in C.collocations(odd_docs, min_count=3).collect()}
    assert got[("en", "word word word")] == (59_998, 60_000, 59_999, 60_021, 1_000_000 * 59_998**2 // (60_000 * 59_999)) and ("en", "one two three") in got and ("en", "one two") not in got
    assert C.collocations(empty_docs).count() == 0
