import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from autoprep.llm import collocations

SCHEMA = "lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=2000):
    """Brute force over tuples of words."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= 30 and len(p) > 1}
        kept = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def invented(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "é", "ß", "x1", "\x1c", " y", "a-b", *(f"w{i}" for i in range(25))]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words, p=share / share.sum()) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n"], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]) for _ in range(rng.integers(0, 60)))
        rows.append((rng.choice(["en", "de", None]), text + "new york city " * int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(rows, seed):
    data = [(None if lang is None else str(lang), text) for lang, text in invented(seed)]
    got = sorted(tuple(r) for r in collocations.collocations(rows(data, SCHEMA)).collect())
    assert got == plain(data) and len(got) > 30


def test_ranks_stop_and_slices_are_small(rows, monkeypatch):
    data = [(None if lang is None else str(lang), text) for lang, text in invented(3)]
    for name, value in (("HELD", 500), ("PARTS", 3), ("FEWEST", 12), ("BLOCK", 1 << 10)):
        monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.collocations(rows(data, SCHEMA).repartition(7), 10).collect())
    assert got == plain(data, 10)


def test_edge_cases(rows):
    schema = "lang string, text string, rank int, phrase int, words string, f int"
    assert collocations.collocations(rows([], schema)).collect() == []
    assert collocations.collocations(rows([(None, None, 1, 2, "", 3), ("en", "", 1, 2, "", 3)], schema)).collect() == []
    long = "to be or not " * 200_000 + ". " + "a" * 1_000_000
    data = [("en", long), ("en", "Same Words here " * 31), ("en", "Same Words here " * 31), (None, "b b " * 40)]
    got = sorted(tuple(r) for r in collocations.collocations(rows([(*r, 1, 2, "z", 3) for r in data], schema)).collect())
    assert got == plain(data)


def test_scores_beyond_64_bits(spark):
    big = 2**62
    r = spark.sql(f"select {collocations.SCORE} as s from values ({big}, {big}, {big + 5}) as t(a, l, r)").first()
    assert r.s == 2000000 * big // (2 * big + 5)
