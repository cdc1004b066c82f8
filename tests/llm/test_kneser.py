import math
import re
import zlib
from collections import Counter

import pytest

from autoprep.llm.kneser import _discounts, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower) + ["</s>"]


def brute_force(docs):
    """The model by dictionaries, one text at a time."""
    train = [tokens(t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    kinds = Counter(w for _, w in pairs)
    d = _discounts(*(sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)))
    b = _discounts(*(sum(c == i for c in kinds.values()) for i in (1, 2, 3, 4)))
    cut = lambda c, x: 0 if c < 1 else x[min(c, 3) - 1]
    total, left = Counter(), Counter()
    for (u, _), c in pairs.items():
        total[u] += c
        left[u] += cut(c, d)
    all_kinds, v, n = sum(kinds.values()), len(count), sum(count.values())
    spread = sum(cut(c, b) for c in kinds.values()) / all_kinds / (v + 1)
    out = {}

    def probability(u, w):
        low = (kinds[w] - cut(kinds[w], b)) / all_kinds + spread
        if not total[u]:
            return low
        return (pairs[u, w] - cut(pairs[u, w], d)) / total[u] + left[u] / total[u] * low

    for i, t in docs:
        t = tokens(t)
        out[i] = (
            len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t),
            sum(math.log10(probability(u, w)) for u, w in zip(["<s>", *t[:-1]], t)),
        )
    vocabulary = [*count, "never seen"]
    for u in ("<s>", vocabulary[0], "never seen"):
        assert math.isclose(sum(probability(u, w) for w in vocabulary), 1, rel_tol=1e-9)
    return out


def check(out, want):
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(want)
    for i, (n, known, train, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-5), (i, r, score)


def test_matches_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(score_documents(docs), brute_force([(r.doc_id, r.text) for r in docs.collect()]))


def test_split_contexts_give_the_same_scores(spark, data):
    from autoprep.llm import kneser
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    layout = kneser.train_model(docs, ~held, tokens_per_bucket=2000)
    assert layout.ranges > 10 and layout.hot_parts.max() > 1
    check(kneser.score(docs, layout, held), brute_force([(r.doc_id, r.text) for r in docs.collect()]))


def test_nulls_empty_texts_repeats_and_extra_columns(rows):
    data = [(0, "A b A b c"), (1, None), (2, ""), (3, " \t\n"), (5, "b c"), (8, "x" * 70_000 + " a b"), (9, "zz zz")]
    docs = rows([(i, t, 1) for i, t in data], "doc_id bigint, text string, score int")
    check(score_documents(docs), brute_force(data))
    twice = rows([(4, "a b"), (4, "a b"), (None, "b a")], "doc_id bigint, text string")
    out = score_documents(twice).collect()
    assert len(out) == 3 and len({r.score for r in out if r.doc_id == 4}) == 1


@pytest.mark.parametrize("held_only", [True, False])
def test_empty_table_and_no_training_rows(rows, held_only):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = rows([(held, "a b")] if held_only else [], "doc_id bigint, text string")
    out = score_documents(docs).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in out] == ([(3, 0, 0)] if held_only else [])
