import math

import numpy as np
import pytest

from autoprep.llm import decontaminate as d
from autoprep.llm import mixing
from autoprep.llm.resample import count_models, label_sample, log_weights, resampled


def plain_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(1, 7, rng.integers(0, 40)), rng.integers(1, 7, rng.integers(0, 70))
        assert d.subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


def test_every_benchmark_text_in_a_document_is_found(spark, data):
    docs, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in benchmark.collect()}
    want = {(i, k) for i, t in texts.items() for k, q in items.items() if q in t}
    found = d.leaks(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert want and len(want & got) >= 0.95 * len(want)
    for r in found:
        assert plain_subsequence(items[r.item_id].lower().split(), texts[r.doc_id].lower().split()) >= 0.6 * len(items[r.item_id].split())
    assert len({i for i, _ in got - want}) <= 0.02 * len(texts)


def test_paraphrases_answers_and_edge_cases(rows):
    rng = np.random.default_rng(3)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    item, other = words(40), words(40)
    loose = [w for i, w in enumerate(item[:-4]) if i % 4] + item[-4:]
    unanswered = [w for i, w in enumerate(item) if i % 4] + ["no"]
    docs = [
        (1, " ".join([*words(30), *item, *words(25)])), (2, "; ".join([*words(70), *loose, *words(9)]).upper()), (3, " ".join(unanswered[:-5] + words(40))),
        (4, " ".join(words(300))), (5, None), (6, ""), (7, " ".join([*words(31), *other])), (7, " ".join([*words(31), *other])), (None, " ".join(item)),
    ]
    schema = "doc_id bigint, text string, item_id string"
    bench = rows([(1, " ".join(item), 0), (2, " ".join(other), 0), (2, " ".join(other), 0), (3, None, 0), (4, "", 0), (5, "t1 t2", 0)], "item_id bigint, text string, doc_id int")
    out = d.leaks(rows([(i, t, "x") for i, t in docs], schema), bench).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in out} == {(1, 1, "copy"), (2, 1, "paraphrase"), (7, 2, "copy")}
    assert d.leaks(rows([], schema), bench).collect() == []
    assert d.leaks(rows([(1, "a", "x")], schema), bench.limit(0)).collect() == []


def source_rows(sizes):
    return [(f"{s}{i}", s, "w " * (3 + i % 5)) for s, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("entropy, repeats", [(0.95, 4.0), (0.99, 2.0), (1.0, 100.0)])
def test_exponent_meets_its_targets(rows, entropy, repeats):
    tokens = np.array([1000.0, 300, 200, 50])
    a = mixing.mixing_exponent(rows([(float(t),) for t in tokens], "tokens double"), entropy, repeats)

    def fits(a):
        w = (tokens / tokens.sum()) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum() <= entropy * math.log(4) + 1e-12 and (tokens.max() / tokens.min()) ** (1 - a) <= repeats * (1 + 1e-12)

    assert fits(a + 1e-9) and (a < 1e-9 or not fits(a - 1e-6))


def test_mixture_fills_its_budgets(rows):
    data = source_rows({"big": 900, "mid": 200, "low": 60, None: 40}) + [("e1", "low", None), ("e2", "only", " "), ("low0", "low", "w w w ")]
    out = mixing.mixed(rows([(i, s, t, 5) for i, s, t in data], "doc_id string, source string, text string, epoch int")).collect()
    assert {r.doc_id for r in out} == {i for i, _, _ in data}
    assert all(r.epoch == 0 for r in out if r.n_tokens == 0)
    seen, have = {}, {}
    for r in out:
        seen[r.source] = seen.get(r.source, 0) + r.n_tokens
    for _, s, t in data:
        have[s] = have.get(s, 0) + len((t or "").split())
    weight = {r.source: r.weight for r in out if r.n_tokens}
    assert math.isclose(sum(weight.values()), 1)
    budget = have["big"] / weight["big"]
    for s in weight:
        assert budget * weight[s] - 14 <= seen[s] <= budget * weight[s] + 1, s
        copies = [sum(r.doc_id == i for r in out) for i in {r.doc_id for r in out if r.source == s and r.n_tokens} if i != "low0"]
        assert max(copies) - min(copies) <= 1
    assert mixing.mixed(rows([], "doc_id string, source string, text string")).collect() == []
    assert mixing.mixed(rows([("a", "s", None)], "doc_id string, source string, text string")).count() == 1
    small = mixing.mixed(rows(source_rows({"a": 50}), "doc_id string, source string, text string"), budget=40)
    assert 25 < sum(r.n_tokens for r in small.collect()) <= 40


def test_quality_keeps_good_and_drops_bad(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in resampled(docs, labels).collect()}
    good = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0 or toxic = 1").collect()]
    assert sum(i in kept for i in good) > 0.93 * len(good) and sum(i in kept for i in bad) < 0.3 * len(bad)


def test_weights_leave_the_document_out(rows, spark):
    docs = rows([(i, "a b c a") for i in range(9)] + [(9, "x x y"), (10, None)], "doc_id bigint, text string")
    roles = {i: 1 for i in range(8)}
    out = {r.doc_id: r for r in log_weights(docs, count_models(docs, roles), roles).collect()}
    assert out[9].log_weight == 0 and out[10].log_weight == 0 and out[9].n_grams == 5 and out[8].log_weight == 0
    foul = rows([(i, "foul foul good") for i in range(40)] + [(100 + i, "good good fine") for i in range(40)], "doc_id bigint, text string")
    roles = {100 + i: 1 for i in range(40)}
    out = {r.doc_id: r.log_weight for r in log_weights(foul, count_models(foul, roles), roles).collect()}
    assert out[0] < -300 and out[100] > -50


def test_sampling_edge_cases(rows):
    docs = rows([(1, "a b", 2.0), (1, "a b", 2.0), (2, None, 1.0), (3, "", 0.0), (None, "c", 0.0), (5, "z " * 90_000, 1.0)], "doc_id bigint, text string, log_weight double")
    none = rows([], "doc_id bigint, quality int, toxic int")
    assert resampled(docs, none).count() == 6
    assert resampled(docs, none, keep=0).count() == 0 and 2 <= resampled(docs, none, keep=2).count() <= 3
    assert resampled(docs.limit(0), none).collect() == []
    mixed = label_sample(rows([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert mixed == {1: 3, 3: 3}


def test_gumbel_keys_draw_by_weight(rows):
    docs = rows([(i, "a") for i in range(2000)], "doc_id bigint, text string")
    keys = sorted(r.sample_key for r in resampled(docs, rows([], "doc_id bigint, quality int, toxic int")).collect())
    assert abs(np.mean(keys) - 0.5772) < 0.1 and abs(np.std(keys) - math.pi / 6**0.5) < 0.1
