import zlib

import numpy as np
from pyspark.sql import functions as F

from autoprep.llm.language import Network, _padded, identify, predict, train


def test_gradients_match_finite_differences():
    net = Network.fresh(["a", "b", "c"], hidden=4, kind=np.float64)
    data = np.frombuffer(b"abc de fghi ", np.uint8)
    x, inside = _padded(data, np.array([0, 4, 7]), np.array([3, 6, 11]))
    label = np.array([0, 1, 2])
    _, grads = net.loss_and_gradients(x, inside, label)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name.startswith("in_"):
                at = (int(x[inside][rng.integers(inside.sum())]), at[1])
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up, _ = net.loss_and_gradients(x, inside, label)
            w[at] = old - eps
            down, _ = net.loss_and_gradients(x, inside, label)
            w[at] = old
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-6, (name, at)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_cases(spark, data):
    learn = spark.read.parquet(f"{data}/documents.parquet")
    net = train(learn, F.lit(True))
    text = learn.where("lang = 'de'").first().text
    rows = [(1, None), (2, ""), (3, " 12 !? "), (4, text), (4, text), (None, text), (5, "ä" * 5000 + " " + text * 30), (6, "x")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, score string")
    out = predict(docs, net, F.lit(False)).collect()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows) and [by_id[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by_id[4][0] == by_id[None][0] == "de" and by_id[6][0] in net.languages
    assert set(net.label_bytes(text)) <= {*net.languages, None} and len(net.label_bytes(text)) == len(text.lower().encode())
    assert identify(learn.limit(0)).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in identify(unlabelled).collect()] == ["und"]
