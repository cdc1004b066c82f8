import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprep.llm import suffixes

LENGTH = 100


def plain_rows(rows):
    """Brute force: every string of 100 bytes by itself; rows of one id are told apart by their hash."""
    seen, out = set(), {}
    for doc, version, text in sorted({r for r in rows if r[0] is not None}):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - LENGTH + 1):
            part = data[a : a + LENGTH]
            if part in seen:
                gone[a : a + LENGTH] = True
            seen.add(part)
        out[doc, version, text] = gone
    result = []
    for doc, version, text in rows:
        data = (text or "").encode()
        gone = out.get((doc, version, text), np.zeros(len(data), bool))
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        result.append((doc, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(result, key=str)


def found(df):
    docs = [tuple(r) for r in suffixes._texts(df).collect()]
    return sorted((tuple(r) for r in suffixes.without_repeated_bytes(df).collect()), key=str), plain_rows(docs)


def invented(seed, n=60):
    """Texts of shared passages, lines just below and above the bound, runs of one byte and periodic parts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcé ") , rng.integers(2, 9)))
    passages = [" ".join(word() for _ in range(rng.integers(8, 60))) for _ in range(8)]
    lines = ["".join(rng.choice(list("xyz"), k)) for k in (60, 98, 99, 100, 101, 130)]
    texts = []
    for _ in range(n):
        parts = [word() for _ in range(rng.integers(0, 30))]
        parts += [passages[i] for i in rng.integers(0, 8, rng.integers(0, 3))] + [lines[i] for i in rng.integers(0, 6, rng.integers(0, 4))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    return texts + ["a" * 700, "b" + "a" * 400, "ab" * 300, texts[0], texts[0] + "x", "abc" * 50 + texts[1]]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for k in range(200):
        text = np.append(rng.integers(1, 2 + k % 7, rng.integers(1, 150)), 0).astype(np.uint8)
        if k % 3 == 0:
            text = np.append(np.tile(text[:5][text[:5] > 0], 20), 0).astype(np.uint8)
        whole, wanted = text.tobytes(), rng.random(len(text)) < (1 if k % 2 else 0.3)
        order = suffixes.suffix_array(text, 24, wanted)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        parts = [whole[i : i + 24] for i in order]
        assert parts == sorted(parts)
        for a, b, n in zip(parts, parts[1:], suffixes.common_prefixes(text, order, 24)):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_equal_strings_have_equal_seeds():
    rng = np.random.default_rng(1)
    one = bytes(rng.integers(97, 100, 300).astype(np.uint8))
    data = np.frombuffer(one + b"\0" + one[50:250] + b"\0", np.uint8)
    _, at, low, high = suffixes.seeds(data, np.array([0, 301, 502]))
    strings = {a: [] for a in (0, 1)}
    for a, x, y in zip(at, low, high):
        strings[int(a > 300)] += [(s, a - s) for s in range(x, y - LENGTH + 1)]
    assert sorted(s for s, _ in strings[0]) == list(range(201))  # every string has one seed
    assert sorted((s - 301 + 50, k) for s, k in strings[1]) == sorted((s, k) for s, k in strings[0] if 50 <= s <= 150)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(rows, seed):
    texts = invented(seed)
    got, want = found(rows([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5))
    assert got == want and sum(r[2] for r in got) > 1000


def test_small_slices_crowds_and_parts(rows, monkeypatch):
    # Module constants reach the tasks with the functions that close over them only as globals of the module: patch and inline.
    monkeypatch.setattr(suffixes, "CROWD", 2)
    got, want = found(rows([(i, t) for i, t in enumerate(invented(3))], "doc_id bigint, text string").repartition(3))
    assert got == want


def test_long_texts_come_in_overlapping_parts():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdef é"), 5000))
    old, suffixes.SLICE = suffixes.SLICE, 700
    try:
        parts = [(o, p) for w, os, ps in suffixes._slices([text, "", "short"]) for o, p in zip(os.tolist(), ps) if p and p != b"short"]
    finally:
        suffixes.SLICE = old
    data = text.encode()
    assert all(data[o : o + len(p)] == p for o, p in parts)
    assert {i for o, p in parts for i in range(o, o + len(p) - LENGTH + 1)} == set(range(len(data) - LENGTH + 1))


def test_edge_cases(rows, spark):
    schema = "doc_id bigint, text string, seed int, start string, bytes int"
    assert suffixes.without_repeated_bytes(rows([], schema)).collect() == []
    long = "".join(f"w{i * i} " for i in range(400_000))
    same = "the same hundred bytes " * 9
    data = [(1, None), (2, ""), (3, long), (4, long[1000:90_000]), (5, same), (5, same), (5, same + "other"), (None, same), (9, "é" * 49), (8, "é" * 49), (10, "é" * 50), (11, "é" * 50)]
    got, want = found(rows([(*r, 1, "s", 2) for r in data], schema))
    assert got == want
    assert [r[2] for r in got if r[0] is None] == [0] and [r[2] for r in got if r[0] in (8, 9)] == [0, 0]


def test_sql_equals_brute_force(spark):
    texts = invented(5, 30)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("x", F.lit(1))
    assert sorted((tuple(r) for r in con.execute(suffixes.oracle()).fetchall()), key=str) == found(df)[1]
