import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from autoprep.llm import simhash
from autoprep.llm.components import components
from autoprep.llm.passages import repeated_spans, without_repeats
from autoprep.llm.simhash import fingerprints, near_links, simhash_groups
from autoprep.llm.vectors import near_vectors


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_random_links_and_a_long_path(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(5000, 5000 + i) for i in range(1, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 7), (9, 9)], "a bigint, b bigint")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert out == smallest_reachable({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_fingerprints_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in fingerprints(docs).collect()}
    assert got == {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}


@pytest.mark.parametrize("listed", [0, 32])
def test_links_equal_brute_force(spark, listed, monkeypatch):
    monkeypatch.setattr(simhash, "LISTED", listed)
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(fps):
        for _ in range(4):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    found = [(r.a, r.b) for r in near_links(spark.createDataFrame([(x,) for x in fps], "fp bigint")).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in found)
    assert smallest_reachable(fps, found) == smallest_reachable(fps, links)


def test_groups_edge_cases(rows, spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    data = [(5, "a b c d"), (3, "A B c d"), (3, "A B c d"), (7, None), (9, " \n"), (8, ""), (1, "one"), (None, "one"), (11, long), (12, long)]
    out = simhash_groups(rows([(i, t, 0) for i, t in data], "doc_id bigint, text string, component_id int")).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(out) == len(data) and got == {5: 3, 3: 3, 7: 7, 9: 7, 8: 7, 1: 1, None: 1, 11: 11, 12: 11}
    assert {r.fp for r in out if r.doc_id in (7, 8, 9)} == {0}
    assert simhash_groups(rows([], "doc_id bigint, text string")).collect() == []


def plain_near_vectors(pairs, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in pairs if v is not None and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.sqrt((ok[i] ** 2).sum()) for i in ids])
    near = x @ x.T >= threshold
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    root = smallest_reachable([i for i, _ in pairs], links)
    count = dict(zip(ids, near.sum(1) - 1))
    return {i: (int(count.get(i, 0)), root[i], root[i] == i) for i, _ in pairs}


@pytest.mark.parametrize("kind, dims, cap", [("float", 64, 16_000), ("float", 64, 20), ("double", 5, 16_000), ("float", 40, 50)])
def test_vectors_equal_brute_force(spark, kind, dims, cap, monkeypatch):
    import autoprep.llm.vectors as v

    monkeypatch.setattr(v, "TILE_ROWS", cap)
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    points = np.concatenate([base, *(base[:20] + rng.normal(size=(20, dims)) * s for s in (0.1, 0.2, 0.3)), base[:3], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, dims)) * 0.05])
    points = points.astype(np.float32 if kind == "float" else float)
    pairs = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    out = near_vectors(spark.createDataFrame(pairs, f"vec_id bigint, embedding array<{kind}>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == plain_near_vectors(pairs)


def test_vectors_edge_cases(rows):
    nan, inf = float("nan"), float("inf")
    data = [(4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (6, [1e200, 0.0]), (7, [0.0, 0.0]), (8, None), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, 0.0, 0.0]), (14, [2.0, 0.0, 0.0]), (15, [1.0] * 5), (16, [1.0] * 4 + [1.1]), (12, [None, 1.0]), (None, [1.0, 0.0]), (13, [])]
    out = near_vectors(rows([(i, e, 1) for i, e in data], "vec_id bigint, embedding array<double>, kept int")).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(data) and got[4] == (3, 2, False) and got[2] == (3, 2, True) and got[6] == (3, 2, False)
    assert got[11] == (1, 11, True) and got[14] == (1, 11, False) and got[15] == (1, 15, True) and got[16] == (1, 15, False)
    assert all(got[i] == (0, i, True) for i in (7, 8, 9, 10, 12, 13)) and got[None] == (0, None, True)
    assert near_vectors(rows([], "vec_id bigint, embedding array<double>")).collect() == []
    assert near_vectors(rows([(1, None)], "vec_id bigint, embedding array<double>")).count() == 1


def windows(text, size=50):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_repeats_are_found_and_the_first_place_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, want = {}, set()
    for i in sorted(texts):
        for w in windows(texts[i]):
            if seen.setdefault(w, i) != i:
                want.add(i)
    spans = repeated_spans(docs).collect()
    assert want and want <= {r.doc_id for r in spans}
    assert all(r.first_doc <= r.doc_id and r.words >= 10 for r in spans)
    left = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    untouched = set(texts) - {r.doc_id for r in spans}
    assert all(left[i] == texts[i] for i in untouched)
    # What repeats 50 words anywhere is gone but for one place.
    after = [w for i in left for w in windows(left[i])]
    assert len(after) == len(set(after)) or len(after) - len(set(after)) < 0.002 * len(after)


def test_near_paragraphs_embedded_passages_and_edge_cases(rows):
    rng = np.random.default_rng(4)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    line, other, passage = words(120), words(80), words(60)
    near = [*line[:118], "changed", "end"]
    data = [
        (1, " ".join(line)), (2, "\n".join([" ".join(other), " ".join(near)])),
        (3, " ".join([*words(33), *passage, *words(21)])), (4, " ".join([*words(50), *passage, *words(9)])),
        (5, " ".join(words(200))), (6, None), (7, ""), (8, " \n\t"), (9, " ".join(other[:6])), (10, "é " * 3 + " ".join(passage)),
    ]
    docs = rows([(i, t, "x", 0) for i, t in data], "doc_id bigint, text string, start string, n_chars bigint")
    spans = {}
    for r in repeated_spans(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop, r.first_doc))
    assert set(spans) == {2, 4, 10}
    assert {s[2] for s in spans[2]} == {1} and {s[2] for s in spans[4] + spans[10]} == {3}
    left = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert set(left) == {i for i, _ in data} and left[5].text == data[4][1] and left[6].text is None
    assert left[2].text.strip() == " ".join(other) and left[2].n_chars == len(left[2].text)
    removed = data[3][1][spans[4][0][0] : spans[4][0][1]].split()
    assert len(removed) >= 30 and set(removed) <= set(passage)
    copies = rows([(1, " ".join(line)), (2, " ".join(line)), (2, " ".join(line)), (None, " ".join(line))], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in without_repeats(copies).collect()) == ["1", "None"]
    assert repeated_spans(rows([], "doc_id bigint, text string")).collect() == []


def test_exact_repeats_of_ten_words_on_are_found_to_the_word(rows, monkeypatch):
    """Short lines and passages inside lines, in one chunk and in many."""
    from autoprep.llm import passages as p

    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    data, want = [], {}
    for k, n in enumerate([9, 10, 11, 12, 13, 15, 17, 19, 20, 25, 30, 40, 50, 60] * 3):
        passage, ahead = words(n), words(7 + k)
        line = k % 3 == 0
        data.append((2 * k, "\n".join([" ".join(words(30)), " ".join(passage), " ".join(words(30))]) if line else " ".join([*words(30), *passage, *words(30)])))
        text = " ".join([*ahead, *passage, *words(8)])
        data.append((2 * k + 1, text.replace(f" {passage[0]}", f"\n{passage[0]}").replace(f"{passage[-1]} ", f"{passage[-1]}\n") if line else text))
        if n >= 10:
            at = len(" ".join(ahead)) + 1
            want[2 * k + 1] = (at, at + len(" ".join(passage)), n, 2 * k)
    data.append((1000, " ".join(["again"] * 50)))
    want[1000] = (60, 299, 40, 1000)
    docs = rows(data, "doc_id bigint, text string")
    for least in (p.CHUNK_LEAST, 1000):
        monkeypatch.setattr(p, "CHUNK_LEAST", least)
        found = repeated_spans(docs).collect()
        assert {r.doc_id: (r.start, r.stop, r.words, r.first_doc) for r in found} == want and len(found) == len(want)


def test_a_run_whose_first_place_goes_with_its_line_stays_elsewhere(rows):
    rng = np.random.default_rng(9)
    line, rest = ([f"u{x}" for x in rng.integers(0, 10**7, n)] for n in (120, 30))
    near = [*line[:108], *rest[:12]]
    docs = rows([(1, " ".join(line)), (2, " ".join(near)), (3, " ".join([*rest[12:], *rest[:12]]))], "doc_id bigint, text string")
    assert [(r.doc_id, r.words) for r in repeated_spans(docs).collect()] == [(2, 120)]


def test_bands_recall(spark):
    """Pairs at the threshold meet in some band nearly always."""
    from autoprep.llm import passages as p

    rng = np.random.default_rng(6)
    data = []
    for k in range(150):
        line = [f"q{x}" for x in rng.integers(0, 10**7, 54)]
        cut = line[:48] + [f"q{x}" for x in rng.integers(0, 10**7, 4)]
        data += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(cut))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    lines = p._mine(docs.withColumn("version", F.lit(0).cast("bigint"))).where("kind = 1").collect()
    bands = {r.doc_id: set(enumerate(r.bands)) for r in lines}
    assert sum(bool(bands[2 * k] & bands[2 * k + 1]) for k in range(150)) >= 147
