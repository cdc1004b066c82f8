import hashlib
import zlib

import duckdb
import numpy as np

from autoprep.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, every=5, most=9):
    """Brute force: every prefix as a tuple of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        giver = c - int(np.fmod(c, every))
        built[c] = tuple(own.get(giver, [])[:h] + mine[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = sorted(c for c in who if len(built[c]) == len(node))
        out.add((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x in under),
            sum(x not in inner for x in under), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def invented(seed, n=90):
    """Conversations with long shared starts, copies, nulls, ties, equal rows and negative ids."""
    rng = np.random.default_rng(seed)
    long = [("u" if i % 2 else None, f"é{i}") for i in range(40)]
    rows = []
    for c in rng.choice(np.arange(-20, 120), n, replace=False).tolist():
        kind = rng.integers(0, 4)
        turns = long[: rng.integers(1, 41)] if kind < 2 else [("u", "ab"[: rng.integers(0, 3)] or None) for _ in range(rng.integers(1, 12))]
        rows += [(c, None if i == 0 and kind == 1 else i // 2 if kind == 3 else i, *t) for i, t in enumerate(turns)]
    return rows + rows[:3] + [(None, 1, "u", "nowhere")]


def test_trie_equals_brute_force(rows):
    for seed in (1, 2):
        data = invented(seed)
        got = [tuple(r) for r in prefixes.prefix_trie(rows(data, SCHEMA)).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_trie(data)


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", invented(3, 40))
    assert {tuple(r) for r in con.execute(prefixes.oracle()).fetchall()} == plain_trie(invented(3, 40))


def test_windows_over_runs_of_blocks(rows, monkeypatch):
    monkeypatch.setattr(prefixes, "RUN", 2)
    data = [(c, i, "u", f"{i}" if i < 100 or c == 5 else f"{c}{i}") for c in (5, 10, 15, 20) for i in range(130)]
    assert {tuple(r) for r in prefixes.prefix_trie(rows(data, SCHEMA)).collect()} == plain_trie(data)


def test_edge_cases(rows, spark):
    assert prefixes.prefix_trie(rows([], SCHEMA)).collect() == []
    assert prefixes.prefix_trie(rows([(None, 0, "a", "b")], SCHEMA)).collect() == []
    data = [(1, 0, "u", "x" * 3_000_000), (2, 0, None, None), (2, 0, None, None), (3, None, None, "")]
    odd = rows([(*r, 1, 2, "z") for r in data], SCHEMA + ", depth int, key int, place string")
    assert {tuple(r) for r in prefixes.prefix_trie(odd).collect()} == plain_trie(data)


def test_digests_of_long_lists(rows, spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 7)
    ends = spark.range(5000).selectExpr("id % 3 as depth", "cast(id % 2 as decimal(38,0)) as key", "id as conv_id")
    got = {(r.depth, int(r.key)): r.sha256 for r in prefixes.digests(ends, ["depth", "key"], "conv_id").collect()}
    for (d, k), digest in got.items():
        ids = [i for i in range(5000) if i % 3 == d and i % 2 == k]
        assert digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert len(got) == 6
