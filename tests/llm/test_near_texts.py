import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from sparkbags.llm import near_texts, simhash


def _plain(rows):
    """The kept rows by brute force: union of all pairs at Jaccard 0.8 or more."""

    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, top = [sh(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for size in (6, 8, 9, 14, 30, 60, 200, 800):
        for _ in range(12):
            base = [word() for _ in range(size)]
            rows.append(base)
            for edits in (1, max(1, size // 60), max(1, size // 45), size // 10 + 1):
                near = list(base)
                for k in rng.sample(range(size), edits):
                    near[k] = word()
                rows.append(near)
            rows.append([*base, word()])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_leave(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _plain(rows)
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert len(want) < len(rows) and got == want
    # pairs at Jaccard 0.8 are further apart than op4's radius
    a, b = next((x[1], y[1]) for x in rows for y in rows if x[0] < y[0] and 0.8 <= near_texts.jaccard(near_texts.shingles(x[1]), near_texts.shingles(y[1])) < 0.9)
    assert bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") > 3


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text + " x"), (7, text), (7, text), (3, "other words"), (3, "more of other words"), (None, "alone")]
    docs = spark.createDataFrame(rows, T.StructType().add("doc_id", "long").add("text", "string"))
    got = sorted((tuple(r) for r in near_texts.without_copies(docs).collect()), key=str)
    assert got == _plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_texts.without_copies(docs).count() == 0


@pytest.mark.parametrize("split", [0, 1, 4])
def test_balls_of_a_table_meet_once(split):
    """Fingerprints within two bits meet at a variant of both, and each pair counts once."""
    r = random.Random(8)
    base = [r.getrandbits(16) for _ in range(25)]
    x = np.array([b ^ sum(1 << i for i in r.sample(range(16), r.randint(0, 3))) for b in base for _ in range(8)], np.int64)
    met = Counter()
    for part in range(1 << split):
        at, f, v = near_texts.variants(x, part, split, 16)
        assert all(x[i] ^ (1 << b if b >= 0 else 0) == y and y & ((1 << split) - 1) == part for i, b, y in zip(at.tolist(), f.tolist(), v.tolist(), strict=True))
        places = {}
        for k in near_texts._useful(v, f).tolist():
            places.setdefault(int(v[k]), []).append((int(at[k]), int(f[k])))
        for y, rows in places.items():
            for (i, a), (j, b) in combinations(rows, 2):
                low = min(a, b) if min(a, b) >= 0 else max(a, b)
                if a < 0 if a == b else not y >> low & 1:
                    met[min(i, j), max(i, j)] += 1
    assert met == {(i, j): 1 for i, j in combinations(range(len(x)), 2) if int(x[i] ^ x[j]).bit_count() <= 2}


def _group(spark, m):
    """Sets whose fingerprints differ in a fifth of their bits, and those bits."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 64 * near_texts.WORDS, np.uint8) ^ (rng.random((m, 64 * near_texts.WORDS)) < 0.11)
    w = np.packbits(bits, axis=1).view(np.int64)
    words = ", ".join(f"w{i} long" for i in range(near_texts.WORDS))
    rows = [(k, 100, [], *x) for k, x in enumerate(w.tolist())]
    return spark.createDataFrame(rows, f"s long, n long, head array<long>, {words}"), bits.astype(np.int64)


def test_a_group_takes_rows_by_its_sets(spark):
    """Not by the variants at which they meet, which grow faster than the group."""
    where = near_texts.tables(400)
    count, former = {}, {}
    for m in (200, 400):
        nodes, bits = _group(spark, m)
        met = near_texts._meetings(nodes, where, 1).collect()
        assert len(met) == len({(r.t, r.part, r.s) for r in met}) <= 2 * m * len(where)
        x = [bits[:, pos] @ (1 << np.arange(len(pos))) for pos in where]
        assert all(r.x == x[r.t][r.s] for r in met)
        places = [near_texts.variants(y, 0, 0, where.shape[1]) for y in x]
        count[m], former[m] = len(met), sum(len(near_texts._useful(v, f)) for _, f, v in places)
    assert count[400] <= 2.2 * count[200] and former[400] > 2.5 * former[200] and former[400] > 2 * count[400]


def test_a_large_part_takes_turns(monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.integers(0, 1 << 20, (30, 1)) ^ (1 << rng.integers(0, 20, (30, 9)))).ravel()

    def rows():
        out = [list(near_texts._places(x, part, 2, 20)) for part in range(4)]
        return max(map(len, out)), sorted((int(i), int(f), int(v)) for turns in out for turn in turns for i, f, v in zip(*turn, strict=True))

    once = rows()
    monkeypatch.setattr(near_texts, "_PART", 200)
    many = rows()
    assert once[0] == 1 < many[0] and once[1] == many[1] != []


@pytest.mark.parametrize("split", [0, 3])
def test_pairs_of_a_group(spark, split):
    """All near pairs of different components, each once; with few, some of them."""
    m = 300
    where = near_texts.tables(m)
    nodes, bits = _group(spark, m)
    met = near_texts._meetings(nodes, where, split).join(nodes.drop("head"), "s")
    i, j = np.triu_indices(m, 1)
    meets = np.any([(bits[i][:, pos] != bits[j][:, pos]).sum(1) <= near_texts.RADIUS for pos in where], axis=0)
    near = meets & ((bits[i] != bits[j]).sum(1) <= near_texts.radius(near_texts.apart()))
    of = spark.createDataFrame([(k, k % 7) for k in range(140)], "node long, component long")
    c = np.array([k % 7 if k < 140 else k for k in range(m)])
    for links, own in ((None, np.arange(m)), (of, c)):
        want = {(a, b) for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True) if own[a] != own[b]}
        got = [tuple(r) for r in near_texts._pairs(met, links, where, split, some=False).collect()]
        few = [tuple(r) for r in near_texts._pairs(met, links, where, split, some=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert 0 < len(few) < len(got) and set(few) < want


def test_places_of_prefixes(spark):
    """Short sets that share a hash are compared, in any table's parts or none."""
    nodes, _ = _group(spark, 40)
    nodes = nodes.selectExpr("s", "n", "array(s div 2, -5) as head", *(f"0L as w{i}" for i in range(near_texts.WORDS)))
    met = near_texts._meetings(nodes, near_texts.tables(40)[:0].reshape(0, 20), 0).join(nodes.drop("head"), "s")
    got = [tuple(r) for r in near_texts._pairs(met, None, near_texts.tables(40), 0, some=False).collect()]
    assert sorted(got) == list(combinations(range(40), 2))
