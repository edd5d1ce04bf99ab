"""Operators on texts against plain versions on small tables with nulls, empty and long
texts, repeated rows, ties and further columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from sparkbags.llm import bpe_replay, decontaminate, langid, quality, queries, simhash, suffix_dedup, token_file

RANKS = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "aa", "the", " the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "1", "²", "'s", "!", "中", "🙂", "́", "<|endoftext|>", "_", "ʰ", "　"]


def texts(n, seed, pieces=PIECES, most=40):
    r = random.Random(seed)
    out = [None, "", " \n ", "x" * 5000, "a" * 3000 + " b"]
    return (out + ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)])[:n] + ["same text here", "same text here"]


def table(spark, rows, extra="k string, t int, z string"):
    return spark.createDataFrame([(i * 3 - 5, x, "p", 1, "q") for i, x in enumerate(rows)], f"doc_id long, text string, {extra}")


def by_key(df):
    rows = df.collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


@pytest.fixture(params=["many", "nulls", "none"])
def docs(request, spark):
    rows = {"many": texts(150, 1), "nulls": [None, ""], "none": []}[request.param]
    return table(spark, rows)


def test_bpe_equals_the_library(docs):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_replay.load_ranks(RANKS), special_tokens={})
    got = by_key(bpe_replay.encode(docs, RANKS, PATTERN, ids=True))
    for r in docs.collect():
        ids, x = enc.encode_ordinary(r.text or ""), got[r.doc_id]
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe_replay.decode(bpe_replay.encode(docs, RANKS, PATTERN, ids=True), RANKS)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("pattern", [PATTERN, r"[^ ]+| +"])
def test_splitting_equals_the_pattern(pattern):
    import pyarrow as pa
    import regex

    from sparkbags.llm import pieces
    from sparkbags.llm.common import utf8

    r = random.Random(8)
    more = [*PIECES, "'", "''", "'re", "'ll", "'v", " 'd", "'t", "\r\n", "\u2003"]
    rows = [None, ""] + ["".join(r.choice(more) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    raw, off = utf8(pa.array(rows))
    start = pieces.split(raw, off) if pattern == PATTERN else pieces.split_by(regex.compile(pattern).findall, rows, off)
    words = [raw[a:b].tobytes().decode() for a, b in zip(start, np.append(start[1:], len(raw)), strict=True)]
    assert words == [w for t in rows if t for w in regex.findall(pattern, t)]


def test_codes_survive_equal_hashes(monkeypatch):
    from sparkbags.llm import pieces

    monkeypatch.setattr(pieces, "hashes", lambda raw, a, b: (b - a).astype(np.uint64) % np.uint64(3) + np.uint64(1))
    r = random.Random(3)
    words = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 4))) for _ in range(300)]
    codes = pieces.Codes(lambda new: ([int.from_bytes(w, "big") & 0x7FFFFFFF for w in new], np.ones(len(new), np.int64)))
    raw, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])[:-1]
    ids, _ = codes.encoded(codes.of([(raw, start)])[0])
    assert ids.tolist() == [int.from_bytes(w, "big") & 0x7FFFFFFF for w in words]


def test_merges_that_bring_a_lower_rank():
    """A vocabulary in which a merge follows one of higher rank: like the library."""
    tokens = [bytes([i]) for i in range(256)]
    ranks = {t: i for i, t in enumerate([*tokens, b"xyz", b"yz", b"xy", b"aa", b"aaa", b"ab"])}
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    words = [bytes(r.choice(b"xyzab") for _ in range(r.randint(1, 14))) for _ in range(500)]
    ids, n = bpe_replay.replay(words, bpe_replay.Merges(ranks))
    for w, x in zip(words, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert x.tolist() == enc.encode_ordinary(w.decode())


def test_bpe_of_long_words_equals_short_ones():
    ranks = bpe_replay.load_ranks(RANKS)
    words = ["".join(random.Random(i).choice("thinger ") for _ in range(i)).encode() for i in range(1, 48)]
    ids, n = bpe_replay.replay(words, bpe_replay.Merges(ranks))
    long = bpe_replay.replay_long(words, ranks)
    for a, b in zip(np.split(ids, np.cumsum(n)[:-1]), long, strict=True):
        assert a.tolist() == b


def test_token_files(docs):
    tok = Tokenizer.from_buffer(queries.tokenizer_file("byte_bpe_50k.json"))
    got, at = by_key(token_file.round_trip(docs, queries.tokenizer_file("byte_bpe_50k.json"), 2)), 0
    for r in sorted(docs.collect()):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n", [1, 7, 1024, 3000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32])
def test_blocks(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.int64)
    ids[:: max(1, n // 5)] = top - 1
    data = token_file.pack_file(3, 10, np.array([4, 9]), np.array([n - n // 3, n // 3]), ids)
    f = token_file.TokenFile(data)
    assert (f.before, f.partition) == (10, 3)
    assert np.concatenate([x for _, _, x in f.documents()]).tolist() == ids.tolist()
    assert f.ids(n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys, linked):
    root = {k: k for k in keys}
    for _ in keys:
        new = {a: min([root[a], *(root[b] for b in linked[a])]) for a in keys}
        if new == root:
            break
        root = new
    return root


def test_simhash(docs):
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    near = {a: [b for b in want if (want[a] ^ want[b]).bit_count() <= 3] for a in want}
    got = by_key(simhash.classes(docs))
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    assert {k: r.component_id for k, r in got.items()} == plain_components(list(want), near)


def test_ball_links_find_every_pair(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(6)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for radius in range(4):
        got = {frozenset(p) for p in simhash.ball_links(df, radius).collect()}
        assert got == {frozenset((signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("buckets", [1, 7, 3000])
def test_packed_variants_are_short(buckets):
    """Ten bytes for a variant at most, so the shuffle grows no faster than the input."""
    r = random.Random(6)
    fp = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
    for radius in range(4):
        packed = simhash._packed(fp, radius, buckets).to_pylist()
        at, _, v = simhash.variants(fp, radius)
        got = [zip(*(c.tolist() for c in simhash._unpacked(x["fps"], x["flips"], radius)), strict=True) for x in packed]
        assert sorted(p for g in got for p in g) == sorted(zip(fp[at].tolist(), v.tolist(), strict=True))
        assert sum(len(x["fps"]) + len(x["flips"]) for x in packed) <= 10 * len(v)


def plain_repeats(rows, length):
    raw = {k: (t or "").encode() for k, t in rows}
    n = Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in raw.items():
        cut = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        left = bytes(b for b, c in zip(t, cut, strict=True) if not c)
        out[k] = (len(t), sum(cut), len(re.findall(rb"\x01+", bytes(cut))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("settings", [{}, {"most_contexts": 2}, {"length": 30, "gram": 9}])
def test_suffix_dedup(spark, settings):
    r = random.Random(1)
    base = "".join(r.choice("abcdé ") for _ in range(2000))
    rows = [None if i % 19 == 0 else "".join(r.choice([base[(a := r.randrange(1500)) : a + r.randint(0, 500)], "ab" * r.randint(0, 200), "".join(r.choice("xyz") for _ in range(50))]) for _ in range(r.randint(0, 4))) for i in range(90)]
    docs = table(spark, rows)
    got = by_key(suffix_dedup.remove(docs, **settings))
    assert {k: tuple(x)[1:] for k, x in got.items()} == plain_repeats([(r.doc_id, r.text) for r in docs.collect()], settings.get("length", 200))


def test_suffix_dedup_of_null_and_repeated_keys(spark):
    """Each row loses what its own text repeats; unique text stays."""
    r = random.Random(9)
    t = "".join(r.choice("abcdefgh ") for _ in range(900))
    own = "".join(r.choice("ijklm") for _ in range(700))
    rows = [(None, t), (2, t[:500] + "zz" + t[500:]), (1, own), (1, own[:300] + "Q" + own[300:600]), (1, "short"), (None, None), (3, "y" * 150), (3, "y" * 150), (4, own[::-1]), (4, own[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_repeats(enumerate(x[1] for x in rows), 200)
    got = sorted((str(x.doc_id), *tuple(x)[1:]) for x in suffix_dedup.remove(docs).collect())
    assert got == sorted((str(rows[i][0]), *x) for i, x in want.items())


def test_suffix_dedup_small_tables_and_columns(spark):
    assert suffix_dedup.remove(table(spark, [])).count() == 0
    assert by_key(suffix_dedup.remove(table(spark, [None, "a"])))[-2].n_bytes == 1
    docs = table(spark, ["x" * 100 + "é" * 150, "y" + "é" * 150, "alone", None])
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 4
    assert {r.doc_id: r.text for r in out.collect()}[1] == "alone"


@pytest.mark.parametrize("length", [7, 14, 20, 33, 60])
def test_merged_transforms(length):
    r = random.Random(length)
    for _ in range(40):
        base = bytes(r.choice(b"ab") for _ in range(300))
        rows = [base[(a := r.randrange(250)) : a + r.randint(0, 200)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 20))]
        weights = np.array([r.choice([1, 1, 2]) for _ in rows])
        n = Counter()
        for t, w in zip(rows, weights.tolist(), strict=True):
            for i in range(len(t) - length + 1):
                n[t[i : i + length]] += w
        got = suffix_dedup.repeated_starts(rows, weights, length, shard_bytes=r.choice([1, 200, 10**6]))
        assert [x.tolist() for x in got] == [[i for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1] for t in rows]


def test_merge_walks_shared_rows_only(monkeypatch):
    """A turn looks ahead from rows whose block has another row, not from all of them."""
    r = random.Random(2)
    texts = [bytes(r.choices(b"abcdefgh", k=300)) for _ in range(60)]
    walked = []
    reached = suffix_dedup.Merged._reached
    monkeypatch.setattr(suffix_dedup.Merged, "_reached", lambda self, x, *a: walked.append((len(x), len(self.next))) or reached(self, x, *a))
    assert not any(len(x) for x in suffix_dedup.repeated_starts(texts, np.ones(60, np.int64), 200, 4000))
    assert walked and all(n < 0.1 * rows for n, rows in walked)


def plain_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    find = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            find.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in find}:
            for k in range(len(w) - n + 1):
                if g := find.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= g
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("n_items,block", [(40, 1 << 24), (40, 300), (0, 1 << 24)])
def test_contamination(spark, n_items, block):
    r = random.Random(3)
    some = ["a", "b", "C", "é", "x1", "Ö"]
    docs = table(spark, [None, "", "---"] + [r.choice(["", " ", "-"]) + r.choice([" ", ".", " - "]).join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(120)])
    items = spark.createDataFrame([(i, None if i == 7 else " ".join(r.choice(some) for _ in range(r.randint(0, 14))), 0) for i in range(n_items)], "item_id long, text string, t int")
    got = by_key(decontaminate.contamination(docs, items, block_bytes=block))
    want = plain_contamination([(x.doc_id, x.text) for x in docs.collect()], [(x.item_id, x.text) for x in items.collect()])
    assert {k: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for k, x in got.items()} == want
    assert all(sum(s.b - s.a for s in x.spans) == x.n_hit for x in got.values())


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_contamination_of_null_and_repeated_ids(spark, block):
    """Items without an id hit; each row has its own result, with any number of blocks."""
    docs = spark.createDataFrame([(1, "x a b c y"), (1, "clean"), (None, "d e f"), (None, "clean too"), (2, "g h i")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (5, "d e f"), (None, "g h i"), (5, "k l m n"), (6, "o p q r s t u")], "item_id long, text string")
    got = decontaminate.contamination(docs, items, block_bytes=block).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.items, x.contaminated) for x in got) == [("1", 1, 0, [], False), ("1", 5, 3, [], True), ("2", 3, 3, [], True), ("None", 2, 0, [], False), ("None", 3, 3, ["5"], True)]


def test_equal_items_and_short_items(spark):
    """Many items with one text are one query; a one-word item doesn't widen the search."""
    items = spark.createDataFrame([(i, "a b c d e f g h i j k l") for i in range(3000)] + [(9000, "zz"), (9001, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y " * 50), (2, "q zz"), (3, "c d e f"), (4, None)], "doc_id long, text string")
    got = by_key(decontaminate.contamination(docs, items))
    assert [(got[i].n_hit, got[i].n_items) for i in (1, 2, 3, 4)] == [(600, 3001), (1, 1), (0, 0), (0, 0)]
    assert got[1]["items"] == sorted([*map(str, range(3000)), "9001"])
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 4}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_longest_match_is_found():
    import pyarrow as pa

    words = [f"w{i}" for i in range(40)]
    items = decontaminate.Items(["i"], pa.array([" ".join(words)]), 10)
    w = decontaminate.Words(pa.array(["x " + " ".join(words[5:30]) + " y"]))
    start, j, length = decontaminate.search(items, w)
    assert max(length.tolist()) == 25 and (1, 5, 25) in zip(start.tolist(), items.query[j].tolist(), length.tolist(), strict=True)


def test_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = by_key(queries.op9_langid(spark, d))
    held = [k for k, r in got.items() if r.held_out]
    assert len(got) == len(want) and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert sum(got[k].lang_pred == want[k] for k in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_grams(text):
    """Bucket numbers of a text's n-grams, character by character."""
    t = " " + re.sub(r"^ +", "", re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())))
    out, m = [[] for _ in langid.ORDERS], 0xFFFFFFFF
    for i in range(len(t)):
        h = 0
        for k, n in enumerate(langid.ORDERS):
            h = (h ^ ord(t[i + n - 1] if i + n - 1 < len(t) else " ")) * 0x9E3779B1 & m
            h ^= h >> 15
            out[k].append(((h * 0x85EBCA6B & m) >> 17) + k * langid.BUCKETS)
    return out


def test_language_scores_equal_plain_ones(spark):
    """Counts, log probabilities and sums by a plain loop; neighbours don't matter."""
    import math

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").limit(60).collect()
    known, asked = [r for r in rows[:40] if r.lang], [r.text for r in rows[40:]] + [None, "a", "", "Ab c", "-x-", "ab"]
    langs = sorted({r.lang for r in known})
    counts, docs_of = {x: Counter() for x in langs}, Counter(r.lang for r in known)
    for r in known:
        for grams in plain_grams(r.text):
            counts[r.lang].update(grams)
    total = {(x, k): sum(n for g, n in counts[x].items() if g // langid.BUCKETS == k) + 0.1 * langid.BUCKETS for x in langs for k in range(3)}
    model = langid.train(spark.createDataFrame([(i, r.text, r.lang) for i, r in enumerate(known)], "doc_id long, text string, lang string"))
    assert model[0] == langs
    got, p = langid.score(asked, *model)
    for t, name, score in zip(asked, got, p.tolist(), strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (name, score) == ("und", 0)
            continue
        grams = plain_grams(t)
        z = [math.log((docs_of[x] + 1) / sum(docs_of[y] + 1 for y in langs)) + sum(math.log((counts[x][g] + 0.1) / total[x, k]) for k in range(3) for g in grams[k]) for x in langs]
        z = [v / max(1, math.sqrt(len(grams[0]))) for v in z]
        want = 1 / sum(math.exp(v - max(z)) for v in z)
        assert name == langs[z.index(max(z))] and abs(score - want) < 1e-3
        alone = langid.score([t], *model)
        assert alone[0] == [name] and abs(alone[1][0] - score) < 1e-9


def test_language_edges(spark):
    few = spark.createDataFrame([(1, "der die das und", "de", 1), (2, "the of and to", "en", 1), (3, None, "en", 1), (4, "12 !?", None, 1), (5, "Das und die", None, 1)], "doc_id long, text string, lang string, t int")
    got = by_key(langid.identify(few, langid.train(few)))
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und", "und", "de"] and got[3].score == 0
    assert by_key(langid.identify(few, langid.train(few.limit(0))))[1].lang_pred == "und"
    assert langid.identify(few.limit(0), langid.train(few)).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = by_key(queries.op1_quality(spark, d))
    assert len(got) == 1000
    assert sum(got[k].keep == v for k, v in labels.items()) > 0.97 * len(labels)


def test_quality_of_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert sum(got[k] == v for k, v in want.items()) > 0.95 * len(want)


def test_posteriors_equal_plain_ones(spark):
    """Sites, paths, strengths and odds by plain sums over all documents."""
    import math

    r = random.Random(6)
    rows = [(f"h{r.randrange(5)}" if r.random() < 0.9 else None, r.choice(["x", "y", None]), r.random() ** (1 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "h string, p string, e double")
    got = quality.posterior(df, quality.site_posteriors(df)).collect()
    cut = lambda x: min(1 - 1e-6, max(1e-6, x))
    logit = lambda x: math.log(cut(x) / (1 - cut(x)))
    mu = sum(x[2] for x in rows) / len(rows)

    def groups(keys):
        out = {}
        for x in rows:
            n, s = out.get(x[:keys], (0, 0.0))
            out[x[:keys]] = (n + 1, s + x[2])
        return out

    def strength(own, mean):
        ss = sum(n * (s / n - mean(k)) ** 2 for k, (n, s) in own.items())
        noise = sum(mean(k) * (1 - mean(k)) for k in own)
        n = sum(n for n, _ in own.values())
        v = sum(m * mean(k) * (1 - mean(k)) for k, (m, _) in own.items())
        return min(1e6, max(2.0, v / n / max(1e-9, (ss - noise) / n) - 1))

    hosts, paths = groups(1), groups(2)
    k1 = strength(hosts, lambda k: mu)
    host = {k: (s + k1 * mu) / (n + k1) for k, (n, s) in hosts.items()}
    k2 = strength(paths, lambda k: host[k[:1]])
    shift = {k: logit((s + k2 * host[k[:1]]) / (n + k2)) - logit(mu) for k, (n, s) in paths.items()}
    want = sorted((x[2], 1 / (1 + math.exp(-(logit(x[2]) + shift[x[:2]])))) for x in rows)
    assert len(got) == len(want)
    for x, (e, post) in zip(sorted(got, key=lambda x: x.e), want, strict=True):
        assert x.e == e and abs(x.posterior - post) < 1e-6 and x.keep == (x.posterior >= 0.5)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "en", 0.5), (2, "", "s", None, 0.5), (3, "a word", "s", "en", 0.5)], "doc_id long, text string, source string, lang string, e double")
    labels = spark.createDataFrame([(3, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = quality.kept(docs, known)
        assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [3]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink_towards_their_hosts(spark):
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.1)] + [("b", "x", 0.2)] * 200 + [("b", "y", 0.1)]
    got = {(r.h, r.p): r["shift"] for r in quality.site_posteriors(spark.createDataFrame(rows, "h string, p string, e double")).collect()}
    assert got["a", "x"] > 0 > got["b", "x"]
    assert got["a", "y"] > got["b", "y"]  # one bad document of a good host
