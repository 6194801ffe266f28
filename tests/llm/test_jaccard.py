"""Near-duplicates against brute force over the texts' whole shingle sets."""

import random

import numpy as np

from gridloom.llm import jaccard, simhash
from gridloom.llm.common import checkpoint

SCHEMA = "doc_id long, text string"


def edited(words, share, draw):
    return [draw.choice("abcdefgh") + str(draw.randrange(10**6)) if draw.random() < share else w for w in words]


def text(n, draw):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def brute(docs, bound=0.8):
    sets = [(k, set(simhash.shingle_hashes(t, 5).tolist())) for k, t in docs]
    of = {k: k for k, _ in sets}

    def top(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or len(x & y) / len(x | y) >= bound:
                low, high = sorted((top(a), top(b)))
                of[high] = low
    return {k: top(k) for k in of}


def found(spark, docs):
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}


def family(draw):
    """Edits of one text, half of them with a near copy of their own, and texts apart."""
    base, out = text(150, draw), []
    for _ in range(250):
        one = edited(base, 0.05, draw)
        out += [one, edited(one, 0.014, draw)] if draw.random() < 0.5 else [one]
    out += [text(150, draw) for _ in range(100)]
    draw.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_copies_inside_a_dense_family_are_found(spark):
    docs = family(random.Random(5))
    want = brute(docs)
    assert 50 < sum(k != v for k, v in want.items()) < 300
    assert found(spark, docs) == want


def test_families_in_blocks_give_the_same(spark, monkeypatch):
    docs = family(random.Random(6))
    monkeypatch.setattr(jaccard.links, "__defaults__", (4000,))
    assert found(spark, docs) == brute(docs)


def test_short_texts_of_just_the_likeness_are_found(spark):
    draw, docs = random.Random(7), []
    for _ in range(300):
        one = text(draw.randrange(30, 130), draw)
        cut = draw.randrange(1, 12)
        docs += [one, one[:-cut] + text(draw.randrange(0, 8), draw)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    want = brute(docs)
    assert sum(k != v for k, v in want.items()) > 50
    assert found(spark, docs) == want


def test_long_texts_near_the_bound_are_told_apart(spark):
    draw, docs = random.Random(8), []
    for i in range(60):
        one = text(2500, draw)
        # shared / all is from 0.77 to 0.83
        other = one[: int(2500 * (0.77 + 0.001 * i))]
        docs += [one, other]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    want = brute(docs)
    assert 20 < sum(k != v for k, v in want.items()) < 40
    assert found(spark, docs) == want


def test_texts_of_one_shingle_in_the_main_are_no_duplicates(spark):
    draw = random.Random(9)
    docs = [(i, " ".join(["buy"] * 200 + text(150, draw))) for i in range(6)]
    assert found(spark, docs) == {i: i for i in range(6)} == brute(docs)


def test_documents_of_one_id_are_judged_by_their_own_texts(spark):
    draw = random.Random(10)
    a, b, c = (" ".join(text(40, draw)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, c), (3, b), (3, b + " x"), (None, b)], SCHEMA)
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert ("2", c) in kept and ("2", a) not in kept and ("1", a) in kept and ("None", b) in kept
    assert len([x for x in kept if x[0] == "3"]) == 1


def test_bitmaps_differ_no_more_than_sets(spark):
    draw, rows, want = np.random.default_rng(1), [], []
    for n in (1, 30, 230, 400, 2000, 2000, 9000):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[draw.random(len(a)) < 0.9], draw.integers(0, 2**63, n // 6).astype(np.uint64)))
        rows += [(len(rows), jaccard.bitmap(a).tolist(), jaccard.bitmap(b).tolist()), (len(rows) + 1, jaccard.bitmap(b).tolist(), jaccard.bitmap(a).tolist())]
        want += [len(np.setxor1d(a, b))] * 2
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    assert len({len(r[1]) for r in rows}) > 3 and any(len(r[1]) != len(r[2]) for r in rows)
    for r in df.select("k", jaccard.bits_apart("a", "b").alias("n")).collect():
        assert 0.5 * want[r.k] <= r.n <= want[r.k]


def test_shingles_of_many_holders_are_frequent_in_a_table_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 40)
    draw, line = random.Random(11), "one line that two hundred of them have"
    docs = spark.createDataFrame([(i, " ".join(text(12, draw)) + (f" {line}" if i % 20 == 0 else "")) for i in range(4000)], SCHEMA)
    assert set(simhash.shingle_hashes(line, 5).tolist()) <= set(jaccard.frequent(docs, 5).tolist())


def test_prefixes_and_bitmaps_are_written_once_and_not_dealt_out(spark, monkeypatch):
    wide, plans, links = [], [], jaccard.links
    keep = lambda df: (wide.append(df.columns) if "prefix" in df.columns else None, checkpoint(df))[1]

    def watched(docs, sets, *rest):
        plans.append(sets._jdf.queryExecution().toString())
        return links(docs, sets, *rest)

    monkeypatch.setattr(simhash, "checkpoint", keep)
    monkeypatch.setattr(jaccard, "links", watched)
    docs = [(i, " ".join(t)) for i, t in enumerate([text(40, random.Random(k // 2)) for k in range(20)])]
    assert found(spark, docs) == brute(docs)
    assert len(wide) == 1 and "Exchange hashpartitioning" not in plans[0]


def test_near_copies_are_found_by_simhash_and_checked(spark, monkeypatch):
    """Without any other search: edits within the radius, and texts of one fingerprint that aren't alike."""
    monkeypatch.setattr(jaccard, "candidates", lambda sets, similarity: spark.createDataFrame([], "u long, v long, dense boolean"))
    draw, docs = random.Random(12), []
    for _ in range(40):
        one = text(400, draw)
        docs += [one, [*one[:-1], "other"]]
    docs += [["buy"] * 200 + text(150, draw) for _ in range(6)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    codes = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in docs]
    near = {2 * i + 1: 2 * i for i in range(40) if (codes[2 * i] ^ codes[2 * i + 1]).bit_count() <= simhash.RADIUS}
    assert len(near) > 20 and len(set(codes[80:])) == 1
    got = found(spark, docs)
    assert near == {k: v for k, v in got.items() if k != v}
