"""Line dedup, SimHash, sketches and graph components against plain versions."""

import random
import re

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from gridloom.llm import graph, linededup, queries, simhash, sketch

DATA = "/root/testdata/sf0.001"


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", ["op3_line_dedup", "op8_decontaminate"])
def test_query_equals_sql(name, spark, duck):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])


def line_model(docs, min_words):
    """Deleted line numbers, without those of blank lines, by comparing runs of every length."""
    seen, gone = set(), {}
    for key, text in docs:
        rows = [(i, x.strip(" "), len(re.findall(r"[^ \t\x0b\f\r]+", x))) for i, x in enumerate(text.split("\n"))]
        rows = [r for r in rows if r[2]]
        drop, own = set(), []
        for a in range(len(rows)):
            for b in range(a, min(len(rows), a + 2 * min_words)):
                if sum(r[2] for r in rows[a : b + 1]) >= min_words:
                    content = tuple(r[1] for r in rows[a : b + 1])
                    if content in seen or content in own:
                        drop |= {r[0] for r in rows[a : b + 1]}
                    own.append(content)
        seen |= set(own)
        gone[key] = sorted(drop)
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(9)] + [""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    out = linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), min_words=5)
    want = line_model(docs, 5)
    for r in out.collect():
        lines, gone = r.text.split("\n"), set(r["__removed"])
        assert [i for i in sorted(gone) if lines[i]] == want[r.doc_id]
        assert r["__text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_line_dedup_of_odd_rows(odd, none):
    out = linededup.deduplicate(odd, min_words=5)
    assert out.count() == odd.count() and linededup.deduplicate(none).count() == 0
    got = {r.doc_id: (list(r["__removed"]), r["__text"]) for r in out.where("doc_id is not null").collect()}
    assert got[0][0] == [] and got[5] == ([0, 1], "") and got[1] == ([], None) and got[2] == ([], "")


def test_a_passage_in_one_line_goes_from_all_but_the_first(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = spark.createDataFrame([(i, f"own line {i}\n{passage}\nend {i}") for i in range(200)], "doc_id long, text string")
    kept = linededup.deduplicate(docs).where(F.col("__text").contains(passage)).select("doc_id").collect()
    assert [r.doc_id for r in kept] == [0]


def test_fingerprints_equal_the_definition(spark, odd):
    import xxhash

    def model(text, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.fingerprints(odd, 3).collect()
    want = sorted(str((r.doc_id, model(r.text, 3))) for r in odd.collect())
    assert sorted(str((r.doc_id, r.fp % (1 << 64))) for r in got) == want


@pytest.mark.parametrize("radius, hot", [(0, 1000), (3, 1000), (3, 7), (6, 1000), (10, 40)])
def test_links_lose_nothing(spark, radius, hot):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    codes = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & ((1 << 64) - 1) for b in base for _ in range(12)}
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    parts = simhash.plan(*simhash.bit_counts(df), radius)
    assert sum(p.threshold + 1 for p in parts) == radius + 1
    found = simhash.links(df, parts, radius, hot)
    nodes = sorted(r.fp for r in df.collect())
    v = np.array(nodes, np.int64).view(np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    want = groups(nodes, [(nodes[a], nodes[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    pairs = [(r.u, r.v) for r in found.collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= radius for a, b in pairs)
    assert groups(nodes, pairs) == want


def test_dense_groups_give_few_links_that_still_connect():
    rng = np.random.default_rng(1)
    codes = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (600, 3)).astype(np.uint64), axis=1))
    links = simhash._bucket_links(codes, np.ones(len(codes), bool), simhash.Near(8))
    assert len(links) <= (simhash.EACH + 1) * len(codes)
    assert len(set(groups(codes.tolist(), links).values())) == 1
    # half of the codes only probe: what links to a lesser code of the others is connected to it
    own = np.arange(len(codes)) % 2 == 0
    links = simhash._bucket_links(codes, own, simhash.Near(8))
    assert len(links) <= (simhash.EACH + 1) * len(codes)
    of = groups(codes.tolist(), links)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 8) & own[:, None] & (codes[:, None] < codes[None, :])
    assert all(of[int(codes[a])] == of[int(codes[b])] for a, b in zip(*np.nonzero(near)))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-50, 200), rng.randrange(-50, 200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    want = groups(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_of_odd_rows(odd, none):
    out = simhash.cluster(odd, 3, 3)
    assert out.count() == odd.count() and simhash.cluster(none, 3, 3).count() == 0
    ids = {}
    for r in out.collect():
        ids.setdefault(r.doc_id, r)
    assert ids[0].component_id == ids[5].component_id == 0
    assert ids[1].component_id == ids[2].component_id == ids[3].component_id == 1 and ids[1].fingerprint == "0" * 16


def test_near_duplicates_keep_one_of_each_group(spark, odd, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for g in range(12):
        base = [word() for _ in range(300)]
        docs.append((100 * g, " ".join(base)))
        for c in range(3):  # one word in 300 changed: likeness about 0.97
            near = base[:]
            near[rng.randrange(300)] = word()
            docs.append((100 * g + 1 + c, " ".join(near)))
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [100 * g for g in range(12)]
    rest = simhash.keep_one(odd)
    assert rest.columns == odd.columns and rest.where("doc_id is null").count() == 2
    assert sorted(r.doc_id for r in rest.where("doc_id is not null").collect()) == [0, 1, 4, 6, 7, 8, 9]
    assert simhash.keep_one(none).count() == 0


# --- sketches


def shingles(text, n=sketch.SHINGLE):
    w = [x for x in re.split(r"[\x20\t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketch_query_against_plain_python(spark):
    import hashlib

    got = {r.doc_id: r for r in queries.op10_bottom_k(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    assert len(got) == len(docs)
    for r, nxt in zip(docs, [*docs[1:], docs[0]]):
        g, t, n = got[r.doc_id], r.text or "", nxt.text or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(n)
        for mine, x, y in ((g.near_edited, a, b), (g.near_next, a, c)):
            assert abs(mine - jaccard(x, y)) < (1e-9 if len(x | y) <= sketch.K else 0.2)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_in_descending_order_of_ids(spark, odd, ranges):
    df = spark.createDataFrame([(i, f"t{i}") for i in [5, 1, 9, 9, -3, 40, 41, 42, 10**12, None]], "doc_id long, t string").withColumn("th", F.xxhash64("t"))
    got = sorted((r.doc_id is None, -(r.doc_id or 0), r.next_t) for r in sketch.with_next(df, ["t"], ranges=ranges).collect())
    assert [g[2] for g in got] == ["t42", "t41", "t40", "t9", "t5", "t9", "t1", "t-3", "tNone", "t1000000000000"]
    one = df.where("doc_id = 5")
    assert [r.next_t for r in sketch.with_next(one, ["t"], ranges=ranges).collect()] == ["t5"]
    assert sketch.with_next(df.limit(0), ["t"], ranges=ranges).count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 20])
def test_next_with_an_id_of_many_rows_and_many_rows_without_id(spark, ranges):
    draw = random.Random(ranges)
    ids = [7] * 90 + [None] * 80 + [draw.randrange(30) for _ in range(60)]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(ids)], "doc_id long, t string").withColumn("th", F.xxhash64("t")).repartition(3)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.th))
    want = {r.t: n.t for r, n in zip(rows, [*rows[1:], rows[0]])}
    out = sketch.with_next(df, ["t"], ranges=ranges)
    assert {r.t: r.next_t for r in out.collect()} == want
    if ranges > 1:
        cuts, _, null = df.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        at = sketch._place(F.col("doc_id"), F.col("th"), list(cuts), null / 230, ranges)
        assert df.groupBy(at.alias("at")).count().agg(F.max("count")).first()[0] < 90


def test_sketches_of_odd_rows(odd, none):
    out = sketch.report(odd).collect()
    assert len(out) == odd.count() and sketch.report(none).count() == 0
    empty = next(r for r in out if r.doc_id == 1)
    assert empty.fingerprint == "" and empty.near_edited == 1.0 and empty.n_chars == 0
    assert len({r.fingerprint for r in out if r.doc_id in (0, 5)}) == 1


def test_sketches_merge_and_estimate(spark):
    a, b = (" ".join(f"w{i}" for i in range(*r)) for r in ((0, 3000), (1500, 5000)))
    df = spark.createDataFrame([(1, a), (1, b), (2, a)], "g int, t string").withColumn("sketch", sketch.sketch(F.col("t")))
    whole = {r.g: list(r.sketch) for r in sketch.merge_groups(df, "g").collect()}
    two = {r.t[:2]: list(r.sketch) for r in df.where("g = 1").collect()}
    assert whole[1] == sorted(set(two["w0"]) | set(two["w1"]))[: sketch.K] and whole[2] == two["w0"]
    pair = df.where("g = 1").agg(F.max_by("sketch", -F.length("t")).alias("a"), F.max_by("sketch", F.length("t")).alias("b"))
    r = pair.select(sketch.distinct_count(F.col("a")).alias("n"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.resemblance(F.col("a"), F.col("b")).alias("j")).first()
    assert abs(r.n - 2996) < 800 and abs(r.c - 0.5) < 0.15 and abs(r.j - 0.3) < 0.1
