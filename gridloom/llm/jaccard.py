"""The exact check of near-duplicates by the Jaccard likeness of shingle sets, and an exact way for those that SimHash leaves.

Two sets are linked if their likeness reaches a bound; documents of one connected component are near-duplicates.
No link is lost to a radius, a sample or a cap:

* Sets that a SimHash search has brought together are a family (see below), and their pairs are no candidates here.
* Shingles have one order: that of their hashes, but those that are frequent in a sample come last. (The sample
  decides how many candidates there are and nothing else; any order finds all links. It grows with the table, so that
  what counts as frequent is a number of holders and not a share.) Sets of likeness t share one of the first
  n - ceil(t n) + 1 shingles of each, so only those are indexed; rows that meet under a shingle are
  candidates unless their sizes or their places in the order rule the likeness out.
* Each set has a bitmap of at least four bits a shingle: bit b tells whether an odd number of its shingles fall on b.
  Two bitmaps (the larger folded to the size of the other) differ in no more bits than the sets do in shingles,
  which rules out most candidates; the others are verified by their whole sets, which only they need.
* A shingle with many candidates for its rows is *dense*. It yields a chain of its rows in place of their
  pairs. Sets that dense shingles or SimHash chain together form a family, whose sets are gathered (pairs of blocks of
  them, if they are many) and searched breadth-first by their exact likeness: each set is compared with all
  candidates that no set has reached yet. That gives a spanning forest of the true links, never all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, broadcast_if_few, checkpoint, chunks, trim
from .graph import components

#: Candidates for each row of a shingle, and pairs of fitting sizes, beyond which it is dense.
EACH, FITTING = 8, 64
#: Least rows and share of the sample that tells frequent shingles; rows of it that hold one; most that are told.
SAMPLE, SHARE, OFTEN, MOST_OFTEN = 10_000, 0.05, 5, 400_000
#: Shingles of a block of a family's sets; least bits of a bitmap.
BLOCK, BITS = 1 << 20, 1024


def least_overlap(n, similarity: float):
    """Fewest shingles that a set of ``n`` shares with any that is alike enough."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    from .simhash import shingle_hashes

    return _distinct(shingle_hashes(text, words))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype(np.uint64))


def bitmap(found: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as longs; their number is a power of two."""
    bits = max(BITS, 1 << (4 * len(found) - 1).bit_length() if len(found) else 0)
    return np.packbits(np.bincount((found % bits).astype(np.int64), minlength=bits) & 1).view(np.int64)


def bits_apart(a: str, b: str):
    """The bits that two bitmaps differ in; sets that can be alike have bitmaps of one size, or one of twice the other's."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))
    return F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)


def _name(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def frequent(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """The shingles that come last in the order."""
    n = max(1, docs.count())
    rate = max(SAMPLE, SHARE * n) / n
    some = docs.where(F.pmod(F.xxhash64(key, F.lit("order")), F.lit(1_000_000)) < int(1e6 * rate)).select(key, text)

    def run(batches):
        for b in chunks(batches, rows=64):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, words) for t in b.column(1).to_pylist())]).view(np.int64))], ["shingle"])

    often = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST_OFTEN)
    return np.sort(often.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, words: int, similarity: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, fp, name, n, prefix, bits) for each row: a hash of its text, its fingerprint, the set's name (equal sets have the same), size, indexed shingles and bitmap."""
    from .simhash import fingerprint, shingle_hashes

    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, words, text, key))

    def ordered(s):
        last = often.value[np.minimum(np.searchsorted(often.value, s), len(often.value) - 1)] == s if len(often.value) else np.zeros(len(s), bool)
        return np.concatenate([s[~last], s[last]])

    def run(batches):
        for b in chunks(batches):
            hashes = [shingle_hashes(t, words) for t in b.column(1).to_pylist()]
            fp = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)
            sets = [_distinct(h) for h in hashes]
            n = np.array([len(s) for s in sets])
            first = np.minimum(n, n - least_overlap(n, similarity) + 1)
            names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            bits = _lists([bitmap(s).view(np.uint64) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp), pa.array(names), pa.array(n.astype(np.int32)), _lists([ordered(s)[:k] for s, k in zip(sets, first)]), bits], [key, "th", "fp", "name", "n", "prefix", "bits"])

    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, th long, fp long, name long, n int, prefix array<long>, bits array<long>")


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, dense): pairs of names to verify, or links of a dense shingle's chain."""
    rows = sets.select("name", "n", F.posexplode("prefix").alias("at", "shingle"))

    def pairs(n, at, a, b):
        """Whether sizes and places allow the likeness."""
        return np.minimum(n[a] - at[a], n[b] - at[b]) >= similarity / (1 + similarity) * (n[a].astype(np.int64) + n[b]) - 1e-9

    def fits(n, a, b):
        return np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9

    def large(name, n, at):
        """Candidates of one shingle, or None if it is dense. Rows are in order of size."""
        if (np.searchsorted(n, n / similarity + 1e-9, "right") - np.arange(1, len(n) + 1)).sum() > FITTING * len(n):
            return None
        found, total = [], 0
        for d in range(1, len(n)):
            a = np.arange(len(n) - d)
            a = a[fits(n, a, a + d)]
            if not len(a):
                break
            a = a[pairs(n, at, a, a + d)]
            found.append((name[a], name[a + d]))
            total += len(a)
            if total > EACH * len(n):
                return None
        return found

    def run(batches):
        for cut, name, n, at in _groups(batches):
            size = np.diff(cut)
            group = np.repeat(np.arange(len(size)), size)
            us, vs, us_dense, vs_dense = [], [], [], []
            small = np.repeat(size <= 2 * EACH, size)
            for d in range(1, 2 * EACH):
                a = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
                if not len(a):
                    break
                a = a[fits(n, a, a + d)]
                a = a[pairs(n, at, a, a + d)]
                us.append(name[a])
                vs.append(name[a + d])
            for i in np.flatnonzero(size > 2 * EACH):
                s = slice(cut[i], cut[i + 1])
                found = large(name[s], n[s], at[s])
                if found is None:
                    a = np.arange(cut[i], cut[i + 1] - 1)
                    a = a[fits(n, a, a + 1)]
                    us_dense.append(name[a])
                    vs_dense.append(name[a + 1])
                else:
                    us += [x for x, _ in found]
                    vs += [y for _, y in found]
            for u, v, dense in ((us, vs, False), (us_dense, vs_dense, True)):
                if u:
                    u, v = np.concatenate(u), np.concatenate(v)
                    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)])[:, u != v], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(both.shape[1], dense))], ["u", "v", "dense"])

    return rows.select("shingle", "n", "name", "at").repartition("shingle").sortWithinPartitions("shingle", "n", "name").mapInArrow(run, "u long, v long, dense boolean").distinct()


def _groups(batches, least: int = 1 << 18):
    """Groups of at least two rows of one shingle in sorted batches, many at a time: (cuts, name, n, at)."""

    def whole(cols):
        change = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        size = np.diff(np.append(change, len(cols[0])))
        keep = np.repeat(size > 1, size)
        return np.append(0, np.cumsum(size[size > 1])), cols[2][keep], cols[1][keep], cols[3][keep]

    kept: list[list[np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            kept.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        if sum(len(k[0]) for k in kept) >= least:
            cols = [np.concatenate(c) for c in zip(*kept)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield whole([c[:last] for c in cols])
            kept = [[c[last:] for c in cols]]
            least = max(1 << 18, 2 * len(kept[0][0]))
    if kept:
        yield whole([np.concatenate(c) for c in zip(*kept)])
    kept.clear()
    trim()


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` of distinct shingles, as pairs of places."""
    n = np.array([len(s) for s in sets])
    flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    # rare shingles first
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    flat, owner = rank[flat], np.repeat(np.arange(len(n)), n)
    flat = flat[np.lexsort((flat, owner))]
    start = np.append(0, np.cumsum(n))
    first = np.minimum(n, n - least_overlap(n, similarity) + 1)
    indexed = np.arange(len(flat)) - start[owner] < first[owner]
    order = np.argsort(flat[indexed], kind="stable")
    holders = owner[indexed][order]
    bounds = np.searchsorted(flat[indexed][order], np.arange(len(count) + 1))
    mark, left, links = np.zeros(len(count), bool), np.ones(len(n), bool), []
    for seed in range(len(n)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front:
            x = front.pop()
            own = flat[start[x] : start[x + 1]]
            near = np.zeros(len(n), bool)
            for s in own[: first[x]]:
                near[holders[bounds[s] : bounds[s + 1]]] = True
            near &= left
            at = np.flatnonzero(near)
            at = at[np.minimum(n[at], n[x]) >= similarity * np.maximum(n[at], n[x]) - 1e-9]
            if not len(at):
                continue
            mark[own] = True
            place = np.repeat(start[at] - np.append(0, np.cumsum(n[at])[:-1]), n[at]) + np.arange(n[at].sum())
            shared = np.add.reduceat(mark[flat[place]], np.append(0, np.cumsum(n[at])[:-1]), dtype=np.int64)
            mark[own] = False
            new = at[shared / (n[at] + n[x] - shared) >= similarity]
            left[new] = False
            links += [(x, int(y)) for y in new]
            front += new.tolist()
    return links


def _families(member: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v): a spanning forest of the links within each family (``member``: name, family; ``sets`` have name and shingles)."""
    rows = member.join(sets, "name")
    blocks = rows.groupBy("family").agg(F.ceil(F.sum(F.size("shingles")) / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    rows = rows.join(blocks, "family").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["family", "low", "high"]
    rows = rows.select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "name", "shingles")

    def run(batches):
        def done():
            links = forest([s for _, s in held], similarity)
            u, v = (np.array([held[p[k]][0] for p in links], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        at, held = None, []
        for b in batches:
            lists = b.column(4)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                if key != at:
                    if len(held) > 1:
                        yield done()
                    at, held = key, []
                held.append((b.column(3)[i].as_py(), values[offsets[i] : offsets[i + 1]].copy()))
        if len(held) > 1:
            yield done()
        held.clear()
        trim()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "name").mapInArrow(run, "u long, v long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct()


def links(docs: DataFrame, sets: DataFrame, names: DataFrame, near: DataFrame, words: int, similarity: float, text: str, key: str, block: int = BLOCK) -> DataFrame:
    """(u, v): links of names, enough to connect all sets that the true links connect.

    ``sets``: name, n, prefix, bits; ``names``: name, least; ``near``: (u, v), a chain of the sets that a search has brought together.
    """
    found = checkpoint(candidates(sets, similarity))
    reach = components(found.where("dense").select("u", "v").union(near))
    member = checkpoint(reach.union(reach.select("component", "component").distinct()).toDF("name", "family"))
    few = broadcast_if_few(member)
    pairs = found.where(~F.col("dense")).select("u", "v")
    for end in ("u", "v"):
        pairs = pairs.join(few.toDF(end, f"family_{end}"), end, "left")
    # the families' own search finds the links inside of them
    pairs = checkpoint(pairs.where(~F.coalesce(F.col("family_u") == F.col("family_v"), F.lit(False))).select("u", "v"))
    of = sets.select("name", F.col("n").alias("__n"), F.col("bits").alias("__bits"))
    needed = checkpoint(_ends(pairs))
    if needed.count() <= ROWS:
        of = of.join(F.broadcast(needed), "name", "left_semi")
    for end in ("u", "v"):
        pairs = pairs.join(of.toDF(end, f"n_{end}", f"bits_{end}"), end)
    pairs = checkpoint(pairs.where(bits_apart("bits_u", "bits_v") <= (F.col("n_u") + F.col("n_v")) * ((1 - similarity) / (1 + similarity)) + 1e-9).select("u", "v"))
    ends = checkpoint(_ends(pairs).union(member.select("name")).distinct().join(names, "name").select("name", F.col("least").alias("__least")))
    read = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(broadcast_if_few(ends), F.col("__key").eqNullSafe(F.col("__least"))).select("name", "__text")

    def run(batches):
        for b in chunks(batches):
            whole = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            # another row may have the same key
            same = np.array([_name(s) for s in whole], np.uint64).view(np.int64) == b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(whole)], ["name", "shingles"]).filter(pa.array(same))

    whole = checkpoint(read.mapInArrow(run, "name long, shingles array<long>").dropDuplicates(["name"]))
    pairs = pairs.join(whole.select(F.col("name").alias("u"), F.col("shingles").alias("a")), "u").join(whole.select(F.col("name").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    alike = pairs.where(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("u", "v")
    return alike.union(_families(member, whole, similarity, block)).distinct()
