"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: a bit is one if it is set in more than half of the XXH64 hashes of the text's
word shingles. Two fingerprints link if they differ in at most ``radius`` bits; documents of one connected
component are near-duplicates.

Search. The bits are grouped into partitions, correlated bits together. If thresholds of the partitions
sum up to ``radius - partitions + 1``, two fingerprints that link differ in some partition by no more than
its threshold; -1 leaves a partition out. A dynamic program allots the thresholds (unequal ones, as the
partitions select unequally) with the least estimated cost: probes (all keys within the threshold) and
candidates (from the bits' shares over all fingerprints). The number of partitions is the one of least cost.
Each distinct fingerprint is sent to the keys that it probes; where rows meet under a key they are verified
by all their bits. A key's rows yield links enough to connect them, in dense groups a few
for each row and never all pairs. A key with more than ``HOT`` rows is split into blocks, and each pair of blocks is a
bucket of its own, so that no task gets an unbounded group and no link is lost.

Defined results: a text without words has fingerprint zero and links like any other; a null text counts as
empty; documents without id link too, with null as their component's id only if no member has an id. Equal
rows get equal results, one for each row. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import broadcast_if_few, checkpoint, chunks
from .graph import components

SEED = 42
#: Rows of one key that one task compares; a larger key is split into blocks of about so many.
HOT = 20_000
#: Largest number of keys that a fingerprint probes in one partition; cost of a candidate against a probe.
MOST_KEYS, PAIR_COST = 5000, 0.02

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included, in order (big-endian)."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, ">u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], ">u8")
    ends = list(itertools.accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: len(found) - words]]]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """As an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): one row for each row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in chunks(batches):
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


# --- the plan of a search


def bit_counts(codes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of codes, and for each two bits how many codes have both (64 x 64), over all rows."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            for part in (b.slice(i, 1 << 16) for i in range(0, b.num_rows, 1 << 16)):
                bits = np.unpackbits(part.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n))], ["at", "n"])

    sums = np.zeros(4097)
    for at, n in codes.select("fp").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n")).collect():
        sums[at] = n
    return int(sums[-1]), sums[:-1].reshape(64, 64)


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]  # 0 is the highest
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << (63 - b) for b in self.bits)

    def flips(self) -> list[int]:
        """What to xor a key with to get all keys within the threshold, the key itself first."""
        return [sum(1 << (63 - b) for b in some) for k in range(self.threshold + 1) for some in itertools.combinations(self.bits, k)]


def _group(together: np.ndarray, parts: int) -> list[list[int]]:
    """Equal groups of bits, each filled with the bit most correlated with those it has."""
    free, out = set(range(64)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [max(sorted(free), key=lambda b: together[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: together[b, group].sum()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def plan(n: int, both: np.ndarray, radius: int) -> list[Partition]:
    """Partitions and thresholds of the least estimated cost for ``n`` codes with these bit counts."""
    if radius >= 64:
        return [Partition((), 0)]
    share = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    together = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd))
    np.fill_diagonal(together, 0)
    best: tuple[float, list[Partition]] = (math.inf, [])
    for parts in range(1, min(radius + 1, 16) + 1):
        groups, total = _group(together, parts), radius - parts + 1
        # table: sum of the thresholds so far -> cost, thresholds
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            within, apart = [0.0], np.array([1.0])
            for b in bits:
                differ = 2 * share[b] * (1 - share[b])
                apart = np.convolve(apart, [1 - differ, differ])
            costs = {-1: 0.0}
            for t in range(0, min(radius, len(bits)) + 1):
                keys = sum(math.comb(len(bits), k) for k in range(t + 1))
                if keys > MOST_KEYS:
                    break
                costs[t] = n * keys + PAIR_COST * n * n / 2 * float(apart[: t + 1].sum())
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, ts) in table.items():
                for t, c in costs.items():
                    if cost + c < new.get(s + t, (math.inf,))[0]:
                        new[s + t] = cost + c, (*ts, t)
            table = new
        if total in table and table[total][0] < best[0]:
            best = table[total][0], [Partition(tuple(b), t) for b, t in zip(groups, table[total][1]) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probes(codes: DataFrame, parts: list[Partition]) -> DataFrame:
    """(part, key, fp, own): each code under all keys that it probes; own: under its own key."""
    out = None
    for i, p in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(_signed(p.mask)))
        flips = [_signed(x) for x in p.flips()]
        if len(flips) == 1:
            rows = codes.select(F.lit(i).alias("part"), key.alias("key"), "fp", F.lit(True).alias("own"))
        else:
            rows = codes.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(F.lit(i).alias("part"), key.bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).alias("own"))
        out = rows if out is None else out.union(rows)
    return out


#: Stands for "no link here" among distances.
FAR = 255
#: Links that a code gets in a dense bucket, besides those of the spanning forest; a bucket of fewer gives all.
EACH = 8


@dataclass(frozen=True)
class Near:
    """Distances of codes as one partition sees them: pairs beyond the radius, or that meet in a partition before it, are FAR."""

    radius: int
    before: tuple[tuple[int, int], ...] = ()  # masks and thresholds of the partitions before

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        out = np.bitwise_count(x)
        out[out > self.radius] = FAR
        if self.before and (at := np.nonzero(out != FAR))[0].size:
            close, met = x[at], np.zeros(at[0].size, bool)
            for mask, threshold in self.before:
                met |= np.bitwise_count(close & np.uint64(mask)) <= threshold
            out[tuple(k[met] for k in at)] = FAR
        return out


def _bucket_links(fp: np.ndarray, own: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links of one bucket, enough to connect all its codes that link by way of it.

    A pair meets under the keys of both its codes, so a code that only probes here is compared with the lesser
    codes whose own key this is; the others meet it under its key. A pair that meets in several partitions
    counts in the first of them.
    """
    base, probing = np.unique(fp[own]), np.unique(fp[~own])
    links, most = [], EACH * len(fp)
    for rows in (base, probing):
        step = max(1, (1 << 21) // max(1, len(rows)))
        for i in range(0, len(base) if len(rows) else 0, step):
            some = base[i : i + step, None]
            a, b = np.nonzero((near(some, rows[None, :]) != FAR) & (some < rows[None, :]))
            links += zip(base[i + a].tolist(), rows[b].tolist())
            if len(links) > most:
                return _sparse(base, probing, near)
    return links


def _sparse(base: np.ndarray, probing: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Few links among many close codes: a spanning forest of ``base``, and of each code to the nearest ones.

    The forest's roots are the most central codes: where many texts are edits of one, its code is in their
    midst, and it is the text that all of them are most alike to.
    """
    total, step, out = np.zeros(len(base), np.int64), max(1, (1 << 21) // len(base)), set()
    for i in range(0, len(base), step):
        some = base[i : i + step]
        total[i : i + step] = np.bitwise_count(some[:, None] ^ base[None, :]).sum(axis=1, dtype=np.int64)
        apart = near(some[:, None], base[None, :])
        apart[np.arange(len(some)), np.arange(i, i + len(some))] = FAR
        for a, b in _nearest(apart.T):
            out |= {(min(x), max(x)) for x in zip(base[a].tolist(), some[b].tolist())}
    forest, trees = _spanning(base[np.argsort(total, kind="stable")], near)
    out |= {(min(x), max(x)) for x in forest}
    step = max(1, (1 << 21) // max(1, len(probing)))
    for tree in trees if len(probing) else ():
        tree = np.array(tree, np.uint64)
        for i in range(0, len(tree), step):
            some = tree[i : i + step]
            apart = near(some[:, None], probing[None, :])
            apart[some[:, None] > probing[None, :]] = FAR
            for a, b in _nearest(apart):
                out |= set(zip(some[a].tolist(), probing[b].tolist()))
    return list(out)


def _nearest(apart: np.ndarray):
    """(row, column) arrays of the EACH least distances of each column that aren't FAR."""
    for at in np.argpartition(apart, min(EACH, len(apart)) - 1, axis=0)[:EACH]:
        ok = np.flatnonzero(apart[at, np.arange(apart.shape[1])] != FAR)
        yield at[ok], ok


def _spanning(codes: np.ndarray, near: Near) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """A spanning forest of the links among codes, by breadth-first search from the first of them; links and trees."""
    links, trees, left = [], [], codes
    while len(left):
        front, left = [left[0]], left[1:]
        trees.append([int(front[0])])
        while front and len(left):
            at = front.pop(0)
            found = near(left, at) != FAR
            new = left[found]
            links += [(int(at), int(x)) for x in new]
            trees[-1] += new.tolist()
            front += list(new)
            left = left[~found]
    return links, trees


def links(codes: DataFrame, parts: list[Partition], radius: int, hot: int = HOT) -> DataFrame:
    """(u, v): links between distinct codes (``fp``), enough to connect all that link."""
    rows = probes(codes, parts)
    # the keys with more rows than a task may hold: at most (rows / hot) of them
    busy = rows.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key", F.ceil(F.col("count") / hot).cast("int").alias("blocks"))
    busy = checkpoint(busy)
    if not busy.isEmpty():
        block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(busy, ["part", "key"], "left").withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", other)
        rows = rows.select("part", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "own")
    else:
        rows = rows.select("part", "key", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp", "own")
    keys = ["part", "key", "low", "high"]
    near = [Near(radius, tuple((p.mask, p.threshold) for p in parts[:i])) for i in range(len(parts))]

    def run(batches):
        for cut, fp, own, part in _whole_groups(batches):
            fp = fp.view(np.uint64)
            sizes = np.diff(cut)
            worth = np.flatnonzero((sizes > 1) & (np.add.reduceat(own, cut[:-1]) > 0)) if len(sizes) else []
            found = {x for i in worth for x in _bucket_links(fp[cut[i] : cut[i + 1]], own[cut[i] : cut[i + 1]].astype(bool), near[part[cut[i]]])}
            if found:
                u, v = (np.array(x, np.uint64).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def _whole_groups(batches, least: int = 1 << 18):
    """Groups of equal (part, key, low, high) in sorted Arrow batches, many at a time: (cuts, fp, own, part)."""
    kept: list[list[np.ndarray]] = []

    def cut(cols):
        change = np.zeros(len(cols[0]), bool)
        change[0] = True
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for b in batches:
        if not b.num_rows:
            continue
        kept.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
        if sum(len(k[0]) for k in kept) >= least:
            cols = [np.concatenate(c) for c in zip(*kept)]
            at = cut(cols)
            if len(at) > 1:
                yield at, cols[4][: at[-1]], cols[5][: at[-1]].astype(np.int64), cols[0]
                kept = [[c[at[-1] :] for c in cols]]
            else:
                kept = [cols]
    if kept:
        cols = [np.concatenate(c) for c in zip(*kept)]
        yield np.append(cut(cols), len(cols[0])), cols[4], cols[5].astype(np.int64), cols[0]


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _codes(prints: DataFrame, key: str) -> DataFrame:
    return checkpoint(prints.groupBy("fp").agg(F.min(key).alias("least")))


def _ids(codes: DataFrame, found: DataFrame, first: str | None = None) -> DataFrame:
    """(fp, component_id): the least key of all codes that each code reaches by the links ``found``; ``first``: with the (least) code that has it."""
    reach = components(found)
    of = checkpoint(codes.join(reach.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    # most components are one code; only the others are gathered
    joint = reach.select("component").distinct()
    least = of.join(joint, "component", "left_semi").groupBy("component").agg(F.min("least").alias("id"), F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp"))).alias("top"))
    out = of.join(least, "component", "left")
    return out.select("fp", F.coalesce("id", "least").alias("component_id"), *([F.coalesce("top.fp", "fp").alias(first)] if first else []))


def cluster(docs: DataFrame, words: int, radius: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for each row: the least key of the documents that it reaches."""
    prints = checkpoint(fingerprints(docs, words, text, key))
    codes = _codes(prints, key)
    ids = _ids(codes, links(codes, plan(*bit_counts(codes), radius), radius))
    return prints.join(ids, "fp").select(key, hexadecimal().alias("fingerprint"), "component_id")


#: Likeness of ``near_duplicates``, and the radius of the search that goes before.
SIMILARITY, RADIUS = 0.8, 3


def together(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): a chain of the sets (``name``) that fingerprints (``fp``) within the radius connect, one link a set and component."""
    of = checkpoint(prints.select("name", "fp").distinct())
    codes = checkpoint(of.select("fp").distinct())
    reach = components(links(codes, plan(*bit_counts(codes), radius), radius)).toDF("fp", "component")
    of = checkpoint(of.join(reach, "fp", "left").select("name", F.coalesce("component", "fp").alias("component")).distinct())
    joint = of.groupBy("component").agg(F.min("name").alias("u"), F.count("*").alias("n")).where("n > 1")
    return checkpoint(of.join(joint, "component").where("name <> u").select("u", F.col("name").alias("v")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, component_id, first) for each row, by links of texts whose shingles have that Jaccard likeness.

    The search by fingerprints within ``RADIUS`` brings texts together, and all pairs of what it brings together are
    checked by their whole shingle sets. Texts may be that much alike and have fingerprints further apart: a prefix
    filter over the shingles finds these, so that no link is lost (``jaccard``). Documents of equal shingle sets are
    one class. ``th`` is a hash of the text; ``first`` tells the documents of the component's least key, of one
    class of them.
    """
    prints = checkpoint(jaccard.prefixes(docs, words, similarity, text, key).withColumn("row", F.monotonically_increasing_id()))
    names = checkpoint(prints.groupBy("name").agg(F.min(key).alias("least"), F.min("row").alias("one"), F.count("*").alias("rows")))
    # one row of each set; what isn't wanted is few or narrow, and prefixes and bitmaps stay where they are
    copies = checkpoint(prints.select("name", "row").join(broadcast_if_few(names.where("rows > 1").select("name", "one")), "name").where("row <> one").select("row"))
    sets = prints.join(broadcast_if_few(copies), "row", "left_anti").select("name", "n", "prefix", "bits")
    found = jaccard.links(docs, sets, names.select("name", "least"), together(prints), words, similarity, text, key)
    codes = names.select(F.col("name").alias("fp"), "least")
    ids = _ids(codes, found, "class")
    rows = prints.select(key, "th", F.col("name").alias("fp")).join(ids, "fp")
    return rows.select(key, "th", "component_id", (F.col("fp").eqNullSafe(F.col("class")) & F.col(key).eqNullSafe(F.col("component_id"))).alias("first"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the least key; those without key stay.

    Where documents of one key differ, each is judged by its own text. Rows that agree in both are one document.
    """
    gone = checkpoint(near_duplicates(docs, text=text, key=key, **how).where(~F.col("first") & F.col(key).isNotNull()).select(F.col(key).alias("__gone"), F.col("th").alias("__th")).distinct())
    return docs.join(broadcast_if_few(gone), (docs[key] == F.col("__gone")) & (F.xxhash64(docs[text]) == F.col("__th")), "left_anti")
