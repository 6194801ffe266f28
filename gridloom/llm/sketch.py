"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k least distinct hashes of a text's shingles (``SHINGLE`` lower-cased words;
all words if there are fewer). Sketches merge: the k least of two sketches' union are the sketch of both
texts' shingles. They estimate resemblance (the share of common hashes among the k least of the union),
containment and the number of distinct shingles, all exactly while there are no more than k.

The query also sketches an edited text, which takes a part of the *next* document in descending order of ids.
Neighbours are found without a global window: ids are cut into ranges at quantiles, more ranges than
partitions; a text travels once, to its range; a range's head goes to the range above as well, where the
last document needs it. An id that holds more than a range's share of the rows, and the rows without id, have
several ranges, by the hash of the texts that orders them. Only the ranges' bounds and heads (a few numbers
a range) come to the driver.

DataFrame functions only. Defined results: null texts count as empty; a text without words has the empty
sketch; two empty sketches resemble each other by 1, an empty one and another by 0. Documents of one id are
ordered by a hash of their texts, those without id come last. A sole document is its own next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes in a sketch, words in a shingle.
K, SHINGLE = 256, 5
#: Ranges of ids for each shuffle partition, so that partitions even out.
RANGES = 4
_NONE = "array<bigint>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, even where ``then`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), then), 0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text that isn't null: at most k longs in ascending order."""

    def shingles(hashes: Column) -> Column:
        count = F.size(hashes)
        starts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(count - (shingle - 1), F.lit(1))))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, shingle)))

    return _least(F.array_distinct(_let(F.transform(words(text), lambda w: F.xxhash64(w)), shingles)), k)


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return _least(F.array_union(a, b), k)


def merge_groups(sketches: DataFrame, by: str, column: str = "sketch", k: int = K, salts: int = 16) -> DataFrame:
    """(by, column): one sketch for each group, by way of the least k of salted parts of it."""
    rows = sketches.select(by, F.explode(column).alias("h"))
    for keys in ([by, F.pmod(F.col("h"), F.lit(salts))], [by]):
        rows = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= k).select(by, "h")
    return rows.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(column))


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimate of the distinct shingles behind a sketch."""
    share = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard likeness of the texts' shingles."""

    def share(union: Column) -> Column:
        common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))

    return _let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has."""
    union = merge(a, b, k)
    both = resemblance(a, b, k) * distinct_count(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def written(s: Column) -> Column:
    """16 lower-case hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _range(ids: Column, bounds: list) -> Column:
    """How many bounds are not above the id (null: 0), searched in blocks."""
    if not bounds:
        return F.lit(0)
    block = 64
    every = F.array(*map(F.lit, bounds))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[block - 1 :: block])), lambda b: b <= ids)) * block
    return F.when(ids.isNull(), 0).otherwise(coarse + F.size(F.filter(F.slice(every, coarse + 1, block), lambda b: b <= ids)))


def _place(key: Column, order: Column, cuts: list, without: float, ranges: int) -> Column:
    """The number of a row's range, in descending order of keys (nulls last) and then ascending of ``order``, a hash.

    ``cuts`` are quantiles of the keys: one that comes up more than once is the key of more than a range's rows.
    """
    bounds = sorted(set(cuts))
    at = _range(key, bounds)
    part = (order.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    split = lambda n: F.least(F.floor(part * n), n - 1).cast("int")
    # pieces of the rows whose key is the bound itself; the range's other keys come before them
    pieces = [0] + [n + 1 if (n := cuts.count(b)) > 1 else 0 for b in bounds]
    starts, total = [0] * len(pieces), 0
    for r in range(len(pieces) - 1, -1, -1):
        starts[r], total = total, total + 1 + pieces[r]
    place = F.get(F.array(*map(F.lit, starts)), at)
    if any(pieces):
        own = F.get(F.array(*map(F.lit, pieces)), at)
        place = place + F.when((own > 0) & (F.get(F.array(*map(F.lit, bounds)), at - 1) == key), 1 + split(own)).otherwise(0)
    return F.when(key.isNull(), total + split(F.lit(max(1, math.ceil(without * ranges))))).otherwise(place).cast("int")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", order: str = "th", ranges: int | None = None) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row in descending order of ``key``; after the last: the first."""
    spark = docs.sparkSession
    n = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, rows, null = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)] if n > 1 else [0.5], max(10_000, 10 * n)), F.count("*"), F.count_if(F.col(key).isNull())).first()
    if not rows:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    at = _place(F.col(key), F.col(order), list(cuts or ()) if n > 1 else [], null / rows, n)
    # the first row of each range that has rows
    first = F.max(F.struct(F.col(key).alias("k"), F.bitwise_not(F.col(order)).alias("o")))
    heads = {r[0]: (r[1].k, ~r[1].o) for r in docs.select(at.alias("at"), key, order).groupBy("at").agg(first).collect()}
    used, kind = sorted(heads), dict(docs.dtypes)[key]
    before = {b: a for a, b in zip(used, used[1:])}
    slots = range(used[-1] + 1)
    head_key = F.get(F.array(*[F.lit(heads.get(i, (None,))[0]).cast(kind) for i in slots]), F.col("__at"))
    head_order = F.get(F.array(*[F.lit(heads[i][1] if i in heads else None).cast("bigint") for i in slots]), F.col("__at"))
    upper = F.get(F.array(*[F.lit(before.get(i)).cast("int") for i in slots]), F.col("__at"))
    is_head = F.col(key).eqNullSafe(head_key) & (F.col(order) == head_order)
    places = F.filter(
        F.array(
            F.struct(F.col("__at").alias("at"), F.lit(0).alias("ghost")),
            F.when(is_head & upper.isNotNull(), F.struct(upper.alias("at"), F.lit(1).alias("ghost"))),
            F.when(is_head & (F.col("__at") == used[0]), F.struct(F.lit(used[-1]).alias("at"), F.lit(2).alias("ghost"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = docs.withColumn("__at", at).withColumn("__place", F.explode(places))
    w = Window.partitionBy("__place.at").orderBy("__place.ghost", F.col(key).desc_nulls_last(), order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("__place.ghost = 0").drop("__at", "__place")


def report(docs: DataFrame) -> DataFrame:
    """The query's form: each document's sketch against its edited text's and its next document's."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("th", F.xxhash64("t")).withColumn("s", sketch(F.col("t")))
    out = with_next(t, ["t", "s"]).withColumn("n", F.length("t"))
    take = F.floor(F.col("n") / 3).cast("int")
    out = out.withColumn("edited", F.concat(F.substr("t", F.lit(1), F.col("n") - take), F.substr(F.col("next_t"), F.lit(1), take)))
    out = out.withColumn("es", sketch(F.col("edited")))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("s")).alias("fingerprint"),
        written(F.col("es")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("es")).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_s")).alias("near_next"),
    )
