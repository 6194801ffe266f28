"""Benchmark decontamination: a hash set of test n-grams, scanned over all windows of the documents.

Texts are lower-cased in A-Z and cut into words at ASCII characters other than letters and digits. A window
is ``size`` consecutive words of a benchmark item (all its words if it has fewer). The windows' hashes are the
set: a bitmap of at least 64 bits for each window, but of no more than ``MOST_BITS``, that goes with the plan. Each
document is scanned in its own row, without a shuffle: a place whose words' hash is in the bitmap is a candidate.
Candidates alone are joined with the benchmark's windows, word by word, and the hits summed by document: of a
clean document one narrow row goes through that shuffle.

The plan is the same for any benchmark. With more windows than the bitmap has room for, more places are
candidates and the join sorts them out; the windows are broadcast up to ``MOST_BYTES`` and shuffled beyond.

DataFrame functions only. Defined results: each row of the input gives one row; null, empty and wordless texts
have no words and no hits; wordless items match nothing; items with equal windows all count. An empty
benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, checkpoint

WINDOW = 10
#: Most bits of the bitmap (2 MB), and bytes of windows that are broadcast.
MOST_BITS, MOST_BYTES = 1 << 24, 1 << 26
_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text, in order."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(lower, _CUT), ""), F.array().cast("array<string>"))


def bitmap(hashes: DataFrame, most: int = MOST_BITS) -> tuple[str, int]:
    """SQL of an array of longs in which the bit of each ``hash`` is set, and their number, a power of two."""
    bits = 1 << 12
    count = hashes.count()
    while bits < min(most, 64 * count):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    # at most bits / 64 rows
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = [0] * (bits // 64)
    for w, b in words:
        out[w] = b
    return f"cast(split('{','.join(map(str, out))}', ',') as array<bigint>)", len(out)


def _found(size: int, known: str, longs: int) -> Column:
    """The places of a document (w, h, n) whose ``size`` words have a hash in the bitmap."""
    hashes = f"transform(if(n >= {size}, sequence(1, n - {size} + 1), cast(array() as array<int>)), i -> xxhash64(slice(h, i, {size})))"
    # the bitmap is a constant that is folded once
    test = f"(shiftright(get({known}, cast(shiftright(x, 6) & {longs - 1} as int)), cast(x & 63 as int)) & 1) = 1"
    at = F.expr(f"filter(transform({hashes}, (x, i) -> if({test}, named_struct('at', i, 'hash', x), null)), y -> y is not null)")
    return F.transform(at, lambda y: F.struct(F.lit(size).alias("size"), y["hash"].alias("hash"), y["at"].alias("at"), F.slice(F.col("w"), y["at"] + 1, size).alias("gram")))


def windows(benchmark: DataFrame, size: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """(size, hash, gram, item): the different windows of each item."""
    w = benchmark.select(F.col(item).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    cut = w.select("item", "w", F.least(F.size("w"), F.lit(size)).alias("size"))
    rows = cut.select("item", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.slice(F.col("w"), i + 1, F.col("size")))).alias("gram"))
    return rows.distinct().select("size", F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("hash"), "gram", "item")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", most_bits: int = MOST_BITS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, th, n_words, places, items) for each row: a hash of the text, hit word positions, sorted, and the ids of the items that occur."""
    grams = checkpoint(windows(benchmark, size, text="text", item=item).groupBy("size", "hash", "gram").agg(F.collect_set("item").alias("of")))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most ``size`` of them
    room = grams.agg(F.sum(F.aggregate("gram", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16) + 8 * F.size("of") + 64)).first()[0] or 0
    known, longs = bitmap(grams.select("hash").distinct(), most_bits)
    base = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.xxhash64(text).alias("th"), words(text).alias("w"))
    base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("w"))
    found = F.array().cast("array<struct<size:int,hash:bigint,at:int,gram:array<string>>>")
    for n in sizes:
        found = F.concat(found, _found(n, known, longs))
    row = ("r", "k", "th", "n")
    rows = base.select(*row, found.alias("found")).select(*row, F.explode_outer("found").alias("f")).select(*row, "f.*")
    # a row that has no candidate meets nothing, wherever it is sent
    rows = rows.withColumns({"hash": F.coalesce("hash", "r"), "size": F.coalesce("size", F.lit(-1)), "gram": F.coalesce("gram", F.array().cast("array<string>"))})
    rows = rows.join(F.broadcast(grams) if room <= most_bytes else grams, ["size", "hash", "gram"], "left")
    places = F.when(F.col("of").isNotNull(), F.sequence("at", F.col("at") + F.col("size") - 1))
    out = rows.groupBy(*row).agg(F.collect_list(places).alias("p"), F.collect_set("of").alias("i"))
    return out.select(F.col("k").alias(key), "th", F.col("n").alias("n_words"), F.array_sort(F.array_distinct(F.flatten("p"))).alias("places"), F.array_distinct(F.flatten("i")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's form."""
    out = hits(docs, benchmark)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    bad = checkpoint(hits(docs, benchmark, size, text, key).where(F.size("places") > 0).select(F.col(key).alias("__k"), F.col("th").alias("__th")).distinct())
    return docs.join(broadcast_if_few(bad), docs[key].eqNullSafe(F.col("__k")) & (F.xxhash64(docs[text]) == F.col("__th")), "left_anti")


#: The same rows in SQL.
ORACLE = f"""
with d as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] as w from documents),
b as (select item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] as w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as g from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
place as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
item as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join place using (doc_id) left join item using (doc_id)
"""
