"""Secret scans that link the parts of multipart credentials.

Strong parts are reported wherever they stand: an assignment of a secret (``assign``), an access identifier
(``access``) and a long hexadecimal run (``hex``). Weak parts mean nothing on their own: a key of 20 or more
mixed characters (``key``), an account name that is assigned (``user``) and an endpoint (``endpoint``: a URL, a
host with a port, or an IPv4 address). An interval join within each document looks for complementary parts
in scope, no more than ``SCOPE`` code points between the two: a weak key needs an access identifier or a
user; a user needs a weak key, an assignment or an access identifier; an endpoint needs an assignment, an
access identifier or a hexadecimal run. The join is by windows with a range of positions: each weak part
meets the parts in its scope, of which code points allow a bounded number. What comes out are the links, a weak
part with each of its complements and the distance between them, and the weak parts that have one.

Positions are code points, ends exclusive. A match's start is the length of what ``split`` leaves before it,
so the scan needs built-in functions only; the second pass over a text is made only if it has a match. One
row for each part goes through the window's shuffle, and the documents' own texts never do.

DataFrame functions only. Defined results: each row of the input gives one row; null and empty texts have no
parts; rows that repeat, and rows without id, are scanned each by itself, so that no number of them meets in
one task. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between two parts that belong together, at most.
SCOPE = 200

# The patterns of the kinds, in their order, with the least length of a group that a match needs.
KINDS = {
    "assign": (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    "key": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9+/A-Z]*[a-z])(?=[0-9+/a-z]*[A-Z])[A-Za-z0-9+/]{20,}", 0, 20),
    "user": (r"(?i)(?<![a-z])(?:user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9._@-]+", 0, 3),
    "endpoint": (r"(?:https?|ftp|jdbc:[a-z]+|s3)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]+)?|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:[0-9]{1,5}(?![0-9])", 0, 3),
}
BASE = ("assign", "access", "hex")
#: What a weak kind needs in its scope.
NEEDS = {"key": ("access", "user"), "user": ("key", "assign", "access"), "endpoint": ("assign", "access", "hex")}


def _matches(text: Column, kind: str) -> Column:
    """(rank, i, gap, n, g): for each match its number, the code points since the last one, its own and its group's."""
    pattern, group, _ = KINDS[kind]
    # Java's split leaves what is between the matches, which regexp_extract_all finds by the same rule
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("b"))
    rank = list(KINDS).index(kind)

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(F.regexp_extract(x["m"], pattern, group) if group else x["m"]).alias("g"))

    return F.when(text.rlike(pattern), F.transform(pairs, one)).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,n:int,g:int>>"))


#: What tells the rows of the input apart: number of the row, key.
_ROW = ("r", "k")


def parts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(r, k, rank, s, e): all parts, strong and weak; a document without any gives one row of nulls.

    One shuffle, of the matches alone, brings a document's parts together for all that follows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_matches(t, kind) for kind in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), found.alias("x"))
    rows = rows.select(*_ROW, F.explode_outer("x").alias("x")).select(*_ROW, "x.*").repartition(*_ROW)
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(*_ROW, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.select(*_ROW, "rank", "g", (end - F.col("n")).alias("s"), end.alias("e"))
    enough = F.create_map(*[F.lit(x) for i, (_, _, least) in enumerate(KINDS.values()) for x in (i, least)])
    ok = F.col("g") >= enough[F.col("rank")]
    # a match that fails leaves a row of nulls, so that its document stays
    return rows.select(*_ROW, *[F.when(ok, F.col(c)).alias(c) for c in ("rank", "s", "e")])


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(r, k, rank, s, e, links): the strong parts, and the weak ones with a complement in scope; nulls for a document without.

    ``links`` are a weak part's complements as (s, rank, e, distance), by place; empty for strong parts.
    """
    ranks = list(KINDS)
    # a part is met at its start and its end, and in between if it is longer than a scope
    points = found.withColumn("at", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.concat(F.sequence("s", "e", F.lit(max(1, scope))), F.array("e")))))
    doc = Window.partitionBy(*_ROW).orderBy("at").rangeBetween(-scope, scope)
    near = F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "rank", "e"))).over(doc)
    needs = F.lit(False)
    for weak, need in NEEDS.items():
        needs = needs | ((F.col("rank") == ranks.index(weak)) & F.col("x.rank").isin(*[ranks.index(k) for k in need]))
    distance = F.greatest(F.col("x.s") - F.col("e"), F.col("s") - F.col("x.e"), F.lit(0))
    # one row for each point of a weak part and each part in its scope
    met = points.withColumn("near", near).withColumn("x", F.explode_outer(F.when(F.col("rank") >= len(BASE), F.col("near"))))
    fits = needs & (distance <= scope)
    one = F.when(fits, F.struct(F.col("x.s").alias("s"), F.col("x.rank").alias("rank"), F.col("x.e").alias("e"), distance.alias("distance")))
    out = met.groupBy(*_ROW, "rank", "s", "e").agg(F.array_sort(F.collect_set(one)).alias("links"))
    keep = (F.col("rank") < len(BASE)) | (F.size("links") > 0)
    return out.select(*_ROW, *[F.when(keep, F.col(c)).alias(c) for c in ("rank", "s", "e")], "links")


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans) for each row: the reported parts, (s, rank, e, links) by start and then kind."""
    out = link(parts(docs, text, key), scope)
    span = F.when(F.col("rank").isNotNull(), F.struct("s", "rank", "e", "links"))
    return out.groupBy(*_ROW).agg(F.array_sort(F.collect_list(span)).alias("spans")).select(F.col("k").alias(key), "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"], x["e"])), ",")


def linked(spans: Column) -> Column:
    """kind:start:end>kind:start:end:distance for each link of a weak part, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    pairs = F.flatten(F.transform(spans, lambda a: F.transform(a["links"], lambda b: F.concat_ws(":", F.get(names, a["rank"]), a["s"], F.concat_ws(">", a["e"], F.get(names, b["rank"])), b["s"], b["e"], b["distance"]))))
    return F.array_join(pairs, ",")


def report(docs: DataFrame) -> DataFrame:
    """The query's form."""
    out = scan(docs)
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return out.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), linked(F.col("spans")).alias("links"))
