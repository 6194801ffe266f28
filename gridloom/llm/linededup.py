"""Deletes repeated runs of lines, found by winnowing over line hashes.

A *run* is a sequence of consecutive lines (blank lines don't count) with at least ``min_words`` words. A
line goes if it lies in a run that an identical run precedes, in the order of documents' keys and of lines
within a document; so the first occurrence of everything stays. A blank line goes with the windows below that it lies in.

The windows of the winnowing are the shortest runs that start at a line or end at one. Each window selects
the line of the least hash in it: a fingerprint. If a run repeats, so do the windows in it, and the
fingerprints that they select: none is missed. Only fingerprints that are selected at two places or more are
kept (an aggregate with partial sums), and their windows extend the match to both sides: those that are
identical to an earlier one are deleted, and as every run is the union of the windows that it holds, the
runs are deleted whole. Windows are compared with the first of their kind, never with each other.

DataFrame functions only. A common line costs a row for each place in a shuffle that splits by skew and is
otherwise aggregated before; nothing is gathered but the lines of one document.

Defined results: null and empty texts stay as they are and have no lines to delete. Rows that agree in key
and text count as one document and get the same result each. Documents without key come first; documents
with one key are ordered by a hash of their texts. Columns may have any name; the others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A run has so many words at least.
MIN_WORDS = 50
_WORD = r"[^ \t\x0B\f\r]+"


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, th, pos, h, w): hash and words of each line that isn't blank; th tells texts of one key apart.

    Rows that repeat count once, by partial aggregates, so that no number of them meets in one task.
    """
    split = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return split.withColumn("w", F.regexp_count("line", F.lit(_WORD)).cast("long")).where("w > 0").select("k", "th", "pos", F.xxhash64(F.trim("line")).alias("h"), "w").groupBy("k", "th", "pos").agg(F.min("h").alias("h"), F.min("w").alias("w"))


def fingerprints(of: DataFrame, min_words: int) -> DataFrame:
    """(k, th, p, fp, windows): the selected lines with the windows (wh, s, e) that selected them."""
    doc = Window.partitionBy("k", "th")
    run = of.withColumn("after", F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("w"))
    line = F.struct("h", "pos", "before", "after")
    run = run.select(
        "k",
        "th",
        F.collect_list(line).over(doc.orderBy("before").rangeBetween(0, min_words - 1)).alias("ahead"),
        F.collect_list(line).over(doc.orderBy("after").rangeBetween(1 - min_words, 0)).alias("behind"),
    )
    windows = run.select("k", "th", F.explode(F.array("ahead", "behind")).alias("win")).where(F.col("win")[F.size("win") - 1]["after"] - F.col("win")[0]["before"] >= min_words)
    least = F.array_min("win")
    windows = windows.select("k", "th", least["pos"].alias("p"), least["h"].alias("fp"), F.struct(F.xxhash64(F.col("win")["h"]).alias("wh"), F.col("win")[0]["pos"].alias("s"), F.col("win")[F.size("win") - 1]["pos"].alias("e")).alias("window"))
    return windows.groupBy("k", "th", "p", "fp").agg(F.collect_set("window").alias("windows"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, th, spans): the runs of lines to delete from each document that has any, as (s, e) by line number."""
    selected = written(fingerprints(lines(docs, text, key), min_words))
    place = F.struct("k", "th", "p")
    twice = selected.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("not low <=> high").select("fp")
    found = selected.join(twice, "fp", "left_semi").select("k", "th", "fp", F.explode("windows").alias("x")).select("k", "th", "fp", "x.*")
    start = F.struct("k", "th", "s")
    first = found.groupBy("fp", "wh").agg(F.min(start).alias("low"), F.max(start).alias("high")).where("not low <=> high").select("fp", "wh", "low")
    later = found.join(first, ["fp", "wh"]).where(~start.eqNullSafe(F.col("low")))
    return later.groupBy("k", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns ``__removed`` (numbers of the deleted lines) and ``__text`` (the rest of the text)."""
    gone = repeats(docs, min_words, text, key).select(F.col("k").alias("__k"), F.col("th").alias("__th"), F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"]))))).alias("__removed"))
    out = docs.join(gone, docs[key].eqNullSafe(F.col("__k")) & (F.xxhash64(docs[text]) == F.col("__th")), "left").drop("__k", "__th")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    out = out.withColumn("__text", F.when(F.col("__removed").isNull(), F.col(text)).otherwise(rest))
    return out.withColumn("__removed", F.coalesce("__removed", F.array().cast("array<int>")))


def report(docs: DataFrame) -> DataFrame:
    """The query's form: what goes from each document, and what stays."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("__removed").cast("long").alias("n_removed"), F.array_join(F.col("__removed").cast("array<string>"), ",").alias("removed"), F.col("__text").alias("text"))


#: The same rows in SQL, by comparing all windows with each other's texts.
ORACLE = f"""
with line as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
counted as (select doc_id, pos, trim(t) as t, len(regexp_extract_all(t, '[^ \\t\\x0B\\f\\r]+')) as w from line),
run as (select *, sum(w) over (partition by doc_id order by pos)::bigint as after from counted where w > 0),
win as (
  select doc_id, pos as s, max(pos) over f as e, string_agg(t, chr(10)) over f as content, max(after) over f - (after - w) as words
  from run window f as (partition by doc_id order by after - w range between current row and {MIN_WORDS - 1} following)
  union all
  select doc_id, min(pos) over f as s, pos as e, string_agg(t, chr(10)) over f as content, after - min(after - w) over f as words
  from run window f as (partition by doc_id order by after range between {MIN_WORDS - 1} preceding and current row)
),
later as (select doc_id, s, e from (select *, rank() over (partition by content order by doc_id, s) as r from win where words >= {MIN_WORDS}) where r > 1),
gone as (select distinct l.doc_id, l.pos, l.t from line l join later x on l.doc_id = x.doc_id and l.pos between x.s and x.e)
select d.doc_id, coalesce(g.n, 0)::bigint as n_removed, coalesce(g.removed, '') as removed,
  case when g.n is null then d.text else coalesce(k.text, '') end as text
from documents d
left join (select doc_id, count(*) as n, string_agg(pos::varchar, ',' order by pos) as removed from gone group by doc_id) g on d.doc_id = g.doc_id
left join (select l.doc_id, string_agg(l.t, chr(10) order by l.pos) as text from line l where not exists (select 1 from gone x where x.doc_id = l.doc_id and x.pos = l.pos) group by l.doc_id) k on d.doc_id = k.doc_id
"""
