"""Line dedup by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, joined, table

#: A repeated run has this many lines at least, or is one line of this many words at least.
RUN, LONG_LINE = 2, 50
#: What is trimmed of lines: the word separators but for the newline.
SPACES = " \t\v\f\r"


def _least(window: Column) -> Column:
    """Place in the text of the smallest hash of a window, the last of equal ones."""
    return -F.array_min(F.transform(window, lambda x: F.struct(x["h"], -x["k"])))["col2"]


def fingerprints(docs: DataFrame, run: int, long_line: int) -> DataFrame:
    """doc_id, same, fp, k, around, long: one row for each selected line.

    Lines are trimmed of white space, blank ones don't count. Selected is the smallest hash of each window of ``run`` lines (the last
    of equal ones), once where several windows have it, and each long line. So every run of ``run`` lines holds a
    selected one, and equal runs have it at the same place. around: the ``run`` - 1 lines to either side and the line
    itself, each with its hash h, its number k among the lines that count and its number i in the text.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(SPACES)).alias("x")))
    full = F.transform(
        F.filter(lines, lambda s: s["x"] != ""),
        lambda s, k: F.struct(s["i"].alias("i"), (k + 1).alias("k"), F.xxhash64(s["x"]).alias("h"), F.when(F.regexp_count(s["x"], F.lit(WORD)) >= long_line, F.xxhash64(F.lit("line"), s["x"])).alias("long")),
    )
    rows = docs.select("doc_id", "same", full.alias("lines")).where(F.size("lines") > 0)
    minima = F.transform(F.sequence(F.lit(1), F.greatest(F.size("lines") - run + 1, F.lit(1))), lambda s: _least(F.slice("lines", s, run)))
    long = F.transform(F.filter("lines", lambda x: x["long"].isNotNull()), lambda x: x["k"])
    chosen = F.array_distinct(F.concat(F.when(F.size("lines") >= run, minima).otherwise(F.array().cast("array<int>")), long))
    at = rows.select("doc_id", "same", "lines", F.explode(chosen).alias("k"))
    low = F.greatest(F.col("k") - run + 1, F.lit(1))
    around = F.transform(F.slice("lines", low, F.col("k") + run - low), lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"), x["i"].alias("i")))
    return at.select("doc_id", "same", F.element_at("lines", F.col("k"))["h"].alias("fp"), "k", around.alias("around"), F.element_at("lines", F.col("k"))["long"].alias("long"))


def repeated_lines(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, same, removed: numbers of the lines that lie in a run that occurs earlier.

    Positions are joined by fingerprint, and only those whose fingerprint has another position go on. There a match is
    extended to both sides: over each window that has the fingerprint as its minimum, and so on over the next
    fingerprints' windows. Of equal windows the first (by doc_id, then place) stays, the lines of all later ones go.
    Counts and firsts are aggregated before the shuffle, no pairs are made, and crowded keys are joined by broadcast.
    """
    places = cut(fingerprints(docs, run, long_line))
    total = places.count()
    twice = places.groupBy("fp").agg(F.count("*").alias("of")).where("of > 1")
    matched = joined(places, twice, ["fp"], total)

    def window(t: Column) -> Column:
        return F.slice("around", t + 1, run)

    sides = F.filter(F.sequence(F.lit(0), F.greatest(F.size("around") - run, F.lit(0))), lambda t: (F.size(window(t)) == run) & (_least(window(t)) == F.col("k")))
    runs = F.transform(sides, lambda t: F.struct(F.transform(window(t), lambda x: x["h"]).alias("key"), F.transform(window(t), lambda x: x["i"]).alias("at")))
    own = F.element_at(F.filter("around", lambda x: x["k"] == F.col("k")), 1)["i"]
    single = F.when(F.col("long").isNotNull(), F.array(F.struct(F.array("fp", "long", "long").alias("key"), F.array(own).alias("at")))).otherwise(F.array().cast("array<struct<key:array<bigint>,at:array<int>>>"))
    windows = cut(matched.select("doc_id", "same", F.explode(F.concat(runs, single)).alias("w")).select("doc_id", "same", "w.key", "w.at"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", F.element_at("at", 1).alias("at"))
    first = windows.groupBy("key").agg(F.count("*").alias("of"), F.min(place).alias("first")).where("of > 1")
    later = joined(windows, first, ["key"], total).where(place != F.col("first"))
    return later.select("doc_id", "same", F.explode("at").alias("i")).groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("i")).alias("removed"))


def dedup_lines(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """docs with repeated runs of lines cut from text, and n_lines, n_removed in place of columns of those names.

    A run is ``run`` lines in a row, or one line of ``long_line`` words; all but its first occurrence (smallest
    doc_id, null last, then place in the text) goes, within a document too. Runs are judged on the input. A
    null text stays null, with 0 lines; a text from which nothing goes stays as it is. Rows with equal doc_id
    and text are one document and get one result. Other columns stay, whatever their names. An empty table gives an
    empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.xxhash64("row.text").alias("same"))
    texts = own.select("row.doc_id", "same", "row.text").where("text is not null")
    gone = repeated_lines(texts, run, long_line).select(F.col("doc_id").alias("id"), F.col("same").alias("hash"), "removed")
    text = F.col("row.text")
    lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.get(lines, i))
    return own.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("hash")), "left").select(
        *((F.when(F.col("removed").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in docs.columns),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of all documents, runs of two lines or one of 50 words."""
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _sql(run: int, long_line: int) -> str:
    window = " || chr(10) || ".join(f"lead(x, {j}) over w" if j else "x" for j in range(run))
    return rf"""
with l as (select doc_id, text, unnest(range(len(string_split(text, chr(10)))))::int as i, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as x from documents where text is not null),
f as (select * from l where x <> ''),
k as (select doc_id, text, i, {window} as key, array[{", ".join(f"lead(i, {j}) over w" if j else "i" for j in range(run))}] as ats from f window w as (partition by doc_id, text order by i)),
a as (select doc_id, text, i, key, ats from k where key is not null
  union all select doc_id, text, i, x, array[i] from f where len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {long_line}),
g as (select *, row_number() over (partition by key, len(ats) order by doc_id nulls last, i) as r from a),
m as (select doc_id, text, list(distinct u) as gone from (select doc_id, text, unnest(ats) as u from g where r > 1) group by all)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(case when gone is null then d.text else array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda z: not list_contains(gone, z)), lambda z: string_split(d.text, chr(10))[z + 1]), chr(10)) end, '')) as kept_sha256
from documents d left join m on d.doc_id is not distinct from m.doc_id and d.text = m.text
"""


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": _sql(RUN, LONG_LINE)}
