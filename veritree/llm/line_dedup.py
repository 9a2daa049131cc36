"""Line dedup by distinct-site spread.

Each line's spread is the number of distinct sites it occurs on. Per line hash, HyperLogLog sketches of
sites are built in every task and merged by aggregation; estimates far from the threshold decide, and
lines near it get exact distinct counts. Lines spread over `min_sites` sites or more are boilerplate and
are removed from every document that has lines of its own. A document without any, all of whose lines are spread, is not a page with
boilerplate but a copy of others; it is left whole for near-duplicate removal, as its text would be lost otherwise.

Lines are \\n-split and compared without white space at their ends; lines without a word are never
boilerplate. Null text stays null and has no lines; null site counts as a site of its own. Repeated rows
are treated alike, and rows of one doc_id each by their own text; null doc_id is carried. An empty table gives an empty table.
Documents keep their other columns, whatever their names.

Scale: lines shuffle as 64-bit hashes with sketches that merge map-side, so a line on a third of all
rows costs one sketch per task. The set of boilerplate hashes joins back to (row, line) pairs on the hash; only
the lists of removed lines' places, one row per touched text, meet the documents again, on doc_id and the text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import WORD_CHAR, scratch, written

MIN_SITES = 5
LG_K = 12
#: Six standard errors of a sketch with 2^12 registers: estimates further off than that decide without an exact count.
MARGIN = 0.1


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """doc_id, t (hash of the text), site, h and place (from 0) of each line with a word."""
    marked = F.transform(_lines(F.col(text)), lambda x, i: F.struct(F.when(x.rlike(WORD_CHAR), line_hash(x)).alias("h"), i.alias("place")))
    rows = docs.select(F.col(key).alias("doc_id"), _text_hash(F.col(text)).alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.explode(marked).alias("l"))
    return rows.select("doc_id", "t", "site", "l.h", "l.place").filter("h is not null")


def spread_lines(occ: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h of the lines that occur on min_sites sites or more; exact."""
    sketched = occ.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = written(sketched.filter(F.col("sites") > min_sites * (1 - MARGIN) - 1), "spread")
    sure = sketched.filter(F.col("sites") > min_sites * (1 + MARGIN) + 1).select("h")
    near = sketched.filter(F.col("sites") <= min_sites * (1 + MARGIN) + 1).select("h")
    exact = occ.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h")
    return sure.unionByName(exact)


def removal(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """doc_id, t and the places of spread lines, for texts that have any; written."""
    with scratch(docs.sparkSession) as keep:
        occ = written(occurrences(docs, key, text, site), "lines")
        return keep(written(occ.join(spread_lines(occ, min_sites), "h", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("place").alias("places")), "places"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """__row (the document as it came), lines (long), removed (long) and clean (its text without boilerplate)."""
    gone = removal(docs, min_sites, key, text, site).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("places").alias("__places"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    t = F.col("__row")[text]
    both = rows.join(gone, rows["__row"][key].eqNullSafe(gone["__id"]) & (_text_hash(rows["__row"][text]) == gone["__t"]), "left")
    both = both.select("__row", "__places", _lines(t).alias("__l")).withColumn("n_lines", F.size(F.filter("__l", lambda x: x.rlike(WORD_CHAR))))
    whole = F.col("__places").isNull() | (F.size("__places") == F.col("n_lines"))
    # lines with their places are distinct, so one hash set takes out those that go
    numbered = lambda i, x: F.concat(i.cast("string"), F.lit(":"), x)
    left = F.array_except(F.transform("__l", lambda x, i: numbered(i, x)), F.transform("__places", lambda i: numbered(i, F.element_at("__l", i + 1))))
    clean = F.array_join(F.transform(left, lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x))), "\n")
    return both.select(
        "__row",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size("__places")).cast("long").alias("n_removed"),
        F.when(whole, t).otherwise(clean).alias("clean"),
    )


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with boilerplate lines removed, all their columns kept; n_chars, where there is one, follows the text."""
    out = cleaned(docs, min_sites)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row")["n_chars"]).alias("n_chars"))
        else:
            cols.append(F.col("__row")[c].alias(c))
    return out.select(*cols)
