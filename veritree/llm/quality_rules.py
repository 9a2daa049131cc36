"""Quality rules: a rule bitmask ledger.

`ledger` reads each text once and stores, per document, the measurements and one failure bit per
rule. Policies are versioned masks over those bits: `apply_policy` decides documents, and `ablation`
says what each rule of a policy costs, both from the ledger alone and without reading texts again.
All of it is built-in SQL functions in one projection over the scan; no shuffle is needed except for
the ablation's one-row-per-task aggregate.

Null or empty text has no words, all measurements are 0, and it fails `few_words`. Repeated rows are
judged alike and each keeps its row. Extra columns, whatever their names, are carried by `ledger`
only when named in `keep`; measurements are computed under private names first, so an input column
called `n_words` cannot clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import SPACE_CLASS, WORD_CHAR, words, written

SYMBOLS = "[#*$%&|<>]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in bit order: a name and, over the measurements, the SQL condition for failure. Rules are only ever appended, so that stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)

BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version; a document is kept if it fails none of the policy's rules.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": BIT["few_words"] | BIT["repeated_windows"] | BIT["symbol_heavy"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
}


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; w: array<string>.

    Window hashes are compared after a sort beside their positions, so a text of n words costs
    n log n. Texts without any repeated window skip the sort.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def _covered(h: Column) -> Column:
    rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, j: F.element_at(s, j)["h"]
    # s: the rows in order; a row counts if a neighbour has its hash. element_at is 1-based, j is 0-based.
    at = F.transform(
        F.array(rows),
        lambda s: F.filter(
            s,
            lambda x, j: ((j > 0) & (same(s, F.greatest(j, F.lit(1))) == x["h"])) | ((j < F.size(s) - 1) & (same(s, F.least(j + 2, F.size(s))) == x["h"])),
        ),
    )
    starts = F.element_at(at, 1)["i"]
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the `keep` columns, the measurements (long), and fail_bits (long)."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    df = docs.select(F.col(key), *[F.col(c) for c in keep if c != key], F.col(text).alias("__t"))
    df = df.withColumn("__w", words(F.col("__t")))
    df = df.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR)))
    df = df.withColumn("__h", _repeated_words(F.col("__w")))
    long = lambda c: c.cast("long")
    measures = F.struct(
        long(F.size("__w")).alias("n_words"),
        long(F.length(F.regexp_replace(t, SPACE_CLASS + "+", ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("__l")).alias("n_lines"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        long(F.when(F.size(F.array_distinct("__h")) == F.size("__h"), 0).otherwise(_covered(F.col("__h")))).alias("n_repeat_words"),
    )
    # a generator of one row: conditions on the measurements stay above it, else the optimizer would evaluate the texts' arrays again inside them, for each element
    df = df.select(key, *[c for c in keep if c != key], F.inline(F.array(measures)))
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fail_bits", bits)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: rules are evaluated once, and any number of policies and ablations read only numbers."""
    return written(ledger(docs, key, text), "ledger")


def apply_policy(led: DataFrame, policy: str | int = "v1") -> DataFrame:
    """The ledger with `kept`: no bit of the policy's mask is set."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(led: DataFrame, policy: str | int = "v1") -> DataFrame:
    """One row per rule of the policy: documents it fails, documents only it fails (those that leaving it out would keep), kept with and without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    inside = [(i, name) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = led.select(hit.alias("hit")).agg(
        count(F.col("hit") == 0).alias("kept"),
        *[count(F.col("hit").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"f{i}") for i, _ in inside],
        *[count(F.col("hit") == (1 << i)).alias(f"o{i}") for i, _ in inside],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"o{i}")).alias("n_kept_without")) for i, n in inside])
    return one.select(F.inline(rows))


def filtered(docs: DataFrame, policy: str | int = "v1") -> DataFrame:
    """The documents the policy keeps, with their own columns: one pass over the scan, no join."""
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("__row"), F.col("text").alias("__text"))
    return apply_policy(ledger(inner, key="__row", text="__text"), policy).filter("kept").select("__row.*")
