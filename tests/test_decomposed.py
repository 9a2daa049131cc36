import random
import unicodedata

from pyspark.sql import functions as F

from veritree.functions import text
from veritree.operators import journal


def test_decomposition_equals_the_standard(spark):
    r = random.Random(1)
    several, _, marks, _ = text._decompositions()
    pool = [chr(r.randrange(0xAC00, 0xD7A4)) for _ in range(40)] + ["가", "힣"] + r.sample(several, 300) + r.sample(marks, 120) + list("abzAZ /.é") + ["𝒜", "😀", "ﬁ", "İ", "ß", "̈́", "ẛ̣", "Å", "Å"]
    rows = ["".join(r.choice(pool) for _ in range(r.randrange(0, 12))) for _ in range(600)] + ["plain", "", None, "q̣̇", "ṩ", "ṩ"] + list(several[::7])
    got = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", text.decomposed(F.col("t")).alias("d")).collect()
    for x in got:
        assert x.d == (None if rows[x.k] is None else unicodedata.normalize("NFD", rows[x.k])), rows[x.k]


def test_leaves_of_one_parent(spark):
    rows = [(1, "p", "Café"), (2, "p", "CAFÉ"), (3, "q", "café"), (4, "p", "cafe"), (5, "p", "café"), (6, None, "x")]
    got = {tuple(x) for x in journal.same_leaves(spark.createDataFrame(rows, "ordinal int, parent string, name string")).collect()}
    assert got == {(1, 2), (1, 5)}
