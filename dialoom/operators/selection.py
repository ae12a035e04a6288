"""Exact numbers of rows in a shuffled order, without sorting the table.

The rank of a row is found by counting: how many rows each prefix of the hash
has, two bytes at a time, comes to the driver as at most 65,536 numbers. The
row that ends a part is then known by its hash and key, and a filter cuts the
table there; no row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.rand import shuffle_key

#: Hexadecimal digits of a hash that are counted at once.
DIGITS = 4


@dataclass(frozen=True)
class Cut:
    """The row of a rank: its hash and key, how many rows lie before it and how many are equal to it."""

    h: str
    key: object
    before: int
    copies: int


def _prefix(n: int) -> Column:
    return F.substring("h", 1, n)


def cuts(rows: DataFrame, ranks: list[int]) -> list[Cut]:
    """The row of each rank, from 1, of (h, key) in their order; h is hexadecimal."""
    if not ranks:
        return []
    out: dict[int, Cut] = {}
    open_ = {r: ("", 0) for r in ranks}  # rank -> prefix that holds it, rows before that prefix
    for _ in range(2):
        known = sorted({p for p, _ in open_.values()})
        some = rows if known == [""] else rows.where(_prefix(len(known[0])).isin(known))
        n = len(known[0]) + DIGITS
        counts = sorted((r.p, r.n) for r in some.groupBy(_prefix(n).alias("p")).agg(F.count("*").alias("n")).collect())
        for rank, (prefix, before) in open_.items():
            for p, k in counts:
                if p.startswith(prefix):
                    if before + k >= rank:
                        open_[rank] = (p, before)
                        break
                    before += k
    # of a prefix of four bytes few keys are left, however many rows they have
    for prefix in {p for p, _ in open_.values()}:
        keys = sorted(((r.h, r.key, r.n) for r in rows.where(F.col("h").startswith(prefix)).groupBy("h", "key").agg(F.count("*").alias("n")).collect()), key=lambda r: r[:2])
        for rank, (p, before) in open_.items():
            if p == prefix:
                for h, key, k in keys:
                    if before + k >= rank:
                        out[rank] = Cut(h, key, before, k)
                        break
                    before += k
    return [out[r] for r in ranks]


def parted(df: DataFrame, key: str, seed: str, sizes: list[int], name: str = "part") -> DataFrame:
    """df with the number of its part, from 0: the first sizes[0] rows of the shuffled order, the next sizes[1], and so on; rows beyond are part len(sizes).

    Rows of a null key come first. Rows that share the key in which a part ends
    are told apart in any order.
    """
    k = F.col(key)
    h = F.coalesce(shuffle_key(seed, key), F.lit("0" * 32))
    rows = df.select(h.alias("h"), k.alias("key"))
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    asked = sorted({e for e in ends if e > 0})
    n = df.count()
    at = dict(zip([e for e in asked if e < n], cuts(rows, [e for e in asked if e < n])))
    part, split = F.lit(0), []
    for e in ends:
        if e <= 0:
            part = part + F.lit(1)
        elif e in at:
            c = at[e]
            beyond = (h > c.h) | ((h == c.h) & (F.lit(False) if c.key is None else k > F.lit(c.key)))
            part = part + beyond.cast("int")
            if c.before + c.copies > e:
                split.append((e, c))
    if not split:
        return df.withColumn(name, part)
    # copies of a key on both sides of an end: their numbers decide
    same = lambda c: k.eqNullSafe(F.lit(c.key))
    torn = F.lit(False)
    for _, c in split:
        torn = torn | same(c)
    rank = F.lit(0)
    for _, c in split:
        rank = F.when(same(c), F.lit(c.before)).otherwise(rank)
    number = rank + F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    beyond = F.lit(0)
    for e in ends:
        beyond = beyond + (F.col("__n") > e).cast("int")
    tied = df.where(torn).withColumn("__n", number).withColumn(name, beyond).drop("__n")
    return df.where(~torn).withColumn(name, part).unionByName(tied)


def first_rows(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows, the first of the shuffled order; all if there are fewer."""
    return parted(df, key, seed, [n], "__part").where("__part = 0").drop("__part")


def numbered(df: DataFrame, key: str, seed: str, name: str = "rn") -> DataFrame:
    """The place of each row, from 1, in the shuffled order.

    Rows of equal two first bytes of the hash are ordered together; how many
    there are before them is one of at most 65,536 numbers that are joined back.
    """
    h = F.coalesce(shuffle_key(seed, key), F.lit("0" * 32))
    rows = df.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, DIGITS))
    sizes = {r["__p"]: r["n"] for r in rows.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(offsets, "__p string, __at bigint")
    order = Window.partitionBy("__p").orderBy("__h", key)
    return rows.join(F.broadcast(table), "__p").withColumn(name, F.col("__at") + F.row_number().over(order)).drop("__p", "__at", "__h")
