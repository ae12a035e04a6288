"""The persona bank and the sampling of personas, reproducible for every partitioning."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions.rand import shuffle_key, uniform
from dialoom.sources.storage import checkpointed


@dataclass(frozen=True)
class Dimension:
    name: str
    category: str
    is_constraint: bool
    values: tuple[str, ...]


def default_bank() -> list[Dimension]:
    """Our own bank: 33 dimensions, 275 values; sizes and kinds follow a rule, eight have an `others` value."""
    out = []
    for i in range(33):
        kind = "basic_info" if i < 10 else "behavioral" if i < 24 else "constraint"
        n = 8 + (i % 3 == 0) + (i % 11 == 5)
        n = n if i else n - 3
        values = [f"d{i:02d}_v{k}" for k in range(n)]
        if i % 4 == 1:
            values[-1] = "others"
        out.append(Dimension(f"dim_{i:02d}", kind, i >= 24 or i % 3 == 1 and i < 21, tuple(values)))
    return out


def read_bank(path: str) -> list[Dimension]:
    """The bank of a YAML or JSON file: its `dimensions`, in order; a bank without any is empty."""
    from dialoom.sources.config import load

    bank = [Dimension(d.get("name") or "", d.get("category") or "", bool(d.get("is_constraint")), tuple(str(v) for v in d.get("values") or ())) for d in load(path).get("dimensions") or []]
    validate(bank)
    return bank


BANK_SCHEMA = "ord int, name string, category string, is_constraint boolean, `values` array<string>"


#: Rows of a task where a row is small but dear to work on.
TASK_ROWS = 8192


def spread(rows: DataFrame, count: int, key: str) -> DataFrame:
    """rows dealt by key into tasks of about TASK_ROWS, for count rows.

    After a shuffle Spark joins tasks up to a size in bytes, and millions of
    small rows would come to one; a number that is asked for stays.
    """
    return rows.repartition(max(1, -(-count // TASK_ROWS)), key)


def bank_frame(spark: SparkSession, bank: list[Dimension]) -> DataFrame:
    validate(bank)
    return spark.createDataFrame([(i, d.name, d.category, d.is_constraint, list(d.values)) for i, d in enumerate(bank)], BANK_SCHEMA)


def validate(bank: list[Dimension]) -> None:
    """Each dimension has a name of its own and values."""
    if any(not d.name or not d.values for d in bank) or len({d.name for d in bank}) != len(bank):
        raise ValueError("a dimension lacks a name or values, or shares its name")


def dimension(bank: list[Dimension], name: str) -> Dimension:
    for d in bank:
        if d.name == name:
            return d
    raise KeyError(name)


def _dims(bank: list[Dimension]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d.name).alias("name"), F.lit(d.is_constraint).alias("con"), F.array(*[F.lit(v) for v in d.values]).alias("vals")) for i, d in enumerate(bank)])


def sample_personas(ids: DataFrame, bank: list[Dimension], seed: str, rate: float = 0.7, constraint_rate: float = 0.7, least: int = 15, most: int = 15, required: tuple[str, ...] = (), key: str = "persona_id", attempt: Column | None = None) -> DataFrame:
    """features: an array of (ord, name, value) for each id, in bank order.

    Required dimensions are always in; each other one joins with its rate;
    then random ones are added or left out to meet the bounds. All of it is an
    expression over the bank as a literal: no join, no shuffle.
    """
    k = F.col(key) if attempt is None else F.concat_ws("/", F.col(key).cast("string"), attempt.cast("string"))
    u = lambda what, d: uniform(f"{seed}/{what}", k, d["name"])

    def one(d):
        fixed = d["name"].isin(*required) if required else F.lit(False)
        wanted = u("in", d) < F.when(d["con"], constraint_rate).otherwise(rate)
        prio = F.when(fixed, 0).when(wanted, 1).otherwise(2)
        value = F.get(d["vals"], F.least((u("value", d) * F.size(d["vals"])).cast("int"), F.size(d["vals"]) - 1))
        return F.struct(prio.alias("prio"), shuffle_key(f"{seed}/order", k, d["name"]).alias("h"), d["ord"].alias("ord"), d["name"].alias("name"), value.alias("value"))

    picks = F.array_sort(F.transform(_dims(bank), one))
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.size(F.filter("__picks", lambda x: x["prio"] <= 1))), F.lit(len(required)))
    kept = F.array_sort(F.transform(F.slice("__picks", 1, n), lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"), x["value"].alias("value"))))
    return ids.withColumn("__picks", picks).withColumn("features", kept).drop("__picks")


def bounded_constraints(personas: DataFrame, bank: list[Dimension], seed: str, least: int, most: int, key: str = "persona_id") -> DataFrame:
    """Random constraint dimensions are added up to least, or taken away down to most."""
    k = F.col(key)
    names = F.transform("features", lambda x: x["name"])
    cons = [d.name for d in bank if d.is_constraint]
    have = F.filter("features", lambda x: x["name"].isin(*cons))
    lacking = F.filter(_dims(bank), lambda d: d["con"] & ~F.array_contains(names, d["name"]))
    order = lambda arr, what: F.array_sort(F.transform(arr, lambda x: F.struct(shuffle_key(f"{seed}/{what}", k, x["name"]).alias("h"), x.alias("x"))))
    value = lambda d: F.get(d["vals"], F.least((uniform(f"{seed}/add", k, d["name"]) * F.size(d["vals"])).cast("int"), F.size(d["vals"]) - 1))
    more = F.transform(F.slice(order(lacking, "more"), 1, F.greatest(F.lit(0), least - F.size(have))), lambda y: F.struct(y["x"]["ord"].alias("ord"), y["x"]["name"].alias("name"), value(y["x"]).alias("value")))
    gone = F.transform(F.slice(order(have, "less"), 1, F.greatest(F.lit(0), F.size(have) - most)), lambda y: y["x"]["name"])
    return personas.withColumn("features", F.array_sort(F.concat(F.filter("features", lambda x: ~F.array_contains(gone, x["name"])), more)))


def stratum(key: Column, n_strata: int, seed: str) -> Column:
    """Balanced strata: each cycle of n_strata draws takes every stratum once, in an order of its own."""
    cycle = F.floor(key / n_strata)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_strata - 1)), lambda i: F.struct(shuffle_key(seed, cycle, i).alias("h"), i.alias("i"))))
    return F.get(order, (key % n_strata).cast("int"))["i"]


def strata_values(bank: list[Dimension], names: list[str]) -> list[tuple[str, ...]]:
    """The ordered product of the dimensions' values."""
    out: list[tuple[str, ...]] = [()]
    for n in names:
        out = [(*x, v) for x in out for v in dimension(bank, n).values]
    return out


@dataclass(frozen=True)
class Rule:
    """If a dimension has one of the values, another gets a preferred value with the probability."""

    dimension: str
    values: tuple[str, ...]
    target: str
    preferred: tuple[str, ...] = ()
    probability: float = 0.8


def apply_rules(features: Column, key: Column, bank: list[Dimension], rules: list[Rule], seed: str) -> Column:
    """A map of features after the rules in order; later rules see earlier effects."""
    out = features
    for i, r in enumerate(rules):
        every = dimension(bank, r.target).values
        options = tuple(v for v in r.preferred if v in every) or every
        new = F.get(F.array(*[F.lit(v) for v in options]), F.least((uniform(f"{seed}/{i}/v", key) * len(options)).cast("int"), F.lit(len(options) - 1)))
        hit = F.element_at(out, F.lit(r.dimension)).isin(*r.values) & (uniform(f"{seed}/{i}", key) < r.probability)
        changed = F.map_concat(_without(out, r.target), F.create_map(F.lit(r.target), new))
        out = F.when(F.coalesce(hit, F.lit(False)), changed).otherwise(out)
    return out


def _without(features: Column, name: str) -> Column:
    return F.map_filter(features, lambda k, v: k != name)


def persona_id(features: Column) -> Column:
    """A short hash of the sorted features."""
    body = F.array_join(F.transform(F.array_sort(F.transform(features, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('": "'), x["value"], F.lit('"'))), ", ")
    return F.concat(F.lit("persona_"), F.substring(F.md5(F.concat(F.lit("{"), body, F.lit("}"))), 1, 12))


def _distance(a: Column, b: Column, priority: tuple[str, ...] = (), weight: int = 2) -> Column:
    """The weight of the names in which two arrays of features differ, names that only one has among them."""
    pair = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    name = lambda c: F.transform(c, lambda x: x["name"])
    same = F.transform(F.array_intersect(pair(a), pair(b)), lambda x: x["name"])
    differ = F.array_except(F.array_union(name(a), name(b)), same)
    heavy = F.size(F.filter(differ, lambda n: n.isin(*priority))) if priority else F.lit(0)
    return (F.size(differ) + heavy * (weight - 1)).cast("bigint")


def distances(personas: DataFrame, pairs: DataFrame, priority: tuple[str, ...] = (), weight: int = 2, key: str = "persona_id") -> DataFrame:
    """(i, j, distance) of the given pairs: over all names of either, the weight of those that differ.

    Spark takes an array for one element when it sizes a side that is computed
    after a shuffle, and would send all features round by the driver; the hint
    keeps them shuffled.
    """
    side = lambda c: personas.select(F.col(key).alias(c), F.col("features").alias(f"__{c}")).hint("merge")
    return pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", _distance(F.col("__i"), F.col("__j"), priority, weight).alias("distance"))


def mean_distance(personas: DataFrame) -> DataFrame:
    """(n, distance): the mean over all pairs, from counts of names and values alone; no pair is made."""
    long = personas.select(F.explode("features").alias("f")).select("f.name", "f.value")
    pairs = lambda c: c * (c - 1) / 2
    values = long.groupBy("name", "value").agg(F.count("*").cast("double").alias("c"))
    names = values.groupBy("name").agg(F.sum("c").alias("c"), F.sum(pairs(F.col("c"))).alias("same"))
    n = personas.agg(F.count("*").cast("double").alias("n"))
    each = names.crossJoin(F.broadcast(n)).select("n", (pairs(F.col("n")) - pairs(F.col("n") - F.col("c")) - F.col("same")).alias("d"))  # one row is sent round
    return each.groupBy("n").agg((F.sum("d") / F.first(pairs(F.col("n")))).alias("distance")).select(F.col("n").cast("bigint").alias("n"), "distance")


def _groups(personas: DataFrame, min_distance: int) -> list[list[str]]:
    """Names dealt by their order into groups, as many as leave MOST_KEYS ways to pass over min_distance - 1 of them."""
    names = sorted(r.name for r in personas.select(F.explode("features.name").alias("name")).distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    if min_distance > max(len(names), 1):
        raise ValueError(f"{len(names)} names are too few for a distance of {min_distance}")
    n = min_distance
    while n < len(names) and math.comb(n + 1, min_distance - 1) <= MOST_KEYS:
        n += 1
    return [names[g::n] for g in range(n)]


def _passed_over(weights: list[int], budget: int) -> list[tuple[int, ...]]:
    """The sets of groups whose weights sum to budget at most and that no other group fits into."""
    fit = [(s, budget - sum(weights[g] for g in s)) for k in range(budget // max(weights), min(budget, len(weights)) + 1) for s in itertools.combinations(range(len(weights)), k)]
    return [s for s, left in fit if left >= 0 and all(w > left for g, w in enumerate(weights) if g not in s)]


def _keyed(personas: DataFrame, groups: list[list[str]], min_distance: int, key: str, priority: tuple[str, ...], weight: int) -> tuple[DataFrame, int]:
    """A row (id, sig, sig2) for each persona and each set of groups that may differ, and the number of sets: equal keys agree in all other groups."""
    part = lambda names: F.array_sort(F.transform(F.filter("features", lambda x: x["name"].isin(*names)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["value"].isNull().alias("none"))))
    slim = personas.select(F.col(key).alias("id"), *[part(names).alias(f"__p{g}") for g, names in enumerate(groups)])
    slim = slim.select("id", *[F.xxhash64(F.lit(salt), f"__p{g}").alias(f"__{salt}{g}") for salt in "ab" for g in range(len(groups))])
    sets = _passed_over([min(weight if n in priority else 1 for n in names) for names in groups], min_distance - 1) if groups[0] else [()]
    sig = lambda salt, i, s: F.xxhash64(F.lit(salt), F.lit(i), *[f"__{salt}{g}" for g in range(len(groups)) if g not in s])
    keys = F.array(*[F.struct(sig("a", i, s).alias("sig"), sig("b", i, s).alias("sig2")) for i, s in enumerate(sets)])
    return slim.select("id", F.explode(keys).alias("x")).select("id", "x.*"), len(sets)


def close_pairs(personas: DataFrame, min_distance: int, key: str = "persona_id", priority: tuple[str, ...] = (), weight: int = 2) -> DataFrame:
    """(i, j, distance) of the pairs i < j that lie less than min_distance apart.

    Names are dealt into groups. Two personas so close differ in fewer groups
    than min_distance, as a name weighs one at least, so they agree in all
    groups but those of some set, and a join on what the other groups hold
    finds them. The more groups, the less do distant personas meet. A distance
    beyond the number of names, where all pairs may be close, is an error.
    """
    rows, _ = _keyed(personas, _groups(personas, min_distance), min_distance, key, priority, weight)
    a, b = rows.select("id", "sig").alias("a"), rows.select("id", "sig").alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()
    return distances(personas, met, priority, weight, key).where(F.col("distance") < min_distance)


#: Names of features that are told apart; a bank has some dozens.
MOST_NAMES = 1000
#: Keys of a persona in the search for close ones; more where the distance itself needs them.
MOST_KEYS = 24


def accept_first(personas: DataFrame, min_distance: int, key: str = "persona_id", priority: tuple[str, ...] = (), weight: int = 2) -> DataFrame:
    """The personas that a pass in order of their keys accepts: those that lie min_distance from all accepted before.

    Equal personas are one, as the first decides for all. Each round settles
    many at once: who has no undecided close persona before it is accepted, and
    those close to it go. The result is that of the pass one by one; only
    whether it is over comes to the driver. Where each name is a group of its
    own, all personas of a key are close to each other, so the rounds need the
    least of each key and make no pairs.
    """
    if min_distance < 1:
        return personas
    features = F.array_sort(F.transform("features", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))
    once = checkpointed(spread(personas.withColumn("__f", features).groupBy("__f").agg(F.min(key).alias(key), F.min_by("features", key).alias("features")).drop("__f"), personas.count(), key))
    groups = _groups(once, min_distance)
    if all(len(names) <= 1 for names in groups):
        kept = _least_of_keys(once, groups, min_distance, key, priority, weight)
    else:
        kept = _without_close(once, min_distance, key, priority, weight)
    return personas.join(kept, key, "left_semi")


def _least_of_keys(once: DataFrame, groups: list[list[str]], min_distance: int, key: str, priority: tuple[str, ...], weight: int) -> DataFrame:
    """The accepted ids, where all personas of a key are close: whoever is the least of all its keys is accepted, and its keys are closed."""
    rows, n_sets = _keyed(once.where(F.col(key).isNotNull()), groups, min_distance, key, priority, weight)
    left = checkpointed(rows)
    accepted = once.select(F.col(key).alias("id")).limit(0)
    while not left.isEmpty():
        first = left.groupBy("sig", "sig2").agg(F.min("id").alias("first"))
        new = checkpointed(first.groupBy(F.col("first").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") == n_sets).select("id"))
        accepted = accepted.union(new)
        closed = left.join(new, "id", "left_semi").select("sig", "sig2")
        gone = left.join(closed, ["sig", "sig2"], "left_semi").select("id").distinct()
        left = checkpointed(left.join(gone, "id", "left_anti"))
    return accepted.select(F.col("id").alias(key))


def _without_close(once: DataFrame, min_distance: int, key: str, priority: tuple[str, ...], weight: int) -> DataFrame:
    """The accepted ids, by rounds over the graph of close pairs."""
    left = checkpointed(close_pairs(once, min_distance, key, priority, weight).select("i", "j"))
    gone = once.select(F.col(key).alias("id")).limit(0)
    while not left.isEmpty():
        waiting = left.select(F.col("j").alias("id")).distinct()
        accepted = checkpointed(left.select(F.col("i").alias("id")).distinct().join(waiting, "id", "left_anti"))
        new = checkpointed(left.join(accepted.select(F.col("id").alias("i")), "i").select(F.col("j").alias("id")).distinct())
        gone = gone.union(new)
        settled = accepted.union(new)
        left = checkpointed(left.join(settled.select(F.col("id").alias("i")), "i", "left_anti").join(settled.select(F.col("id").alias("j")), "j", "left_anti"))
    return once.select(key).join(gone.select(F.col("id").alias(key)), key, "left_anti")


def diverse_personas(ids: DataFrame, bank: list[Dimension], seed: str, min_distance: int = 3, max_attempts: int = 50, key: str = "persona_id", priority: tuple[str, ...] = (), **how) -> DataFrame:
    """A persona for each id, min_distance apart: whoever the pass in order of ids rejects draws anew.

    Each round draws for the rejected and passes over all again, with the
    accepted before the new. After max_attempts the last draw stays, as a
    persona for each id was asked for.
    """
    drawn = checkpointed(sample_personas(ids.withColumn("attempt", F.lit(0)), bank, seed, key=key, attempt=F.col("attempt"), **how))
    for attempt in range(1, max_attempts):
        order = drawn.withColumn("__at", F.struct("attempt", key))
        kept = checkpointed(accept_first(order, min_distance, "__at", priority).select(key))
        rejected = checkpointed(drawn.select(key).join(kept, key, "left_anti"))
        if rejected.isEmpty():
            break
        again = sample_personas(rejected.withColumn("attempt", F.lit(attempt)), bank, seed, key=key, attempt=F.col("attempt"), **how)
        drawn = checkpointed(drawn.join(kept, key, "left_semi").unionByName(again.select(*drawn.columns)))
    return drawn


def observed_bank(df: DataFrame, name: str, value: str, category: Column, constraint: Column) -> DataFrame:
    """A bank of what a table holds: a dimension for each name with its sorted values; category and constraint are aggregates."""
    rows = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name"), F.col(value).alias("value")).agg(category.alias("category"), constraint.alias("is_constraint"))
    return rows.groupBy("name").agg(F.max("category").alias("category"), F.bool_or("is_constraint").alias("is_constraint"), F.sort_array(F.collect_list("value")).alias("values"))


def apportioned(seen: DataFrame, n: int, seed: str, stratum: str = "stratum", count: str = "seen") -> DataFrame:
    """seen with a quota: how many of n new draws each stratum gets, so that the least filled are filled first and evenly.

    The level to which water poured over the counts would rise: with the m
    lowest of them under it, it is (n + their sum) / m. What is left of whole
    levels goes to the first strata of a shuffled order. One row a stratum is
    ordered.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(count, shuffle_key(seed, stratum), stratum)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = seen.withColumn("__m", F.row_number().over(order)).withColumn("__sum", F.sum(count).over(upto))
    under = F.max(F.when(F.col(count) * F.col("__m") - F.col("__sum") <= n, F.struct("__m", "__sum"))).over(every)
    rows = rows.withColumn("__u", under)
    m, volume = F.col("__u.__m"), F.col("__u.__sum") + n
    level = F.floor(volume / m)
    lowest = F.col("__m") <= m
    place = F.row_number().over(every.orderBy(lowest.desc(), shuffle_key(seed, stratum), stratum))
    extra = F.when(lowest & (place <= volume - level * m), 1).otherwise(0)
    quota = F.when(lowest, F.greatest(level - F.col(count), F.lit(0)) + extra).otherwise(0)
    return rows.withColumn("quota", quota.cast("bigint")).drop("__m", "__sum", "__u")


def resolve_others(value: Column, proposal: Column | None) -> Column:
    """`others` gives way to a proposed value in snake case; without a proposal it stays."""
    if proposal is None:
        return value
    neat = F.translate(F.lower(F.trim(proposal)), " -", "__")
    return F.when((value == "others") & (F.coalesce(neat, F.lit("")) != ""), neat).otherwise(value)


STRATEGIES = ("random", "stratified", "custom")


def strategy(config: dict, overrides: dict | None = None) -> dict:
    """The sampling settings of a configuration after overrides; an unknown strategy is an error."""
    out = {"strategy": "random", "rate": 0.7, "least": 15, "most": 15, "seed": "0"} | config | {k: v for k, v in (overrides or {}).items() if v is not None}
    if out["strategy"] not in STRATEGIES:
        raise ValueError(f"unknown strategy {out['strategy']!r}")
    if out["least"] > out["most"]:
        raise ValueError("least is over most")
    return out
