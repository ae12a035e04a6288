"""Exact parts by counting, accept-first diversity, and apportionment, each against a plain replay."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import personas, prep, samples, selection
from dialoom.plans import catalog

SF = "/root/testdata/sf0.001"


def order(seed, keys):
    return sorted(keys, key=lambda k: ("0" * 32 if k is None else hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k or 0))


def test_parts_have_their_sizes_and_no_row_is_shuffled(spark):
    df = spark.range(5000)
    want = order("s", range(5000))
    got = selection.parted(df, "id", "s", [700, 0, 1300])
    at = {r.id: r.part for r in got.collect()}
    assert [k for k in want if at[k] == 0] == want[:700] and [k for k in want if at[k] == 2] == want[700:2000]
    assert set(at.values()) == {0, 2, 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted(r.id for r in selection.first_rows(df, "id", "s", 9).collect()) == sorted(want[:9])
    assert selection.first_rows(df, "id", "s", 6000).count() == 5000 and selection.first_rows(df, "id", "s", 0).count() == 0
    assert selection.parted(df.limit(0), "id", "s", [3]).count() == 0


def test_copies_of_a_key_and_nulls(spark):
    keys = [None] * 3 + [7] * 40 + list(range(10))
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    for n in (1, 3, 20, 47, 60):
        got = [r.k for r in selection.first_rows(df, "k", "s", n).collect()]
        assert order("s", got) == order("s", keys)[:n]


def test_places_and_splits(spark):
    got = {r.id: r.rn for r in selection.numbered(spark.range(3000), "id", "q").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == order("q", range(3000)) and sorted(got.values()) == list(range(1, 3001))
    parts = {}
    for r in samples.split(spark.range(333), "id", "x").collect():
        parts.setdefault(r.split, []).append(r.id)
    want = order("x", range(333))
    assert [sorted(parts[k]) for k in ("train", "val", "test")] == [sorted(want[:266]), sorted(want[266:299]), sorted(want[299:])]


# ---- diversity


def distance(x, y, priority):
    return sum(2 if k in priority else 1 for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def one_by_one(rows, least, priority=()):
    kept = {}
    for k in sorted(rows):
        if all(distance(rows[k], x, priority) >= least for x in kept.values()):
            kept[k] = rows[k]
    return sorted(kept)


@pytest.mark.parametrize("priority", [(), ("d1", "d4")])
def test_accepted_as_one_by_one(spark, priority):
    rng = random.Random(5)
    rows = {k: {f"d{i}": rng.choice("ab") for i in range(7) if rng.random() < 0.8} for k in range(150)}
    df = spark.createDataFrame([(k, [(n, v) for n, v in f.items()]) for k, f in rows.items()], "persona_id bigint, features array<struct<name:string,value:string>>")
    for least in (0, 1, 3):
        got = personas.accept_first(df.repartition(5), least, priority=priority)
        assert sorted(r.persona_id for r in got.collect()) == one_by_one(rows, least, priority)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_accepted_documents(spark):
    from dialoom.plans import randoms

    rows = {r.persona_id: {f.name: f.value for f in r.features} for r in randoms._document_features(spark, SF).collect()}
    got = sorted(r.persona_id for r in catalog.queries()["r08_accepted_documents"](spark, SF).collect())
    assert got == one_by_one(rows, 3, ("source",)) and 0 < len(got) < len(rows)


def test_diverse_draws_lie_apart(spark):
    bank = [personas.Dimension(f"d{i}", "basic_info", False, tuple("abcd")) for i in range(5)]
    ids = spark.range(25).withColumnRenamed("id", "persona_id")
    got = personas.diverse_personas(ids, bank, "s", min_distance=2, least=5, most=5)
    assert got.count() == 25 and personas.close_pairs(got, 2).isEmpty()
    first = {r.persona_id: r.features for r in personas.sample_personas(ids.withColumn("attempt", F.lit(0)), bank, "s", least=5, most=5, attempt=F.col("attempt")).collect()}
    kept = one_by_one({k: {f.name: f.value for f in v} for k, v in first.items()}, 2)
    assert {r.persona_id for r in got.where("attempt = 0").collect()} == set(kept)


# ---- apportionment


def test_apportioned_as_draw_by_draw(spark):
    rng = random.Random(2)
    for counts in ([0, 0, 0], [5], [1, 3], [9, 0, 4, 4, 2, 30], [rng.randint(0, 20) for _ in range(12)]):
        df = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(counts)], "stratum string, seen bigint")
        tie = {f"s{i}": hashlib.md5(f"z:s{i}".encode()).hexdigest() for i in range(len(counts))}
        for n in (0, 2, 7, 50):
            now = {f"s{i}": c for i, c in enumerate(counts)}
            for _ in range(n):
                k = min(now, key=lambda s: (now[s], tie[s]))
                now[k] += 1
            got = {r.stratum: r.seen + r.quota for r in personas.apportioned(df, n, "z").collect()}
            assert got == now


# ---- diversity at size


def test_dense_personas_are_accepted_without_pairs(spark, monkeypatch):
    """4,000 personas of six names: hundreds of thousands of pairs are close, and none of them is made."""
    rng = random.Random(9)
    rows = {k: {f"d{i}": str(rng.randrange(5)) for i in range(6)} for k in range(4000)}
    df = spark.createDataFrame([(k, list(f.items())) for k, f in rows.items()], "persona_id bigint, features array<struct<name:string,value:string>>")
    monkeypatch.setattr(personas, "close_pairs", None)
    got = personas.accept_first(df, 3, priority=("d2",))
    assert sorted(r.persona_id for r in got.collect()) == one_by_one(rows, 3, ("d2",))


def test_distant_personas_share_few_keys(spark):
    """Personas of the whole bank lie far apart; a key holds few of them, and there are no more keys than MOST_KEYS for each."""
    drawn = personas.sample_personas(spark.range(1500).withColumnRenamed("id", "persona_id"), personas.default_bank(), "s").cache()
    rows, n = personas._keyed(drawn, personas._groups(drawn, 4), 4, "persona_id", (), 2)
    met = rows.groupBy("sig").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("n")).first().n
    assert n <= personas.MOST_KEYS and met < 20  # by four groups of names it would be 159
    assert personas.close_pairs(drawn, 4).isEmpty()


def test_features_are_not_sent_round(spark):
    """Distances shuffle both sides, however small Spark takes the features for."""
    drawn = personas.sample_personas(spark.range(30).withColumnRenamed("id", "persona_id").distinct(), personas.default_bank(), "s")
    got = personas.distances(drawn, spark.range(29).selectExpr("id AS i", "id + 1 AS j"))
    assert got.count() == 29 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


# ---- targets and histories


def test_a_key_of_many_rows_is_not_gathered(spark):
    rng = random.Random(3)
    rows = [(k % 3 if k % 7 else None, k, rng.choice([None, 1, 2, 3])) for k in range(500)] + [(8, 900, 1)]
    df = spark.createDataFrame(rows, "p bigint, c bigint, num_turns bigint")
    got = prep.target_and_history(df, "p", "c")
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((t or 0, c) for p, c, t in rows if p == key)
        want += [(key, mine[0][1], c) for _, c in mine[1:]]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("p", "target", "c").collect())
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_rows_that_are_dear_are_dealt_by_their_number(spark):
    """Tasks that Spark joins by their bytes alone would leave all draws to one."""
    from dialoom.plans import randoms

    rows = spark.range(personas.TASK_ROWS * 5 + 1).withColumnRenamed("id", "persona_id")
    dealt = personas.spread(rows, rows.count(), "persona_id").distinct()
    assert dealt.rdd.getNumPartitions() == 6 and dealt.count() == rows.count()
    few = personas.sample_personas(personas.spread(rows.limit(300), 300, "persona_id"), personas.default_bank(), "s")
    assert sorted(few.collect()) == sorted(personas.sample_personas(rows.limit(300), personas.default_bank(), "s").collect())
    assert "spread" in randoms._ids.__code__.co_names
