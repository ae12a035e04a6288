"""Reproducible sampling: personas, strata, queries, noise layers and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.functions.rand import choice, normal, shuffle_key, uniform
from dialoom.operators import dialogue, personas, samples, selection
from dialoom.plans.catalog import query
from dialoom.plans.inputs import sql_normal, sql_shuffle, sql_uniform, table

BANK = personas.default_bank()
BANK_SQL = "bank(ord, name, category, is_constraint, vals) AS (VALUES " + ", ".join(f"({i}, '{d.name}', '{d.category}', {str(d.is_constraint).lower()}, [{', '.join(repr(v) for v in d.values)}])" for i, d in enumerate(BANK)) + ")"


def _observed(spark, d):
    """A dimension for each source, its values the languages seen there."""
    return personas.observed_bank(table(spark, d, "documents"), "source", "lang", F.when(F.max("n_chars") > 9000, "constraint").otherwise("behavioral"), F.max("n_chars") > 12000)


OBSERVED_SQL = """v AS (SELECT source AS name, lang AS value, CASE WHEN max(n_chars) > 9000 THEN 'constraint' ELSE 'behavioral' END AS category, max(n_chars) > 12000 AS is_constraint FROM documents WHERE source IS NOT NULL GROUP BY ALL),
bank AS (SELECT name, max(category) AS category, bool_or(is_constraint) AS is_constraint, list(value ORDER BY value) FILTER (value IS NOT NULL) AS vals FROM v GROUP BY name)"""


@query("s01_bank", f"WITH {OBSERVED_SQL} SELECT name, category, is_constraint, len(vals)::INT AS n_values, list_contains(vals, 'en') AS has_en FROM bank")
def _(spark, d):
    return _observed(spark, d).select("name", "category", "is_constraint", F.size("values").alias("n_values"), F.array_contains("values", "en").alias("has_en"))


@query("p01_constraint_dimensions", f"WITH {OBSERVED_SQL} SELECT name, category FROM bank WHERE is_constraint OR category = 'behavioral'")
def _(spark, d):
    return _observed(spark, d).where(F.coalesce("is_constraint", F.lit(False)) | (F.col("category") == "behavioral")).select("name", "category")


@query("p02_dimension_values", f"WITH {OBSERVED_SQL} SELECT name, unnest(vals) AS value, unnest(range(len(vals)))::INT AS pos FROM bank WHERE name IN (SELECT min(source) FROM documents UNION SELECT max(source) FROM documents)")
def _(spark, d):
    ends = table(spark, d, "documents").agg(F.array(F.min("source"), F.max("source")).alias("n")).select(F.explode("n").alias("name")).distinct()
    return _observed(spark, d).join(ends, "name", "left_semi").select("name", F.posexplode("values").alias("pos", "value"))


def _draw_sql(seed: str, least: int, most: int, required: tuple[str, ...] = ()) -> str:
    fixed = f"name IN ({', '.join(repr(r) for r in required)})" if required else "false"
    return f"""{BANK_SQL}, x AS (SELECT p AS persona_id, b.*, CASE WHEN {fixed} THEN 0 WHEN {sql_uniform(seed + '/in', 'p', 'name')} < 0.7::DOUBLE THEN 1 ELSE 2 END AS prio FROM (SELECT DISTINCT doc_id AS p FROM documents) t, bank b),
      r AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY prio, {sql_shuffle(seed + '/order', 'persona_id', 'name')}, ord) AS rn, greatest({least}, least({most}, count(*) FILTER (prio <= 1) OVER (PARTITION BY persona_id))) AS n FROM x),
      f AS (SELECT persona_id, ord, name, is_constraint, vals[least(floor({sql_uniform(seed + '/value', 'persona_id', 'name')} * len(vals))::INT, len(vals) - 1) + 1] AS value FROM r WHERE rn <= n)"""


def _exploded(df):
    return df.select("persona_id", F.explode("features").alias("f")).select("persona_id", "f.ord", "f.name", "f.value")


def _ids(spark, d):
    """A persona for each document; drawing them is the work, so they are dealt out by their number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("persona_id"))
    return personas.spread(docs, docs.count(), "persona_id").distinct()


@query("r02_random_personas", f"WITH {_draw_sql('r02', 15, 15)} SELECT persona_id, ord, name, value FROM f")
def _(spark, d):
    return _exploded(personas.sample_personas(_ids(spark, d), BANK, "r02"))


@query("r01_bounded_personas", f"WITH {_draw_sql('r01', 20, 25)} SELECT persona_id, count(*) AS n FROM f GROUP BY persona_id")
def _(spark, d):
    return personas.sample_personas(_ids(spark, d), BANK, "r01", least=20, most=25).select("persona_id", F.size("features").cast("bigint").alias("n"))


@query("r06_required_dimensions", f"WITH {_draw_sql('r06', 15, 18, ('dim_02', 'dim_30'))} SELECT persona_id, ord, name, value FROM f")
def _(spark, d):
    return _exploded(personas.sample_personas(_ids(spark, d), BANK, "r06", least=15, most=18, required=("dim_02", "dim_30")))


@query(
    "r07_constraint_bounds",
    f"""WITH {_draw_sql('r07', 15, 15)}, c AS (SELECT persona_id, count(*) FILTER (is_constraint) AS n_con, count(*) AS n FROM f GROUP BY persona_id)
    SELECT persona_id, least(greatest(n_con, 6), 7) AS n_constraints, n + least(greatest(n_con, 6), 7) - n_con AS n_features FROM c""",
)
def _(spark, d):
    p = personas.bounded_constraints(personas.sample_personas(_ids(spark, d), BANK, "r07"), BANK, "r07", 6, 7)
    cons = [x.name for x in BANK if x.is_constraint]
    return p.select("persona_id", F.size(F.filter("features", lambda x: x["name"].isin(*cons))).cast("bigint").alias("n_constraints"), F.size("features").cast("bigint").alias("n_features"))


@query(
    "r03_balanced_strata",
    f"WITH c AS (SELECT DISTINCT doc_id // 12 AS c FROM documents), o AS (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY {sql_shuffle('r03', 'c', 'i')}, i) - 1 AS pos FROM c, range(12) b(i)) SELECT p.doc_id AS persona_id, i::INT AS stratum FROM (SELECT DISTINCT doc_id FROM documents) p JOIN o ON o.c = p.doc_id // 12 AND o.pos = p.doc_id % 12",
)
def _(spark, d):
    return _ids(spark, d).select("persona_id", personas.stratum(F.col("persona_id"), 12, "r03").alias("stratum"))


@query(
    "r03_apportioned_strata",
    f"""WITH s AS (SELECT lang || '/' || source AS stratum, count(*) AS seen FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), n AS (SELECT sum(seen)::BIGINT // 2 AS n FROM s),
    slots AS (SELECT stratum, seen + k AS level FROM s, n, range(n) t(k)), taken AS (SELECT stratum, row_number() OVER (ORDER BY level, {sql_shuffle('r03/level', 'stratum')}, stratum) AS place FROM slots)
    SELECT stratum, seen, (SELECT count(*) FROM taken t WHERE t.stratum = s.stratum AND place <= (SELECT n FROM n)) AS quota FROM s""",
)
def _(spark, d):
    """Half as many new draws as there are documents, to the strata that have least."""
    seen = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source").alias("stratum")).where("stratum IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("seen"))
    return personas.apportioned(seen, seen.agg(F.sum("seen")).first()[0] // 2, "r03/level")


@query("u05_strata_product", "WITH a AS (SELECT list(DISTINCT lang ORDER BY lang) FILTER (lang IS NOT NULL) AS x, list(DISTINCT source ORDER BY source) FILTER (source IS NOT NULL) AS y FROM documents), i AS (SELECT *, unnest(range(len(x))) AS i FROM a), j AS (SELECT *, unnest(range(len(y))) AS j FROM i) SELECT x[i + 1] AS x, y[j + 1] AS y, (i * len(y) + j)::INT AS pos FROM j")
def _(spark, d):
    """Every language with every source that occurs."""
    sets = table(spark, d, "documents").agg(F.sort_array(F.collect_set("lang")).alias("xs"), F.sort_array(F.collect_set("source")).alias("ys"))
    return sets.select("ys", F.posexplode("xs").alias("i", "x")).select("i", "x", F.size("ys").alias("n"), F.posexplode("ys").alias("j", "y")).select("x", "y", (F.col("i") * F.col("n") + F.col("j")).cast("int").alias("pos"))


RULES = [
    personas.Rule("dim_00", ("d00_v0", "d00_v1"), "dim_02", ("d02_v3", "nowhere"), 0.8),
    personas.Rule("dim_02", ("d02_v3",), "dim_04", (), 0.9),
]


@query(
    "r04_rule_chain",
    f"""WITH {BANK_SQL}, a AS (SELECT p AS persona_id, 'd00_v' || (p % 4) AS a, 'd02_v' || (p % 5) AS b, 'd04_v0' AS c FROM (SELECT DISTINCT doc_id AS p FROM documents) t),
    s AS (SELECT persona_id, a, CASE WHEN a IN ('d00_v0', 'd00_v1') AND {sql_uniform('r04/0', 'persona_id')} < 0.8::DOUBLE THEN 'd02_v3' ELSE b END AS b, c FROM a)
    SELECT persona_id, a, b, CASE WHEN b = 'd02_v3' AND {sql_uniform('r04/1', 'persona_id')} < 0.9::DOUBLE THEN (SELECT vals FROM bank WHERE name = 'dim_04')[least(floor({sql_uniform('r04/1/v', 'persona_id')} * {len(BANK[4].values)})::INT, {len(BANK[4].values) - 1}) + 1] ELSE c END AS c FROM s""",
)
def _(spark, d):
    start = F.create_map(F.lit("dim_00"), F.concat(F.lit("d00_v"), (F.col("persona_id") % 4).cast("string")), F.lit("dim_02"), F.concat(F.lit("d02_v"), (F.col("persona_id") % 5).cast("string")), F.lit("dim_04"), F.lit("d04_v0"))
    f = personas.apply_rules(start, F.col("persona_id"), BANK, RULES, "r04")
    return _ids(spark, d).select("persona_id", f.alias("f")).select("persona_id", *[F.element_at("f", k).alias(n) for k, n in (("dim_00", "a"), ("dim_02", "b"), ("dim_04", "c"))])


@query(
    "j09_pair_distances",
    f"""WITH {_draw_sql('j09', 15, 15)}, n AS (SELECT persona_id AS i, lead(persona_id) OVER (ORDER BY persona_id) AS j FROM (SELECT DISTINCT persona_id FROM f)),
    u AS (SELECT n.i, n.j, f.name FROM n JOIN f ON f.persona_id IN (n.i, n.j) WHERE n.j IS NOT NULL GROUP BY ALL)
    SELECT u.i, u.j, count(*) FILTER (a.value IS DISTINCT FROM b.value) AS distance FROM u LEFT JOIN f a ON a.persona_id = u.i AND a.name = u.name LEFT JOIN f b ON b.persona_id = u.j AND b.name = u.name GROUP BY u.i, u.j""",
)
def _(spark, d):
    """Each persona against the next one."""
    ids = samples.ranked(_ids(spark, d), [F.col("persona_id")])
    pairs = ids.select("rn", F.col("persona_id").alias("i")).join(ids.select((F.col("rn") - 1).alias("rn"), F.col("persona_id").alias("j")).hint("merge"), "rn").select("i", "j")
    return personas.distances(personas.sample_personas(_ids(spark, d), BANK, "j09"), pairs)


def _document_features(spark, d):
    """Documents as personas: what they are, and a few more values by their ids."""
    docs = table(spark, d, "documents")
    size = F.floor(F.log2(F.coalesce("n_chars", F.lit(0)) + 1)).cast("string")
    more = [F.struct(F.lit(f"by_{m}").alias("name"), (F.xxhash64("doc_id", F.lit(m)) % m).cast("string").alias("value")) for m in (11, 13, 17, 19)]
    named = [F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit("none")).alias("value")) for n, c in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size))]
    return docs.select(F.col("doc_id").alias("persona_id"), F.array(*named, *more).alias("features"))


@query("r08_accepted_documents")
def _(spark, d):
    """The documents that a pass in order of their ids accepts, no two nearer than three, where the source counts twice."""
    return personas.accept_first(_document_features(spark, d), 3, priority=("source",)).select("persona_id")


@query("r08_diverse_personas")
def _(spark, d):
    drawn = personas.diverse_personas(_ids(spark, d), BANK, "r08", min_distance=4)
    return drawn.select("persona_id", personas.persona_id(F.col("features")).alias("persona_key"), F.size("features").alias("n"))


@query("d03_persona_ids", f"WITH {_draw_sql('d03', 15, 15)} SELECT persona_id, 'persona_' || substr(md5('{{' || string_agg('\"' || name || '\": \"' || value || '\"', ', ' ORDER BY name) || '}}'), 1, 12) AS persona_key FROM f GROUP BY persona_id")
def _(spark, d):
    return personas.sample_personas(_ids(spark, d), BANK, "d03").select("persona_id", personas.persona_id(F.col("features")).alias("persona_key"))


@query("r09_resolve_others", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'very_new_' || lang ELSE lang END AS value FROM documents")
def _(spark, d):
    v = F.when(F.col("doc_id") % 3 == 0, "others").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", personas.resolve_others(v, F.concat(F.lit(" Very New-"), "lang")).alias("value"))


LENGTHS = ("very_short", "short", "medium", "long", "very_long")


@query("r10_length_category", f"SELECT doc_id, [{', '.join(repr(x) for x in LENGTHS)}][greatest(0, least(4, round_even({sql_normal('r10', 1.5, 1.0, 'doc_id')}, 0)))::INT + 1] AS target_length FROM documents")
def _(spark, d):
    i = F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.rint(normal("r10", 1.5, 1.0, "doc_id")))).cast("int")
    return table(spark, d, "documents").select("doc_id", F.get(F.array(*[F.lit(x) for x in LENGTHS]), i).alias("target_length"))


@query("r11_target_turns", f"SELECT doc_id, greatest(2, least(5, round_even({sql_normal('r11', 3.0, 0.5, 'doc_id')}, 0)))::INT AS target_turns FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(2.0), F.least(F.lit(5.0), F.rint(normal("r11", 3.0, 0.5, "doc_id")))).cast("int").alias("target_turns"))


# A persona for each ten documents; each takes some queries.
_PERSONAS = "(SELECT count(*) // 10 FROM documents)"


def _wanted(spark, d, each):
    return table(spark, d, "documents").count() // 10 * each


@query("r12_random_allocation", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_shuffle('r12', 'doc_id')}, doc_id) AS rn FROM documents) SELECT (rn - 1) // 5 AS persona_id, doc_id FROM r WHERE rn <= 5 * {_PERSONAS}")
def _(spark, d):
    top = selection.first_rows(table(spark, d, "documents").select("doc_id"), "doc_id", "r12", _wanted(spark, d, 5))
    return selection.numbered(top, "doc_id", "r12").select(F.floor((F.col("rn") - 1) / 5).alias("persona_id"), "doc_id")


@query("r13_round_robin_allocation", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) SELECT (rn - 1) // 4 AS persona_id, doc_id FROM r WHERE rn <= 4 * {_PERSONAS}")
def _(spark, d):
    """Queries without a label are free, and go round in order."""
    free = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return samples.ranked(free, [F.col("doc_id")]).where(F.col("rn") <= _wanted(spark, d, 4)).select(F.floor((F.col("rn") - 1) / 4).alias("persona_id"), "doc_id")


@query("r14_reset_and_redraw", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_shuffle('r14/second', 'doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id FROM r WHERE rn <= {_PERSONAS}")
def _(spark, d):
    return selection.first_rows(table(spark, d, "documents").select("doc_id"), "doc_id", "r14/second", _wanted(spark, d, 1))


LAYERS = [("surface_noise", 0.5), ("incomplete_info", 0.3), ("semantic_ambiguity", 0.2)]


@query("r15_noise_layer", f"WITH u AS (SELECT doc_id, {sql_uniform('r15', 'doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.5::DOUBLE THEN 'surface_noise' WHEN u < 0.8::DOUBLE THEN 'incomplete_info' ELSE 'semantic_ambiguity' END AS layer FROM u")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", choice(uniform("r15", "doc_id"), LAYERS).alias("layer"))


@query("m10_weight_normalisation", f"WITH u AS (SELECT doc_id, {sql_uniform('m10', 'doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.25::DOUBLE THEN 'a' WHEN u < 0.75::DOUBLE THEN 'b' ELSE 'c' END AS label FROM u")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", choice(uniform("m10", "doc_id"), [("a", 1.0), ("b", 2.0), ("c", 1.0)]).alias("label"))


STRATEGY_TABLE = [("casual", True, 0.0), ("fragment", False, 0.3), ("misspelt", False, 0.25), ("spacing", False, 0.15), ("stops", False, 0.4)]


@query(
    "r16_strategy_sampling",
    f"""WITH s(strategy, mandatory, p) AS (VALUES {", ".join(f"('{n}', {str(m).lower()}, {p})" for n, m, p in STRATEGY_TABLE[1:])}), x AS (SELECT doc_id, strategy, {sql_uniform('r16', 'doc_id', 'strategy')} < p::DOUBLE AS hit, {sql_shuffle('r16/one', 'doc_id', 'strategy')} AS h FROM documents, s)
    SELECT doc_id, coalesce(string_agg(strategy, ',' ORDER BY strategy) FILTER (hit), min_by(strategy, h)) AS strategies FROM x GROUP BY doc_id""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(dialogue.chosen_strategies(STRATEGY_TABLE[1:], "r16", F.col("doc_id"))), ",").alias("strategies"))


@query("r17_locked_model", f"WITH u AS (SELECT DISTINCT conv_id, {sql_uniform('r17', 'conv_id')} AS u FROM conversations) SELECT conv_id, CASE WHEN u < 0.6::DOUBLE THEN 'large' ELSE 'small' END AS model FROM u")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", choice(uniform("r17", "conv_id"), [("large", 0.6), ("small", 0.4)]).alias("model"))


@query("r18_noisy_pick", f"SELECT doc_id, min_by(strategy, {sql_shuffle('r18', 'doc_id', 'strategy')}) AS strategy FROM documents, (VALUES ('typo'), ('word_swap'), ('synonym')) s(strategy) GROUP BY doc_id")
def _(spark, d):
    options = F.array(*[F.lit(s) for s in ("typo", "word_swap", "synonym")])
    best = F.get(F.array_sort(F.transform(options, lambda s: F.struct(shuffle_key("r18", F.col("doc_id"), s).alias("h"), s.alias("s")))), F.lit(0))["s"]
    return table(spark, d, "documents").select("doc_id", best.alias("strategy"))


@query("r19_template_choice", f"SELECT doc_id, CASE WHEN {sql_uniform('r19', 'doc_id')} < 0.5::DOUBLE THEN 'partial' ELSE 'full' END AS template FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(uniform("r19", "doc_id") < 0.5, "partial").otherwise("full").alias("template"))


@query("p14_activation", f"SELECT doc_id, NOT ({sql_uniform('p14', 'doc_id')} > 0.4::DOUBLE) AS applied, {sql_uniform('p14', 'doc_id')} < 0.4::DOUBLE AS selected FROM documents")
def _(spark, d):
    u = uniform("p14", "doc_id")
    return table(spark, d, "documents").select("doc_id", (~(u > 0.4)).alias("applied"), (u < 0.4).alias("selected"))


@query(
    "r20_queries_per_persona",
    f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_shuffle('r20', 'doc_id')}, doc_id) AS rn FROM documents) SELECT (rn - 1) // 5 AS persona_id, doc_id, greatest(2, least(5, round_even({sql_normal('r20/turns', 3.0, 0.5, 'doc_id')}, 0)))::INT AS target_turns FROM r WHERE rn <= 5 * {_PERSONAS}",
)
def _(spark, d):
    top = selection.first_rows(table(spark, d, "documents").select("doc_id"), "doc_id", "r20", _wanted(spark, d, 5))
    turns = F.greatest(F.lit(2.0), F.least(F.lit(5.0), F.rint(normal("r20/turns", 3.0, 0.5, "doc_id")))).cast("int")
    return selection.numbered(top, "doc_id", "r20").select(F.floor((F.col("rn") - 1) / 5).alias("persona_id"), "doc_id", turns.alias("target_turns"))


@query("j11_strategy_lines", "SELECT doc_id, '1. **typo**: neighbouring keys' || chr(10) || '2. **' || lang || '**: ' || lang AS lines FROM documents")
def _(spark, d):
    names = F.array(F.lit("typo"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", dialogue.strategy_lines(names, {"typo": "neighbouring keys"}).alias("lines"))


@query("j12_preferred_values", f"WITH {OBSERVED_SQL} SELECT name, CASE WHEN list_has_any(vals, ['en', 'nowhere']) THEN 'en' ELSE array_to_string(vals, ',') END AS allowed FROM bank")
def _(spark, d):
    both = F.array_intersect(F.array(F.lit("en"), F.lit("nowhere")), "values")
    return _observed(spark, d).select("name", F.array_join(F.when(F.size(both) > 0, both).otherwise(F.col("values")), ",").alias("allowed"))


def _dialogues(spark, d):
    tasks = table(spark, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("query"), F.lit("- tone: brief").alias("persona"), (2 + F.col("doc_id") % 3).cast("int").alias("target_turns"))
    return dialogue.simulate(tasks, dialogue.MockClient())


@query("c01_dialogues")
def _(spark, d):
    return _dialogues(spark, d).select("task_id", F.size("messages").alias("n_messages"), "num_turns", "attempts")


@query("c07_resume", "SELECT doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def _(spark, d):
    return dialogue.pending(table(spark, d, "documents").select(F.col("doc_id").alias("task_id")), table(spark, d, "conversations").select(F.col("conv_id").alias("task_id")).distinct())


@query("t27_noise_decisions", f"WITH u AS (SELECT doc_id, {sql_uniform('t27/active', 'doc_id')} > 0.7::DOUBLE AS skipped, {sql_uniform('t27/layer', 'doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN skipped THEN 'skipped' WHEN u < 0.5::DOUBLE THEN 'surface_noise' WHEN u < 0.8::DOUBLE THEN 'incomplete_info' ELSE 'semantic_ambiguity' END AS layer, CASE WHEN skipped THEN 0 WHEN u < 0.5::DOUBLE THEN 1 WHEN u < 0.8::DOUBLE THEN 2 ELSE 3 END AS layer_index FROM u")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", dialogue.noise_decision(F.col("doc_id"), LAYERS, 0.7, "t27").alias("n")).select("doc_id", "n.layer", "n.layer_index")


@query("t27_noised_texts")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dialogue.noised(docs, "doc_id", "text", dialogue.MockClient(), LAYERS, STRATEGY_TABLE, "t27")


@query("t28_style_transfer")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("query"), F.lit("- tone: brief").alias("persona"))
    return dialogue.style_transfer(docs, dialogue.MockClient())


_VERBS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.INTENT_VERBS.items()) + "}"


@query(
    "t27c_intents",
    f"""WITH d AS (SELECT doc_id, text AS t, (7 + length(text)) % 4 AS k, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: element_at({_VERBS}, w) IS NOT NULL) AS hits FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'book' WHEN 1 THEN 'unknown' ELSE coalesce({_VERBS}[hits[1]], 'general_request') END AS intent,
      CASE k WHEN 0 THEN '{{"n":"1"}}' ELSE '{{}}' END AS slots, md5(CASE k WHEN 0 THEN 'short' ELSE t END) AS compressed_md5, CASE WHEN k < 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM d""",
)
def _(spark, d):
    """Intents as the mock model reads them: an answer in a fence, one whose innermost object has no field of these, one without an object, and none."""
    said = dialogue.extract_intents(table(spark, d, "documents"), dialogue.MockClient(), "doc_id", "text")
    return said.select("doc_id", "intent", "slots", F.md5("compressed_text").alias("compressed_md5"), "confidence")
