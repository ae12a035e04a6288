"""Dialogues, noise and style by a language-model client that runs inside tasks.

A client is any picklable object with `generate(prompt) -> str`. The mock one
is deterministic and needs no network; keys of real ones come from the
environment of the executors, never from files.
"""

from __future__ import annotations

import json
import time
import zlib
from typing import TYPE_CHECKING, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text
from dialoom.functions.rand import choice, shuffle_key, uniform
from dialoom.operators.batches import in_batches

if TYPE_CHECKING:
    from dialoom.operators.ledger import Ledger


class Client(Protocol):
    def generate(self, prompt: str) -> str: ...


class MockClient:
    """Answers from a checksum of the prompt; JSON where the prompt asks for it."""

    def __init__(self, empty_every: int = 0):
        self.empty_every = empty_every

    def generate(self, prompt: str) -> str:
        h = zlib.crc32(prompt.encode())
        if self.empty_every and h % self.empty_every == 0:
            return ""
        if prompt.startswith("FEEDBACK"):
            return json.dumps({"satisfied": h % 4 == 0, "feedback": f"please say more about point {h % 97}"})
        if prompt.startswith("JUDGE"):
            return f"Score: {h % 5 + 1} of 5" if prompt.startswith("JUDGE 1-5") else f"Score: {h % 10 + 1}"
        if prompt.startswith("STYLE"):
            return json.dumps({"adapted_query": f"quick one: {prompt.rsplit(chr(10), 1)[-1]}", "inferred_domain": ("coding", "travel", "gardening")[h % 3], "inferred_scenario": ("casual", "learning")[h % 2]})
        if prompt.startswith("INTENT"):
            return ('```json\n{"intent": "book", "slots": {"n": "1"}, "compressed_text": "short"}\n```', 'Sure: {"slots": {"n": "2"}}', "no braces here", "")[len(prompt) % 4]
        return f"answer {h % 10_007}"

    def generate_with_tokens(self, prompt: str) -> tuple[str, int, int]:
        """The answer with two tokens a word on either side."""
        out = self.generate(prompt)
        return out, 2 * len(prompt.split()), 2 * len(out.split())


def with_retries(call, attempts: int, delay: float = 0.0, grow: float = 2.0):
    """(result, attempts used): a result that is None or empty, or an error, is tried again, the pause growing each time."""
    for k in range(attempts):
        try:
            got = call()
        except Exception:  # noqa: BLE001 - an outer service may fail in any way
            got = None
        if got:
            return got, k + 1
        if delay and k + 1 < attempts:
            time.sleep(delay * grow**k)
    return None, attempts


def _feedback(raw: str) -> str | None:
    """The same decision as functions.text.feedback, for use inside a task."""
    body = raw.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1]
    body = body.removesuffix("```").strip()
    try:
        got = json.loads(body)
    except ValueError:
        return raw if len(raw.strip()) >= 10 else None
    said = got.get("feedback") if isinstance(got, dict) and not got.get("satisfied") else None
    return str(said) if said and len(str(said).strip()) > 5 else None


def converse(client: Client, persona: str, query: str, target_turns: int, max_turns: int) -> list[dict] | None:
    """Messages of one dialogue; an empty answer discards all of it, no feedback ends it.

    Feedback of the last allowed turn is still appended, so a dialogue may end
    with the user.
    """
    messages = [{"role": "user", "content": query, "turn": 0}]
    turn = 0
    while turn < max_turns:
        lines = "\n".join(f"{'User' if m['role'] == 'user' else 'Assistant'}: {m['content']}" for m in messages)
        answer = client.generate(f"REPLY\n{lines}")
        if not answer:
            return None
        turn += 1
        messages.append({"role": "assistant", "content": answer, "turn": turn})
        said = _feedback(client.generate(f"FEEDBACK {turn}/{target_turns}\n{persona}\n{lines}\n{answer}")) if turn < target_turns else None
        if said is None:
            break
        messages.append({"role": "user", "content": said, "turn": turn})
    return messages


#: Calls of a task that are under way at once.
WORKERS = 5

USAGE = "array<struct<operation:string,input_tokens:bigint,output_tokens:bigint>>"
_USAGE_ARROW = pa.list_(pa.struct([("operation", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64())]))


def _usage_array(calls: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("operation", "input_tokens", "output_tokens"), c, strict=True)) for c in x] for x in calls], _USAGE_ARROW)


def simulate(tasks: DataFrame, client: Client, max_turns: int = 5, retries: int = 3, delay: float = 0.0, workers: int = WORKERS, usage: bool = False, ledger: Ledger | None = None) -> DataFrame:
    """(task_id, messages, num_turns, attempts) of the tasks (task_id, query, persona, target_turns) that succeed.

    The whole loop of a dialogue runs in its task, several dialogues at once;
    retries are its own, so that a repeated Spark task is the exception. With
    usage, a column of the calls follows, and failed tasks stay, without messages.
    With a ledger, calls that were answered in any run before are not made again.
    """
    from dialoom.operators.clients import Metered, pooled

    message = pa.struct([("role", pa.string()), ("content", pa.string()), ("turn", pa.int32())])

    def one(task, book):
        i, q, p, n = task
        paid = book.paid(client, i) if book else client
        meter = Metered(paid, "dialogue") if usage else paid
        m, used = with_retries(lambda: converse(meter, p or "", q or "", n, max_turns), retries + 1, delay)
        return i, m, sum(x["role"] == "user" for x in m or ()), used, meter.calls if usage else []

    def run(batches):
        book = ledger.session() if ledger else None
        for b in batches:
            got = [x for x in pooled(lambda t: one(t, book), zip(*(b.column(k).to_pylist() for k in range(4)), strict=True), workers) if x[1] or usage]
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(message)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())]
            names = ["task_id", "messages", "num_turns", "attempts"]
            yield pa.RecordBatch.from_arrays(out + ([_usage_array(cols[4])] if usage else []), names + (["usage"] if usage else []))

    schema = "task_id bigint, messages array<struct<role:string,content:string,turn:int>>, num_turns int, attempts int"
    rows = tasks.select("task_id", "query", "persona", "target_turns")
    return in_batches(ledger.dealt(rows, F.col("task_id")) if ledger else rows, run, schema + (f", usage {USAGE}" if usage else ""))


def usage_rows(df: DataFrame, client: Client, module: str, col: str = "usage") -> DataFrame:
    """One row for each call that a column of calls holds: module, operation, provider, model, model_key and tokens."""
    from dialoom.operators.clients import name_of

    provider, model = name_of(client)
    calls = df.select(F.explode(col).alias("c"))
    return calls.select(F.lit(module).alias("module"), "c.operation", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(f"{provider}/{model}").alias("model_key"), "c.input_tokens", "c.output_tokens")


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """The tasks that no earlier run has finished."""
    return tasks.join(done.select(key), key, "left_anti")


def supplement(tasks: DataFrame, client: Client, rounds: int = 3, **how) -> DataFrame:
    """Simulate, then try the missing tasks again for a bounded number of rounds."""
    from dialoom.sources.storage import checkpointed

    done = checkpointed(simulate(tasks, client, **how))
    for _ in range(rounds):
        left = pending(tasks, done)
        if left.isEmpty():
            break
        more = checkpointed(simulate(left, client, **how))
        if more.isEmpty():
            break
        done = done.unionByName(more)
    return done


def ask(df: DataFrame, client: Client, prompt: str, answer: str, attempts: int = 1, workers: int = WORKERS, usage: str | None = None, ledger: Ledger | None = None) -> DataFrame:
    """df with a column of answers; '' where all attempts fail. Filter before: every row is asked.

    With usage, a column of that name holds the calls of the row, failed
    attempts that were answered among them. With a ledger, rows of equal
    prompts, of this run or any before, are asked and paid once.
    """
    from dialoom.operators.clients import Metered, pooled

    gone = {answer, usage}
    kept = df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in gone])

    def one(p, book):
        paid = book.paid(client, p or "") if book else client
        meter = Metered(paid) if usage else paid
        said = with_retries(lambda: meter.generate(p or ""), attempts)[0] or ""
        return said, meter.calls if usage else []

    def run(batches):
        book = ledger.session() if ledger else None
        for b in batches:
            if book:
                b = b.drop_columns(["__bucket"])
            got = list(pooled(lambda p: one(p, book), b.column(b.schema.get_field_index(prompt)).to_pylist(), workers))
            more = [pa.array([x for x, _ in got], pa.string())] + ([_usage_array([x for _, x in got])] if usage else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, answer, *([usage] if usage else [])])

    fields = [T.StructField(answer, T.StringType())] + ([T.StructField(usage, T._parse_datatype_string(USAGE))] if usage else [])
    rows = ledger.dealt(kept, F.coalesce(prompt, F.lit(""))) if ledger else kept
    return in_batches(rows, run, T.StructType([*kept.schema.fields, *fields]))


def chosen_strategies(table: list[tuple[str, bool, float]], seed: str, key: Column) -> Column:
    """Mandatory strategies, and others by their probability; one at random if that leaves none."""
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("must"), F.lit(float(p)).alias("p")) for n, m, p in table])
    hit = F.transform(F.filter(options, lambda s: s["must"] | (uniform(seed, key, s["name"]) < s["p"])), lambda s: s["name"])
    one = F.get(F.array_sort(F.transform(options, lambda s: F.struct(shuffle_key(f"{seed}/one", key, s["name"]).alias("h"), s["name"].alias("n")))), F.lit(0))["n"]
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(one))


# The layers, and the strategies of each as (name, mandatory, probability), that stand for a missing file.
DEFAULT_LAYERS = [("surface_noise", 0.5), ("incomplete_info", 0.3), ("semantic_ambiguity", 0.2)]
DEFAULT_STRATEGIES = {
    "surface_noise": [("colloquial_speech", True, 0.0), ("incomplete_sentence", True, 0.0), ("typo_misspelling", False, 0.3), ("punctuation_format", False, 0.5), ("emotional_attitude", False, 0.5)],
    "incomplete_info": [("missing_slots", False, 0.5), ("vague_slot_values", False, 0.6), ("unclear_priority", False, 0.7)],
    "semantic_ambiguity": [("multi_intent", False, 0.6), ("self_contradiction", False, 0.7), ("mind_changing", False, 0.4)],
}


def load_strategies(path: str) -> tuple[list[tuple[str, float]], dict[str, list[tuple[str, bool, float]]]]:
    """(layers with weights that sum to one, strategies of each layer) of a file; the defaults where there is none."""
    from dialoom.sources.config import load

    try:
        said = load(path)
    except FileNotFoundError:
        return DEFAULT_LAYERS, DEFAULT_STRATEGIES
    weights = {n: float(w) for n, w in (said.get("layer_weights") or dict(DEFAULT_LAYERS)).items()}
    total = sum(weights.values())
    tables = {layer: [(n, bool(x.get("mandatory")), float(x.get("probability", 0.0))) for n, x in rows.items()] for layer, rows in (said.get("strategies") or {}).items()}
    return [(n, w / total) for n, w in weights.items()], tables


def strategy_lines(names: Column, descriptions: dict[str, str]) -> Column:
    """Numbered strategies with their descriptions; one without is described by its name."""
    known = F.create_map(*[F.lit(x) for kv in descriptions.items() for x in kv])
    return F.array_join(F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". **"), n, F.lit("**: "), F.coalesce(F.element_at(known, n), n))), "\n")


def noise_decision(key: Column, layers: list[tuple[str, float]], probability: float, seed: str, enabled: bool = True) -> Column:
    """struct(layer, layer_index): none if disabled, skipped if not activated, else a weighted layer."""
    if not enabled:
        return F.struct(F.lit("none").alias("layer"), F.lit(0).alias("layer_index"))
    layer = F.when(uniform(f"{seed}/active", key) > probability, "skipped").otherwise(choice(uniform(f"{seed}/layer", key), layers))
    index = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n, _ in layers]), layer), F.lit(0)), F.lit(0)).cast("int")
    return F.struct(layer.alias("layer"), index.alias("layer_index"))


def noised(df: DataFrame, key: str, col: str, client: Client, layers, strategies, seed: str, probability: float = 0.7) -> DataFrame:
    """(key, text, noisy_text, layer, layer_index, strategies): a model rewrites the activated texts.

    Where the model says nothing the text stays, and layer and strategies are
    still recorded as applied.
    """
    d = df.select(key, F.col(col).alias("text"), noise_decision(F.col(key), layers, probability, seed).alias("n")).select(key, "text", "n.*")
    off = d.where("layer_index = 0").select(key, "text", F.col("text").alias("noisy_text"), "layer", "layer_index", F.array().cast("array<string>").alias("strategies"))
    on = d.where("layer_index > 0").withColumn("strategies", chosen_strategies(strategies, f"{seed}/strategy", F.col(key)))
    prompt = F.concat(F.lit("NOISE "), "layer", F.lit("\n"), strategy_lines(F.col("strategies"), {}), F.lit("\nintent: "), text.intent(F.col("text")), F.lit("\n"), "text")
    said = ask(on.withColumn("prompt", prompt), client, "prompt", "answer")
    clean = text.clean_response(F.col("answer"))
    return off.unionByName(said.select(key, "text", F.when(clean == "", F.col("text")).otherwise(clean).alias("noisy_text"), "layer", "layer_index", "strategies"))


INTENT_TEMPLATE = "INTENT\n{text}"


def extract_intents(df: DataFrame, client: Client, key: str, col: str, template: str = INTENT_TEMPLATE, **how) -> DataFrame:
    """(key, intent, slots, compressed_text, confidence) of each text, as a model reads it.

    A fence around the answer, or words before its object, are passed over;
    fields that it lacks take defaults. Where it holds no object, or there is no
    answer, the first request verb names the intent, with half the confidence.
    """
    head, tail = template.split("{text}")
    said_text = F.coalesce(col, F.lit(""))
    said = ask(df.select(key, said_text.alias("__text"), F.concat(F.lit(head), said_text, F.lit(tail)).alias("__prompt")), client, "__prompt", "__answer", **how)
    js = text.json_object(text.unfenced(F.col("__answer")))
    said = said.withColumn("__js", F.when(js.startswith("{"), js))
    found = F.col("__js").isNotNull()
    field = lambda f, other: F.coalesce(F.get_json_object("__js", f"$.{f}"), other)
    return said.select(
        key,
        F.when(found, field("intent", F.lit("unknown"))).otherwise(text.intent(F.col("__text"))).alias("intent"),
        F.when(found, field("slots", F.lit("{}"))).otherwise("{}").alias("slots"),
        F.when(found, field("compressed_text", F.col("__text"))).otherwise(F.col("__text")).alias("compressed_text"),
        F.when(found, 1.0).otherwise(0.5).alias("confidence"),
    )


def style_transfer(df: DataFrame, client: Client, seed: str = "t28") -> DataFrame:
    """Queries in a persona's manner, with the domain and scenario that the model infers; known values only."""
    template = F.when(uniform(seed, "doc_id") < 0.5, "partial").otherwise("full")
    said = ask(df.withColumn("template", template).withColumn("prompt", F.concat(F.lit("STYLE "), "template", F.lit("\n"), "persona", F.lit("\n"), "query")), client, "prompt", "answer")
    js = text.json_object(F.col("answer"))
    known = lambda c, names, other: F.when(F.lower(text.strip(c)).isin(*names), F.lower(text.strip(c))).otherwise(other)
    field = lambda f, default: F.coalesce(F.get_json_object(js, f"$.{f}"), F.lit(default))
    return said.select(
        "doc_id",
        F.col("query").alias("original_query"),
        F.when(js.isNull(), text.strip(F.col("answer"))).otherwise(F.coalesce(F.get_json_object(js, "$.adapted_query"), "query")).alias("adapted_query"),
        known(field("inferred_domain", "general"), text.DOMAINS, "others").alias("inferred_domain"),
        known(field("inferred_scenario", "casual"), text.SCENARIOS, "others").alias("inferred_scenario"),
        F.col("template").alias("prompt_type"),
    )


def noise_prompt(persona: Column, slots: Column, strategies: Column, descriptions: dict[str, str]) -> Column:
    """Persona, slots and numbered strategies in their given order; a note stands for an empty part."""
    part = lambda c, note: F.when(F.size(c) == 0, note).otherwise(text.persona_lines(c))
    return F.concat_ws("\n", part(persona, "(no persona)"), part(slots, "(no slots)"), strategy_lines(strategies, descriptions))


def formulate(df: DataFrame, client: Client, min_length: int = 50, attempts: int = 3) -> DataFrame:
    """personas with a system_prompt; an answer that is no valid prompt counts as none and gives ''."""
    said = ask(df.withColumn("__prompt", F.concat(F.lit("PERSONA\n"), text.persona_lines(F.col("features"), titled=True))), client, "__prompt", "system_prompt", attempts)
    return said.withColumn("system_prompt", F.when(text.valid_prompt(F.col("system_prompt"), min_length), F.col("system_prompt")).otherwise("")).drop("__prompt")


def score_responses(df: DataFrame, client: Client, key: str, query: str, *more: str, workers: int = WORKERS) -> DataFrame:
    """(key, more, scores): an answer to each query, judged twice from its first 2,000 characters; a failed judge scores 5, and scores.failed says so."""
    from dialoom.operators.clients import pooled

    asked = df.select(key, *more, F.col(query).alias("__q"))

    def one(q):
        call = lambda p: with_retries(lambda: client.generate(p), 1)[0] or ""
        response = call("" if q is None else f"ANSWER\n{q}")
        return call(f"JUDGE persona\n{response[:2000]}"), call(f"JUDGE task\n{response[:2000]}")

    def run(batches):
        for b in batches:
            got = list(pooled(one, b.column(b.num_columns - 1).to_pylist(), workers))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], [*b.schema.names[:-1], "s1", "s2"])

    schema = T.StructType([*asked.schema.fields[:-1], T.StructField("s1", T.StringType()), T.StructField("s2", T.StringType())])
    return in_batches(asked, run, schema).select(key, *more, F.struct(text.ten_score(F.col("s1")).alias("persona_score"), text.ten_score(F.col("s2")).alias("task_score"), ((F.col("s1") == "") | (F.col("s2") == "")).alias("failed")).alias("scores"))
