"""Text parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSISTANT_MARK = "[ASSISTANT_RESPONSE]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?s)^\s+|\s+$", "")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def title_words(c: Column) -> Column:
    """snake_case as Title Case."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def persona_lines(features: Column, titled: bool = False) -> Column:
    """`- key: value` lines; features is an array of structs with name and value, in the order wanted."""
    return F.array_join(F.transform(features, lambda x: F.concat(F.lit("- "), title_words(x["name"]) if titled else x["name"], F.lit(": "), x["value"])), "\n")


def dialogue_lines(msgs: Column, empty: str = "") -> Column:
    """`User: ` and `Assistant: ` lines of all messages."""
    return F.when(F.size(msgs) == 0, F.lit(empty)).otherwise(F.array_join(F.transform(msgs, lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), m["content"])), "\n"))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def conversation_text(msgs: Column, with_assistant: bool = True) -> Column:
    """A conversation as one text; a blank line follows each assistant turn, trailing ones go."""
    say = lambda m: F.when(m["role"] == "assistant", m["content"] if with_assistant else F.lit(ASSISTANT_MARK)).when(m["role"] == "user", F.concat(F.lit("User: "), m["content"])).otherwise(F.concat(capitalised(m["role"]), F.lit(": "), m["content"]))
    empty = lambda m: F.coalesce(m["content"], F.lit("")) == ""
    gone = (lambda m: empty(m)) if with_assistant else (lambda m: empty(m) & (m["role"] != "assistant"))
    lines = F.flatten(F.transform(F.filter(msgs, lambda m: ~gone(m)), lambda m: F.when(m["role"] == "assistant", F.array(say(m), F.lit(""))).otherwise(F.array(say(m)))))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", "")


def session_text(msgs: Column, max_chars: int) -> Column:
    """User turns, cut at max_chars, and a mark for each assistant turn; other roles are left out."""
    kept = F.filter(msgs, lambda m: m["role"].isin("user", "assistant"))
    cut = lambda c: F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("..."))).otherwise(c)
    return F.array_join(F.transform(kept, lambda m: F.when(m["role"] == "user", F.concat(F.lit("**User:** "), cut(m["content"]))).otherwise(F.lit("**Assistant:** [Assistant responded]"))), "\n")


def history_text(sessions: Column, own: Column, limit: int | None = None) -> Column:
    """Numbered sessions that have any text; without sessions the own conversation; a note for those beyond the limit.

    Numbers count every session, also those without text.
    """
    shown = sessions if limit is None else F.slice(sessions, 1, limit)
    parts = F.filter(F.transform(shown, lambda s, i: F.when(s != "", F.concat(F.lit("### Session "), (i + 1).cast("string"), F.lit(":\n"), s))), lambda s: s.isNotNull())
    if limit is not None:
        more = F.size(sessions) - limit
        parts = F.when(more > 0, F.concat(parts, F.array(F.concat(F.lit("\n(... "), more.cast("string"), F.lit(" more sessions omitted for brevity)"))))).otherwise(parts)
    none = F.lit("(No conversation history available)")
    alone = F.when(own != "", F.concat(F.lit("### Previous conversation in this session:\n"), own)).otherwise(none)
    return F.when(F.size(sessions) == 0, alone).when(F.size(parts) == 0, none).otherwise(F.array_join(parts, "\n\n"))


#: Our own wording of the task frame; placeholders are the contract.
STATE_HEAD = "Read the earlier conversations, infer how this user likes to ask, and improve the current query."
STATE_TASK = "## Task\n\nWrite one improved query in the user's own manner. Give the query alone."


def state_text(histories: Column, query: Column) -> Column:
    """Sections of the optimiser's input: frame, numbered histories if any, current query, task."""
    past = F.transform(histories, lambda h, i: F.concat(F.lit("### Conversation "), (i + 1).cast("string"), F.lit("\n\n"), h, F.lit("\n\n---")))
    body = F.when(F.size(histories) > 0, F.concat(F.array(F.lit(STATE_HEAD), F.lit("## Historical Conversations")), past)).otherwise(F.array(F.lit(STATE_HEAD)))
    return F.array_join(F.concat(body, F.array(F.concat(F.lit("## Current Query\n\nUser: "), query), F.lit(STATE_TASK))), "\n\n")


def sft_output(reasoning: Column, prompt: Column) -> Column:
    return F.concat(F.lit("<REASONING>"), reasoning, F.lit("</REASONING><PROMPT>"), prompt, F.lit("</PROMPT>"))


def parse_tags(c: Column) -> Column:
    """struct(reasoning, prompt) of the first tagged parts; the whole text where no prompt is tagged."""
    inner = lambda tag: strip(F.coalesce(_first(c, rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit("")))
    prompt = inner("PROMPT")
    return F.struct(inner("REASONING").alias("reasoning"), F.when(prompt == "", strip(c)).otherwise(prompt).alias("prompt"))


def clean_output(c: Column) -> Column:
    """A model's answer without its reasoning part, whole or cut off, and without prompt tags."""
    t = strip(F.coalesce(c, F.lit("")))
    opened, closed = t.rlike("(?i)<REASONING>"), t.rlike("(?i)</REASONING>")
    whole = F.regexp_replace(t, r"(?is)<REASONING>.*?</REASONING>\s*", "")
    rest = F.when(opened & ~closed, F.regexp_replace(whole, r"(?is)<REASONING>.*$", "")).when(closed & ~opened, F.regexp_replace(whole, r"(?is)^.*?</REASONING>\s*", "")).otherwise(whole)
    rest = strip(rest)
    after = F.when(rest.rlike("(?i)<PROMPT>"), strip(F.regexp_extract(rest, r"(?is)<PROMPT>(.*)$", 1))).otherwise(rest)
    before = F.when(after.rlike("(?i)</PROMPT>"), strip(F.regexp_extract(after, r"(?is)^(.*?)</PROMPT>", 1))).otherwise(after)
    inner = F.when(rest.rlike(r"(?is)<PROMPT>.*?</PROMPT>"), strip(F.regexp_extract(rest, r"(?is)<PROMPT>(.*?)</PROMPT>", 1))).otherwise(before)
    return F.when(~opened & ~closed, t).otherwise(inner)


def unit_score(c: Column, scale: int = 5) -> Column:
    """The first number; from 1 to scale it is mapped onto 0 to 1, then clamped there; none is 0."""
    v = F.regexp_extract(c, r"-?[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    mapped = F.when((v >= 1) & (v <= scale), (v - 1) / (scale - 1)).otherwise(v)
    return F.when(v.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mapped)))


def ten_score(c: Column) -> Column:
    """The first whole number, clamped to 1..10; none is 5."""
    v = F.regexp_extract(c, r"\b([0-9]+)\b", 1).try_cast("bigint")
    return F.when(v.isNull(), 5).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), v))).cast("bigint")


def verdict(c: Column) -> Column:
    """1.0 for a win, 0.0 for anything else."""
    t = F.lower(strip(c))
    return F.when(t.isin("lose", "tie"), 0.0).when(t.contains("win"), 1.0).otherwise(0.0)


def dataset_of(query_id: Column) -> Column:
    return F.substring_index(query_id, ":", 1)


def source_of(query_id: Column) -> Column:
    """What follows the first colon, or null."""
    return F.when(F.instr(query_id, ":") > 0, F.substr(query_id, F.instr(query_id, ":") + 1))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_or_last(*cols: Column) -> Column:
    """The first that is not empty, else the last as it is: empty, or null."""
    *some, last = cols
    return F.coalesce(first_truthy(*some), last)


def is_json(c: Column) -> Column:
    """Whether all of it is one JSON value.

    The parser stops after a first value, so the text stands in an array before
    its own checksum, which is the second member only if nothing else follows.
    """
    sum_ = F.md5(c)
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(', "'), sum_, F.lit('"]')))
    return F.coalesce(F.try_variant_get(both, "$[1]", "string") == sum_, F.lit(False))


def json_object(c: Column) -> Column:
    """The text if it is JSON, else its first object without inner braces, if that is JSON."""
    t = strip(c)
    inner = F.regexp_extract(t, r"\{[^{}]*\}", 0)
    return F.when(is_json(t), t).when((inner != "") & is_json(inner), inner)


def unfenced(c: Column) -> Column:
    """Without a Markdown fence around it."""
    t = strip(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```$", "")).otherwise(t)


def clean_response(c: Column) -> Column:
    """Without outer white space, one pair of equal quotes and a fence."""
    t = strip(c)
    quoted = (F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
    return strip(unfenced(F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)))


# Request verbs and the intents they name.
INTENT_VERBS = {
    "write": "write",
    "create": "create",
    "make": "create",
    "help": "assist",
    "explain": "explain",
    "summarize": "summarize",
    "translate": "translate",
    "fix": "fix",
    "debug": "debug",
    "review": "review",
    "edit": "edit",
    "improve": "improve",
    "analyze": "analyze",
    "find": "search",
    "search": "search",
    "generate": "generate",
    "list": "list",
    "compare": "compare",
}


def intent(c: Column, verbs: dict[str, str] = INTENT_VERBS) -> Column:
    """The intent of the first word that is a verb of the map."""
    known = F.create_map(*[F.lit(x) for kv in verbs.items() for x in kv])
    hits = F.filter(F.split(strip(F.lower(c)), r"\s+"), lambda w: F.map_contains_key(known, w))
    return F.coalesce(F.element_at(known, F.get(hits, F.lit(0))), F.lit("general_request"))


# Domains and scenarios of queries.
DOMAINS = "general writing coding data product design marketing sales customer_support bizdev ops career education finance legal health travel shopping food communication productivity life_admin research news entertainment others".split()
SCENARIOS = "in_a_rush work_task learning decision_making troubleshooting brainstorming planning casual others".split()

# What a failed prompt says.
ERROR_PHRASES = ("i cannot generate", "unable to generate", "i apologize", "i'm sorry, i cannot", "error occurred", "failed to generate", "invalid request", "cannot create")
ERROR_WORDS = ("sorry", "error", "cannot", "unable", "failed")


def valid_prompt(c: Column, min_length: int = 50) -> Column:
    low = F.lower(c)
    head = F.substring(low, 1, 100)
    bad = F.lit(False)
    for p in ERROR_PHRASES:
        bad = bad | head.contains(p)
    short = F.lit(False)
    for w in ERROR_WORDS:
        short = short | low.contains(w)
    return (F.length(c) >= min_length) & (strip(c) != "") & ~bad & ~((F.length(c) < 100) & short)


def feedback(c: Column) -> Column:
    """The follow-up of a feedback answer, or null: satisfied, too short, or unreadable and short."""
    t = unfenced(c)
    said = F.get_json_object(t, "$.feedback")
    happy = F.coalesce(F.get_json_object(t, "$.satisfied") == "true", F.lit(False))
    return F.when(is_json(t), F.when(~happy & (F.length(strip(said)) > 5), said)).when(F.length(strip(c)) >= 10, c)


# Public chat markup of three model families.
CHAT_MARKUP = {
    "qwen": ("<|im_start|>system\n", "<|im_end|>\n", "<|im_start|>user\n", "<|im_end|>\n", "<|im_start|>assistant\n"),
    "llama": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "harmony": ("<|start|>developer<|message|>", "<|end|>", "<|start|>user<|message|>", "<|end|>", "<|start|>assistant<|channel|>final<|message|>"),
}


def chat_family(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.contains("llama"), "llama").when(low.contains("gpt-oss"), "harmony").otherwise("qwen")


def chat_prompt(family: Column, system: Column, user: Column) -> Column:
    """A prompt in a family's markup; no system part for an empty system text."""
    out = None
    for name, (s0, s1, u0, u1, a) in CHAT_MARKUP.items():
        head = F.when(F.coalesce(system, F.lit("")) == "", "").otherwise(F.concat(F.lit(s0), system, F.lit(s1)))
        text = F.concat(head, F.lit(u0), user, F.lit(u1), F.lit(a))
        out = F.when(family == name, text) if out is None else out.when(family == name, text)
    return out


# Public tokenizer names by checkpoint name.
def tokenizer_of(checkpoint: Column) -> Column:
    low = F.lower(F.coalesce(checkpoint, F.lit("")))
    return F.when(low.contains("llama"), "meta-llama/Llama-3.1-8B-Instruct").when(low.contains("qwen"), "Qwen/Qwen3-8B").otherwise("openai/gpt-oss-20b")


def mock_tokens(c: Column) -> Column:
    """Two tokens a word, as the mock client counts."""
    t = strip(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")) * 2).cast("bigint")


SYSTEM_MARK = "[SYSTEM]"


def with_system(c: Column, system: str) -> Column:
    return F.when(c.startswith(SYSTEM_MARK), c).otherwise(F.concat(F.lit(f"{SYSTEM_MARK}\n{system}\n\n"), c))
