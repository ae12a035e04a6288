"""Conversation structure repair against an enumeration of all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from dialoom.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string, kept string, fault int"
COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SPACE = "\x20\x09-\x0D"


def all_edits(rows):
    """(cost, audit, repaired) of every edit with up to two turns inserted at a place."""
    options = [[("I" * k, 5 * k, [(r, "") for r in combo])] for k in range(3) for combo in itertools.product(("user", "assistant"), repeat=k)]
    inserts = [o[0] for o in options]
    partial = [(0, "", ())]
    for role, text, fault in rows:
        acts = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            acts += [("K", extra, [(role, text)]), ("R", 1 + extra, [("user", text)]), ("R", 1 + extra, [("assistant", text)])]
        partial = [(c + ci + ca, a + ai + aa, (*out, *oi, *oa)) for c, a, out in partial for ai, ci, oi in inserts for aa, ca, oa in acts]
    return [(c + ci, a + ai, (*out, *oi)) for c, a, out in partial for ai, ci, oi in inserts]


def cheapest(rows):
    """The same least (cost, audit) for longer conversations: edits in order of cost, then of the audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        step = lambda letter, price, j, role, text: heapq.heappush(heap, (cost + price, audit + letter, j, role[0], (*out, (role, text)))) if (last + role[:1]) in ("s", "u", "su", "ua", "au") else None  # noqa: E731,B023
        for role in ("user", "assistant"):
            step("I", 5, i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role:
                    step("K", extra, i + 1, role, text)
                for r in ("user", "assistant"):
                    step("R", 1 + extra, i + 1, r, text)


def judged(rows):
    """(turn, role, text, fault) of sorted rows."""
    seen, out = set(), []
    for turn, role, text in rows:
        body = re.sub(f"[{SPACE}]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain(rows):
    rows = judged(sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())))
    best = cheapest([r[1:] for r in rows])
    if len(rows) < 4:
        assert best == min((c, a, out) for c, a, out in all_edits([r[1:] for r in rows]) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and all(r for r, _ in out))
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = [r[3] for r in rows]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], sha)


def sample(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(0, longest)):
            out.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "sage", "tool"]), rng.choice(["a.", "b!", "c", "d", " \n", "", None, "Zé?\t"]), "clash", 1))
    return out


def by_conversation(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        out[c].append((t, r, x))
    return out


@pytest.mark.parametrize(("seed", "longest"), [(1, 3), (2, 9)])
def test_digest_is_that_of_the_best_of_all_edits(spark, seed, longest):
    rows = sample(seed, 80, longest)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_digest(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {c: plain(v) for c, v in by_conversation(rows).items()}


def test_the_rows_say_what_the_digest_does(spark):
    rows = spark.createDataFrame(sample(3, 40, 9), TURNS)
    edits = defaultdict(list)
    for r in repair.repair(rows).collect():
        edits[r.conv_id].append(r)
    for d in repair.repair_digest(rows).collect():
        mine = sorted(edits[d.conv_id], key=lambda r: r.seq)
        assert "".join(r.edit for r in mine) == d.audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == d.repaired_sha256


def test_many_turns_in_one_conversation_and_in_any_partitions(spark):
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 11 else "user", f"turn {i}{'.' if i % 5 else ''}", "clash", 1) for i in range(20_000)]
    df = spark.createDataFrame(rows, TURNS)
    one = repair.repair_digest(df).collect()
    assert one == repair.repair_digest(df.repartition(9)).collect()
    assert len(one) == 1 and len(re.sub("I", "", one[0].audit)) == 20_000


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Word {c} {t}. Is it? Yes!", "clash", 1) for c in range(300) for t in range(1 + c % 2)] + [(None, None, None, None, "clash", 1)]
    got = {r.conv_id: r for r in repair.repair_digest(repair.damaged(spark.createDataFrame(rows, TURNS)), there=repair.F.col("there")).collect()}
    want = {}
    for c, t, r, x, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        out = want.setdefault(c, [])
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        if kind:
            out += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    assert set(got) == set(want)
    gone = 0
    for c, v in want.items():
        mine = tuple(got[c][k] for k in COLUMNS)
        assert mine == (plain(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
        gone += not v
    assert gone
    assert not repair.repair_digest(repair.damaged(spark.createDataFrame([], TURNS)), there=repair.F.col("there")).collect()
