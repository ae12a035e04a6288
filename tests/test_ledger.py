"""Calls are paid once: across runs, across equal prompts, and when a worker is lost."""

import os
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from dialoom.operators import dialogue, usage
from dialoom.operators.ledger import Ledger, Pace

ROOT = Path(__file__).resolve().parents[1]

LOST = """
import os, sys
from dialoom.session import local_session
from dialoom.operators import dialogue
from dialoom.operators.ledger import Ledger

folder = sys.argv[1]

class Deadly(dialogue.MockClient):
    # notes every answered call, and takes its whole process down once in the middle of one
    def generate_with_tokens(self, prompt):
        if prompt.endswith("question 60") and not os.path.exists(folder + "/died"):
            open(folder + "/died", "w").close()
            os._exit(1)
        with open(folder + "/calls", "a") as f:
            f.write(prompt.replace("\\n", " ") + "\\n")
        return super().generate_with_tokens(prompt)

spark = local_session("2,4", "lost", 2)
book = Ledger(folder + "/ledger", buckets=4)
rows = spark.range(0, 120, 1, 3).selectExpr("id", "concat('REPLY question ', id) AS prompt")
got = dialogue.ask(rows, Deadly(), "prompt", "answer", workers=1, ledger=book).collect()
print("GOT", len(got), sum(r.answer != "" for r in got), book.calls(spark).count())
"""


def counting(path, empty_every=0):
    """A client that notes its calls in a file, as it runs in other processes; a local class travels with the plan."""

    class Counting(dialogue.MockClient):
        def generate(self, prompt):
            with open(path, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            return super().generate(prompt)

    return Counting(empty_every)


def calls(path):
    return Path(path).read_text().splitlines() if Path(path).exists() else []


def test_a_lost_worker_repeats_no_answered_call(tmp_path):
    (tmp_path / "job.py").write_text(LOST.replace("\\\\n", "\\n"))
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path)], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(ROOT)})
    assert "GOT 120 120 120" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert max(Counter(calls(tmp_path / "calls")).values()) == 1 and len(calls(tmp_path / "calls")) == 120


def test_equal_prompts_and_later_runs(spark, tmp_path):
    book = Ledger(str(tmp_path / "l"), buckets=3)
    rows = spark.range(60).select("id", F.concat(F.lit("REPLY "), F.col("id") % 7).alias("prompt")).union(spark.createDataFrame([(99, None)], "id bigint, prompt string"))
    client = counting(str(tmp_path / "calls"))
    one = dialogue.ask(rows, client, "prompt", "answer", ledger=book).collect()
    assert len(calls(tmp_path / "calls")) == 8
    two = dialogue.ask(rows, client, "prompt", "answer", ledger=book, usage="u")
    assert sorted(r.answer for r in two.collect()) == sorted(r.answer for r in one)
    assert len(calls(tmp_path / "calls")) == 8 and book.calls(spark).count() == 8
    other = Ledger(str(tmp_path / "none"))
    assert other.calls(spark).count() == 0


def test_dialogues_resume_and_totals_are_the_ledgers(spark, tmp_path):
    tasks = spark.range(40).select(F.col("id").alias("task_id"), F.concat(F.lit("ask "), "id").alias("query"), F.lit("p").alias("persona"), F.lit(3).alias("target_turns"))
    client = counting(str(tmp_path / "calls"), empty_every=11)
    book = Ledger(str(tmp_path / "l"), buckets=5)
    dialogue.simulate(tasks.where("task_id < 25"), client, ledger=book).collect()
    so_far = len(calls(tmp_path / "calls"))
    got = dialogue.simulate(tasks, client, usage=True, ledger=book)
    rows = got.collect()
    assert len(calls(tmp_path / "calls")) == book.calls(spark).count() > so_far
    plain = dialogue.simulate(tasks, dialogue.MockClient(11), usage=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain))
    totals = usage.totals(dialogue.usage_rows(got, client, "m", "usage")).where("scope = 'all'").first()
    said = book.calls(spark).agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count("*").alias("n")).first()
    assert (totals.input_tokens, totals.output_tokens, totals.calls) == (said.i, said.o, said.n)


def test_a_cut_off_line_is_asked_again(spark, tmp_path):
    book = Ledger(str(tmp_path / "l"), buckets=1)
    rows = spark.range(5).select("id", F.concat(F.lit("REPLY "), "id").alias("prompt"))
    client = counting(str(tmp_path / "calls"))
    dialogue.ask(rows, client, "prompt", "answer", workers=1, ledger=book).collect()
    file = next((tmp_path / "l" / "bucket=0").glob("*.json"))
    file.write_bytes(file.read_bytes()[:-9])
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert len(dialogue.ask(rows, client, "prompt", "answer", workers=1, ledger=book).collect()) == 5
    assert len(calls(tmp_path / "calls")) == 6


def test_pace():
    pace, start = Pace(50), time.monotonic()
    for _ in range(11):
        pace.wait()
    assert 0.19 < time.monotonic() - start < 2
    assert Ledger("x", rate=10.0).session().pace.gap == 0.1
