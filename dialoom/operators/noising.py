"""Noise strategies over whole texts, in time proportional to their length.

The folds of functions.noise rewrite a word array at every hit, which suits
short messages; over texts of thousands of words the same draws are made here
in Arrow batches. Both give the same text, as the tests hold.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from dialoom.functions.noise import FILLERS, NEIGHBOURS, SYNONYMS
from dialoom.operators.batches import in_batches

BLANKS = " \t\n\x0b\f\r"
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def _uniform(seed: str, *parts) -> float:
    """functions.rand.uniform for one row."""
    raw = ":".join([seed, *map(str, parts)]).encode()
    return (int(hashlib.md5(raw, usedforsecurity=False).hexdigest()[:8], 16) + 1.0) / 4294967297.0


def _at(u: float, n: int) -> int:
    return min(int(u * n), n - 1)


def _words(text: str) -> list[str]:
    bare = text.strip(BLANKS)
    return _BLANK.split(bare) if bare else []


def _share(words: list[str], rate: float) -> int:
    return max(1, int(len(words) * rate)) if words else 0


def typos(text: str, key, intensity: float = 0.1, seed: str = "typo") -> str:
    words = _words(text)
    for k in range(1, _share(words, intensity) + 1):
        i = _at(_uniform(f"{seed}/w", key, k), len(words))
        w = words[i]
        p = _at(_uniform(f"{seed}/c", key, k), len(w))
        near = NEIGHBOURS.get(w[p].lower())
        if len(w) > 2 and near:
            new = near[_at(_uniform(f"{seed}/n", key, k), 2)]
            words[i] = w[:p] + (new if w[p] == w[p].lower() else new.upper()) + w[p + 1 :]
    return " ".join(words)


def insertions(text: str, key, rate: float = 0.05, seed: str = "ins") -> str:
    words = _words(text)
    for k in range(1, _share(words, rate) + 1):
        words.insert(_at(_uniform(f"{seed}/p", key, k), len(words) + 1), FILLERS[_at(_uniform(f"{seed}/f", key, k), len(FILLERS))])
    return " ".join(words)


def synonyms(text: str, key, rate: float = 0.15, tries: int = 10, seed: str = "syn") -> str:
    words = _words(text)
    plain = lambda w: w.lower().strip(".,!?")
    for k in range(1, _share(words, rate) + 1):
        for t in range(1, tries + 1):
            i = _at(_uniform(f"{seed}/p", key, k, t), len(words))
            options = SYNONYMS.get(plain(words[i]))
            if options:
                new, head = options[_at(_uniform(f"{seed}/s", key, k), len(options))], words[i][0]
                words[i] = new if head == head.lower() else new[0].upper() + new[1:]
                break
    return " ".join(words)


def deletions(text: str, key, rate: float = 0.05, seed: str = "del") -> str:
    words = _words(text)
    n = max(1, int(len(words) * rate))
    if len(words) <= n + 2:
        return text
    head, md5 = f"{seed}:{key}:".encode(), hashlib.md5
    order = [md5(head + b"%d" % i, usedforsecurity=False).digest() for i in range(len(words))]
    for i in sorted(range(len(words)), key=order.__getitem__)[:n]:
        words[i] = None
    return " ".join([w for w in words if w is not None])


STRATEGIES = {"typo": typos, "word_deletion": deletions, "word_insertion": insertions, "synonym": synonyms}


def noisy(df: DataFrame, key: str, text: str, strategy: str, out: str = "noisy") -> DataFrame:
    """(key, out): each text under a strategy; a null text stays null. The key has to be a whole number or a string."""
    f = STRATEGIES[strategy]
    slim = df.select(key, text)

    def run(batches):
        for b in batches:
            said = [None if t is None else f(t, k) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], [key, out])

    return in_batches(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, `{out}` string")


class Noise:
    """noise(TABLE(t), strategy, key => 'doc_id', text => 'text'): a row (key, noisy) for each row of a table, in SQL."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, strategy: AnalyzeArgument, key: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if strategy.value not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy.value!r}; there are {', '.join(sorted(STRATEGIES))}")
        names = [a.value if a is not None else other for a, other in ((key, "doc_id"), (text, "text"))]
        fields = {f.name: f for f in rows.dataType.fields}
        for n in names:
            if n not in fields:
                raise ValueError(f"the table has no column {n}")
        return AnalyzeResult(T.StructType([fields[names[0]], T.StructField("noisy", T.StringType())]), select=[SelectedColumn(f"`{n}`") for n in names])

    def eval(self, row: Row, strategy: str, key: str = "doc_id", text: str = "text"):
        said = row[text]
        yield row[key], None if said is None else STRATEGIES[strategy](said, row[key])


def register(spark: SparkSession) -> None:
    """The strategies as a table function of the session's catalogue."""
    spark.udtf.register("noise", F.udtf(Noise, useArrow=False))
