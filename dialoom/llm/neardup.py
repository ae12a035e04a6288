"""MinHash near-dedup: a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Documents with equal
sets are one representative. In each of several independent trees a document
descends a path of minwise tokens: a small node compares all its members, a
larger one branches on the next token. A node still large at depth WIDE is
compared whole: first each member with the node's hub, the member that shares
most with the others, and what then stays apart in pairs of salted blocks.
Candidates are confirmed on the full sets, best first, and pairs that earlier
links already connect are skipped.

Recall: a pair of similarity s meets in a node of depth d with probability
s ** d in each tree, and no node is left uncompared at depth WIDE; the number
of trees follows from RECALL, for a pair of just the similarity and before
other paths of links. In large nodes pairs that agree in fewer than ALIKE of
all tokens are not confirmed; one at 0.75 does so with 3e-6. The result does
not depend on how rows are dealt out.

Defined results: a null or empty text has an empty set and is linked with
nothing; fewer than five words make one shingle of all; repeated rows are
equal sets; each row of a repeated id with unlike texts has the component of
its own text, and texts with the same least id are linked through it; rows
with a null id are never linked and always kept; an empty table gives an empty
one. keep_one keeps every row of an id that is kept in any row, so that no
text without a copy elsewhere is lost. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import WordHashes, ascii_lower, checkpointed, filter_place, id_filter, in_batches, in_filter, map_batches, slices, windows
from dialoom.llm.components import components

SHINGLE = 5
PERCENT = 75
#: A node of at most so many documents is compared exhaustively.
LEAF = 8
#: Nodes of this depth are compared whole, whatever their size.
WIDE = 3
#: The least chance to meet in a node for two sets of just the similarity; it sets the number of trees.
RECALL = 0.9998
#: Minwise tokens of a tree; those beyond WIDE only estimate similarity inside large nodes.
DEPTH = 6


def trees_for(recall: float, percent: int = PERCENT, depth: int = WIDE) -> int:
    """The least number of independent trees in which a pair of the similarity meets with the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** depth)))


TREES = trees_for(RECALL)
#: Members of a large node in one block.
BLOCK_ROWS = 512
#: Of the TREES * DEPTH tokens, so many are equal in a pair worth confirming.
ALIKE = 52
SEED = 7
_BLOCK = 4096


def shingles(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = ascii_lower(text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.array(words)
    if len(h) < k:
        return windows(h, len(h)) ^ np.uint64(len(h))
    s = np.sort(windows(h, k))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def minwise(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One minwise token for each factor."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), _BLOCK):
            np.minimum(out, np.multiply.outer(factors, s[at : at + _BLOCK]).min(1), out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, s1, s2, path): set size, 128-bit set hash and the tokens of all trees."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = WordHashes()

    def sketch(cols):
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_shingles": [], "s1": [], "s2": [], "path": []}
        for t in cols["text"]:
            s = shingles(t, hashes)
            raw = xxhash.xxh3_128_digest(s.tobytes())
            out["n_shingles"].append(len(s))
            out["s1"].append(int.from_bytes(raw[:8], "little", signed=True))
            out["s2"].append(int.from_bytes(raw[8:], "little", signed=True))
            out["path"].append(minwise(s, factors) if len(s) else None)
        return out

    return map_batches(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
        sketch,
        "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, path array<int>",
        pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("path", pa.list_(pa.int32()))]),
        hashes,
    )


def branched(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a row for each node in which a pair met, and (node, tree, rep, size) of the nodes left large.

    Level by level: nodes of 2 to LEAF members are compared, larger ones branch
    on their next token. Sizes are counted before rows are brought together, so
    only small nodes ever become a group, and a hot node is an ordinary skewed
    join; nothing depends on how the rows are dealt out.
    """
    levels = [f"n{i}" for i in range(1, WIDE + 1)]
    tokens = lambda t, i: [F.get("path", F.lit(t * DEPTH + k)) for k in range(i)]
    at = F.array(*[F.struct(F.lit(t).cast("short").alias("tree"), *[F.xxhash64(F.lit(t), *tokens(t, i)).alias(n) for i, n in enumerate(levels, 1)]) for t in range(TREES)])
    rows = reps.select("rep", F.col("n_shingles").cast("int").alias("n"), F.explode(at).alias("x")).select("x.*", "rep", "n")
    pairs = []
    for k, node in enumerate(levels):
        sizes = rows.groupBy(node).agg(F.count("*").alias("size")).where("size > 1")
        rows = checkpointed(rows.join(sizes.hint("merge"), node))
        group = rows.where(F.col("size") <= LEAF).groupBy(node).agg(F.collect_list(F.struct("rep", "n")).alias("g"))
        met = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["rep"] > x["rep"]) & _sized(x["n"], y["n"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
        pairs.append(group.select(F.explode(met).alias("p")).select("p.a", "p.b"))
        rows = rows.where(F.col("size") > LEAF)
        if k + 1 < len(levels):
            rows = rows.drop("size", node)
    return reduce(DataFrame.union, pairs), rows.select(F.col(levels[-1]).alias("node"), "tree", "rep", "size")


def _sized(m, n):
    """Set sizes that allow the similarity."""
    return 100 * F.least(m, n).cast("bigint") >= PERCENT * F.greatest(m, n).cast("bigint")


def hub_pairs(wide: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each member of a large node with the node's member that has most company over all trees."""
    weight = wide.groupBy("rep").agg(F.sum("size").alias("weight")).join(reps.select("rep", "n_shingles").hint("merge"), "rep")
    rows = checkpointed(wide.join(weight.hint("merge"), "rep").select("node", "rep", "n_shingles", "weight"))
    hubs = rows.groupBy("node").agg(F.max(F.struct("weight", (-F.col("rep")).alias("o"), "n_shingles")).alias("h"))
    hubs = hubs.select("node", (-F.col("h.o")).alias("hub"), F.col("h.n_shingles").alias("n"))
    return rows.join(hubs.hint("merge"), "node").where((F.col("rep") != F.col("hub")) & _sized(F.col("n_shingles"), F.col("n"))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def alike(rows: pa.Table) -> pa.Table:
    """Links between the components of two blocks of a node, exact for pairs that agree in ALIKE tokens.

    Pairs that meet in an earlier tree's node are left to it, and pairs that
    links of these blocks already connect are skipped.
    """
    col = lambda n: rows.column(n).to_numpy()
    path = rows.column("path").combine_chunks().flatten().to_numpy().reshape(-1, TREES * DEPTH)
    rep, size, comp, salt, x, y = (col(n) for n in ("rep", "n_shingles", "comp", "salt", "x", "y"))
    left, right = np.flatnonzero(salt == x), np.flatnonzero(salt == y)
    equal = np.zeros((len(left), len(right)), np.uint8)
    met = np.zeros((TREES, len(left), len(right)), bool)
    for t in range(TREES):
        same = np.ones((len(left), len(right)), bool)
        for i in range(DEPTH):
            e = path[left, None, t * DEPTH + i] == path[None, right, t * DEPTH + i]
            equal += e
            if i < WIDE:
                same &= e
        met[t] = same
    own = int(rows.column("tree")[0].as_py())
    a, b = rep[left][:, None], rep[right][None, :]
    m, n = size[left][:, None], size[right][None, :]
    ok = (equal >= ALIKE) & ~met[:own].any(0) & (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n))
    if x[0] == y[0]:
        ok &= a < b
    i, j = np.nonzero(ok)
    best = np.argsort(-equal[i, j].astype(np.int16), kind="stable")
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")] if len(i) else []
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for u, v in zip(left[i[best]].tolist(), right[j[best]].tolist(), strict=True):
        cu, cv = root(int(comp[u])), root(int(comp[v]))
        if cu != cv:
            both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[u]) + len(sets[v]) - both):
                parent[cu] = cv
                links.append((min(rep[u], rep[v]), max(rep[u], rep[v])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def apart_links(wide: DataFrame, reps: DataFrame, comps: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(a, b): links inside large nodes between what comps leaves apart; only links leave a task. None if nothing is apart."""
    named = wide.join(comps.select(F.col("id").alias("rep"), F.col("component").alias("comp")).hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    named = checkpointed(named)
    mixed = named.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node")
    rows = checkpointed(named.join(mixed.hint("merge"), "node"))
    if rows.isEmpty():
        return None
    sets = sets_of(rows.select(F.col("rep").alias("id"))).select(F.col("id").alias("rep"), "set")
    rows = rows.join(reps.select("rep", "n_shingles", "path").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), blocks)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.select("node", "tree", "rep", "n_shingles", "path", "set", "comp", "salt", F.least("salt", "k").alias("x"), F.greatest("salt", "k").alias("y"))
    return dealt.groupBy("node", "x", "y").applyInArrow(alike, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: np.ndarray, text: str, id_col: str) -> DataFrame:
    """(id, set) of the documents whose bit is set; sets as sorted 64-bit words."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), filter_place(F.col(id_col).cast("bigint")).alias("at"), F.col(text).alias("text"))
    hashes = WordHashes()
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                b = b.filter(in_filter(bits.value, b.column(1)))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, hashes).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["id", "set"])

    return in_batches(rows, run, "id bigint, set binary", hashes)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    j = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            b = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])

    return in_batches(j.select("a", "b", "sa", "sb"), run, "a bigint, b bigint").distinct()


def best_pairs(pairs: DataFrame) -> DataFrame:
    """For each document its most often met partner, as distinct pairs."""
    both = pairs.select(F.col("a").alias("x"), F.struct("n", (-F.col("b")).alias("o"), "a", "b").alias("p")).union(pairs.select(F.col("b").alias("x"), F.struct("n", (-F.col("a")).alias("o"), "a", "b").alias("p")))
    return both.groupBy("x").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs that no link connects yet."""
    ca = comps.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    cb = comps.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ca.hint("merge"), "a", "left").join(cb.hint("merge"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "n")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    marks = checkpointed(sketches(docs, text, id_col))
    reps = checkpointed(
        marks.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("path").alias("path"))
    )
    met, wide = branched(reps)
    wide = checkpointed(wide)
    if not wide.isEmpty():
        met = met.union(hub_pairs(wide, reps))
    pairs = checkpointed(met.groupBy("a", "b").agg(F.count("*").alias("n")))
    comps = reps.sparkSession.createDataFrame([], "id bigint, component bigint")
    links = None

    def sets_of(ids):
        # an id that is repeated with unlike texts has several sets
        return checkpointed(full_sets(docs, id_filter(ids, "id"), text, id_col).withColumn("h", F.xxhash64("set")).dropDuplicates(["id", "h"]).drop("h"))

    if not pairs.isEmpty():
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        # the second round tries all pairs that the first has not connected
        for choose in (best_pairs, lambda p: p.select("a", "b")):
            tried = checkpointed(choose(pairs))
            found = confirmed(tried, sets)
            links = checkpointed(found if links is None else links.union(found))
            comps = components(links, "a", "b")
            if choose is not best_pairs:
                break
            pairs = checkpointed(_apart(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), comps))
            if pairs.isEmpty():
                break
    found = None if wide.isEmpty() else apart_links(wide, reps, comps, sets_of)
    if found is not None:
        comps = components(found if links is None else links.union(found), "a", "b")
    named = reps.select("s1", "s2", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    named = checkpointed(named)
    joined = marks.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, but of each group of near-duplicates only the least id."""
    ids = near_duplicates(docs, text, id_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = ids.where("NOT kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
