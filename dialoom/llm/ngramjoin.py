"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct four-word shingles, and documents with
equal sets are one. Similar sets are first brought together by minwise keys and
linked inside bounded groups; the components of these links, dealt into groups
of bounded size, are the groups of the matrix, and every other set is a group
of its own. Then each set asks the groups of larger components: the matrix
holds the rarest tokens of a group's members with the places where they stand,
the places and the number of a query's tokens found there bound its overlap with
any member, a histogram of all tokens bounds it again, and only groups that may
hold a member similar enough are opened, where the whole union gives a third
bound before members are compared. A large group of one key shares a few hubs, its members of most
company, so that copies of one text become one component before the matrix.

No link is lost: with any order of tokens that is the same for all, two sets of
the similarity share one of their first n - ceil(0.85 n) + 1 tokens each. The
order is that of hashes with frequent tokens last. Frequent are those that stand
first in many documents of a sample, and, as others come to the front of documents that lose
theirs, those found often in such documents of it; sets without a frequent
token at the front are never read again. The tokens are kept in a filter of 4 MB,
and what it takes for frequent changes the work only, as the order is one for all. Of the first tokens only those of two components or
more leave the one shuffle that brings equal ones together.

Sets are told apart by a 64-bit hash and their size. The result does not depend
on how rows are dealt out.

Defined results: a null or empty text has an empty set and is linked with
nothing; fewer than four words make one shingle of all; repeated rows are equal
sets; each row of a repeated id has the component of its own text; rows with a
null id are never linked and have no component; an empty table gives an empty
one. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import FILTER_BITS, WordHashes, checkpointed, filter_place, id_filter, in_batches, in_filter, map_batches, slices
from dialoom.llm.components import components
from dialoom.llm.neardup import shingles

SHINGLE = 4
PERCENT = 85
#: Members of a group, and queries that open it in one task; and their tokens, where texts are long.
GROUP, GROUP_TOKENS = 32, 1_000_000
#: Minwise keys by which similar sets are brought together first; and all keys, which tell a large group's hubs.
KEYS, COMPANY = 2, 16
#: Hubs of a large group.
HUBS = 4
#: Parts of the token space whose counts bound the overlap of two sets.
PARTS = 64
#: A token that stands first in more documents, as the sample has it, is frequent; at most so many are told apart.
FREQUENT, FREQUENT_TOKENS = 256, 1 << 21
#: One set in so many is looked through for frequent tokens, whole if it has one at the front; any number gives the same links.
SAMPLE = 8
SEED = 13
#: Tokens are 62 bits of a hash; this bit puts the frequent ones last.
LAST = 1 << 62
_BLOCK = 4096


def first_tokens(n: int) -> int:
    """How many of n ordered tokens must be looked at to meet every set of the similarity."""
    return n - -(-PERCENT * n // 100) + 1


def minwise(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), _BLOCK):
            np.minimum(out, np.multiply.outer(factors, s[at : at + _BLOCK]).min(1), out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def histogram(s: np.ndarray) -> bytes | None:
    """How many tokens fall in each part of the token space; None where a byte cannot count them."""
    n = np.bincount((s >> np.uint64(58)).astype(np.intp), minlength=PARTS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def _rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, sid, keys, hist, first): the set's hash, its minwise keys, its histogram and its first tokens by the hash alone."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, COMPANY, np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = WordHashes()

    def sketch(cols):
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_shingles": [], "sid": [], "keys": [], "hist": [], "first": []}
        for t in cols["text"]:
            s = shingles(t, hashes, SHINGLE)
            out["n_shingles"].append(len(s))
            out["sid"].append(set_id(s) if len(s) else None)
            out["keys"].append(minwise(s, factors) if len(s) else None)
            out["hist"].append(histogram(s) if len(s) else None)
            out["first"].append((s[: first_tokens(len(s))] >> np.uint64(2)).view(np.int64) if len(s) else None)
        return out

    return map_batches(
        _rows(docs, text, id_col),
        sketch,
        "doc_id bigint, n_shingles bigint, sid bigint, keys array<int>, hist binary, first array<bigint>",
        pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("keys", pa.list_(pa.int32())), ("hist", pa.binary()), ("first", pa.list_(pa.int64()))]),
        hashes,
    )


def token_place(token: Column) -> Column:
    """The bit of a token in a filter of tokens, whether it is marked as frequent or not."""
    return token.bitwiseAND(F.lit(FILTER_BITS - 1))


def asked_sets(sets: DataFrame, asked: np.ndarray, tokens: np.ndarray | None = None) -> DataFrame:
    """(at, sid, first, hot): of sets (at, sid, first) those in the filter asked, and whether a first token is in the filter of tokens."""
    shared = sets.sparkSession.sparkContext.broadcast((asked, tokens))  # filters of a fixed size

    def run(batches):
        asked, tokens = shared.value
        for b in batches:
            b = b.filter(in_filter(asked, b.column(0)))
            first = b.column(2)
            hot = np.zeros(b.num_rows, bool)
            if tokens is not None:
                found = in_filter(tokens, pc.bit_wise_and(first.flatten(), FILTER_BITS - 1))
                hot[pc.list_parent_indices(first).filter(found).to_numpy(zero_copy_only=False)] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), first, pa.array(hot)], ["at", "sid", "first", "hot"])

    return in_batches(sets.select("at", "sid", "first"), run, "at bigint, sid bigint, first array<bigint>, hot boolean")


def all_tokens(sets: DataFrame) -> DataFrame:
    """(token): each token of sets (sid, set)."""

    def run(batches):
        for b in batches:
            for s in b.column("set"):
                yield pa.RecordBatch.from_arrays([pa.array((np.frombuffer(s.as_buffer(), np.uint64) >> np.uint64(2)).view(np.int64))], ["token"])

    return in_batches(sets.select("set"), run, "token bigint")


def frequent_filter(counts: DataFrame, least: int) -> np.ndarray | None:
    """A bit for each token of (token, n) with n over least; that rises until the tokens fit the filter. None without one."""
    many = checkpointed(counts.where(F.col("n") > least))  # few, so that they are counted once
    bits = id_filter(many, "token", token_place)
    while np.unpackbits(bits).sum(dtype=np.int64) > FREQUENT_TOKENS:
        least *= 2
        bits = id_filter(many.where(F.col("n") > least), "token", token_place)
    return bits if bits.any() else None


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first tokens of a set, in order, the frequent ones last."""
    t = (s >> np.uint64(2)).view(np.int64)
    at = t & (FILTER_BITS - 1)
    hot = (frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return np.concatenate([t[~hot], t[hot] | LAST])[: first_tokens(len(t))]


def token_sets(docs: DataFrame, asked: np.ndarray, frequent: np.ndarray | None, text: str, id_col: str) -> DataFrame:
    """Of the documents in the filter asked: (sid, set), the set as sorted 64-bit words, or with frequent tokens (sid, first)."""
    rows = docs.where(F.col(id_col).isNotNull()).select(filter_place(F.col(id_col).cast("bigint")).alias("at"), F.col(text).alias("text"))
    hashes = WordHashes()
    shared = docs.sparkSession.sparkContext.broadcast((asked, frequent))  # filters of a fixed size

    def run(batches):
        asked, frequent = shared.value
        for b in batches:
            for part in slices(b):
                part = part.filter(in_filter(asked, part.column(0)))
                sets = [s for s in (shingles(t, hashes, SHINGLE) for t in part.column(1).to_pylist()) if len(s)]
                if sets:
                    found = pa.array([s.tobytes() for s in sets], pa.binary()) if frequent is None else pa.array([ordered(s, frequent) for s in sets], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), found], ["sid", "set" if frequent is None else "first"])

    return in_batches(rows, run, "sid bigint, " + ("set binary" if frequent is None else "first array<bigint>"), hashes)


def in_runs(df: DataFrame, keys: list[str], f: Callable[[list[tuple]], Iterator[tuple[int, int]]]) -> DataFrame:
    """(a, b) from f over the rows of each key, which are bounded; the keys' rows are sorted together and streamed."""

    def run(batches):
        key, rows, out = None, [], []
        for b in batches:
            values = [b.column(n).to_pylist() for n in b.schema.names if n not in keys]
            for k, v in zip(zip(*[b.column(n).to_pylist() for n in keys]), zip(*values)):
                if k != key:
                    out += f(rows)
                    key, rows = k, []
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                        out = []
                rows.append(v)
        out += f(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return in_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, "a bigint, b bigint")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _arrays(rows: list[tuple]) -> dict[int, np.ndarray]:
    return {sid: np.frombuffer(raw, np.uint64) for sid, raw in rows}


def alike(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """(sid, at) of those rows (sid, n, hist, at) of a group whose histogram allows the similarity with another member's."""
    n = np.array([r[1] for r in rows])
    hist = np.frombuffer(b"".join(r[2] or b"\xff" * PARTS for r in rows), np.uint8).reshape(-1, PARTS)
    unknown = np.array([r[2] is None for r in rows])
    for k, (sid, size, _, at) in enumerate(rows):
        both = np.minimum(np.minimum(n, size), np.where(unknown | unknown[k], size, np.minimum(hist, hist[k]).sum(1, dtype=np.int64)))
        may = 100 * both >= PERCENT * (n + size - both)
        may[k] = False
        if may.any():
            yield sid, at


def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links that join the similar sets of a group; pairs that earlier links connect are skipped."""
    sets = _arrays(rows)
    ids = sorted(sets, key=lambda i: (len(sets[i]), i))
    part = {i: i for i in ids}
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if 100 * len(sets[x]) < PERCENT * len(sets[y]):
                break
            if part[x] != part[y] and _similar(sets[x], sets[y]):
                old, new = part[y], part[x]
                part = {i: new if p == old else p for i, p in part.items()}
                yield min(x, y), max(x, y)


def opened(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links of the queries (asks = true) with the members of one group, opened where the union allows it."""
    members = _arrays([(i, s) for i, asks, s in rows if not asks])
    if not members:
        return
    union = np.unique(np.concatenate(list(members.values())))
    for q, s in _arrays([(i, s) for i, asks, s in rows if asks]).items():
        if 100 * (len(s) + len(union) - len(np.union1d(s, union))) >= PERCENT * len(s):
            # a group's members are of one component, so that one link is enough
            for i, m in members.items():
                if i != q and _similar(s, m):
                    yield min(q, i), max(q, i)
                    break


def parts(count: Column, tokens: Column) -> Column:
    """Into how many parts so many sets are dealt."""
    return F.greatest(F.ceil(count / GROUP), F.ceil(tokens / GROUP_TOKENS))


def key_groups(reps: DataFrame) -> DataFrame:
    """(r, key, sub, sid): sets of one minwise key in bounded groups; a large group's hubs, who share most keys with most sets, are in each of its parts."""
    rows = reps.select("sid", "n", F.posexplode(F.slice("keys", 1, KEYS)).alias("r", "key"))
    sizes = rows.groupBy("r", "key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
    sizes = sizes.select("r", "key", parts(F.col("size"), F.col("tokens")).alias("subs"))
    dealt = checkpointed(rows.join(sizes.hint("merge"), ["r", "key"]).select("r", "key", "subs", "sid"))
    large = dealt.where("subs > 1")
    keys = large.select("sid").distinct().join(reps.select("sid", F.posexplode("keys").alias("k", "v")).hint("merge"), "sid")
    company = keys.groupBy("k", "v").agg(F.count("*").alias("size"))
    weight = keys.join(company.hint("merge"), ["k", "v"]).groupBy("sid").agg(F.sum("size").alias("weight"))
    first = Window.partitionBy("r", "key").orderBy(F.desc("weight"), "sid")
    hubs = large.join(weight.hint("merge"), "sid").withColumn("at", F.row_number().over(first)).where(F.col("at") <= HUBS)
    hubs = hubs.select("r", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)).alias("sub"), "sid")
    return dealt.select("r", "key", F.pmod(F.xxhash64("sid"), F.col("subs")).alias("sub"), "sid").union(hubs).distinct()


def _share(n: Column, m: Column) -> Column:
    """The least overlap of similar sets of these sizes."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def shared_tokens(marks: DataFrame, reps: DataFrame, docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(sid, token, pos): the first tokens by which sets can meet, and their places; and (sid, n, last) of all sets.

    Sets travel whole, once, and their tokens part where they are joined by sid: which tokens two
    sets share is only asked when their components are known.
    """
    asked = id_filter(reps, "rep")
    sets = marks.where("doc_id IS NOT NULL AND sid IS NOT NULL").select(filter_place(F.col("doc_id")).alias("at"), "sid", "first")
    sample = sets.where(F.pmod(F.xxhash64("sid"), F.lit(SAMPLE)) == 0)
    ends = reps.select("sid", "n", "last")
    often = max(1, FREQUENT // SAMPLE)
    bits = frequent_filter(asked_sets(sample, asked).select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("n")), often)
    if bits is None:
        rows = asked_sets(sets, asked).select("sid", "first")
    else:

        def hot(some, tokens):
            # whoever has none of these tokens first stays as it is
            return id_filter(asked_sets(some, asked, tokens).where("hot"), "at", lambda at: at)

        others = frequent_filter(all_tokens(token_sets(docs, hot(sample, bits), None, text, id_col)).groupBy("token").agg(F.count("*").alias("n")), often)
        bits = bits if others is None else bits | others
        moved = checkpointed(token_sets(docs, hot(sets, bits), bits, text, id_col))
        # a set read again without need has the same first tokens again
        rows = asked_sets(sets, asked, bits).where("NOT hot").select("sid", "first").union(moved)
        ends = ends.join(moved.groupBy("sid").agg(F.max(F.element_at("first", -1)).alias("other")).hint("merge"), "sid", "left").select("sid", "n", F.coalesce("other", "last").alias("last"))
    # one shuffle by sid leaves each set once, and serves the join by sid that follows
    return rows.repartition("sid").dropDuplicates(["sid"]).select("sid", F.posexplode("first").alias("pos", "token")).select("sid", "token", "pos"), ends


def bounded(met: DataFrame) -> DataFrame:
    """Of met (q, comp, sub, n, found, least, mine, theirs) those whose histograms allow an overlap of least: (q, comp, sub, n, found)."""

    def run(batches):
        for b in batches:
            both = [[h or b"\xff" * PARTS for h in b.column(c).to_pylist()] for c in ("mine", "theirs")]
            mine, theirs = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, PARTS) for x in both)
            no_bound = pc.or_(pc.is_null(b.column("mine")), pc.is_null(b.column("theirs"))).to_numpy(zero_copy_only=False)
            may = np.minimum(mine, theirs).sum(1, dtype=np.int64) >= b.column("least").to_numpy()
            yield b.select(["q", "comp", "sub", "n", "found"]).filter(pa.array(may | no_bound))

    return in_batches(met.select("q", "comp", "sub", "n", "found", "least", "mine", "theirs"), run, "q bigint, comp bigint, sub bigint, n bigint, found bigint")


def group_bounds(named: DataFrame) -> DataFrame:
    """(comp, sub, n_lo, last_lo, size, theirs): theirs is for each part of the token space the most tokens that a member of the group has; null where a member's are not known."""
    all_of = named.groupBy("comp", "sub").agg(F.min("n").alias("n_lo"), F.min("last").alias("last_lo"), F.count("*").alias("size"), F.collect_list("hist").alias("hists"))

    def run(batches):
        for b in batches:
            hists = zip(b.column("hists").to_pylist(), b.column("size").to_pylist())
            most = [np.frombuffer(b"".join(h), np.uint8).reshape(-1, PARTS).max(0).tobytes() if len(h) == size else None for h, size in hists]
            yield pa.RecordBatch.from_arrays([*b.select(range(5)).columns, pa.array(most, pa.binary())], ["comp", "sub", "n_lo", "last_lo", "size", "theirs"])

    return in_batches(all_of, run, "comp bigint, sub bigint, n_lo bigint, last_lo bigint, size bigint, theirs binary")


def candidates(rows: DataFrame, ends: DataFrame, comps: DataFrame, hists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, comp, sub, n, found): the groups that a set may have to ask; and (sid, comp, sub) of all sets.

    rows are first tokens and their places (sid, token, pos), ends the size and
    last first token of each set, hists its histogram (sid, hist).

    In two sets of n and m tokens the first common one stands at places i and
    j with n - i and m - j no less than the overlap, so that for similar sets
    85 m <= 100 n - 185 i and 85 n <= 100 m - 185 j.
    """
    same = Window.partitionBy("token")
    named = ends.join(hists.hint("merge"), "sid").join(comps.select(F.col("id").alias("sid"), "component").hint("merge"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    sizes = named.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("n")).select("comp", "members", parts(F.col("members"), F.col("n")).alias("subs"))
    named = checkpointed(named.join(sizes.hint("merge"), "comp").withColumn("sub", F.pmod(F.xxhash64("sid"), F.col("subs"))).drop("subs"))
    own = lambda n: F.col(n) - F.ceil(PERCENT * F.col(n) / 100) + 1

    cross = rows.join(named.select("sid", "comp", "sub", "members", "n").hint("merge"), "sid")
    # a set that is a component by itself takes its name along once
    cross = cross.withColumn("comp", F.nullif("comp", "sid")).repartition("token").withColumn("comp", F.coalesce("comp", "sid"))
    cross = cross.withColumn("room", 100 * F.col("n") - (100 + PERCENT) * F.col("pos")).drop("pos")
    cross = cross.withColumn("lo", F.min("comp").over(same)).withColumn("hi", F.max("comp").over(same))
    cross = checkpointed(cross.where("lo < hi").drop("lo", "hi"))
    matrix = cross.groupBy("token", F.col("comp").alias("g"), F.col("sub").alias("g_sub")).agg(
        F.first("members").alias("g_members"), F.max("room").alias("g_room"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi")
    )
    # a set asks the groups of larger components, so that either of two similar sets asks for the other
    larger = (F.col("members") < F.col("g_members")) | ((F.col("members") == F.col("g_members")) & (F.col("comp") < F.col("g")))
    sized = (100 * F.col("n") >= PERCENT * F.col("n_lo")) & (100 * F.col("n_hi") >= PERCENT * F.col("n"))
    least = F.greatest("n_lo", F.ceil(PERCENT * F.col("n") / 100))
    placed = (PERCENT * least <= F.col("room")) & (PERCENT * F.col("n") <= F.col("g_room"))
    met = cross.join(matrix.hint("merge"), "token").where(larger & sized)
    met = met.groupBy("sid", "g", "g_sub").agg(F.first("n").alias("n"), F.count("*").alias("found"), F.max(placed).alias("placed"), F.min(least).alias("m")).where("placed")
    met = met.select(F.col("sid").alias("q"), F.col("g").alias("comp"), F.col("g_sub").alias("sub"), "n", "found", _share(F.col("n"), F.col("m")).alias("least"))
    met = met.join(named.select(F.col("sid").alias("q"), "last", F.col("hist").alias("mine")).hint("merge"), "q").join(group_bounds(named).hint("merge"), ["comp", "sub"])
    # of a query's first tokens those not found are in no member, if no member's first tokens end before them
    by_query = own("n") - F.col("found") <= F.col("n") - F.col("least")
    by_member = own("n_lo") - F.col("found") <= F.col("n_lo") - _share(F.col("n"), F.col("n_lo"))
    met = met.where(F.when(F.col("last") <= F.col("last_lo"), by_query).when(F.col("size") == 1, by_member).otherwise(True))
    return checkpointed(bounded(met)), named.select("sid", "comp", "sub")


def opened_links(asks: DataFrame, named: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links between queries and the groups they ask; many queries of one group are dealt into blocks."""
    sizes = asks.groupBy("comp", "sub").agg(parts(F.count("*"), F.sum("n")).alias("blocks"))
    q = asks.join(sizes.hint("merge"), ["comp", "sub"]).select("comp", "sub", F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"), F.col("q").alias("sid"), F.lit(True).alias("asks"))
    m = named.join(sizes.hint("merge"), ["comp", "sub"]).select("comp", "sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "sid", F.lit(False).alias("asks"))
    rows = q.union(m)
    return in_runs(rows.join(sets_of(rows.select("sid")).hint("merge"), "sid").select("comp", "sub", "block", "sid", "asks", "set"), ["comp", "sub", "block"], opened)


def linked_by_matrix(asks: DataFrame, named: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links with those that the matrix finds: first the best group of each component that a set asks, then the rest of those not yet joined to it."""
    best = asks.groupBy("q", "comp").agg(F.max_by(F.struct("sub", "n"), F.struct("found", "sub")).alias("x")).select("q", "comp", "x.sub", "x.n")
    links = checkpointed(links.union(opened_links(best, named, sets_of)).distinct())
    now = components(links, "a", "b")
    rest = asks.join(best.select("q", "comp", "sub").hint("merge"), ["q", "comp", "sub"], "left_anti")
    for c in ("q", "comp"):
        rest = rest.join(now.select(F.col("id").alias(c), F.col("component").alias(f"now_{c}")).hint("merge"), c, "left").withColumn(f"now_{c}", F.coalesce(f"now_{c}", c))
    rest = checkpointed(rest.where("now_q <> now_comp").select("q", "comp", "sub", "n"))
    return links if rest.isEmpty() else checkpointed(links.union(opened_links(rest, named, sets_of)).distinct())


def jaccard_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    marks = checkpointed(sketches(docs, text, id_col))
    sets = marks.where("doc_id IS NOT NULL AND sid IS NOT NULL").select("doc_id", "sid", "n_shingles", "keys", "hist", F.element_at("first", -1).alias("last"))
    reps = checkpointed(sets.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("hist").alias("hist"), F.first("last").alias("last")))

    def sets_of(sids):
        ids = sids.distinct().join(reps.select("sid", "rep").hint("merge"), "sid")
        return token_sets(docs, id_filter(ids, "rep"), None, text, id_col)

    dealt = key_groups(reps).select(F.xxhash64("r", "key", "sub").alias("group"), "sid")
    dealt = dealt.join(reps.select("sid", "n", "hist").hint("merge"), "sid").select("group", "sid", "n", "hist", F.col("group").alias("at"))
    # many share a key by chance, more of them in larger tables; their sets are not fetched
    grouped = checkpointed(in_runs(dealt, ["group"], alike).toDF("sid", "group"))
    near = in_runs(grouped.join(sets_of(grouped.select("sid")).hint("merge"), "sid").select("group", "sid", "set"), ["group"], linked)
    links = checkpointed(near.distinct())
    asks, named = candidates(*shared_tokens(marks, reps, docs, text, id_col), components(links, "a", "b"), reps.select("sid", "hist"))
    if not asks.isEmpty():
        links = linked_by_matrix(asks, named, links, sets_of)
    comps = components(links, "a", "b").select(F.col("id").alias("sid"), "component")
    named = reps.select("sid", "rep").join(comps.hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least.hint("merge"), "component").select("sid", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return marks.select("doc_id", "n_shingles", "sid").join(named, "sid", "left").select("doc_id", "n_shingles", component.alias("component_id"))
