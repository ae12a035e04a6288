"""Text noise as folds over word arrays, driven by reproducible uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.rand import shuffle_key, uniform
from dialoom.functions.text import strip

# Keys beside each letter on the keyboard.
NEIGHBOURS = {
    "a": "sq",
    "b": "vn",
    "c": "xv",
    "d": "sf",
    "e": "wr",
    "f": "dg",
    "g": "fh",
    "h": "gj",
    "i": "uo",
    "j": "hk",
    "k": "jl",
    "l": "ko",
    "m": "n,",
    "n": "bm",
    "o": "ip",
    "p": "o[",
    "q": "wa",
    "r": "et",
    "s": "ad",
    "t": "ry",
    "u": "yi",
    "v": "cb",
    "w": "qe",
    "x": "zc",
    "y": "tu",
    "z": "xs",
}
# Filler words.
FILLERS = ("like", "um", "uh", "basically", "actually", "you know", "I mean", "sort of", "kind of", "just")
# Synonyms of simple words.
SYNONYMS = {
    "big": ("large", "huge", "massive"),
    "small": ("tiny", "little", "mini"),
    "good": ("great", "nice", "fine"),
    "bad": ("poor", "terrible", "awful"),
    "fast": ("quick", "rapid", "swift"),
    "slow": ("sluggish", "gradual"),
    "help": ("assist", "aid", "support"),
    "make": ("create", "build", "produce"),
    "get": ("obtain", "acquire", "receive"),
    "show": ("display", "demonstrate", "present"),
}


def words_of(text: Column) -> Column:
    t = strip(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def _times(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _at(u: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.least((u * n).cast("int"), n - 1)


def _put(words: Column, i: Column, w: Column) -> Column:
    return F.transform(words, lambda x, k: F.when(k == i, w).otherwise(x))


def typos(text: Column, key: Column, intensity: float = 0.1, seed: str = "typo") -> Column:
    """Neighbouring keys hit by mistake; a short word uses its attempt up."""
    words = words_of(text)
    near = F.create_map(*[F.lit(x) for kv in NEIGHBOURS.items() for x in kv])

    def hit(ws, k):
        i = _at(uniform(seed + "/w", key, k), F.size(ws))
        w = F.get(ws, i)
        p = _at(uniform(seed + "/c", key, k), F.length(w)) + 1
        old = F.substr(w, p, F.lit(1))
        keys = F.element_at(near, F.lower(old))
        new = F.substr(keys, _at(uniform(seed + "/n", key, k), F.lit(2)) + 1, F.lit(1))
        new = F.when(old == F.lower(old), new).otherwise(F.upper(new))
        return F.when((F.length(w) > 2) & keys.isNotNull(), _put(ws, i, F.concat(F.substr(w, F.lit(1), p - 1), new, F.substr(w, p + 1)))).otherwise(ws)

    n = F.greatest(F.lit(1), (F.size(words) * intensity).cast("int"))
    return F.array_join(F.when(F.size(words) == 0, words).otherwise(F.aggregate(_times(n), words, hit)), " ")


def swaps(text: Column, key: Column, times: int = 2, seed: str = "swap") -> Column:
    """Neighbouring words change places; a lone word stays."""

    def swap(ws, k):
        place = F.array(_at(uniform(seed, key, k), F.size(ws) - 1))  # an element, so that it is drawn once and not at every word
        done = lambda i: F.concat(F.slice(ws, F.lit(1), i), F.array(F.get(ws, i + 1), F.get(ws, i)), F.slice(ws, i + 3, F.size(ws)))
        return F.get(F.transform(place, done), F.lit(0))

    def swapped(words):
        n = F.least(F.lit(times), F.floor(F.size(words) / 2).cast("int"))
        return F.when(F.size(words) < 2, text).otherwise(F.array_join(F.aggregate(_times(n), words, swap), " "))

    return F.get(F.transform(F.array(words_of(text)), swapped), F.lit(0))


def deletions(text: Column, key: Column, rate: float = 0.05, seed: str = "del") -> Column:
    """Some words go, the first by a shuffle of places; a text too short for it stays."""
    words = words_of(text)
    n = F.greatest(F.lit(1), (F.size(words) * F.lit(rate)).cast("int"))
    ranked = F.sort_array(F.transform(words, lambda w, i: F.struct(shuffle_key(seed, key, i).alias("h"), i.alias("i"), w.alias("w"))))
    left = F.sort_array(F.transform(F.slice(ranked, n + 1, F.greatest(F.size(words) - n, F.lit(0))), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))
    return F.when(F.size(words) <= n + 2, text).otherwise(F.array_join(F.transform(left, lambda x: x["w"]), " "))


def insertions(text: Column, key: Column, rate: float = 0.05, seed: str = "ins") -> Column:
    """Filler words between others; an empty text stays."""
    words = words_of(text)
    fillers = F.array(*[F.lit(f) for f in FILLERS])

    def insert(ws, k):
        return F.array_insert(ws, _at(uniform(seed + "/p", key, k), F.size(ws) + 1) + 1, F.get(fillers, _at(uniform(seed + "/f", key, k), F.lit(len(FILLERS)))))

    n = F.greatest(F.lit(1), (F.size(words) * rate).cast("int"))
    return F.array_join(F.when(F.size(words) == 0, words).otherwise(F.aggregate(_times(n), words, insert)), " ")


def synonyms(text: Column, key: Column, rate: float = 0.15, tries: int = 10, seed: str = "syn") -> Column:
    """Simple words give way to synonyms; each turn tries some places and takes the first that fits."""
    words = words_of(text)
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    plain = lambda w: F.trim(F.lower(w), F.lit(".,!?"))

    def replace(ws, k):
        places = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda t: _at(uniform(seed + "/p", key, k, t), F.size(ws)))
        i = F.get(F.filter(places, lambda p: F.map_contains_key(known, plain(F.get(ws, p)))), F.lit(0))
        old = F.get(ws, i)
        options = F.element_at(known, plain(old))
        new = F.get(options, _at(uniform(seed + "/s", key, k), F.size(options)))
        head = F.substring(old, 1, 1)
        new = F.when(head != F.lower(head), F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2)))).otherwise(new)
        return F.when(i.isNull(), ws).otherwise(_put(ws, i, new))

    n = F.greatest(F.lit(1), (F.size(words) * rate).cast("int"))
    return F.array_join(F.when(F.size(words) == 0, words).otherwise(F.aggregate(_times(n), words, replace)), " ")


#: Name to function (text, key) -> text; more may be registered.
STRATEGIES = {"typo": typos, "word_swap": swaps, "word_deletion": deletions, "word_insertion": insertions, "synonym": synonyms}
