"""Substring dedup with automata of recurring phrases.

A window of consecutive words that occurs elsewhere too is found in four steps. Documents are dealt into
shards of a few megabytes once and kept that way; only hashes travel between the steps.

1. Anchors. Of each window's shorter phrases the one with the least hash is its anchor, so equal windows
   have equal anchors wherever they stand. A shard reports each anchor once, and whether it stands in two
   places there.
2. Recurring phrases. An anchor that two shards report, or one shard twice, is confirmed as recurring;
   its hash goes back to the shards that have it.
3. Automata. A shard compiles its recurring phrases into Aho-Corasick automata of bounded size and streams
   its documents through them. Windows around an occurrence are candidates. Of equal candidates in a shard
   only the first is sent on, under a hash of all its words (96 bits); the others are later copies.
4. Order. Candidates with the same hash meet; all but the first in document order are later copies. Words
   covered by a later copy are removed.

A frequent phrase or window is one entry per shard, however often it occurs. Exact copies of a whole text
take no part: all windows of a later copy occur earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch, shuffles
from kgweave.plans.skew import HEAVY_SHARE, join_counted

WINDOW = 20
PHRASE = 8
SHARD_BYTES = 8_000_000
PATTERNS = 40_000  # phrases that one automaton takes
LAST = np.iinfo(np.int64).max  # stands for a null id in the order of documents

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _runs(hashes: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * multiplier + hashes[k:n + k]
    total ^= total >> np.uint64(29)
    return total * _SECOND


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases that are the least (the leftmost of equal ones) of some window."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found = _runs(hashes, phrase, _MULTIPLIER)
    span = window - phrase + 1
    least = np.lib.stride_tricks.sliding_window_view(found, span).argmin(axis=1)
    places = np.unique(least + np.arange(len(least)))
    return places, found[places]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _dealt(frame: dict[str, np.ndarray], key: np.ndarray, parts: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of ``frame`` by ``key`` modulo ``parts``."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, edges) if len(order) else ():
        yield int(part[own[0]]), {k: v[own] for k, v in frame.items()}


def _joined(arrays: pd.Series, dtype=np.int64) -> np.ndarray:
    return np.concatenate([np.asarray(a, dtype) for a in arrays] or [np.empty(0, dtype)])


def _own(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """The shard's documents without later exact copies."""
    copies = _joined(notes.loc[notes["kind"] == "copy", "rows"])
    return docs[~docs["row"].isin(copies)]


NOTE = "shard int, kind string, rows array<long>, starts array<int>, hashes array<long>"
FOUND = ("part int, shard int, kind string, h1 array<long>, h2 array<int>, ids array<long>, rows array<long>, "
         "starts array<int>")


def _note(shard: int, kind: str, rows=(), starts=(), hashes=()) -> dict:
    return {"shard": shard, "kind": kind, "rows": list(rows), "starts": list(starts), "hashes": list(hashes)}


def _report(window: int, phrase: int, parts: int):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        found = [anchors(_hashes(words_of(t)), window, phrase)[1] for t in _own(docs, notes)["text"]]
        if not found:
            return pd.DataFrame(columns=["part", "shard", "hashes", "twice"])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        shard = int(docs["shard"].iloc[0])
        return pd.DataFrame(
            [(part, shard, _signed(own["h"]), own["twice"])
             for part, own in _dealt({"h": values, "twice": counts > 1}, values, parts)],
            columns=["part", "shard", "hashes", "twice"])
    return run


def _confirm(reports: pd.DataFrame) -> pd.DataFrame:
    hashes, twice = _joined(reports["hashes"]), _joined(reports["twice"], bool)
    shards = np.repeat(reports["shard"].to_numpy(), [len(h) for h in reports["hashes"]])
    values, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    recurring = (counts > 1) | (np.bincount(place, twice, len(values)) > 0)
    keep = recurring[place]
    return pd.DataFrame([
        _note(int(s), "phrase", hashes=hashes[keep & (shards == s)]) for s in np.unique(shards[keep])],
        columns=["shard", "kind", "rows", "starts", "hashes"])


def automata(phrases: list[str]) -> Iterator[ahocorasick.Automaton]:
    """Automata over the phrases, of bounded size each."""
    for at in range(0, len(phrases), PATTERNS):
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[at:at + PATTERNS]:
            machine.add_word(phrase)
        machine.make_automaton()
        yield machine


def spelled(numbers: np.ndarray, width: int) -> str:
    """Word numbers as ``width`` characters each; the first is of another alphabet than the rest.

    So a phrase is found at whole words only, and is short, which keeps automata and streams small.
    """
    digits = np.empty((len(numbers), width), np.uint16)
    for k in range(width):
        digits[:, k] = (numbers >> (6 * k) & 63) + (64 if k else 128)
    return digits.tobytes().decode("utf-16-le")


def _locate(window: int, phrase: int, parts: int):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
        recurring = np.unique(_joined(notes.loc[notes["kind"] == "phrase", "hashes"]))
        docs = _own(docs, notes)
        if not len(recurring) or not len(docs):
            return empty
        shard = int(docs["shard"].iloc[0])
        vocabulary: dict[bytes, int] = {}
        numbers = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
                   for words in map(words_of, docs["text"])]
        width = max(2, -(-len(vocabulary).bit_length() // 6))
        known = _hashes(list(vocabulary))
        phrases, streams, hashed = set(), [], []
        for own in numbers:
            hashes = known[own] if len(own) >= window else np.empty(0, np.uint64)
            stream = spelled(own, width) if len(hashes) else ""
            places, found = anchors(hashes, window, phrase)
            for p in places[_among(_signed(found), recurring)].tolist():
                phrases.add(stream[p * width:(p + phrase) * width])
            streams.append(stream)
            hashed.append(hashes)
        ends: list[list[int]] = [[] for _ in streams]
        for machine in automata(sorted(phrases)):
            for own, stream in zip(ends, streams):
                if stream:
                    own.extend(end for end, _ in machine.iter(stream))
        ids = docs["id"].to_numpy()
        columns = {"h1": [], "h2": [], "ids": [], "rows": [], "starts": []}
        for i, (own, row) in enumerate(zip(ends, docs["row"])):
            if not own:
                continue
            n = len(hashed[i])
            places = (np.unique(own) + 1) // width - phrase
            near = np.zeros(n + 1, np.int64)  # windows from the one that ends with the phrase to the one that begins with it
            np.add.at(near, np.maximum(places + phrase - window, 0), 1)
            np.add.at(near, places + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[:n - window + 1] > 0)
            columns["h1"].append(_runs(hashed[i], window, _MULTIPLIER)[starts])
            columns["h2"].append((_runs(hashed[i], window, _SECOND)[starts] >> np.uint64(33)).astype(np.int32))
            columns["ids"].append(np.full(len(starts), ids[i]))
            columns["rows"].append(np.full(len(starts), row))
            columns["starts"].append(starts.astype(np.int32))
        if not columns["h1"]:
            return empty
        frame = {k: np.concatenate(v) for k, v in columns.items()}
        later = _later(frame)
        out = [(part, shard, "window", _signed(own["h1"]), own["h2"], own["ids"], own["rows"], own["starts"])
               for part, own in _dealt({k: v[~later] for k, v in frame.items()}, frame["h1"][~later], parts)]
        none = np.empty(0, np.int64)
        out.append((shard % parts, shard, "later", none, none.astype(np.int32), none, frame["rows"][later],
                    frame["starts"][later]))
        return pd.DataFrame(out, columns=list(empty.columns))
    return run


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in ``ordered``, by binary search: ``ordered`` is long and read for each text."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _later(frame: dict[str, np.ndarray]) -> np.ndarray:
    """Which windows have an equal one that comes first in document order."""
    order = np.lexsort((frame["starts"], frame["rows"], frame["ids"], frame["h2"], frame["h1"]))
    h1, h2 = frame["h1"][order], frame["h2"][order]
    same = np.zeros(len(order), bool)
    same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    later = np.zeros(len(order), bool)
    later[order] = same
    return later


def _order(found: pd.DataFrame) -> pd.DataFrame:
    local = found[found["kind"] == "later"]
    out = [_note(s, "later", r, w) for s, r, w in zip(local["shard"], local["rows"], local["starts"])]
    windows = found[found["kind"] == "window"]
    if len(windows):
        frame = {k: _joined(windows[k]) for k in ("h1", "h2", "ids", "rows", "starts")}
        shards = np.repeat(windows["shard"].to_numpy(), [len(h) for h in windows["h1"]])
        later = np.flatnonzero(_later(frame))
        later = later[np.argsort(shards[later], kind="stable")]
        for own in np.split(later, np.flatnonzero(np.diff(shards[later])) + 1) if len(later) else ():
            out.append(_note(int(shards[own[0]]), "later", frame["rows"][own], frame["starts"][own]))
    return pd.DataFrame(out, columns=["shard", "kind", "rows", "starts", "hashes"])


def _cut(window: int):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        copies = set(_joined(notes.loc[notes["kind"] == "copy", "rows"]).tolist())
        later = notes[notes["kind"] == "later"]
        rows, starts = _joined(later["rows"]), _joined(later["starts"])
        order = np.argsort(rows, kind="stable")
        rows, starts = rows[order], starts[order]
        out = []
        for doc_id, known, row, text in zip(docs["id"], docs["known"], docs["row"], docs["text"]):
            words = words_of(text)
            gone = np.zeros(len(words), bool)
            if row in copies:
                gone[:] = len(words) >= window
            else:
                begin, end = np.searchsorted(rows, [row, row + 1])
                if begin < end:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts[begin:end], 1)
                    np.add.at(cover, starts[begin:end] + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
            out.append((doc_id, known, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["id", "known", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs`` (``doc_id`` an integer, ``text``).

    Words are runs of characters other than ASCII white space; ``kept`` holds those that stay, joined by
    one space. A window's first occurrence is the one with the smallest ``doc_id`` (null ids last; among
    rows with the same id, the one read first) and the earliest start. Null and empty texts have no words.
    Texts shorter than the window lose nothing. Other columns are not carried along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = shuffles(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, total // SHARD_BYTES)
    parts = max(4 * n, shards)  # a part is one task's share of what the shards send on
    row = F.monotonically_increasing_id()
    packed = (
        docs.select("doc_id", "text", row.alias("row"))
        .withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))))
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
        .withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit("second"), F.col("text")))
    )
    packed = scratch.keep(packed.repartition(n, "shard"), n, "shard")
    places = packed.where(F.col("text").isNotNull()).select("d1", "d2", "shard", "row", F.struct("id", "row").alias("place"))
    firsts = scratch.keep(
        places.groupBy("d1", "d2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1))
    copies = scratch.keep(
        join_counted(places, firsts, ["d1", "d2"], max(packed.count(), HEAVY_SHARE))
        .where(F.col("place") != F.col("first"))
        .groupBy("shard", F.lit("copy").alias("kind")).agg(F.collect_list("row").alias("rows"))
        .select("shard", "kind", "rows", F.array().cast("array<int>").alias("starts"),
                F.array().cast("array<long>").alias("hashes")))
    scratch.drop(firsts)
    # ids are never null here, as a column of numbers with nulls would reach pandas as floating point
    texts = packed.select("shard", "row", "id", F.col("doc_id").isNotNull().alias("known"), "text").groupBy("shard")
    beside = lambda notes, run, schema: texts.cogroup(notes.groupBy("shard")).applyInPandas(run, schema)
    reports = beside(copies, _report(window, phrase, parts),
                     "part int, shard int, hashes array<long>, twice array<boolean>")
    phrases = reports.groupBy("part").applyInPandas(_confirm, NOTE)
    found = beside(copies.unionByName(phrases), _locate(window, phrase, parts), FOUND)
    later = found.groupBy("part").applyInPandas(_order, NOTE)
    cut = beside(copies.unionByName(later), _cut(window), "id long, known boolean, n_words long, n_removed long, kept string")
    return cut.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
