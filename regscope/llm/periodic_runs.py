"""Periodic runs of words, by the dictionary of basic factors.

A run is a longest stretch of words that repeats with a smallest period q and is
at least ``max(MIN_LENGTH, MIN_ROUNDS * q)`` words long.

The dictionary names, for every power of two l, the stretches of l words: equal
stretches of one document get one name, made of the names of their two halves.
Only stretches that occur again are named, so natural text leaves after a few
lengths. For each length, the distance from a stretch to its next occurrence
proposes a period:

* Take l as the least power of two >= q. Inside a run of period q a stretch of l
  words starts again after exactly q words: after fewer, the period would be a
  power of a shorter one. So the run's successor distances are an arithmetic
  progression with the difference q, q > l / 2, at consecutive starts.
* Consecutive starts i .. i + m - 1 with the same distance q in (l / 2, l] are a
  progression; extended by its last stretch and one period it is the run
  [i, i + m - 1 + l + q). It can't be extended further: the start before would
  have the same distance, by the same argument.

Each period belongs to one length, so a run is proposed once and the results need
no further removal of repeats; those too short are left out. Many documents are
named at once (names hold the document), some ``CHUNK`` words together, so work is
O(n log n) for any text, one word repeated for ever included.

Cases: null, empty and white texts have no words and no runs. A text below
``MIN_LENGTH`` words has no runs. Repeated rows and ids are rows of their own; a
null id stays null. A text is one row, however long. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MIN_LENGTH, MIN_ROUNDS = 24, 3
CHUNK = 500_000               # words that a task looks at together
RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names from 1 on for the keys that occur twice or more, 0 for the others;
    and the order that sorts the keys, equal ones by position."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group) > 1
    fresh = np.cumsum(several) * several
    names = np.empty(len(keys), np.int64)
    names[order] = fresh[group]
    return names, order


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, rounds: int = MIN_ROUNDS) -> np.ndarray:
    """Rows (start, length, period) of the runs of an array of word numbers, by start, then period.

    Documents can be put one after the other if their numbers differ."""
    total, size, found = len(words), 1, []
    at = np.arange(total)
    names, order = _named(words)
    while True:
        # Successor distances, for the stretches that occur again.
        position, name = at[order], names[order]
        gap = np.zeros(total + 1, np.int64)
        same = (name[1:] == name[:-1]) & (name[1:] > 0)
        gap[position[:-1][same]] = (position[1:] - position[:-1])[same]
        gap[(gap * 2 <= size) | (gap > size)] = 0
        edge = np.flatnonzero(np.diff(gap, prepend=0))
        if len(edge):
            first, last = edge, np.append(edge[1:], total + 1)
            period = gap[first]
            length = last - first - 1 + size + period
            keep = (period > 0) & (length >= np.maximum(min_length, rounds * period))
            found.append(np.column_stack([first, length, period])[keep])
        # Stretches of twice the length: both halves occur again.
        full = np.zeros(total, np.int64)
        full[at] = names
        here = at[(names > 0) & (at + size < total)]
        here = here[full[here + size] > 0]
        size *= 2
        if not len(here) or rounds * (size // 2 + 1) > total:
            break
        at = here
        names, order = _named(full[at] * (int(full.max()) + 1) + full[at + size // 2])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, rounds: int = MIN_ROUNDS) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period)
    and collapsed (the words outside the later periods of every run, joined by spaces)."""

    def flush(held: list[tuple]) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        ends = np.cumsum([len(w) for _, w in held])
        flat = np.fromiter((numbers.setdefault(x, len(numbers)) for _, w in held for x in w), np.int64, int(ends[-1]))
        flat += np.repeat(np.arange(len(held)), [len(w) for _, w in held]) * len(numbers)
        runs = find_runs(flat, min_length, rounds)
        cuts = np.searchsorted(runs[:, 0], ends)
        out, low = [], 0
        for (d, w), end, high in zip(held, ends, cuts):
            mine = runs[low:high] - [end - len(w), 0, 0]
            low = high
            if len(mine):
                w_kept = [x for x, stays in zip(w, kept_words(len(w), mine)) if stays]
            else:
                w_kept = w
            out.append((d, len(w), [dict(zip(("start", "length", "period"), r)) for r in mine.tolist()], b" ".join(w_kept).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for d, t in zip(batch["doc_id"], batch["text"]):
                # bytes.split cuts at x09-x0D and x20.
                w = t.encode().split() if t else []
                held.append((None if pd.isna(d) else int(d), w))
                size += len(w) + 1
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(
        rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_exponent(runs: Column) -> Column:
    """Of an array of runs by start, then period, the first with the greatest length / period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by crc32 of its id repeats a stretch of its words to its end.

    A null id counts as the empty text for the crc32."""
    bind = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - evaluates value once
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(F.col("h") / 10)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        index = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, index(i))), " "))

    text = F.when(F.col("h") % 10 == 0, bind(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeated)).otherwise(F.col("text"))
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The counts, the run of greatest exponent and the digests of ``periodic_runs``."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.select("*", longest_exponent(F.col("runs")).alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
