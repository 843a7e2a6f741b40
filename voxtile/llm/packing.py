"""Filling containers of fixed capacity with texts (problem 7).

Method: best-fit decreasing. Texts go by falling size; a segment tree over remaining
capacities finds the tightest open container that still takes a text, in a number of
steps that grows with the logarithm of the capacity. A text above the capacity is split
into full containers and a rest, which is packed like any other text.

Scale: sizes are whole numbers up to the capacity, so texts of one size are alike to the
method, and so are open containers with one remaining capacity. The driver packs the
counts of each size, at most capacity + 1 numbers whatever the corpus, and containers in
runs of equal ones; what it hands to the tasks is, for each size, which places in the
order of the texts go to which run of containers. The result is that of one pass over all
texts, for any number of them. Tasks sort texts by size and look their place up.

Defined results: null and empty texts have size 0 and still get a container; ties in size
go by doc_id; a repeated row is a text of its own, placed by its own; empty tables give
empty results; extra columns are ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.llm.tokens import VOCABULARY, token_counts
from voxtile.operators.dataset import with_position
from voxtile.session import checkpointed


class BestFit:
    """Open containers by remaining capacity, in a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.base = 1
        while self.base < capacity + 1:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def change(self, room: int, by: int) -> None:
        i = self.base + room
        while i:
            self.count[i] += by
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` that an open container has."""
        i = self.base + size
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None

    def put(self, size: int) -> int:
        room = self.tightest(size)
        if room is None:
            number, room = self.bins, self.capacity
            self.bins += 1
        else:
            number = self.open[room].pop()
            self.change(room, -1)
        self.open[room - size].append(number)
        self.change(room - size, 1)
        return number


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Best-fit decreasing over the number of texts of each size.

    Gives for each size the runs (first place, first container, texts a container) in
    order of place, and the number of containers. Open containers of one remaining
    capacity are held as runs of neighbouring numbers; a container takes texts of a size
    as long as it has room, for after each it is the tightest.
    """
    rooms = BestFit(capacity)  # its tree knows which capacities occur; runs stand for containers
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    placed: dict[int, list[tuple[int, int, int]]] = {}
    opened = 0

    def keep(room: int, first: int, n: int) -> None:
        runs[room].append((first, n))
        rooms.change(room, 1)

    for size in sorted(counts, reverse=True):
        left, place, log = counts[size], 0, []
        while left:
            room = rooms.tightest(size)
            if room is None:
                each = capacity // size if size else left
                first, n, room = opened, -(-left // each), capacity
                opened += n
            else:
                first, n = runs[room].pop()
                rooms.change(room, -1)
                each = room // size if size else left
            full = min(n, left // each)
            if full:
                log.append((place, first, each))
                keep(room - each * size, first, full)
                place, left, first, n = place + full * each, left - full * each, first + full, n - full
            if n and left:
                log.append((place, first, left))
                keep(room - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            if n:
                keep(room, first, n)
        placed[size] = log
    return placed, opened


def pack_sizes(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n_tokens, split, container) for (doc_id, n_tokens)."""
    if capacity < 1:
        raise ValueError("the capacity must be above 0")
    whole = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("long")
    items = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("part"))
    items = items.select(
        F.least(F.col("n_tokens") - F.col("part") * capacity, F.lit(capacity)).cast("long").alias("size"), "doc_id", "part",
        (F.col("n_tokens") > capacity).alias("split"),
    )
    # sorting samples its input first: the sizes are written once, or each text would be measured twice
    placed = with_position(checkpointed(items), F.desc("size"), "doc_id", "part")
    # one row for each size, at most capacity + 1
    counts = {r["size"]: r["n"] for r in placed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = pack_counts(counts, capacity)
    firsts, at = {}, 0
    for size in sorted(counts, reverse=True):
        firsts[size] = at
        at += counts[size]

    @F.pandas_udf("long")
    def container(size: pd.Series, pos: pd.Series) -> pd.Series:
        out = np.empty(len(size), dtype=np.int64)
        values = size.to_numpy()
        for s in np.unique(values):
            rows = values == s
            log = np.array(runs[int(s)], dtype=np.int64)
            place = pos.to_numpy()[rows] - firsts[int(s)]
            k = np.searchsorted(log[:, 0], place, side="right") - 1
            out[rows] = log[k, 1] + (place - log[k, 0]) // log[k, 2]
        return pd.Series(out)

    return placed.select("doc_id", "part", F.col("size").alias("n_tokens"), "split", container("size", "_pos").alias("container"))


def pack(documents: DataFrame, capacity: int, path: str = VOCABULARY) -> DataFrame:
    """A container for each text, whole unless it exceeds the capacity itself; sizes in tokens."""
    return pack_sizes(token_counts(documents, path), capacity)


def oversized(packed: DataFrame) -> DataFrame:
    """(doc_id,): the texts that had to be split."""
    return packed.where("split").select("doc_id").distinct()


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_tokens, fill): how full the containers are."""
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"),
        (F.sum("held") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
