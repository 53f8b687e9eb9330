"""Filling containers of fixed capacity by bin completion, in blocks and rounds.

Items are spread over blocks of about `block_items` by a hash of their id, so no source or slug can
overload a task. Each block is packed by branch and bound over bin completions: the largest item left
opens a container, the undominated ways to fill the rest are tried fullest first, partial
solutions are cut off by their waste, and best-fit-decreasing gives the first incumbent. The first filling is
looked for alone; all others are enumerated when the search comes back to the container.
Containers that stay emptier than `open_below` give their items back; those are put into new blocks
and packed together, until one block holds them all or a round no longer sets a tenth of them free.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import TOKENIZER, tokenizer

CAPACITY = 2048
BLOCK_ITEMS = 4096
#: Fillings tried in one block, and steps of their enumeration, after which the best solution so far is kept (it is
#: never worse than best fit); None: no end but the optimum.
NODES, STEPS = 4_000, 100_000
#: Steps of the search for the first filling of a container.
FIRST_STEPS = 400


def best_fit_decreasing(sizes: list[int], cap: int) -> list[list[int]]:
    """Containers (lists of indexes into sizes), best fit, largest first."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        bisect.insort(rooms, (room - sizes[i], b))
    return bins


def completions(avail: list[int], room: int, steps: int | None = None, first: bool = False) -> tuple[list[tuple[int, ...]], int, bool]:
    """(fillings, steps taken, whether they are all): undominated fillings of `room` from the descending sizes `avail`, fullest first.

    A filling is dominated if an unused item still fits, or if one of its items could be replaced by a
    larger unused one. Fillings of the same sizes come once. The enumeration ends after `steps` steps, and with `first`
    at the first filling without waste; if it ended before any filling was whole, the greedy one is given.
    """
    have: dict[int, int] = {}
    for s in avail:
        have[s] = have.get(s, 0) + 1
    sizes = sorted(have, reverse=True)
    minus = [-s for s in sizes]
    found: dict[tuple[int, ...], int] = {}
    taken, stop = 0, False

    def grow(k: int, left: int, picked: list[int]) -> None:
        nonlocal taken, stop
        taken += 1
        if steps is not None and taken > steps:
            stop = True
            return
        # the one size that leaves no waste comes before the others
        if have.get(left, 0) - picked.count(left) > 0 and (not picked or left <= picked[-1]):
            found[(*picked, left)] = 0
            if first:
                stop = True
                return
        k = max(k, bisect.bisect_left(minus, -left))
        fits = False
        while k < len(sizes) and not stop:
            s = sizes[k]
            if have[s] - picked.count(s) > 0:
                fits = True
                if s != left:
                    picked.append(s)
                    grow(k, left - s, picked)
                    picked.pop()
            k += 1
        # a smaller unused one may not fit while a larger was passed over: what fits decides
        if not fits and not stop and not any(have[s] - picked.count(s) > 0 for s in sizes[bisect.bisect_left(minus, -left) :]):
            for s in set(picked):  # the next larger unused size in the place of one that was picked?
                j = bisect.bisect_left(minus, -s) - 1
                while j >= 0 and have[sizes[j]] - picked.count(sizes[j]) <= 0:
                    j -= 1
                if j >= 0 and sizes[j] - s <= left:
                    return
            found[tuple(picked)] = left

    grow(0, room, [])
    if not found:
        picked = []
        for s in avail:
            if s <= room:
                picked.append(s)
                room -= s
        found[tuple(picked)] = room
    return sorted(found, key=lambda key: (found[key], [-x for x in key])), taken, not stop


class _Frame:
    """One container of the search: the items left, the waste so far, and the fillings not tried yet."""

    def __init__(self, avail: list[int], cap: int, waste: int):
        self.avail, self.waste, self.room = avail, waste, cap - avail[0]
        rest = avail[1:]
        self.tried: set[tuple[int, ...]] = set()
        self.options, _, self.whole = completions(rest, self.room, FIRST_STEPS, True) if rest and rest[-1] <= self.room else ([()], 0, True)

    def next(self, steps: int | None) -> tuple[tuple[int, ...] | None, int]:
        """The next filling (None: there is no other), and the steps its enumeration took."""
        taken = 0
        if not self.options and not self.whole:
            every, taken, _ = completions(self.avail[1:], self.room, steps)
            self.options, self.whole = [x for x in every if x not in self.tried], True
        if not self.options:
            return None, taken
        pick = self.options.pop(0)
        self.tried.add(pick)
        return pick, taken


def bin_completion(sizes: list[int], cap: int, nodes: int | None = NODES, steps: int | None = STEPS) -> list[list[int]]:
    """Pack sizes (each 0 .. cap) into few containers; lists of indexes. Empty input: none. Without bounds on nodes and steps: as few as can be."""
    if not sizes:
        return []
    incumbent = best_fit_decreasing(sizes, cap)
    total = sum(sizes)
    bound = max(1, math.ceil(total / cap), sum(1 for s in sizes if 2 * s > cap))
    if len(incumbent) <= bound:
        return incumbent
    order = sorted((s for s in sizes if s > 0), reverse=True)
    best: list[tuple[int, ...]] | None = None
    best_n = len(incumbent)
    # depth-first over containers
    stack = [_Frame(order, cap, 0)]
    done: list[tuple[int, ...]] = []
    used = 0
    while stack and (nodes is None or used < nodes) and (steps is None or steps > 0):
        frame = stack[-1]
        pick, taken = frame.next(steps)
        if steps is not None:
            steps -= taken
        # every solution better than the incumbent wastes at most this much, and later fillings waste no less
        here = frame.waste + frame.room - sum(pick or ())
        if pick is None or here > cap * (best_n - 1) - total:
            stack.pop()
            if done:
                done.pop()
            continue
        used += 1
        rest = frame.avail[1:]
        for s in pick:
            del rest[bisect.bisect_left(rest, -s, key=lambda x: -x)]
        done.append((frame.avail[0], *pick))
        if not rest and len(done) < best_n:
            best, best_n = list(done), len(done)
            if best_n <= bound:
                break
        if not rest or len(done) + math.ceil(sum(rest) / cap) >= best_n:
            done.pop()
            continue
        stack.append(_Frame(rest, cap, here))
    if best is None:
        return incumbent
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    bins = [[by_size[s].pop() for s in b] for b in best]
    bins[0].extend(by_size.get(0, []))
    return bins


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """id, n_tokens of every row; NULL and '' have 0."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return s.map(lambda x: t.count(x) if x else 0)

    return docs.select(F.col(id_col).alias("doc_id"), count(F.col(text)).alias("n_tokens"))


def _blocks(n: int, block_items: int) -> int:
    return max(1, math.ceil(n / block_items))


def _filler(r: int, cap: int, nodes: int | None, steps: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fill(b: pd.DataFrame) -> pd.DataFrame:
        sizes = b["size"].astype(int).tolist()
        name, used = [""] * len(b), [0] * len(b)
        for k, members in enumerate(bin_completion(sizes, cap, nodes, steps)):
            total = sum(sizes[i] for i in members)
            for i in members:
                name[i], used[i] = f"{r}-{int(b['__block'].iloc[0])}-{k}", total
        return b.assign(container_id=name, used=used)[["container_id", "doc_id", "piece", "n_pieces", "__row", "size", "used"]]

    return fill


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, open_below: float = 0.98, nodes: int | None = NODES, steps: int | None = STEPS) -> DataFrame:
    """Containers for items(doc_id, n_tokens): container_id, doc_id, piece, n_tokens, used, n_pieces.

    An item above the capacity is cut into full pieces, one container each, and a rest that is packed
    like an item; no other is cut. piece counts from 0, n_pieces tells how many the item has. Items of
    size 0 or NULL size go into some container and take no room. nodes and steps bound the search of a block;
    None lets it run to the block's optimum. Repeated rows (also of a NULL doc_id)
    are items of their own. An empty table gives no rows. Every item comes out exactly once.
    """
    cap = capacity
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    sized = items.select("doc_id", n.alias("n_tokens"), F.greatest(F.lit(1), F.ceil(n / cap)).cast("int").alias("n_pieces"), F.monotonically_increasing_id().alias("__row"))
    pieces = sized.select("doc_id", "n_pieces", "__row", F.posexplode(F.expr(f"transform(sequence(1, n_pieces), i -> if(i < n_pieces, {cap}, n_tokens - {cap} * (n_pieces - 1)))")).alias("piece", "size"))
    pieces = materialize(pieces, "pack")
    total = pieces.filter(F.col("size") < cap).count()
    full = pieces.filter(F.col("size") == cap).select(F.concat_ws("-", F.lit("f"), F.col("__row"), F.col("piece")).alias("container_id"), "doc_id", "piece", F.col("size").alias("n_tokens"), F.col("size").cast("bigint").alias("used"), "n_pieces")
    out = [full]
    todo = pieces.filter(F.col("size") < cap)
    before = math.inf
    for r in itertools.count():
        blocks = _blocks(total, block_items)
        last = blocks == 1 or total > 0.9 * before
        before = total

        blocked = todo.withColumn("__block", F.pmod(F.xxhash64("__row", "piece", F.lit(r)), F.lit(blocks)))
        # as many partitions as keep some blocks each; a stated number isn't merged into few large tasks
        blocked = blocked.repartition(max(min(blocks, 2000), blocks // 64), "__block")
        packed = blocked.groupBy("__block").applyInPandas(_filler(r, cap, nodes, steps), "container_id string, doc_id bigint, piece int, n_pieces int, __row bigint, size int, used bigint")
        shape = lambda d: d.select("container_id", "doc_id", "piece", F.col("size").alias("n_tokens"), "used", "n_pieces")
        if last:
            out.append(shape(packed))
            break
        packed = materialize(packed, "pack")
        out.append(shape(packed.filter(F.col("used") >= open_below * cap)))
        todo = packed.filter(F.col("used") < open_below * cap).select("doc_id", "n_pieces", "__row", "piece", "size")
        total = todo.count()
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    return pack(token_counts(docs, path=path), capacity)


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, lower bound of containers, mean fill."""
    each = containers.groupBy("container_id").agg(F.max("used").alias("u"), F.count(F.lit(1)).alias("n"))
    tokens: Column = F.coalesce(F.sum("u"), F.lit(0)).cast("bigint")
    return each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("items"), tokens.alias("tokens"), F.ceil(tokens / capacity).cast("bigint").alias("lower_bound"), F.avg(F.col("u") / capacity).alias("mean_fill"))


def properties(docs: DataFrame, containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, and of the containers' promises how often each is broken: missing or repeated pieces of documents,
    overfull containers, documents split though they fit. Rows with a NULL doc_id count as documents only."""
    n = docs.agg(F.count(F.lit(1)).alias("documents"))
    rows = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    each = containers.filter("doc_id is not null").groupBy("doc_id").agg(F.sum(F.lit(1.0) / F.col("n_pieces")).alias("held"), F.sum("n_tokens").alias("tokens"), F.max("n_pieces").alias("parts"))
    j = rows.join(each, "doc_id", "left").agg(
        F.count_if(F.coalesce("held", F.lit(0.0)) < F.col("rows") - 1e-6).alias("missing"),
        F.count_if(F.col("held") > F.col("rows") + 1e-6).alias("repeated"),
        F.count_if((F.col("parts") > 1) & (F.col("rows") == 1) & (F.col("tokens") <= capacity)).alias("wrongly_split"),
    )
    full = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.max("used").alias("u")).agg(F.count_if((F.col("t") > capacity) | (F.col("t") != F.col("u"))).alias("overfull"))
    return n.crossJoin(j).crossJoin(full).select("documents", "missing", "repeated", "overfull", "wrongly_split")
