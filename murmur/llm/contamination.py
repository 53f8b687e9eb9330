"""Evaluation items inside training texts, found with a generalised suffix automaton.

The normalised test items form one automaton, which tells where each piece of 4 letters (7 in alphabetic
scripts, fewer for a shorter item) stands in them. Every letter of a document is read: all its pieces that stand in
some item are looked up. An item is left out only where those pieces, with gaps of up to 3 letters between them
filled, hold less of it than a leak needs. What is left is streamed through the automaton, which keeps the length of
the longest match at every letter; the matches with an item are chained in order, and each passage that
covers `share` of the item's letters and digits is a leak. Test sets too large for one automaton are worked through in parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's letters and digits that one passage must reproduce.
SHARE = 0.5
#: Letters between two matching pieces of one passage, in the text or in the item.
GAP = 24
#: Shortest matching piece that counts towards a passage, for wide and alphabetic scripts.
PIECE_WIDE, PIECE_ALPHA = 4, 7
#: Letters of all items of one automaton, some 1 kB of memory each in every Python worker; a larger test set takes several passes.
PART_CHARS = 400_000

#: Markup inside a passage; only the marks go, the words they wrap stay.
_MARKS = re.compile(
    r"<!--.*?-->|<ref\b[^<>]*>[^<>]*</ref>|<style\b.*?</style>|</?[a-zA-Z][^<>]*>|<!DOCTYPE[^<>]*>|\]\([a-z]+://[^()\s]*\)|\[\[(?:[^\[\]|\n]*\|)?"
    r"|\{\{color\|[^|{}]*\||\{\{VoiceData/word\|[^|{}]*\||\{\{[^{}|\n]*\|?\}\}|\\footnote\{[^{}]*\}|\\[a-zA-Z]+\*?(?=\{)|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\{@\w+\}|\[[a-zA-Z]+(?:\([^()]*\))?\](?!\()",
    re.S,
)
_LETTERS = re.compile(r"[^\W_]+")


def letters(text: str) -> str:
    """Letters and digits of a text, without markup, case, width and accents."""
    if "<" in text or "[" in text or "{" in text or "&" in text or "\\" in text:
        text = _MARKS.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return "".join(_LETTERS.findall(text.lower()))


def letters_at(text: str) -> tuple[str, list[int]]:
    """letters(text), and the offset in text each of them comes from."""
    out: list[str] = []
    at: list[int] = []
    spans = [(m.start(), m.end()) for m in _MARKS.finditer(text)] if any(c in text for c in "<[{&\\") else []
    spans.append((len(text), len(text)))
    i = 0
    for a, b in spans:
        for k in range(i, a):
            for c in "".join(_LETTERS.findall(unicodedata.normalize("NFKD", text[k]).lower())):
                out.append(c)
                at.append(k)
        i = b
    return "".join(out), at


class SuffixAutomaton:
    """Generalised suffix automaton of several strings; every state knows one end position, its subtree of links knows all."""

    def __init__(self, items: list[str]):
        self.items = items
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for n, s in enumerate(items):
            last = 0
            for i, c in enumerate(s):
                last = self._extend(last, c)
                self.ends[last].append((n, i + 1))
        self.kids: dict[int, list[int]] = defaultdict(list)
        for v in range(1, len(self.link)):
            self.kids[self.link[v]].append(v)

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def occurrences(self, v: int, at_least: int) -> Iterator[tuple[int, int]]:
        """(item, end) of every occurrence in the items of the last `at_least` letters read on the way to v."""
        while self.link[v] > 0 and self.len[self.link[v]] >= at_least:
            v = self.link[v]
        todo = [v]
        while todo:
            u = todo.pop()
            yield from self.ends[u]
            todo.extend(self.kids.get(u, ()))


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each k letters in a row; equal letters have equal numbers."""
    h = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(h)]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Finder:
    def __init__(self, items: list[tuple[int, str]]):
        pairs = [(i, letters(t or "")) for i, t in items]
        pairs = [(i, s) for i, s in pairs if s]
        self.ids, self.norm = [i for i, _ in pairs], [s for _, s in pairs]
        self.sizes = np.array([len(s) for s in self.norm], dtype=np.int64)
        self.sam = SuffixAutomaton(self.norm)
        self._piece = [min(len(s), PIECE_ALPHA if 2 * sum(c.isascii() for c in s) > len(s) else PIECE_WIDE) for s in self.norm]
        self._ends_of: dict[tuple[int, int], dict[int, list[int]]] = {}
        self.places = {k: self._places(k) for k in sorted(set(self._piece))}

    def piece(self, item: int) -> int:
        return self._piece[item]

    def _places(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All k letters in a row of the items whose pieces have k: numbers, their upper bits as a table, and where each stands."""
        grams = sorted({s[p : p + k] for n, s in enumerate(self.norm) if self._piece[n] == k for p in range(len(s) - k + 1)})
        keys = np.array([_hashes(_codes(g), k)[0] for g in grams], dtype=np.uint64)
        order = np.argsort(keys)
        starts, item, at = [0], [], []
        for o in order.tolist():
            v = 0
            for c in grams[o]:
                v = self.sam.next[v][c]
            for n, end in self.sam.occurrences(v, k):
                if self._piece[n] == k:
                    item.append(n)
                    at.append(end - k)
            starts.append(len(item))
        some = np.zeros(1 << 22, dtype=bool)
        some[keys >> np.uint64(42)] = True
        return keys[order], some, np.array(starts), np.array(item, dtype=np.int64), np.array(at, dtype=np.int64)

    def runs(self, t: str, share: float) -> dict[int, list[tuple[int, int]]]:
        """Item -> parts of t in which one passage may reproduce `share` of it; what lies outside can't.

        Matches more than GAP letters apart are never chained, and a chain covers no letters of the item but
        those in matches of a piece's length and gaps of up to 3 between them.
        """
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        codes = _codes(t)
        for k, (keys, some, starts, items, offsets) in self.places.items():
            h = _hashes(codes, k)
            pos = np.flatnonzero(some[h >> np.uint64(42)])
            if not len(pos):
                continue
            g = np.minimum(np.searchsorted(keys, h[pos]), len(keys) - 1)
            same = keys[g] == h[pos]
            pos, g = pos[same], g[same]
            n = starts[g + 1] - starts[g]
            row = np.repeat(starts[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
            i, item, p = np.repeat(pos, n), items[row], offsets[row]
            need = share * self.sizes - 1e-9
            enough = (np.bincount(item, minlength=len(self.sizes)) * (k + 3) >= need)[item]
            i, item, p = i[enough], item[enough], p[enough]
            if not len(i):
                continue
            order = np.lexsort((i, item))
            i, item, p = i[order], item[order], p[order]
            first = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(i) > GAP + k)))
            last = np.append(first[1:], len(i))
            some_of = (last - first) * (k + 3) >= need[item[first]]
            first, last = first[some_of], last[some_of]
            if not len(first):
                continue
            # letters of the item that a run's pieces hold, gaps of up to 3 filled: of its places in the item, sorted, each step counts
            n = last - first
            run = np.repeat(np.arange(len(n)), n)
            at = p[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            order = np.lexsort((at, run))
            run, at = run[order], at[order]
            step = np.diff(at)
            held = np.bincount(run[1:], np.where(np.diff(run) == 0, np.where(step <= k + 3, step, k), 0), len(n)) + k
            for g in np.flatnonzero(held >= need[item[first]]).tolist():
                out[int(item[first[g]])].append((int(i[first[g]]), int(i[last[g] - 1]) + k))
        return out

    def _ends(self, u: int, k: int) -> dict[int, list[int]]:
        """Item -> where the k letters of state u end in it, remembered by state."""
        got = self._ends_of.get((u, k))
        if got is None:
            got = {}
            for x, end in self.sam.occurrences(u, k):
                got.setdefault(x, []).append(end)
            self._ends_of[u, k] = got
        return got

    def matches(self, t: str, item: int, a: int, b: int) -> list[tuple[int, int, int]]:
        """(begin in t, begin in the item, letters) of the maximal matches of t[a:b] with the item, from a piece's length on.

        The automaton reads the letters and keeps the longest match that ends at each; where that is a piece or more,
        it tells where the last piece stands in the item, and what follows on one diagonal is one match.
        """
        sam, k = self.sam, self._piece[item]
        out: list[list[int]] = []
        open_: dict[int, list[int]] = {}  # diagonal -> its last match
        v = n = 0
        for i in range(a, b):
            c = t[i]
            while v and c not in sam.next[v]:
                v = sam.link[v]
                n = sam.len[v]
            if c in sam.next[v]:
                v, n = sam.next[v][c], n + 1
            if n < k:
                continue
            u = v
            while sam.len[sam.link[u]] >= k:
                u = sam.link[u]
            for end in self._ends(u, k).get(item, ()):
                d = i + 1 - end
                m = open_.get(d)
                if m is not None and m[0] + m[2] == i:
                    m[2] += 1
                else:
                    m = [i + 1 - k, end - k, k]
                    open_[d] = m
                    out.append(m)
        return sorted((m[0], m[1], m[2]) for m in out)

    def coverage(self, t: str, item: int, spans: list[tuple[int, int]]) -> tuple[float, int, int]:
        """Best share of the item in one passage of the spans of t, with the passage's begin and end; 0 if there is none."""
        size = len(self.norm[item])
        best = (0.0, 0, 0)
        for a, b in spans:
            blocks = self.matches(t, item, a, b)
            score: list[tuple[float, int]] = []  # letters covered, begin
            for j, (i, p, n) in enumerate(blocks):
                top = (float(n), i)
                for h in range(j - 1, -1, -1):
                    i0, p0, n0 = blocks[h]
                    if i - (i0 + n0) > GAP and i - i0 > size + GAP:
                        break
                    cut = max(0, i0 + n0 - i, p0 + n0 - p)
                    gi, gp = i + cut - i0 - n0, p + cut - p0 - n0
                    if n - cut <= 0 or p <= p0 or gi > GAP or gp > GAP:
                        continue
                    slip = gp if gp <= 3 and gi <= 3 else 0  # a slip of a letter or two is still reproduced
                    if score[h][0] + n - cut + slip > top[0]:
                        top = (score[h][0] + n - cut + slip, score[h][1])
                score.append(top)
                if top[0] / size > best[0]:
                    best = (top[0] / size, top[1], i + n)
        return best

    def passages(self, t: str, item: int, spans: list[tuple[int, int]], share: float) -> list[tuple[float, int, int]]:
        """Every passage of the spans that covers `share` of the item: the best one, then what lies before and after it."""
        out = []
        todo = list(spans)
        while todo:
            a, b = todo.pop()
            c, x, y = self.coverage(t, item, [(a, b)])
            if c >= share - 1e-9 and y > x:
                out.append((c, x, y))
                todo += [(a, x), (y, b)]
        return sorted(out, key=lambda m: m[1])

    def leaks(self, text: str, share: float = SHARE) -> list[tuple[int, float, int, int]]:
        """(item id, share reproduced, begin, end in letters) of every passage of the text that leaks an item."""
        t = letters(text)
        return [(self.ids[item], *m) for item, spans in self.runs(t, share).items() for m in self.passages(t, item, spans, share)]


_finders: dict[object, Finder] = {}


def leaked_passages(docs: DataFrame, items: DataFrame, share: float = SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, covered (share of the item's letters and digits), start, stop (of the passage in text).

    One row for each passage: an item that stands in a document twice has two. NULL and '' texts leak
    nothing; items without letters or digits can't leak, items shorter than a piece leak where they stand whole.
    Items stored twice (same item_id and text) count once; documents stored twice give their rows once. Either
    table may be empty.
    """
    spark = docs.sparkSession
    # the test set is small by its nature; it is read in parts of at most part_chars characters, each with its own automaton
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in items.filter("text <> ''").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if size + len(r["text"]) > part_chars and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((r["item_id"], r["text"]))
        size += len(r["text"])
    slim = docs.select("doc_id", "text").filter("text <> ''")
    out = None
    for part in parts:
        found = slim.mapInPandas(_scanner(spark.sparkContext.broadcast(part), share), "doc_id bigint, item_id bigint, covered double, start int, stop int")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leaked_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id of every item that a document leaks, once."""
    return leaked_passages(docs, items, share).select("doc_id", "item_id").distinct()


def _scanner(shared, share: float):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = shared._path if hasattr(shared, "_path") else id(shared)
        if key not in _finders:
            _finders.clear()
            _finders[key] = Finder(shared.value)
        finder = _finders[key]
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                hits = finder.leaks(text, share)
                if hits:
                    _, at = letters_at(text)
                    for item, c, x, y in hits:
                        rows.append((doc, item, c, at[min(x, len(at) - 1)], at[min(y, len(at)) - 1] + 1))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "start", "stop"])

    return scan


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_leaks, text without the leaked passages, for every row of docs."""
    spans = leaked_passages(docs, items, share).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__s"))
    # what stands between the passages, in order; overlapping passages are cut once
    cut = """aggregate(__s, struct('' as t, 0 as at), (a, x) -> struct(
        concat(a.t, if(x.start > a.at, substring(text, a.at + 1, x.start - a.at), '')) as t, greatest(a.at, x.stop) as at),
        a -> concat(a.t, substring(text, a.at + 1)))"""
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.size("__s"), F.lit(0)).alias("n_leaks"), F.when(F.col("__s").isNull(), F.col("text")).otherwise(F.expr(cut)).alias("text"))
