"""Cutting oversized texts into pieces by dynamic programming over boundary positions.

A text's tokens are counted once; a cut lies between two pre-tokens, or inside one of more than 64 tokens
where a token ends on a whole character. Cuts cost less at section ends than at paragraph, sentence,
clause or word ends; a piece costs more the further its size is from an even share. The cheapest chain of
cuts, of any number of pieces whose size (the overlap with the piece before included) stays under the
limit, is found exactly by dynamic programming. A border is left out only where a bound shows that no
chain through it can be cheaper than one already found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, Tokenizer, tokenizer

LIMIT = 2048
OVERLAP = 64
#: Cost of a cut by the kind of boundary it lies at.
PENALTY = {"section": 0.0, "paragraph": 1.0, "line": 2.0, "sentence": 4.0, "clause": 12.0, "space": 24.0, "none": 60.0}
#: Weight of the squared relative distance of a piece from the even share.
BALANCE = 6.0

_HEADING = re.compile(r"(?m)^(?=[ \t]*(?:#{1,6}[ \t]|={2,}[^=\n]|\\(?:sub)*section\b|<h[1-6]\b))")
_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}|(?:</(?:p|ul|ol|table|h[1-6]|div)>\s*)+")
_LINE = re.compile(r"\r?\n|<br\s*/?>")
_SENTENCE = re.compile(r"[。！？；…!?]+[”’」』）)\]】\"']*|\.+[”’\"')\]]*(?=\s|$)")
_CLAUSE = re.compile(r"[，、,;:：—]+")
_SPACE = re.compile(r"\s+")


#: Kinds of borders, the strongest first.
_KINDS = [("section", _HEADING), ("paragraph", _PARAGRAPH), ("line", _LINE), ("sentence", _SENTENCE), ("clause", _CLAUSE), ("space", _SPACE)]


def boundaries(text: str, kind: str, pattern: re.Pattern) -> np.ndarray:
    """Offsets of one kind of boundary inside the text; what is before a cut goes into the earlier piece."""
    at = np.fromiter((m.start() if kind == "section" else m.end() for m in pattern.finditer(text)), dtype=np.int64)
    return at[(at > 0) & (at < len(text))]


def split_offsets(text: str, tok: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str, int]]:
    """Pieces (start, end, shared with the piece before in characters, kind of boundary at the end, tokens), in order.

    A text of at most `limit` tokens is one piece. Each later piece begins at the last border
    that lies at least `overlap` tokens before the end of the piece before.
    """
    offs, toks, pure = tok.borders(text)
    if not toks or toks[-1] <= limit:
        return [(0, len(text), 0, "end", toks[-1] if toks else 0)]
    e, n = np.asarray(offs), np.asarray(toks)
    room = limit
    while True:
        out = []
        for a, b, shared, kind in _split(text, e, n, room, overlap):
            if pure:  # counts add up, but for white space at the end, which is read as one there
                z = b - (len(text[a:b]) - len(text[a:b].rstrip()))
                k = int(np.searchsorted(e, z))
                size = int(n[k] - (n[np.searchsorted(e, a)] if a else 0)) + tok.count(text[z:b]) if z == e[k] and z > a else tok.count(text[a:b])
            else:
                size = tok.count(text[a:b])
            out.append((a, b, shared, kind, size))
        if all(x[4] <= limit for x in out):
            return out
        room -= max(8, limit // 128)
        if room <= 2 * overlap + 16:
            raise ValueError("limit too small for the overlap")


def _cheapest(pos: np.ndarray, pen: np.ndarray, share: float, own: int) -> tuple[float, list[int]]:
    """Cost and indexes of the cheapest chain from the first to the last position; inf if none has steps of at most `own`."""
    lo = np.searchsorted(pos, pos - own)
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), dtype=np.int64)
    best[0] = 0.0
    for j in range(1, len(pos)):
        i = int(lo[j])
        if i < j:
            way = best[i:j] + BALANCE * ((pos[j] - pos[i:j]) / share - 1) ** 2
            k = int(way.argmin())
            best[j], back[j] = way[k] + pen[j] + 1.0, i + k
    cuts = [len(pos) - 1]
    while np.isfinite(best[-1]) and cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    return float(best[-1]), cuts[::-1]


def _split(text: str, e: np.ndarray, n: np.ndarray, room: int, overlap: int) -> list[tuple[int, int, int, str]]:
    total = int(n[-1])
    own = room - 2 * overlap - 10  # tokens a piece may add; its overlap may reach back to the border before
    share = total / max(1, -(-total // own))
    names = list(PENALTY)
    penalty = np.array(list(PENALTY.values()))
    kind = np.full(len(e), names.index("none"))  # of the cut at each border
    for name, pattern in reversed(_KINDS):
        k = np.searchsorted(e, boundaries(text, name, pattern))
        kind[k[k < len(e)]] = names.index(name)
    inner = np.arange(len(e) - 1)
    pen = penalty[kind[inner]]
    # every stretch of `own` tokens holds a cut: the cheapest border of each bounds what any chain costs
    stretch = (n[inner] - 1) // own
    floor = np.full(int((total - 1) // own) + 1, np.inf)
    np.minimum.at(floor, stretch, pen)
    floor = np.where(np.isfinite(floor), floor, 0.0)
    floor[-1] = 0.0  # the last stretch reaches to the end and need not hold one
    count = np.arange(max(1, -(-total // own)), len(e) + 1)
    least = float((count + BALANCE * count * (total / count / share - 1) ** 2).min())
    bound = pen + floor.sum() - floor[stretch] + least
    # a chain over strong borders bounds the cost from above; a border with which no chain can be cheaper is left out
    at, cuts = inner[:0], [0]
    top = np.inf
    for weakest in np.unique(pen) if len(pen) else [0.0]:
        some = inner[(pen <= weakest) & (bound <= top)]
        if np.any(pen[some] == weakest) or not np.isfinite(top):
            found, way = _cheapest(np.concatenate([[0], n[some], [total]]).astype(float), np.concatenate([[0.0], pen[some], [0.0]]), share, own)
            if np.isfinite(found):
                top, at, cuts = found, some, way
        if not np.any(bound[pen > weakest] <= top):
            break
    if not np.isfinite(top):
        raise ValueError("limit too small for the borders of the text")
    at = np.append(at, len(e) - 1)
    pos = np.concatenate([[0], n[at]])
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        start = cut = 0
        if a:
            cut = int(e[at[a - 1]])
            back = int(np.searchsorted(n, n[at[a - 1]] - overlap - 2, side="right")) - 1
            start = int(e[back]) if back >= 0 else 0
        last = b == len(pos) - 1
        out.append((start, len(text) if last else int(e[at[b - 1]]), cut - start, "end" if last else names[kind[at[b - 1]]]))
    return out


def split_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER, oversized_only: bool = True) -> DataFrame:
    """Ordered pieces: doc_id, piece (from 0), n_pieces, start, stop, n_tokens, shared, boundary, text.

    Pieces tile the text: piece k > 0 repeats the last `shared` characters (at least `overlap` tokens)
    of the piece before, and no piece has more than `limit` tokens. With oversized_only texts within
    the limit don't come out, else they come as one piece. NULL and '' texts have no pieces. Rows with
    equal doc_id are cut each for itself.
    """
    rows = docs.select("doc_id", F.col("text").alias("text")).filter("text <> ''")
    if oversized_only:  # a byte-level vocabulary never has more tokens than bytes
        rows = rows.filter(F.octet_length("text") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                # a text of few bytes more than the limit is counted first, which is cheaper than to list its borders
                if oversized_only and len(text) < 2 * limit and tok.count(text) <= limit:
                    continue
                pieces = split_offsets(text, tok, limit, overlap)
                if oversized_only and len(pieces) == 1:
                    continue
                out += [(doc, k, len(pieces), a, z, size, shared, kind, text[a:z]) for k, (a, z, shared, kind, size) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "n_pieces", "start", "stop", "n_tokens", "shared", "boundary", "text"])

    return rows.mapInPandas(cut, "doc_id bigint, piece int, n_pieces int, start int, stop int, n_tokens int, shared int, boundary string, text string")


def oversized(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """doc_id of every text that had to be cut, from its pieces."""
    return split_documents(docs, limit, overlap, path).filter("n_pieces > 1").select("doc_id").distinct()


def tiling(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chars (that the pieces cover, shared ones once), within (no piece over the limit), ordered (every piece begins where it
    shares the end of the one before, which repeats at least one character)."""
    each = pieces.select("doc_id", "n_tokens", F.struct("piece", "start", "stop", "shared", F.length("text").alias("n")).alias("p"))
    g = each.groupBy("doc_id").agg(F.sum(F.col("p.n") - F.col("p.shared")).cast("bigint").alias("chars"), F.bool_and(F.col("n_tokens") <= limit).alias("within"), F.array_sort(F.collect_list("p")).alias("ps"))
    joins = F.transform("ps", lambda x, i: F.when(i == 0, (x["start"] == 0) & (x["shared"] == 0)).otherwise((F.get("ps", i - 1)["stop"] == x["start"] + x["shared"]) & (x["shared"] > 0)) & (x["n"] == x["stop"] - x["start"]))
    return g.select("doc_id", "chars", "within", F.forall(joins, lambda ok: ok).alias("ordered"))
