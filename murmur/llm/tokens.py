"""Token counts and offsets with a public byte-level BPE vocabulary, memoised by pre-token."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files and the file used; both are parameters of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker. A memo only: results are the same at any size.
MEMO = 400_000


class Tokenizer:
    """Encodes text piece by piece; pieces repeat so often that most are looked up."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        get, total, missed = self.counts.get, 0, []
        for p in self.pieces.findall(text):
            n = get(p)
            if n is None:
                missed.append(p)
            else:
                total += n
        if missed:
            if len(self.counts) > MEMO:
                self.counts.clear()
            for p in missed:
                n = self.counts.get(p)
                if n is None:
                    n = len(self.enc.encode_ordinary(p))
                    if len(p) <= 64:
                        self.counts[p] = n
                total += n
        return total

    def borders(self, text: str, longest: int = 64) -> tuple[list[int], list[int], bool]:
        """Offsets at which the text may be cut, tokens up to each, and whether all of them lie between pre-tokens.

        A text is encoded pre-token by pre-token, so counts between such borders add up. A pre-token of
        more than `longest` tokens is opened at the ends of its tokens that end on a whole character.
        """
        pieces = self.pieces.findall(text)
        get = self.counts.get
        sizes = [get(p) or self.count(p) for p in pieces]
        at, n, pure = 0, 0, True
        offs, toks = [], []
        for p, k in zip(pieces, sizes, strict=True):
            if k > longest:
                pure = False
                last = 0
                for i, e in enumerate(self._ends(p)[:-1]):
                    if e > last:
                        offs.append(at + e)
                        toks.append(n + i + 1)
                        last = e
            at += len(p)
            n += k
            offs.append(at)
            toks.append(n)
        return offs, toks, pure

    def _ends(self, piece: str) -> list[int]:
        starts = []  # byte offset at which each character ends
        b = 0
        for ch in piece:
            b += len(ch.encode())
            starts.append(b)
        out, done, c = [], 0, 0
        for tok in self.enc.encode_ordinary(piece):
            done += len(self.enc.decode_single_token_bytes(tok))
            while c < len(starts) and starts[c] <= done:
                c += 1
            out.append(c)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER) -> Tokenizer:
    return Tokenizer(path)
