"""One consistent form for texts that look the same.

Look-alike relations between strings (code points, base letters with combining marks, invisible
characters) are closed transitively by union-find. The representative of a class is its most frequent
member in the collection. Texts are rewritten greedily, longest match first, by a multi-pattern
automaton over all other members. Only code points, and bases with marks of LONGEST code points in all, are counted;
a base with more marks goes to its composed form, whatever its frequency, so the table of classes doesn't grow with the texts' fancy.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize

# Letters of other alphabets drawn like a Latin letter.
LOOKALIKE_LETTERS = {
    "Latin letters drawn as Cyrillic": {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "Ү", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у"},
    "Latin letters drawn as Greek": {"A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "j": "ϳ", "o": "ο", "v": "ν"},
    "Latin letters drawn as Armenian": {"O": "Օ", "S": "Տ", "o": "օ", "n": "ո", "u": "ս", "h": "հ", "g": "ց", "q": "զ"},
}
# Hyphens drawn like the hyphen-minus.
HYPHENS = "‐‑−﹣－"
# Characters without any look of their own.
INVISIBLE = ["­", "͏", "؜", "ᅟ", "ᅠ", "឴", "឵", "᠋", "᠌", "᠍", "᠎", "​", "‌", "‍", "‎", "‏", "‪", "‫", "‬", "‭", "‮", "⁠", "⁡", "⁢", "⁣", "⁤", "⁦", "⁧", "⁨", "⁩", "⁪", "⁫", "⁬", "⁭", "⁮", "⁯", "ㅤ", "︀", "︁", "︂", "︃", "︄", "︅", "︆", "︇", "︈", "︉", "︊", "︋", "︌", "︍", "︎", "️", "﻿", "ﾠ"]
_SPACES = "".join(map(chr, [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_LATIN = {v: k for group in LOOKALIKE_LETTERS.values() for k, v in group.items()}


def look(ch: str) -> str | None:
    """What one code point looks like, if that can also be written otherwise; else None."""
    if ch in _INVISIBLE:
        return ""
    if ch in _SPACES:
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in _LATIN:
        return _LATIN[ch]
    o = ord(ch)
    if o >= 0x80:
        kind = unicodedata.decomposition(ch).split(" ")[0]
        wide = unicodedata.normalize("NFKC", ch)
        if kind in ("<wide>", "<narrow>") and wide.isalnum():
            return wide
        if 0x2E80 <= o <= 0x2FDF and len(wide) == 1 and wide != ch:  # radicals of the CJK scripts
            return wide
        if 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F:  # compatibility ideographs
            return unicodedata.normalize("NFC", ch)
    return None


_INVISIBLE = frozenset(INVISIBLE)
#: Code points of the longest base with marks (decomposed) that has a class; what is longer is composed by rule.
LONGEST = 3


def flat(s: str) -> str:
    """s with every code point as it looks."""
    return "".join(c if p is None else p for c, p in ((c, look(c)) for c in s))


def overlong(s: str) -> bool:
    return len(unicodedata.normalize("NFD", s)) > LONGEST


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b, key=lambda s: (len(s), s))] = min(a, b, key=lambda s: (len(s), s))


def classes(frequency: dict[str, int]) -> dict[str, str]:
    """Member -> representative for the look-alike classes of the strings counted in `frequency`.

    Strings are single code points, or a base followed by combining marks. The representative is the
    most frequent member; of equally frequent ones the shortest, then the smallest. What looks
    like nothing goes to ''.
    """
    uf = UnionFind()
    members = set(frequency)
    for s in frequency:
        plain = flat(s)
        whole = unicodedata.normalize("NFC", plain)
        for other in {plain, whole, unicodedata.normalize("NFD", whole)} - {s}:
            uf.union(s, other)
            members.add(other)
    groups: dict[str, list[str]] = {}
    for m in members:
        groups.setdefault(uf.find(m), []).append(m)
    out = {}
    for g in groups.values():
        best = "" if "" in g else min(g, key=lambda m: (-frequency.get(m, 0), len(m), m))
        for m in g:
            if m != best:
                out[m] = best
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting with an Aho-Corasick automaton."""

    def __init__(self, mapping: dict[str, str]):
        import ahocorasick

        self.mapping = mapping
        self.automaton = ahocorasick.Automaton()
        for k in mapping:
            if k:
                self.automaton.add_word(k, k)
        self.automaton.make_automaton()
        self.empty = not any(mapping)

    def once(self, text: str) -> str:
        if self.empty:
            return text
        out, at = [], 0
        for end, k in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - len(k)])
            out.append(self.mapping[k])
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def parts(self, text: str) -> str:
        """once() on what lies between bases with very many marks, which are composed by rule."""
        out, at = [], 0
        for m in _marked().finditer(text):
            if overlong(m.group()):
                out += [self.once(text[at : m.start()]), unicodedata.normalize("NFC", flat(m.group()))]
                at = m.end()
        return "".join([*out, self.once(text[at:])])

    def __call__(self, text: str) -> str:
        # taking out an invisible character may bring a base and its mark together; a step that repeats ends the way
        seen = set()
        while text not in seen:
            seen.add(text)
            text = self.parts(text)
        return text


@lru_cache(maxsize=1)
def _marked():  # noqa: ANN202
    import regex

    return regex.compile(r"\P{M}\p{M}+")


def string_counts(texts: DataFrame, col: str = "text") -> dict[str, int]:
    """How often each code point, and each base with combining marks, occurs. The plainest characters are counted in bulk.

    Invisible characters between a base and a mark are passed over when the two are put together.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        gone = {ord(c): None for c in INVISIBLE}
        total: Counter[str] = Counter()
        for b in batches:
            joined = "\n".join(t for t in b[col] if t)
            total.update(joined)
            if regex.search(r"\p{M}", joined):
                total.update(m for m in _marked().findall(joined.translate(gone)) if not overlong(m))
        yield pd.DataFrame({"s": pd.Series(list(total.keys()), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    counted = texts.select(F.col(col)).filter(f"{col} <> ''").mapInPandas(count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    # bounded by Unicode: code points and strings of at most LONGEST of them, not texts
    return {r["s"]: r["n"] for r in counted.toLocalIterator()}


def odd_pattern(mapping: Iterable[str]) -> str:
    """A Java pattern that every text to be rewritten matches."""
    first = sorted({ord(k[0]) for k in mapping if len(k) == 1})
    marks = sorted({ord(c) for k in mapping if len(k) > 1 for c in k[1:]})
    points = sorted(set(first) | set(marks))
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]" if spans else r"(?!)"


def canonical(texts: DataFrame, mapping: dict[str, str], col: str = "text", to: str = "canonical") -> DataFrame:
    """texts with the column `to`: col in its one form. Only texts with an odd character leave the JVM. NULL stays NULL."""
    if to in texts.columns:
        texts = texts.drop(to)
    shared = texts.sparkSession.sparkContext.broadcast(mapping)

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        r = _rewriter(shared)
        return s.map(lambda t: r(t) if t else t, na_action="ignore")

    odd = F.col(col).rlike(odd_pattern(mapping))
    return texts.withColumn("__odd", rewrite(F.when(odd, F.col(col)))).withColumn(to, F.coalesce("__odd", col)).drop("__odd")


_rewriters: dict[int, Rewriter] = {}


def _rewriter(shared) -> Rewriter:  # noqa: ANN001
    key = hash(frozenset(shared.value.items()))
    if key not in _rewriters:
        _rewriters.clear()
        _rewriters[key] = Rewriter(shared.value)
    return _rewriters[key]


def records(lines: DataFrame, data: DataFrame) -> DataFrame:
    """src, id, text of every row of both tables."""
    a = lines.select(F.lit("annotated_lines").alias("src"), F.col("line_uid").alias("id"), "text")
    b = data.select(F.lit("operator_data").alias("src"), F.col("rec_id").alias("id"), "text")
    return a.unionByName(b)


def canonical_records(lines: DataFrame, data: DataFrame) -> DataFrame:
    """src, id, text, canonical for every record of both tables; NULL and '' texts stay as they are."""
    rec = records(lines, data)
    return canonical(rec, classes(string_counts(rec)))


def lookalike_pairs(rec: DataFrame) -> DataFrame:
    """Pairs of records(src, id, text, canonical) with one form but different texts: src_a, id_a, src_b, id_b.

    The smaller (src, id) comes first and no pair twice. A form with two different texts has at least
    one text that isn't the form itself; so only forms of rewritten texts are looked up among all
    records, and records are paired by way of the distinct texts of a form: equal texts, however
    many, are never compared with each other. Records with NULL or '' text, or NULL id, are in no pair.
    """
    rec = rec.filter("text <> '' and id is not null").select("src", "id", "text", "canonical")
    # only rewritten records are written, and then those whose text is one of their forms; for these nothing is rewritten again
    odd = materialize(rec.filter("text <> canonical").distinct(), "looks")
    forms = materialize(odd.select("canonical").distinct(), "looks")
    plain = rec.select("src", "id", "text", F.col("text").alias("canonical")).join(F.broadcast(forms) if fits_broadcast(forms, 100_000) else forms, "canonical", "left_semi")
    some = materialize(odd.unionByName(plain.select("src", "id", "text", "canonical").distinct()), "looks")
    texts = some.select("canonical", "text").distinct()
    ab: Column = F.col("b.text") > F.col("a.text")
    pairs = texts.alias("a").join(texts.alias("b"), (F.col("a.canonical") == F.col("b.canonical")) & ab).select(F.col("a.text").alias("ta"), F.col("b.text").alias("tb"))
    one, two = some.select("src", "id", "text").alias("x"), some.select("src", "id", "text").alias("y")
    both = pairs.join(one, F.col("ta") == F.col("x.text")).join(two, F.col("tb") == F.col("y.text"))
    x, y = F.struct("x.src", "x.id"), F.struct("y.src", "y.id")
    lo, hi = F.least(x, y), F.greatest(x, y)
    return both.filter(x != y).select(lo["src"].alias("src_a"), lo["id"].alias("id_a"), hi["src"].alias("src_b"), hi["id"].alias("id_b")).distinct()
