"""Spellings of one person, role or organisation linked across two scripts.

Every distinct spelling is cut into tokens and turned into TF-IDF vectors of character n-grams: of its own
characters, and of letters (a transliteration is learned from known pairs), so that both scripts meet. A
distributed sparse join gives every spelling all names and views of names (initial and surname, surname, parts
of a by-named given name) of at least a threshold's cosine; only the rarest n-grams that the threshold allows
are joined on, which loses no pair. An exact check of the edits follows for whole names. What passes is
grouped by average linkage over the cosines: two spellings are as similar as their cosine, or as the product of
theirs to a known name; the spellings that the tables of known names state for one name are one node, and two
known names never share a group. Large components are merged in rounds by all tasks, with the same result. A
shortened form then goes to the group with the greatest cosine, if no other group comes near it.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Least cosine by the kind of view: whole names in characters and letters, initial and surname in both, surname, short forms in both.
COSINE = {"c": 0.4, "r": 0.45, "ci": 0.5, "ri": 0.5, "cu": 0.5, "sc": 0.45, "sc-": 0.45, "sr": 0.4, "si": 0.99}
#: Least average similarity of two groups that are merged.
LINKAGE = 0.3
#: How much nearer a shortened form must be to its group than to the next.
MARGIN = 0.04
#: Weight of a short form read without its form of address, against one read as it stands.
STRIPPED = 0.95
#: Greatest weight of an n-gram, and the least, which is that of one in a single spelling: it can speak for no link. One slip so costs a bounded share of the cosine, however many names there are.
MOST_WEIGHT, LONE_WEIGHT = 1.5, 1.0
#: Part of the threshold that n-grams left out of the join may make up; what they add is computed for the pairs that still can reach it.
LEFT_OUT = 1 / 3
#: Most known pairs (those with the least hashes) from which transliteration and forms of address are learned.
FIT_PAIRS = 20_000
#: Characters of a given name above which it has no parts by which it could be called.
LONGEST_GIVEN = 40
#: Most spellings that one task links; in larger components all tasks merge, until the rest falls apart.
LINK_NODES = 5_000
#: Units in a similarity of 1: sums of whole units don't depend on the order of adding.
UNITS = 1e9
#: Similarity from which two spellings have equal vectors, and the least of any link.
EQUAL, ANY = 0.999, 1e-9
# Common forms of address before and after a part of a name; those that known by-names show are added.
BEFORE, AFTER = ["小", "老", "阿", "大"], ["老大", "老师", "先生", "女士", "小姐", "姐", "哥", "叔", "爷", "头", "婶", "妹", "姨", "伯"]
# Counters behind the word for an unnamed voice.
COUNTERS = "甲乙丙丁戊己庚辛壬癸"

_CJK = re.compile(r"[㐀-鿿]")
_DOTS = re.compile(r"[·・•‧∙・･]")


def plain(name: str) -> str:
    """Width, case, dots and spaces made one; what stands in brackets and says nothing is kept."""
    s = unicodedata.normalize("NFKC", name).strip().lower()
    return re.sub(r"\s+", " ", _DOTS.sub("·", s))


def counted_stem(name: str) -> tuple[str, str] | None:
    """(word, counter) of a voice that is only counted, such as a soldier B; None for others."""
    m = re.fullmatch(rf"(.*[㐀-鿿])\s*([{COUNTERS}]|[a-z]|\d+)|(\w+) ([a-z]|\d+)", plain(name))
    return ((m[1], m[2]) if m[1] else (m[3], m[4])) if m else None


def tokens(name: str) -> list[str]:
    """Parts of a name in given-surname order; 'Surname, Given' is turned round."""
    s = plain(name)
    if not _CJK.search(s) and s.count(",") == 1:
        a, b = s.split(",")
        s = f"{b.strip()} {a.strip()}"
    return [t for t in re.split(r"[·\s]+", s) if t]


def learn_transliteration(pairs: Iterable[tuple[str, str]], rounds: int = 8) -> dict[str, str]:
    """Character -> Latin letters, from (name in characters, name in letters) by hard expectation-maximisation over segmentations."""
    words = []
    for zh, en in pairs:
        a, b = tokens(zh), tokens(en)
        if len(a) == len(b):
            words += [(x, y) for x, y in zip(a, b, strict=True) if _CJK.search(x) and y.isascii() and len(x) <= len(y)]
    if not words:
        return {}
    both: Counter[tuple[str, str]] = Counter()
    chars: Counter[str] = Counter()
    chunks: Counter[str] = Counter()
    for x, y in words:
        subs = {y[i : i + n] for n in (1, 2, 3) for i in range(len(y) - n + 1)}
        chunks.update(subs)
        for c in set(x):
            chars[c] += 1
            both.update((c, s) for s in subs)
    score = {(c, s): 2 * n / (chars[c] + chunks[s]) * (1 + 0.3 * (len(s) == 2)) for (c, s), n in both.items()}
    for _ in range(rounds):
        counts: Counter[tuple[str, str]] = Counter()
        for x, y in words:
            best = {0: (0.0, ())}
            for c in x:
                nxt: dict[int, tuple[float, tuple[str, ...]]] = {}
                for at, (v, way) in best.items():
                    for n in (1, 2, 3, 4):
                        if at + n <= len(y):
                            w = v + math.log(score.get((c, y[at : at + n]), 1e-5))
                            if at + n not in nxt or w > nxt[at + n][0]:
                                nxt[at + n] = (w, (*way, y[at : at + n]))
                best = nxt
            if len(y) in best:
                counts.update(zip(x, best[len(y)][1], strict=True))
        total: Counter[str] = Counter()
        for (c, _), n in counts.items():
            total[c] += n
        score = {(c, s): n / total[c] for (c, s), n in counts.items()}
    out: dict[str, str] = {}
    for (c, s), _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])):
        out.setdefault(c, s)
    return out


def roman(token: str, table: dict[str, str]) -> str:
    """Letters of a token; characters that the table lacks stand for themselves."""
    return "".join(table.get(c, c) for c in token)


def learn_address(pairs: Iterable[tuple[str, str]], known: tuple[list[str], list[str]] = (BEFORE, AFTER)) -> tuple[list[str], list[str]]:
    """Forms of address before and after a part of a name: the `known` ones and those of known (by-name, name) pairs.

    A by-name is a form of address if the rest of it is a part of the name; a by-name as long as the given name
    whose rest stands in its own place only has a character wrong.
    """
    before, after = set(known[0]), set(known[1])
    for alias, name in pairs:
        given, s = tokens(name)[0], plain(alias)
        if not _CJK.search(s) or "·" not in plain(name):
            continue
        for n in (1, 2):
            rest = s[:-n]
            if rest and rest in plain(name) and not set(s[-n:]) & set(name) and not (len(s) == len(given) and given.startswith(rest)):
                after.add(s[-n:])
        if s[1:] and s[1:] in given and s[0] not in name and not (len(s) == len(given) and given.endswith(s[1:])):
            before.add(s[0])
    return sorted(before), sorted(after, key=lambda x: (-len(x), x))


def bare(token: str, before: list[str], after: list[str]) -> str | None:
    """A short form without its form of address, or its one character if that is doubled; None if it has none."""
    if len(token) == 2 and token[0] == token[1]:
        return token[0]
    for a in after:
        if token.endswith(a) and len(token) > len(a):
            return token[: -len(a)]
    return token[1:] if len(token) > 1 and token[0] in before else None


def abbreviated(ts: list[str]) -> bool:
    """Whether one of two tokens is an initial or ends in a full stop."""
    return len(ts) == 2 and any(len(t.rstrip(".")) <= 1 or t.endswith(".") for t in ts)


def views(name: str, observed: bool, label: str | None, by_named: bool, table: dict[str, str], before: list[str], after: list[str]) -> list[tuple[str, str, str]]:
    """(kind, text, side) of a spelling's vectors; side 'q' looks, 't' can be found.

    Kinds: c, r whole names in characters and letters; ci, ri initial and surname; cu surname; sc, sr short
    forms of those of whom by-names are known (sc- is looked for without its form of address), si their initials.
    """
    ts = [t for t in tokens(name) if t.strip(".")]
    if not ts:
        return []
    cjk = bool(_CJK.search(name))
    own = [t.strip(".") for t in ts]
    letters_ = [roman(t, table) for t in own]
    short = abbreviated(ts)
    whole = not short if len(ts) >= 2 else len(own[0]) >= (4 if cjk else 7)
    out = []
    if observed:
        if short:
            given, sur = (0, 1) if len(own[0]) <= 1 or ts[0].endswith(".") else (1, 0)
            out.append(("ci" if cjk else "ri", f"{own[given]} {own[sur]}", "q"))
        elif whole:
            out.append(("c" if cjk else "r", " ".join(own), "q"))
            if len(ts) >= 2 and cjk and own[0][0] in before and len(own[0]) > 2:
                out.append(("c", " ".join([own[0][1:], *own[1:]]), "q"))
        if cjk and len(ts) == 1 and len(own[0]) >= 5:
            out.append(("cu", own[0], "q"))
        if len(ts) == 1 or (not cjk and len(ts) > 2):
            out.append(("sc" if cjk else "sr", " ".join(t.replace(".", "") for t in own), "q"))
            if len(ts) == 1 and not cjk:
                out.append(("si", own[0].replace(".", ""), "q"))
            core = bare(own[0], before, after) if cjk else None
            if core:
                out.append(("sc-", core, "q"))
    if whole or label is not None:
        if cjk:
            out.append(("c", " ".join(own), "t"))
        out.append(("r", " ".join(letters_), "t"))
    if len(ts) == 2 and not short:
        if cjk:
            out += [("cu", own[1], "t"), ("ci", f"{own[0][:1]} {own[1]}", "t"), ("ci", f"{letters_[0][:1]} {own[1]}", "t")]
        out.append(("ri", f"{letters_[0][:1]} {letters_[1]}", "t"))
    if by_named:
        parts = [" ".join(t.replace(".", "") for t in own)] if len(ts) == 1 or not cjk else []
        if len(ts) == 2 and not short and cjk and name == label and len(own[0]) <= LONGEST_GIVEN:
            parts += [own[0][i:j] for i in range(len(own[0])) for j in range(i + 2, len(own[0]) + 1)]
            out += [("sc-", c, "t") for c in own[0]]
        acronym = not cjk and len(ts) == 1 and name.isupper()
        out += [(k, x, "t") for x in parts for k in (("sc", "sc-") if cjk else ("si",) if acronym else ("sr",))]
        if not cjk and len(ts) >= 2:
            out += [("sr", own[0], "t"), ("si", "".join(t[0] for t in own if t not in ("of", "the", "and")), "t")]
    return sorted(set(out))


def grams(kind: str, text: str) -> list[str]:
    """n-grams of every token with its borders marked: 2 characters or 3 letters, and shorter ones for short forms. The order of tokens doesn't matter."""
    out = []
    sizes = {"r": (3,), "ri": (3,), "sr": (2, 3), "si": (2, 3), "sc": (1, 2), "sc-": (1, 2)}.get(kind, (2,))
    for t in text.split(" "):
        b = f"^{t}$"
        out += [b[i : i + n] for n in sizes for i in range(len(b) - n + 1) if b[i : i + n] not in ("^", "$")]
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether at most one letter is wrong, missing, too many or swapped with its neighbour. Takes time in proportion to the length."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    return (len(x) <= 1 and len(y) <= 1) or (len(x) == 2 and x == y[::-1])


def agree(kind: str, a: str, b: str, table: dict[str, str], before: list[str]) -> bool:
    """The exact check behind the cosine: whether spelling a (the one that looks) can mean b, given the kind of view they met in."""
    ta, tb = tokens(a), tokens(b)
    ra, rb = [roman(t.strip("."), table) for t in ta], [roman(t.strip("."), table) for t in tb]
    if kind in ("ci", "ri"):
        p, s = (ta[0].strip("."), ra[1]) if len(ta[0].rstrip(".")) == 1 or ta[0].endswith(".") else (ta[1].strip("."), ra[0])
        if len(rb) != 2 or s != rb[1]:
            return False
        return tb[0].startswith(p) or rb[0].startswith(roman(p, table))
    if kind == "cu":
        rest = ta[0]
        return len(rb) == 2 and any(roman(rest[:n], table) == rb[1] for n in range(3, len(rest) - 1))
    if sorted(ra) == sorted(rb) or "".join(ra) == "".join(rb) or "".join(ra) == "".join(reversed(rb)):
        return True
    if ta[0][0] in before and [roman(ta[0][1:], table), *ra[1:]] == rb:
        return True
    both = bool(_CJK.search(a)) and bool(_CJK.search(b))
    if both:  # compare characters; a wrong one that the transliteration never uses is a slip, another is another name
        x, y = "".join(ta), "".join(tb)
        if min(len(x), len(y)) < 4 or not one_edit(x, y):
            return False
        if len(x) == len(y):
            odd = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
            if len(odd) == 1 and odd[0][0] in table and odd[0][1] in table:
                # two characters that names are made of: a slip only if they sound alike, the letters of one ending in the other's
                p, q = sorted((table[odd[0][0]], table[odd[0][1]]), key=len)
                return len(p) >= 2 and q.endswith(p)
        return True
    x, y = " ".join(ra), " ".join(rb)
    if min(len(x), len(y)) < 7:
        return False
    return one_edit(x, y) or one_edit(" ".join(sorted(ra)), " ".join(sorted(rb)))


def top_cosine(looking: DataFrame, found: DataFrame, least: dict[str, float] = COSINE) -> DataFrame:
    """For each looking(id, kind, text) every found(id, kind, text) of at least the kind's cosine: a, b, kind, cosine.

    Vectors are n-gram counts weighted by rarity over the texts of a kind, within bounds that don't depend on their
    number. Only the rarest n-grams are joined, up to the point from which the rest of a vector is shorter than a
    part of the threshold; pairs whose products so far fall short of the threshold by more than that part can't
    reach it, the others are computed in full. That loses no pair. Equal texts are one vector. No rank cuts them off.
    """
    both = looking.select("kind", "text", F.lit(True).alias("q"), F.lit(False).alias("t")).unionByName(found.select("kind", "text", F.lit(False).alias("q"), F.lit(True).alias("t")))

    @F.pandas_udf("array<string>")
    def cut(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([grams(k, t) for k, t in zip(kind, text, strict=True)], dtype=object)

    texts = both.groupBy("kind", "text").agg(F.bool_or("q").alias("q"), F.bool_or("t").alias("t")).withColumn("v", F.xxhash64("kind", "text"))
    texts = materialize(texts.withColumn("g", cut("kind", "text")), "names")
    each = texts.select("kind", "v", "q", "t", F.explode("g").alias("g")).groupBy("kind", "v", "q", "t", "g").agg(F.count(F.lit(1)).alias("tf"))
    df = each.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("df"))
    total = texts.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))  # one row a kind
    rare = F.when(F.col("df") <= 1, LONE_WEIGHT).otherwise(F.greatest(F.lit(LONE_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.log((F.col("total") + 1) / (F.col("df") + 0.5)))))
    w = each.join(df.join(F.broadcast(total), "kind").select("kind", "g", "df", rare.alias("idf")), ["kind", "g"]).withColumn("w", F.col("tf") * F.col("idf"))
    mine = Window.partitionBy("v")
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(mine)))
    units = materialize(w.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(mine.orderBy("df", "g")))).select("kind", "v", "q", "t", "g", "w", "rest"), "names")
    bound = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    # n-grams up to `rest` = LEFT_OUT of the threshold are joined: what a pair shares beyond adds less than that, so it must reach the rest here
    prefix = units.filter(F.col("rest") >= bound[F.col("kind")] * LEFT_OUT)
    x, y = prefix.filter("q").select("kind", "g", F.col("v").alias("a"), F.col("w").alias("wa")), prefix.filter("t").select("kind", "g", F.col("v").alias("b"), F.col("w").alias("wb"))
    cand = x.join(y, ["kind", "g"]).filter("a <> b").groupBy("kind", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("p"))
    cand = cand.filter(F.col("p") >= bound[F.col("kind")] * (1 - LEFT_OUT) - 1e-9).select("a", "b")
    vec = units.groupBy("v").agg(F.first("kind").alias("kind"), F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("m"))
    scored = cand.join(vec.select(F.col("v").alias("a"), "kind", F.col("m").alias("ma")), "a").join(vec.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
    dot = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("mb", e["key"]), F.lit(0.0)))
    good = scored.select("a", "b", "kind", dot.alias("cosine")).filter(F.col("cosine") >= bound[F.col("kind")] - 1e-9).drop("kind")
    # equal texts are as near as can be
    good = good.unionByName(texts.filter("q and t").select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("cosine")))
    named = lambda d, side, v: d.select(F.col("id").alias(side), "kind", F.xxhash64("kind", "text").alias(v)).distinct()
    pairs = good.withColumnsRenamed({"a": "va", "b": "vb"}).join(named(looking, "a", "va"), "va").join(named(found, "b", "vb").drop("kind"), "vb")
    return pairs.filter("a <> b").groupBy("a", "b", "kind").agg(F.max("cosine").alias("cosine"))


def average_linkage(nodes: list[str], sims: dict[tuple[str, str], float], known: dict[str, str], least: float = LINKAGE) -> dict[str, int]:
    """Group of each node, as the place of its least member among the sorted nodes. Missing pairs have similarity 0;
    groups with different known names are never merged. Of equal averages the groups with the least members come first."""
    import heapq

    members = {i: [n] for i, n in enumerate(sorted(nodes))}
    at = {n[0]: i for i, n in members.items()}
    first = {i: i for i in members}
    label = {i: known.get(n[0]) for i, n in members.items()}
    total: dict[int, dict[int, int]] = defaultdict(dict)
    for (a, b), v in sims.items():
        i, j = at[a], at[b]
        if i != j:
            total[i][j] = total[j][i] = max(int(v * UNITS), total[i].get(j, 0))
    heap = [(-float(v), i, j, i, j) for i, row in total.items() for j, v in row.items() if i < j]
    heapq.heapify(heap)
    fresh = len(members)
    while heap:
        v, _, _, i, j = heapq.heappop(heap)
        if -v < int(least * UNITS):
            break
        if i not in members or j not in members:
            continue
        if label[i] is not None and label[j] is not None and label[i] != label[j]:
            continue
        k, fresh = fresh, fresh + 1
        row: dict[int, int] = defaultdict(int)
        for old in (i, j):
            for x, s in total.pop(old).items():
                if x not in (i, j):
                    row[x] += s
        members[k] = members.pop(i) + members.pop(j)
        first[k] = min(first.pop(i), first.pop(j))
        label[k] = label.pop(i) or label.pop(j, None)
        label.pop(j, None)
        for x, s in row.items():
            total[x].pop(i, None)
            total[x].pop(j, None)
            total[x][k] = s
            heapq.heappush(heap, (-s / (len(members[x]) * len(members[k])), min(first[x], first[k]), max(first[x], first[k]), x, k))
        total[k] = dict(row)
    return {n: first[g] for g, ns in members.items() for n in ns}


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) for edges(a, b), by passing the least id on until nothing changes; after some rounds by leaps."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "names")
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "names")
    for turn in itertools.count():
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("m"))
        new = materialize(label.join(near, label["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), (F.coalesce("m", "component") < F.col("component")).alias("moved")), "names")
        label = new.select("id", "component")
        if new.filter("moved").isEmpty():
            return label
        if turn > 2:  # a long chain: take what the id at the component's name has come to
            there = label.select(F.col("id").alias("at"), F.col("component").alias("to"))
            label = materialize(label.join(there, label["component"] == there["at"]).select("id", F.col("to").alias("component")), "names")


def merge_nearest(clusters: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of average linkage in all tasks: (clusters, links, move, near).

    clusters(id, n, w, label) are groups by their least member, links(a, b, t) the sums of the similarities between
    two. Two groups that are each other's nearest are merged: an average is never above the greater of its parts, and
    groups of different known names stay apart whatever joins them, so nothing that is merged elsewhere comes nearer
    to either, and the order of merging makes no difference. For the same reason a group without a link of at least
    `least` will never have one, and is left out of what comes back. move(old, new) are the merges, near(a, b) the
    links of at least `least` as they were before.
    """
    side = lambda s: clusters.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("label").alias(f"l{s}"))
    ways = links.join(side("a"), "a").join(side("b"), "b").filter("la is null or lb is null or la = lb")
    ways = materialize(ways.select("a", "b", "t", (F.col("t") / (F.col("na") * F.col("nb"))).alias("v")), "names")
    near = ways.filter(F.col("v") >= int(least * UNITS))
    pair = F.struct((-F.col("v")).alias("v"), "a", "b").alias("pair")
    ends = near.select(F.col("a").alias("id"), pair).unionByName(near.select(F.col("b").alias("id"), pair))
    best = materialize(ends.groupBy("id").agg(F.min("pair").alias("pair")), "names")
    move = materialize(best.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("pair.b").alias("old"), F.col("pair.a").alias("new")), "names")
    for end in ("a", "b"):
        ways = ways.join(best.select(F.col("id").alias(end)), end, "left_semi")
        ways = ways.join(move.withColumnsRenamed({"old": end, "new": f"new_{end}"}), end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    ways = ways.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("t").alias("t"))
    kept = clusters.join(best.select("id"), "id", "left_semi").join(move.withColumnRenamed("old", "id"), "id", "left")
    kept = kept.groupBy(F.coalesce("new", "id").alias("id")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("label").alias("label"))
    return materialize(kept, "names"), materialize(ways, "names"), move, near


def linkage_parts(clusters: DataFrame, links: DataFrame, least: float, most: int = 0) -> DataFrame:
    """id, part, settled for clusters(id, n, w, label) and links(a, b, t): no link between two parts is ever merged.

    Rounds of merge_nearest go on until every part has at most `most` spellings (the sum of w), or is settled: one
    group, however many it has. What links of at least the threshold connect makes a part; those in between only fall.
    """
    place = clusters.select("id", F.col("id").alias("at"))
    done: list[DataFrame] = []
    for turn in itertools.count():
        now = clusters
        clusters, links, move, near = merge_nearest(now, links, least)
        if near.isEmpty():
            done.append(place.select("id", F.col("at").alias("part"), F.lit(True).alias("settled")))
            break
        if most and turn & (turn - 1) == 0:  # before rounds 0, 1, 2, 4, 8 and so on
            comp = components(near.select("a", "b"))
            size = comp.join(now, "id").groupBy("component").agg(F.sum("w").alias("w"))
            comp = materialize(comp.join(size, "component").select(F.col("id").alias("at"), F.col("component").alias("part"), (F.col("w") > most).alias("large")), "names")
            here = materialize(place.join(comp, "at", "left"), "names")
            done.append(here.filter("not coalesce(large, false)").select("id", F.coalesce("part", "at").alias("part"), F.col("part").isNull().alias("settled")))
            large, place = comp.filter("large"), here.filter("large").select("id", "at")
            if large.isEmpty():
                break
            move = move.join(large.select(F.col("at").alias("old")), "old", "left_semi")
            clusters = clusters.join(large.select(F.col("at").alias("id")), "id", "left_semi")
            links = links.join(large.select(F.col("at").alias("a")), "a", "left_semi").join(large.select(F.col("at").alias("b")), "b", "left_semi")
        place = materialize(place.join(move.withColumnRenamed("old", "at"), "at", "left").select("id", F.coalesce("new", "at").alias("at")), "names")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def bounded_components(edges: DataFrame, most: int = LINK_NODES, known: DataFrame | None = None, least: float = LINKAGE) -> tuple[DataFrame, DataFrame]:
    """(a, b, sim, component, settled; id, component, entity): components of more than `most` ids are taken apart where average linkage never merges.

    Of known(id, label) the ids of one name are one node. To links of large components come those by way of a known
    name, so that every part has all of its own, and grow_groups finds in the parts what it would in the whole.
    A settled part is one group, and has its entity; the others have at most `most` ids.
    """
    comp = components(edges)
    large = materialize(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("component"), "names")
    inside = materialize(edges.join(comp.select(F.col("id").alias("a"), "component"), "a"), "names").select("a", "b", "sim", "component").withColumn("settled", F.lit(False))
    comp = comp.withColumn("entity", F.lit(None).cast("string"))
    if large.isEmpty():
        return inside, comp
    small, small_edges = comp.join(large, "component", "left_anti"), inside.join(large, "component", "left_anti")
    ids, raw = comp.join(large, "component", "left_semi").select("id"), inside.join(large, "component", "left_semi").select("a", "b", "sim")
    ids = materialize(ids.withColumn("label", F.lit(None).cast("string")) if known is None else ids.join(known.select("id", "label"), "id", "left"), "names").withColumn("node", F.coalesce("label", "id"))
    to = lambda d, end: d.join(ids.select(F.col("id").alias(end), F.col("node").alias(f"node_{end}")), end).withColumn(end, F.col(f"node_{end}")).drop(f"node_{end}")
    between = lambda d: d.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))
    nodes = materialize(ids.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("w"), F.max("label").alias("label")), "names")
    direct = materialize(between(to(to(raw, "a"), "b")), "names")
    # by way of a known name
    both = direct.unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    around = both.join(nodes.filter("label is not null").select(F.col("id").alias("a")), "a", "left_semi").join(nodes.filter("label is null").select(F.col("id").alias("b")), "b", "left_semi")
    x, y = around.select("a", F.col("b").alias("x"), F.col("sim").alias("s")), around.select("a", F.col("b").alias("y"), F.col("sim").alias("t"))
    by_way = materialize(between(x.join(y, "a").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("s") * F.col("t")).alias("sim"))), "names")
    direct = between(direct.unionByName(by_way))
    units = (F.col("sim") * UNITS).cast("long").alias("t")
    # equal vectors first, then what they make up
    equal = linkage_parts(nodes.select("id", F.lit(1).alias("n"), "w", "label"), direct.filter(F.col("sim") >= EQUAL).select("a", "b", units), ANY)
    equal = materialize(nodes.join(equal, "id").select("id", "w", "label", F.col("part").alias("node")), "names")
    last = lambda d, end: d.join(equal.select(F.col("id").alias(end), F.col("node").alias(f"node_{end}")), end).withColumn(end, F.col(f"node_{end}")).drop(f"node_{end}")
    clusters = materialize(equal.groupBy(F.col("node").alias("id")).agg(F.lit(1).alias("n"), F.sum("w").alias("w"), F.max("label").alias("label")), "names")
    parts = linkage_parts(clusters, materialize(between(last(last(direct, "a"), "b")), "names").select("a", "b", units), least, most)
    parts = materialize(equal.select("id", "label", "node").join(parts.withColumnRenamed("id", "node"), "node").select("id", "label", "part", "settled"), "names")
    names_ = parts.filter("settled").groupBy("part").agg(F.coalesce(F.max("label"), F.min("id")).alias("entity"))
    parts = materialize(ids.select("id", "node").join(parts.join(names_, "part", "left").withColumnRenamed("id", "node").drop("label"), "node").select("id", F.col("part").alias("component"), "entity", "settled"), "names")
    a, b = parts.select(F.col("id").alias("a"), "component", "settled"), parts.select(F.col("id").alias("b"), F.col("component").alias("other"))
    ours = raw.unionByName(by_way).groupBy("a", "b").agg(F.max("sim").alias("sim")).join(a, "a").join(b, "b").filter("component = other").drop("other")
    return small_edges.unionByName(materialize(ours.select("a", "b", "sim", "component", "settled"), "names")), small.select("id", "component", "entity").unionByName(parts.select("id", "component", "entity"))


def spellings(story: DataFrame, lines: DataFrame) -> DataFrame:
    """name of every distinct spelling in both fields; NULL, '' and unnamed voices left out.

    Unnamed are spellings without a letter or digit, and words that stand with two or more different counters.
    """
    names = story.select(F.col("speaker").alias("name")).unionByName(lines.select(F.col("interlocutor").alias("name"))).filter("name <> ''").distinct()

    @F.pandas_udf("struct<stem:string,counter:string>")
    def counted(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted_stem(x) or (None, None) for x in s], columns=["stem", "counter"])

    read = materialize(names.filter(F.col("name").rlike(r"(?U)\w")).withColumn("c", counted("name")), "names")
    stems = read.filter("c.stem is not null").groupBy(F.col("c.stem").alias("stem")).agg(F.count_distinct("c.counter").alias("n")).filter("n > 1")
    return read.join(stems, read["c.stem"] == stems["stem"], "left_anti").select("name")


def _fit(pairs: DataFrame, most: int) -> list[tuple[str, str]]:
    """The `most` pairs with the least hashes, in a fixed order: a bounded sample to learn from."""
    cols = pairs.columns
    return sorted(tuple(r) for r in pairs.distinct().orderBy(F.xxhash64(*cols), *cols).limit(most).collect())


def name_links(story: DataFrame, lines: DataFrame, operators: DataFrame, aliases: DataFrame, fit_pairs: int = FIT_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spellings, known, links): links are a, b, kind, cosine of every pair of the cosine join that passes the check."""
    spark = story.sparkSession
    records = operators.filter("name_zh <> '' and name_en <> ''").select("name_zh", "name_en")
    by_names = aliases.filter("alias <> '' and canonical <> ''").select("alias", "canonical")
    learned = spark.sparkContext.broadcast((learn_transliteration(_fit(records, fit_pairs)), *learn_address(_fit(by_names, fit_pairs))))

    names = materialize(spellings(story, lines), "names")
    both = operators.select(F.explode(F.array("name_zh", "name_en")).alias("id"), F.col("name_zh").alias("label")).unionByName(by_names.select(F.explode(F.array("alias", "canonical")).alias("id"), F.col("canonical").alias("label")))
    famed = by_names.select(F.col("canonical").alias("label")).distinct().withColumn("famed", F.lit(True))
    known = both.filter("id <> '' and label <> ''").groupBy("id").agg(F.min("label").alias("label"))
    known = materialize(known.join(famed, "label", "left").select("id", "label", F.coalesce("famed", F.lit(False)).alias("famed")), "names")
    nodes = names.withColumn("seen", F.lit(True)).join(known.withColumnRenamed("id", "name"), "name", "full").select(F.col("name").alias("id"), F.coalesce("seen", F.lit(False)).alias("seen"), "label", F.coalesce("famed", F.lit(False)).alias("famed"))

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, before, after = learned.value
        for b in batches:
            rows = [(i, *v) for i, seen, label, famed_ in zip(b["id"], b["seen"], b["label"], b["famed"], strict=True) for v in views(i, bool(seen), label if isinstance(label, str) else None, bool(famed_), table, before, after)]
            yield pd.DataFrame(rows, columns=["id", "kind", "text", "side"])

    seen = materialize(nodes.mapInPandas(see, "id string, kind string, text string, side string"), "names")
    near = top_cosine(seen.filter("side = 'q'"), seen.filter("side = 't'"))

    @F.pandas_udf("boolean")
    def check(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        table, before, _ = learned.value
        return pd.Series([k[0] == "s" or agree(k, x, y, table, before) for k, x, y in zip(kind, a, b, strict=True)], dtype=bool)

    return names, known, materialize(near.filter(check("kind", "a", "b")), "names")


def name_groups(story: DataFrame, lines: DataFrame, operators: DataFrame, aliases: DataFrame, fit_pairs: int = FIT_PAIRS, linkage: float = LINKAGE, margin: float = MARGIN) -> DataFrame:
    """name, entity (a group's id) of every named spelling; spellings that link to none are groups of their own.

    Spellings are compared as stored strings; equal ones are one. The tables of known names may be
    empty, then spellings are linked by likeness alone. Transliteration and forms of address are learned from at
    most `fit_pairs` known pairs each.
    """
    names, known, links = name_links(story, lines, operators, aliases, fit_pairs)
    stated = known.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"), F.lit(1.0).alias("sim"))
    whole = links.filter("kind in ('c', 'r')").select("a", "b", F.col("cosine").alias("sim")).unionByName(stated)
    whole = materialize(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim")), "names")
    inside, comp = bounded_components(whole, known=known, least=linkage)
    settled, inside = comp.filter("entity is not null").select("id", "entity"), inside.filter("not settled")
    members = comp.filter("entity is null").join(known.select("id", "label"), "id", "left").select(F.col("component").alias("part"), "id", "label")

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sims = {(a, b): s for a, b, s in zip(left["a"], left["b"], left["sim"], strict=True)}
        labels = {i: x for i, x in zip(right["id"], right["label"], strict=True) if isinstance(x, str)}
        groups = grow_groups(list(right["id"]), sims, labels, linkage)
        return pd.DataFrame({"id": list(groups), "entity": list(groups.values())})

    # a stated number of partitions isn't merged into one task
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside, members = inside.repartition(parts, "component"), members.repartition(parts, "part")
    grouped = materialize(inside.groupBy("component").cogroup(members.groupBy("part")).applyInPandas(link, "id string, entity string").unionByName(settled), "names")
    # a shortened form goes to the group it comes nearest to, if no other comes near that
    score = F.when(F.col("kind") == "sc-", F.col("cosine") * STRIPPED).when(F.col("kind").isin("ci", "ri", "cu", "si"), 1.0).otherwise(F.col("cosine"))
    ways = links.filter("kind not in ('c', 'r')").select("a", "b", score.alias("score")).join(grouped.withColumnRenamed("id", "b"), "b", "left")
    ways = ways.groupBy("a", F.coalesce("entity", "b").alias("e")).agg(F.max("score").alias("score"))
    best = ways.groupBy("a").agg(F.max_by("e", "score").alias("partly"), F.sort_array(F.collect_list("score"), False).alias("s"))
    part = best.filter((F.size("s") == 1) | (F.col("s")[0] - F.try_element_at("s", F.lit(2)) >= margin)).select(F.col("a").alias("name"), "partly")
    out = names.join(grouped.withColumnRenamed("id", "name"), "name", "left").join(part, "name", "left")
    return out.select("name", F.coalesce("entity", "partly", "name").alias("entity"))


def grow_groups(ids: list[str], sims: dict[tuple[str, str], float], labels: dict[str, str], least: float = LINKAGE) -> dict[str, str]:
    """id -> entity by average linkage. The known spellings of one name are one node; two spellings are as similar
    as their cosine, or as the product of their cosines to one known name."""
    node = {i: labels.get(i, i) for i in ids}
    merged: dict[tuple[str, str], float] = {}
    for (a, b), s in sims.items():
        x, y = sorted((node[a], node[b]))
        if x != y:
            merged[x, y] = max(s, merged.get((x, y), 0.0))
    known = {x: x for x in labels.values()}
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for (x, y), s in merged.items():
        if x in known and y not in known:
            near[x].append((y, s))
        elif y in known and x not in known:
            near[y].append((x, s))
    for around in near.values():
        for k, (x, s) in enumerate(around):
            for y, t in around[k + 1 :]:
                pair = (min(x, y), max(x, y))
                merged[pair] = max(s * t, merged.get(pair, 0.0))
    # spellings of equal vectors are one node as well, so that the average is over different ones
    names = sorted(set(node.values()))
    first = {n: names[i] for n, i in average_linkage(names, {k: s for k, s in merged.items() if s >= EQUAL}, known, ANY).items()}
    rest: dict[tuple[str, str], float] = {}
    for (a, b), s in merged.items():
        x, y = sorted((first[a], first[b]))
        if x != y:
            rest[x, y] = max(s, rest.get((x, y), 0.0))
    second = average_linkage(sorted(set(first.values())), rest, {first[n]: n for n in known}, least)
    title: dict[int, str] = {}
    for n in names:
        g = second[first[n]]
        if g not in title or (n in known and title[g] not in known):
            title[g] = n
    return {i: title[second[first[node[i]]]] for i in ids}


def name_pairs(groups: DataFrame) -> DataFrame:
    """name_a, name_b of every two different spellings of one entity, the smaller first."""
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
