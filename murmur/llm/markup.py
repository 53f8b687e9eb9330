"""Markup residue: wrappers inferred from token streams, and clean text that keeps structure.

A text is read as blocks of marks and text slots. The blocks of all texts of one host (table and source) that begin
with the same mark are folded and aligned into a union-free regular expression, the wrapper: adjacent repeats
become repeated groups, marks that stand on one side only become optional groups, and what stands between marks is a
text slot. Folding and aligning are commutative and idempotent, so parts of the data are aligned where they lie and
only distinct wrappers travel. A grammar tells what may be a mark; whether it is one is for the wrappers: a mark of a
block counts if the wrapper of its host and first mark holds it well-formed, of a pair both halves in their order, and
wrappers over the whole collection hold it in at least two texts. A half whose partner stands in
other blocks only, or a sign that no other text repeats, is left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize

# Element names of HTML and of wiki extensions that count as tags.
TAGS = "a b i u s em strong small big sub sup p br hr div span font center h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption html head body title meta link img blockquote pre code tt kbd del ins style script syntaxhighlight source math ref nowiki gallery color size"
# Commands of LaTeX and of story scripts.
LATEX = "section subsection subsubsection chapter paragraph title textbf textit emph underline texttt footnote cite label documentclass usepackage begin end caption href url"
STORY = "name dialog Dialog Decision HEADER Blocker stopmusic stopMusic playMusic playSound Delay delay Image Background Character CameraShake Subtitle Sticker PlaySound StopSound Predicate Tutorial"

_TAG = "(?:" + "|".join(sorted(TAGS.split(), key=lambda t: (-len(t), t))) + ")"
_VOID = {"br", "hr", "img", "meta", "link"}

#: class -> pattern of one mark. A class that ends in < needs its partner that ends in >.
MARKS: list[tuple[str, str]] = [
    ("comment", r"<!--.*?-->"),
    ("doctype", r"<!DOCTYPE[^<>]*>"),
    ("tag", rf"</?{_TAG}(?:[\s=][^<>]*|/)?>"),
    ("entity", r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|(?:nbsp|lt|gt|amp|quot|apos|mdash|ndash|hellip|middot|copy|times|ensp|emsp|thinsp|ldquo|rdquo|lsquo|rsquo));"),
    ("md-fence", r"(?m:^```[^\n`]*$)"),
    ("md-code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("md-link", r"\[[^\[\]\n]*\]\([a-z]+://[^()\s]*\)"),
    ("wiki-category", r"\[\[(?:分类|Category|File|文件)[:：][^\[\]\n]*\]\]"),
    ("wiki-link", r"\[\[[^\[\]\n]+\]\]"),
    ("wiki-table<", r"(?m:^\{\|[^\n]*$)"),
    ("wiki-table>", r"(?m:^\|\}[ \t]*\r?$)"),
    ("wiki-row", r"(?m:^\|-[ \t]*\r?$)"),
    ("wiki-template<", r"\{\{(?=[^\s{}|][^{}|\n]*[|}])"),
    ("wiki-template>", r"\}\}"),
    ("wiki-heading", r"(?m:^={2,6}[^=\n]+={2,6}[ \t]*\r?$)"),
    ("wiki-quote", r"'{2,5}(?=[^'])"),
    ("latex-math", r"\$\$[^$]+?\$\$|(?<!\$)\$(?=[^$\n]*[\\_^{])[^$\n\u4e00-\u9fff]+\$(?!\$)|\\\([^\n]*?\\\)|\\\[(?!\]).*?\\\]"),
    ("latex-command", r"\\(?:" + "|".join(LATEX.split()) + r")\*?(?=[\[{])"),
    ("latex-item", r"(?m:^[ \t]*\\item\b)"),
    ("story-command", r"\[(?:" + "|".join(STORY.split()) + r")(?:\([^()\n]*\)|=[^\[\]\n]*)?\](?!\()"),
    ("story-name", r"\{@[A-Za-z]\w*\}"),
    ("md-heading", r"(?m:^#{1,6}[ \t]+(?=\S))"),
    ("md-rule", r"(?:(?<=\S\n)|(?<=\S\r\n))(?m:(?:-{3,}|={3,})[ \t]*\r?$)"),
    ("md-row", r"(?m:^\|(?![-}|])[^\n]*\|[ \t]*\r?$)"),
    ("md-cells", r"(?m:^\|(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*\r?$)"),
    ("md-bullet", r"(?m:^[ \t]*[-*+][ \t]+(?=\S))"),
    ("md-bold", r"\*\*(?=\S)[^*\n]+?\*\*"),
    ("md-strike", r"~~(?=\S)[^~\n]+?~~"),
    ("md-italic", r"(?<![A-Za-z0-9_])_(?![_\s])[^_\n]{1,80}?(?<!\s)_(?!_)|_(?=[^_\n]*[^\x00-\x7f])(?!\d)[^_\s][^_\n]{0,80}?_(?![_\d])"),
]
#: First characters of each class; a mark is looked for only where one of them stands.
_LEADS = {"comment": "<", "doctype": "<", "tag": "<", "entity": "&", "md-fence": "`", "md-code": "`", "md-link": "[", "wiki-category": "[", "wiki-link": "[", "wiki-table<": "{", "wiki-table>": "|", "wiki-row": "|", "wiki-template<": "{", "wiki-template>": "}", "wiki-heading": "=", "wiki-quote": "'", "latex-math": "$\\", "latex-command": "\\", "latex-item": "\\ \t", "story-command": "[", "story-name": "{", "md-heading": "#", "md-rule": "-=", "md-row": "|", "md-cells": "|", "md-bullet": "-*+ \t", "md-bold": "*", "md-strike": "~", "md-italic": "_"}
_NAMES = {f"m{k}": name for k, (name, _) in enumerate(MARKS)}
_AT = {c: re.compile("|".join(f"(?P<m{k}>{p})" for k, (name, p) in enumerate(MARKS) if c in _LEADS[name]), re.S) for c in "<&`[{|}='$\\ \t#-*+~_"}
_SPOT = re.compile(r"[<&`\[{'$\\~_]|\*\*|\}\}|^[=#+\-*|]|^[ \t]+(?=[-*+\\])", re.M)
#: Java pattern of texts that may hold a mark; others needn't leave the JVM.
TRIGGER = r"(?m)[<\[{`$|\\_&~='*]|^[ \t]*[-+#][ \t#]|^[-=]{3,}"


def marks(text: str) -> list[tuple[str, int, int]]:
    """(class, begin, end) of every mark in reading order."""
    out = []
    at = 0
    for spot in _SPOT.finditer(text):
        if spot.start() < at:
            continue
        m = _AT[text[spot.start()]].match(text, spot.start())
        if m is None:
            continue
        at = max(m.end(), at + 1)
        name = _NAMES[m.lastgroup]
        if name == "tag":
            raw = m.group()
            tag = re.match(r"</?([a-zA-Z0-9]+)", raw).group(1).lower()
            if tag in _VOID or raw.endswith("/>"):
                name = f"tag:{tag}"
            else:
                name = f"tag:{tag}>" if raw[1] == "/" else f"tag:{tag}<"
        elif name == "latex-command" and m.group().rstrip("*") in ("\\begin", "\\end"):
            env = re.match(r"\{([A-Za-z]+\*?)\}", text[m.end() : m.end() + 40])
            name = f"env:{env.group(1) if env else ''}" + ("<" if m.group().startswith("\\begin") else ">")
        out.append((name, m.start(), m.end()))
    return out


# ---- wrappers: a wrapper is a tuple of elements; an element is a mark, '#' (text slot), or ('+' or '?' or '*', wrapper)


def fold(tokens: list) -> tuple:
    """Collapse adjacent repeats of up to four elements into repeated groups, until nothing changes."""
    seq = list(tokens)
    changed = True
    while changed:
        changed = False
        for width in (1, 2, 3, 4):
            i = 0
            while i + 2 * width <= len(seq):
                unit = seq[i : i + width]
                n = 1
                while seq[i + n * width : i + (n + 1) * width] == unit:
                    n += 1
                if n > 1 and unit != ["#"]:
                    group = unit[0] if width == 1 and isinstance(unit[0], tuple) else ("+", tuple(unit))
                    seq[i : i + n * width] = [group]
                    changed = True
                elif n > 1:
                    seq[i : i + n] = ["#"]
                    changed = True
                i += 1
    return tuple(seq)


def _inner(e: object) -> object:
    return e[1] if isinstance(e, tuple) else (e,)


def align(a: tuple, b: tuple) -> tuple:
    """The least union-free expression found for both wrappers: what both have stays, the rest becomes optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    same = lambda x, y: _inner(x) == _inner(y)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    only: set = set()

    def flush() -> None:
        out.extend(sorted(only, key=repr))
        only.clear()

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and same(a[i], b[j]):
            flush()
            kinds = {e[0] for e in (a[i], b[j]) if isinstance(e, tuple)}
            kind = "*" if "*" in kinds or {"+", "?"} <= kinds else "?" if "?" in kinds else "+" if "+" in kinds else ""
            out.append((kind, _inner(a[i])) if kind else a[i])
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            only.add(_optional(a[i]))
            i += 1
        else:
            only.add(_optional(b[j]))
            j += 1
    flush()
    # optional groups side by side in any order are kept once
    tidy: list = []
    for e in out:
        if isinstance(e, tuple) and e[0] in "?*":
            again = next((k for k in range(len(tidy) - 1, -1, -1) if isinstance(tidy[k], tuple) and tidy[k][0] in "?*" and tidy[k][1] == e[1]), None)
            if again is not None:
                tidy[again] = ("*", e[1])
                continue
        tidy.append(e)
    return tuple(tidy)


def _optional(e: object) -> tuple:
    if isinstance(e, tuple):
        return ("*" if e[0] in "+*" else "?", e[1])
    return ("?", (e,))


def show(w: tuple) -> str:
    return " ".join(e if isinstance(e, str) else f"({show(e[1])}){e[0]}" for e in w)


def parse(s: str) -> tuple:
    """The wrapper that show() wrote."""
    stack: list[list] = [[]]
    for t in re.findall(r"\)[+?*]|\(|[^\s()]+", s):
        if t == "(":
            stack.append([])
        elif t[0] == ")":
            group = (t[1], tuple(stack.pop()))
            stack[-1].append(group)
        else:
            stack[-1].append(t)
    return tuple(stack[0])


def blocks(text: str, found: list[tuple[str, int, int]]) -> set[tuple[str, str]]:
    """(key, folded stream) of every line that holds marks; the key is the first mark. Pairs open over lines run to their end."""
    out = set()
    stream: list[str] = []
    key, depth, at = "", 0, None
    for name, a, b in found:
        if at is not None and depth <= 0 and "\n" in text[at:a]:
            out.add((key, show(fold(stream))))
            stream, key, depth = [], "", 0
        if not stream:
            key = name
        elif at is not None and text[at:a].strip():
            stream.append("#")
        stream.append(name)
        depth += name.endswith("<") - name.endswith(">")
        at = b
    if stream:
        out.add((key, show(fold(stream))))
    return out


def confirmed(wrapper: str) -> list[str]:
    """Classes of marks that stand well-formed in a wrapper: void marks, and pairs of which a half that opens stands before one that closes."""
    order = re.findall(r"[^\s()#]+", re.sub(r"\)[+?*]", " ", wrapper))
    first = {t: i for i, t in reversed(list(enumerate(order)))}
    last = {t: i for i, t in enumerate(order)}
    pair = lambda t: first.get(t[:-1] + "<", len(order)) < last.get(t[:-1] + ">", -1)
    return sorted(t for t in first if (pair(t) if t[-1] in "<>" else True))


# ---- the operator


def texts_of(operator_data: DataFrame, story_lines: DataFrame, documents: DataFrame) -> DataFrame:
    """src, row_key, host, text of the three tables; rows stored twice once."""
    o = operator_data.select(F.lit("operator_data").alias("src"), F.col("rec_id").alias("row_key"), F.concat_ws(":", F.lit("operator_data"), "kind").alias("host"), "text")
    s = story_lines.select(F.lit("story_lines").alias("src"), F.col("row_id").alias("row_key"), F.lit("story_lines").alias("host"), "text")
    d = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_key"), F.concat_ws(":", F.lit("documents"), "source").alias("host"), "text")
    return o.unionByName(s).unionByName(d)


def mark_streams(texts: DataFrame) -> DataFrame:
    """src, row_key, host, blocks (mark: the first, stream, classes) of every text that may hold a mark."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for src, key, host, text in zip(b["src"], b["row_key"], b["host"], b["text"], strict=True):
                found = marks(text)
                if found:
                    rows.append((src, key, host, [{"mark": k, "stream": s, "classes": sorted(set(re.findall(r"[^\s()#]+", re.sub(r"\)[+?*]", " ", s))))} for k, s in sorted(blocks(text, found))]))
            yield pd.DataFrame(rows, columns=["src", "row_key", "host", "blocks"])

    return texts.filter(F.col("text").rlike(TRIGGER)).mapInPandas(read, "src string, row_key bigint, host string, blocks array<struct<mark:string,stream:string,classes:array<string>>>")


#: Distinct streams that one task aligns at once, and how many partial wrappers the next level joins.
STREAMS, FAN = 500, 16


def infer_wrappers(streams: DataFrame) -> DataFrame:
    """host, mark (the first of the block), wrapper, n (blocks it was inferred from, equal ones of a text once).

    Streams are counted first, so equal ones are one row. Distinct ones are aligned in a tree of levels over salts, as
    many as their number asks for: no task takes all the streams of a host, however many it has.
    """
    counted = streams.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.mark").alias("mark"), F.col("b.stream").alias("wrapper")).agg(F.count(F.lit(1)).alias("n"))
    keyed = materialize(counted, "marks")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        w: tuple | None = None
        for s in sorted(rows["wrapper"], key=lambda s: (len(s), s)):
            p = parse(s)
            w = p if w is None else align(w, p)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "mark": [rows["mark"].iloc[0]], "wrapper": [show(fold(list(w)))], "n": [int(rows["n"].sum())]})

    shape = "host string, mark string, wrapper string, n bigint"
    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = keyed.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
    salts = -(-largest // STREAMS)
    while True:
        salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        # a stated number of partitions isn't merged into one task
        keyed = salted.repartition(parts, "host", "mark", "__salt").groupBy("host", "mark", "__salt").applyInPandas(merge, shape)
        if salts == 1:
            return keyed
        salts = -(-salts // FAN)


#: Texts that must hold a mark in a wrapper before it counts.
SUPPORT = 2


def wrapper_marks(wrappers: DataFrame, support: int = SUPPORT) -> DataFrame:
    """host, mark, marks: the classes that the wrapper of each host and first mark confirms.

    Of those a class counts whose wrappers have at least `support` blocks in all.
    """

    @F.pandas_udf("array<string>")
    def check(s: pd.Series) -> pd.Series:
        return s.map(confirmed)

    each = materialize(wrappers.select("host", "mark", "n", F.explode(check("wrapper")).alias("class")), "marks")
    held = each.groupBy("class").agg(F.sum("n").alias("held")).filter(F.col("held") >= support).select("class")
    return each.join(F.broadcast(held) if fits_broadcast(held, 20_000) else held, "class", "left_semi").groupBy("host", "mark").agg(F.collect_set("class").alias("marks"))


def _known(df: DataFrame, known: DataFrame, on: list[str], how: str) -> DataFrame:
    return df.join(F.broadcast(known) if fits_broadcast(known, 20_000) else known, on, how)


def residue(operator_data: DataFrame, story_lines: DataFrame, documents: DataFrame, support: int = SUPPORT) -> DataFrame:
    """src, row_key of every text of which a block holds a mark that its wrapper confirms.

    NULL and '' texts hold none; rows stored twice come once, though both count for the support.
    """
    streams = materialize(mark_streams(texts_of(operator_data, story_lines, documents)), "marks")
    known = materialize(wrapper_marks(infer_wrappers(streams), support), "marks")
    held = streams.select("src", "row_key", "host", F.explode("blocks").alias("b")).select("src", "row_key", "host", "b.mark", "b.classes")
    return _known(held, known, ["host", "mark"], "inner").filter(F.arrays_overlap("classes", "marks")).select("src", "row_key").distinct()


def clean_texts(operator_data: DataFrame, story_lines: DataFrame, documents: DataFrame, support: int = SUPPORT) -> DataFrame:
    """src, row_key, clean for every row of the three tables; texts without markup come out as they are, NULL as NULL.

    Only classes of marks that the wrappers of a host confirm are taken out of its texts.
    """
    texts = texts_of(operator_data, story_lines, documents)
    streams = materialize(mark_streams(texts), "marks")
    known = materialize(wrapper_marks(infer_wrappers(streams), support).groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks")), "marks")

    @F.pandas_udf("string")
    def tidy(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([clean_markup(x, frozenset(k) if k is not None else frozenset()) if x else x for x, k in zip(t, m, strict=True)])

    joined = _known(texts, known, ["host"], "left")
    return joined.select("src", "row_key", tidy("text", "marks").alias("clean"))


# ---- cleaning one text

_ALL = None


def clean_markup(text: str, allowed: frozenset[str] | None = _ALL) -> str:
    """Plain text with structure: '# ' headings, '- ' items, ' | ' cells, fenced code, $formulas$. allowed: the host's marks (None: all)."""
    if not any(allowed is None or m[0] in allowed for m in marks(text)):
        return text
    kept: list[str] = []

    def keep(s: str, block: bool) -> str:
        kept.append(s)
        mark = f"\x00{len(kept) - 1}\x00"
        return f"\n{mark}\n" if block else mark

    def code(m: re.Match) -> str:
        body = html.unescape(m.group("body")).strip("\r\n")
        return keep(f"```\n{body}\n```", True)

    def sub(kind: str, pattern: str, to: str | Callable[[re.Match], str], flags: int = 0) -> None:
        nonlocal text
        if allowed is None or any(k.startswith(kind) for k in allowed):
            text = re.sub(pattern, to, text, flags=flags)

    sub("md-fence", r"^```[^\n`]*\r?\n(?P<body>.*?)^```[ \t]*\r?$", code, re.S | re.M)
    sub("tag:pre", r"<pre[^<>]*>\s*(?:<code[^<>]*>)?(?P<body>.*?)(?:</code>)?\s*</pre>", code, re.S)
    sub("tag:syntaxhighlight", r"<syntaxhighlight[^<>]*>(?P<body>.*?)</syntaxhighlight>", code, re.S)
    sub("env:verbatim", r"\\begin\{verbatim\}(?P<body>.*?)\\end\{verbatim\}", code, re.S)
    inline = lambda m: keep(f"${m.group(1).strip()}$", False)
    sub("env:equation", r"\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}", inline, re.S)
    sub("tag:math", r"<math[^<>]*>(.*?)</math>", inline, re.S)
    sub("tag:span", r'<span class="math">\s*\\\((.*?)\\\)\s*</span>', inline, re.S)
    sub("latex-math", r"\$\$([^$]+?)\$\$", inline, re.S)
    sub("latex-math", r"\\\(([^\n]*?)\\\)", inline)
    sub("latex-math", r"(?<!\$)\$(?=[^$\n]*[\\_^{])([^$\n\u4e00-\u9fff]+)\$(?!\$)", inline)
    sub("comment", r"<!--.*?-->", "", re.S)
    sub("doctype", r"<!DOCTYPE[^<>]*>", "")
    sub("tag:", r"<(style|script|head|title)\b[^<>]*>.*?</\1>", "", re.S)
    sub("tag:ref", r"<ref\b[^<>/]*>.*?</ref>|<ref\b[^<>]*/>", "", re.S)
    sub("latex-command", r"\\(?:footnote|label|cite|documentclass|usepackage)(?:\[[^\[\]]*\])?\{[^{}]*\}", "")
    sub("story-command", dict(MARKS)["story-command"], "")
    sub("story-name", r"\{@[A-Za-z]\w*\}", "")
    sub("wiki-category", r"\[\[(?:分类|Category|File|文件)[:：][^\[\]\n]*\]\]", "")
    sub("wiki-link", r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1")
    sub("md-link", r"\[([^\[\]\n]*)\]\([a-z]+://[^()\s]*\)", r"\1")
    sub("wiki-template", r"\{\{DrName\|?\}\}", "")
    sub("wiki-template", r"\{\{VoiceData/word\|[^|{}]*\|([^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*)\}\}(?:\|[^\n{}]*(?:\}\})?)?", r"\1")
    for _ in range(4):
        sub("wiki-template", r"\{\{color\|[^|{}]*\|([^{}]*)\}\}", r"\1")
        sub("wiki-template", r"\{\{[^{}|\n]+(?:\|[^{}]*)?\}\}", "")
    # tables
    sub("wiki-table", r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[ \t]*\r?\n", "", re.M)
    sub("wiki-table", r"^[|!][ \t]*([^\n|!].*?(?:\|\||!!).*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", m.group(1)), re.M)
    sub("md-cells", r"^\|(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*\r?\n?", "", re.M)
    sub("md-row", r"^\|[ \t]*(?![-}|])([^\n]*?)[ \t]*\|[ \t]*\r?$", lambda m: re.sub(r"[ \t]*\|[ \t]*", " | ", m.group(1)), re.M)
    sub("env:tabular", r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in m.group(1).split("\\\\") if r.strip()), re.S)
    sub("tag:td", r"</t[dh]>\s*<t[dh][^<>]*>", " | ")
    sub("tag:tr", r"<tr[^<>]*>|</tr>", "\n")
    # headings and lists
    sub("tag:h", r"\s*<h([1-6])[^<>]*>(.*?)</h\1>\s*", lambda m: f"\n\n{'#' * int(m.group(1))} {m.group(2).strip()}\n\n", re.S)
    sub("wiki-heading", r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*\r?$", lambda m: f"{'#' * len(m.group(1))} {m.group(2)}", re.M)
    sub("latex-command", r"\\(sub)*section\*?\{([^{}]*)\}", lambda m: f"{'###' if m.group(1) else '##'} {m.group(2)}")
    sub("md-rule", r"^([^\n]*\S)[ \t]*\r?\n(?:-{3,}|={3,})[ \t]*\r?$", r"## \1", re.M)
    sub("tag:li", r"\s*<li[^<>]*>\s*", "\n- ")
    sub("latex-item", r"^[ \t]*\\item\b[ \t]*", "- ", re.M)
    sub("md-bullet", r"^[ \t]*[-*+][ \t]+(?=\S)", "- ", re.M)
    # inline marks
    for _ in range(3):
        sub("latex-command", r"\\(?:textbf|textit|emph|underline|texttt|caption|title|paragraph)\*?\{([^{}]*)\}", r"\1")
    sub("env:", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}]*\})?\r?\n?", "")
    sub("wiki-quote", r"'{2,5}", "")
    sub("md-bold", r"\*\*(?=\S)([^*\n]+?)\*\*", r"\1")
    sub("md-strike", r"~~(?=\S)([^~\n]+?)~~", r"\1")
    sub("md-code", r"(?<!`)`([^`\n]+)`(?!`)", r"\1")
    sub("md-italic", dict(MARKS)["md-italic"], lambda m: m.group().strip("_"))
    sub("tag:br", r"<br\s*/?>\s*", "\n")
    sub("tag:", r"\s*</?(?:p|div|ul|ol|table|blockquote|html|body)(?:\s[^<>]*)?>\s*", "\n")
    sub("tag:", rf"</?{_TAG}(?:[\s=][^<>]*|/)?>", "")
    sub("entity", dict(MARKS)["entity"], lambda m: html.unescape(m.group()).replace("\xa0", " "))
    text = re.sub(r"(?:[ \t]*\r?\n){3,}", "\n\n", text)
    text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], text)
    return text.strip("\r\n")
