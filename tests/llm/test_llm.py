"""Text operators against brute force, round trips and edge cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from murmur.llm import contamination, lookalike, markup, names, packing, splitting, termcounts
from murmur.llm.tokens import tokenizer

ACTS = "line_uid bigint, phase string, situation_type string, speech_acts array<struct<type:string,label:string,confidence:double>>"


def test_ngrams_against_brute_force(spark):
    rnd = random.Random(3)
    recs = [(i, [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]) for i in range(200)] + [(-1, None)]
    df = spark.createDataFrame(recs, "i bigint, terms array<string>").withColumn("g", F.lit("x"))
    occ, rec = Counter(), defaultdict(set)
    for i, t in recs:
        for n in (1, 2, 3):
            for k in range(len(t or []) - n + 1):
                occ[tuple(t[k : k + n])] += 1
                rec[tuple(t[k : k + n])].add(i)
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in termcounts.ngram_counts(df, "g", "terms", 3).collect()}
    assert got == {g: (n, len(rec[g])) for g, n in occ.items()}
    every = {(r["gram"][0], len(r["gram"])) for r in termcounts.ngram_counts(df, "g", "terms").collect()}
    assert {n for _, n in every} == {1, 2, 3, 4, 5, 6} and termcounts.ngram_counts(df.limit(0), "g", "terms").count() == 0


def test_term_counts_edges(spark):
    a = [("x", None, 0.5)]
    rows = [(1, "p", "", a * 3), (1, "p", "", a * 3), (2, None, "s", []), (None, "p", "s", None), (None, "p", "s", [("", "l", 1.0), None])]
    df = spark.createDataFrame(rows, ACTS).withColumn("mark", F.lit(1)).withColumn("ingested_at", F.current_timestamp())
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["lines"], r["mark"]) for r in termcounts.term_counts(df).collect()}
    assert got == {("phase", "p"): (3, 3, "rare"), ("situation_type", "s"): (3, 3, "rare"), ("speech_acts", "x"): (3, 1, "rare")}
    assert termcounts.term_counts(df.limit(0)).count() == 0


def test_suffix_automaton_finds_leaks(spark):
    item = "双方出于谨慎争执57日，终致引来更多船只。Céleste 号的炮手随后把77件缆绳带上甲板。试问铁匣在哪里，而节省一半煤由谁批准？"
    half = item[5:45].replace("缆", "览")
    docs = [(1, "开头。" + item + "结尾"), (2, "<p>" + half[:12] + "<em>" + half[12:] + "</em></p>"), (3, item[:14]), (4, None), (5, ""), (6, "无关" * 5000), (1, "开头。" + item + "结尾")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "!!")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contamination.leaked_passages(df, items).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7]["covered"] == 1.0
    assert docs[0][1][got[1, 7]["start"] : got[1, 7]["stop"]] == item[:-1]
    clean = {r["doc_id"]: r["text"] for r in contamination.decontaminate(df, items).collect()}
    assert clean[1] == "开头。？结尾" and clean[3] == item[:14] and clean[4] is None
    assert contamination.leaked_passages(df.limit(0), items).count() == 0
    assert contamination.leaked_passages(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_leaks_with_slips_are_all_found(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(45)) for i in range(12)] + [(12, "".join(chr(0x4E00 + rnd.randrange(300)) for _ in range(90)))]
    finder = contamination.Finder(items)
    leaked = 0
    for _ in range(60):
        i, s = rnd.choice(items)
        a = rnd.randrange(len(s) // 3)
        part = "".join(rnd.choice("xyzq") if rnd.random() < 0.07 else c for c in s[a : a + 2 * len(s) // 3])
        doc = text(30) + " " + part + " " + text(30)
        t = contamination.letters(doc)
        want = {finder.ids[n] for n in range(len(items)) if finder.coverage(t, n, [(0, len(t))])[0] >= contamination.SHARE}
        leaked += i in want
        assert {x[0] for x in finder.leaks(doc)} == want
    assert leaked > 10


@pytest.mark.parametrize("every", [10, 15, 20, 25])
def test_leaks_with_one_wrong_letter_in_every_few(every):
    rnd = random.Random(every)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(45))) for i in range(30)]
    finder = contamination.Finder(items)
    slipped = lambda s: "".join("q" if k % every == every - 1 else c for k, c in enumerate(contamination.letters(s)))
    found = sum(i in {x[0] for x in finder.leaks(f"{word()} {slipped(s)} {word()}")} for i, s in items)
    assert found >= 0.9 * len(items)


def test_every_passage_of_an_item_goes(spark):
    item, short = "The lantern keeper counts ninety-four crates before the fog lifts.", "灰港"
    text = f"First. {item} Middle. {item.upper()} End of it, near 灰港."
    docs = spark.createDataFrame([(1, text), (1, text), (2, "灰 海")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item), (6, short)], "item_id bigint, text string")
    got = contamination.leaked_passages(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 5), (1, 5), (1, 6)]
    assert sorted(tuple(r) for r in contamination.leaked_items(docs, items).collect()) == [(1, 5), (1, 6)]
    clean = {r["doc_id"]: r for r in contamination.decontaminate(docs, items).collect()}
    assert "lantern" not in clean[1]["text"].lower() and clean[1]["n_leaks"] == 3 and clean[2]["text"] == "灰 海"
    rest = contamination.decontaminate(docs, items).select("doc_id", "text")
    assert contamination.leaked_passages(rest, items).isEmpty()


def test_suffix_automaton_occurrences():
    sam = contamination.SuffixAutomaton(["abcbc", "bcb"])
    v = 0
    for c in "bc":
        v = sam.next[v][c]
    assert sorted(sam.occurrences(v, 2)) == [(0, 3), (0, 5), (1, 2)]


def fewest(sizes, cap):
    """Least number of containers by dynamic programming over sets of items."""
    best = [(0, 0)] + [(len(sizes) + 1, 0)] * (2 ** len(sizes) - 1)
    for m in range(1, 2 ** len(sizes)):
        for i, s in enumerate(sizes):
            if m >> i & 1:
                n, used = best[m & ~(1 << i)]
                best[m] = min(best[m], (n + (n == 0 or used + s > cap), s if n == 0 or used + s > cap else used + s))
    return best[-1][0]


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_finds_the_optimum(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([20, 30, 97])
    sizes = [rnd.randint(0 if seed % 3 else cap // 6, cap // 2) for _ in range(rnd.randint(6, 11))]
    bins = packing.bin_completion(sizes, cap, None, None)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= cap for b in bins)
    assert len(bins) == max(1, fewest([s for s in sizes if s], cap))


@pytest.mark.parametrize("seed", range(8))
def test_completions_are_all_undominated(seed):
    rnd = random.Random(seed)
    avail = sorted((rnd.randint(1, 12) for _ in range(8)), reverse=True)
    got, _, whole = packing.completions(avail, 17)
    every = {tuple(sorted((avail[i] for i in range(8) if m >> i & 1), reverse=True)) for m in range(256)}
    every = {x for x in every if sum(x) <= 17}

    def dominated(x):
        left = Counter(avail) - Counter(x)
        return any(s <= 17 - sum(x) for s in left) or any(t > s and t - s <= 17 - sum(x) for s in x for t in left)

    assert whole and set(got) == {x for x in every if not dominated(x)} and [sum(x) for x in got] == sorted(map(sum, got), reverse=True)


def test_pack_keeps_everything(spark):
    rows = [(i, (i * 37) % 120) for i in range(300)] + [(300, 5000), (301, 100), (302, 0), (303, None), (1, 37), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("used", F.lit("clash"))
    got = packing.pack(df, 100, block_items=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r["container_id"]].append(r)
    assert all(sum(r["n_tokens"] for r in b) <= 100 and sum(r["n_tokens"] for r in b) == b[0]["used"] for b in by.values())
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in rows)
    assert all(r["n_pieces"] == 1 for r in got if r["doc_id"] == 301) and sorted(r["piece"] for r in got if r["doc_id"] == 300) == list(range(50))
    assert len(by) <= 1.03 * -(-sum(n or 0 for _, n in rows) // 100) + 1
    assert packing.pack(df.limit(0), 100).count() == 0


TEXTS = ["", "短。", "字。" * 2000, "a" * 9000, "雾" * 3000, "word " * 4000, "\n\n \r\n" * 900, "# 一\n" + "句子很长，没有尽头。" * 400 + "\n\n## 二\n" + "The end is near. " * 800, "😀" * 900]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_tile_the_text(text):
    t = tokenizer()
    pieces = splitting.split_offsets(text, t, 256, 16)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for k, (a, b, shared, _, n) in enumerate(pieces):
        assert n == t.count(text[a:b]) <= 256
        if k:
            assert a + shared == pieces[k - 1][1] and shared > 0
    assert t.count(text) == len(t.enc.encode_ordinary(text))


def chain_cost(text, pieces, tok, own):
    """Cost of a list of pieces as the splitter states it, and the tokens each adds."""
    offs, toks, _ = tok.borders(text)
    ends = [dict(zip(offs, toks, strict=True))[p[1]] for p in pieces]
    added = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    share = ends[-1] / max(1, -(-ends[-1] // own))
    return sum(1 + splitting.BALANCE * (k / share - 1) ** 2 + splitting.PENALTY.get(p[3], 0.0) for k, p in zip(added, pieces, strict=True)), added


def test_pieces_end_at_sections():
    t = tokenizer()
    section = "# head\n" + "the sea is calm and the ship goes on. " * 110 + "\n"
    pieces = splitting.split_offsets(section * 10, t)
    assert [p[3] for p in pieces] == ["section"] * 9 + ["end"]


@pytest.mark.parametrize("seed", range(4))
def test_split_is_cheapest(seed):
    rnd, t = random.Random(seed), tokenizer()
    text = "".join(rnd.choice(["word "] * rnd.choice([4, 20]) + ["stop. ", "half, ", "\n", "\n\n", "\n# top\n"]) for _ in range(900)) + "end"
    limit, overlap = 200, 8
    own = limit - 2 * overlap - 10
    offs, toks, _ = t.borders(text)
    kind = ["none"] * len(offs)
    for name, pattern in (("space", splitting._SPACE), ("clause", splitting._CLAUSE), ("sentence", splitting._SENTENCE), ("line", splitting._LINE), ("paragraph", splitting._PARAGRAPH), ("section", splitting._HEADING)):
        for x in splitting.boundaries(text, name, pattern).tolist():
            kind[next(k for k, o in enumerate(offs) if o >= x)] = name
    pos, pen = [0, *toks], [0.0, *[splitting.PENALTY[k] for k in kind[:-1]], 0.0]
    share = toks[-1] / -(-toks[-1] // own)
    best = [0.0]
    for j in range(1, len(pos)):
        best.append(min((best[i] + 1 + splitting.BALANCE * ((pos[j] - pos[i]) / share - 1) ** 2 + pen[j] for i in range(j) if pos[j] - pos[i] <= own), default=float("inf")))
    cost, added = chain_cost(text, splitting.split_offsets(text, t, limit, overlap), t, own)
    assert max(added) <= own and cost == pytest.approx(best[-1])


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "好" * 4000), (4, "小")], "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    assert [r["doc_id"] for r in splitting.oversized(df).collect()] == [3]
    every = splitting.split_documents(df, oversized_only=False).filter("n_pieces = 1").collect()
    assert [(r["doc_id"], r["text"]) for r in every] == [(4, "小")]


def test_lookalikes(spark):
    same = ["Céleste 号 5", "Сéleste 号 5", "Ce\u0301le\u200bste\u00a0号 ５", "Céleste\u2005号\u00ad 5"]
    rows = [(i, s) for i, s in enumerate(same)] + [(9, "céleste 号 5"), (10, "Céleste 号 ⑤"), (11, None), (12, ""), (13, same[0]), (13, same[0])]
    lines = spark.createDataFrame(rows, "line_uid bigint, text string").withColumn("src", F.lit(1))
    data = spark.createDataFrame([(1, "⼈口"), (2, "人口")], "rec_id bigint, text string")
    rec = lookalike.canonical_records(lines, data)
    canon = {(r["src"], r["id"]): r["canonical"] for r in rec.collect()}
    assert len({canon["annotated_lines", i] for i in range(4)}) == 1 and canon["annotated_lines", 9] == "céleste 号 5" and canon["annotated_lines", 11] is None
    got = [tuple(r) for r in lookalike.lookalike_pairs(rec).collect()]
    text = {("annotated_lines", i): s for i, s in rows} | {("operator_data", 1): "⼈口", ("operator_data", 2): "人口"}
    want = {(*a, *b) for a in text for b in text if a < b and text[a] and text[b] and text[a] != text[b] and canon[a] == canon[b]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 10
    assert lookalike.lookalike_pairs(rec.limit(0)).count() == 0


def test_looks_with_many_marks_and_odd_chains():
    heap = "e" + "\u0301" * 5
    texts = ["é" + "\u0301" * 4, heap, "е" + "\u0301" * 5, "e\u200b" + "\u0301" * 5, "e\u0301", "é", "a\u0328\u0301", "ą\u0301"]
    counts = Counter(c for t in texts for c in t)
    counts.update(m for t in texts for m in lookalike._marked().findall(t) if not lookalike.overlong(m))
    r = lookalike.Rewriter(lookalike.classes(counts))
    assert len({r(t) for t in texts[:4]}) == 1 and r(texts[4]) == r(texts[5]) and r(texts[6]) == r(texts[7]) and r(r(heap)) == r(heap)
    assert max(len(k) for k in lookalike.classes(counts)) <= 3
    # more invisible characters in a row than any fixed number of passes would take
    assert r("e" + "\u200b" * 40 + "\u0301") == r("é")


CASES = [
    ("== 港口 ==\n'''船'''来了<ref>注</ref>。\n[[分类:港]]", "## 港口\n船来了。"),
    ("<h2>港</h2>\n<ul><li>甲</li><li>乙</li></ul><table><tr><td>a</td><td>1</td></tr></table>", "## 港\n- 甲\n- 乙\n\na | 1"),
    ("```\nx < 1\n```", "```\nx < 1\n```"),
    ("<pre><code>x &lt; 1</code></pre>", "```\nx < 1\n```"),
    ("\\section{港}\n\\begin{itemize}\n\\item 甲\n\\end{itemize}\n$$v = \\frac{1}{t}$$", "## 港\n- 甲\n$v = \\frac{1}{t}$"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"),
    ("我~~说~~[不出](https://wiki.example/p/1)话。[playMusic(key=\"x\")]{@nickname}", "我说不出话。"),
]


@pytest.mark.parametrize("raw,clean", CASES)
def test_clean_markup(raw, clean):
    assert markup.clean_markup(raw) == clean


@pytest.mark.parametrize("text", ["温度在3 < 5这一档", "去#63泊位", "代号K_59的图，代号K_60", "20%~30%", "97 & 77", "$7 和 $50", "C:\\fog\\log6", "骂了句***，走", "dock_id_15 与 2|3", "<<志>>", "{待定} [95]", "", "v = d / t"])
def test_no_markup(text):
    assert markup.marks(text) == [] and markup.clean_markup(text) == text


def test_wrappers_align():
    a, b = markup.fold(["<p", "#", ">p", "<p", "#", ">p"]), markup.fold(["<p", "#", ">p", "br"])
    assert markup.show(a) == "(<p # >p)+" and markup.parse(markup.show(a)) == a
    w = markup.align(("a", "#", "c"), ("a", "b", "#", "c"))
    assert markup.show(w) == "a (b)? # c" and markup.align(w, ("a", "#", "c")) == w
    assert markup.confirmed("tag:p< # tag:p> br") == ["br", "tag:p<", "tag:p>"] and markup.confirmed("tag:b< #") == [] and markup.confirmed("tag:b> # tag:b<") == []


def test_wrappers_decide_which_signs_count(spark):
    o, d = spark.createDataFrame([], "rec_id bigint, kind string, text string"), spark.createDataFrame([], "doc_id bigint, source string, text string")
    s = lambda *texts: spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "row_id bigint, text string")
    found = lambda *texts: sorted(r["row_key"] for r in markup.residue(o, s(*texts), d).collect())
    # halves that stand alone are no markup, though both occur on the host
    assert found("{{a|b}} 好", "{{c|d}}", "左}}右", "<p>好</p>", "<p>好</p>", "好</p>") == [0, 1, 3, 4]
    # a sign counts once other texts of the collection repeat it
    assert found("他说_好_了", "没有") == [] and found("他说_好_了", "又说_不_好") == [0, 1]
    clean = {r["row_key"]: r["clean"] for r in markup.clean_texts(o, s("他说_好_了", "<b>好</b>", "<b>不</b>"), d).collect()}
    assert clean == {0: "他说_好_了", 1: "好", 2: "不"}


@pytest.mark.parametrize("salts", [1, 3, 40])
def test_wrappers_do_not_depend_on_the_salts(spark, monkeypatch, salts):
    rows = [(1, "h", f"<p>{'<b>x</b>' * (i % 4)}{'<br>' * (i % 3)}</p>") for i in range(40)]
    texts = spark.createDataFrame(rows, "row_key bigint, host string, text string").withColumn("src", F.lit("s"))
    monkeypatch.setattr(markup, "STREAMS", max(1, 12 // salts))
    monkeypatch.setattr(markup, "FAN", 2)
    w = markup.infer_wrappers(markup.mark_streams(texts)).collect()
    assert sum(r["n"] for r in w) == 40 and {c for r in w for c in markup.confirmed(r["wrapper"])} == {"tag:p<", "tag:p>", "tag:b<", "tag:b>", "tag:br"}


def test_residue_edges(spark):
    o = spark.createDataFrame([(1, "voice", "<p>好</p>"), (1, "voice", "<p>好</p>"), (2, None, None), (3, "voice", "")], "rec_id bigint, kind string, text string")
    s = spark.createDataFrame([(1, "3 < 5"), (2, "**好**"), (3, "**坏**")], "row_id bigint, text string")
    d = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert sorted(tuple(r) for r in markup.residue(o, s, d).collect()) == [("operator_data", 1), ("story_lines", 2), ("story_lines", 3)]
    assert {(r["src"], r["row_key"], r["clean"]) for r in markup.clean_texts(o, s, d).collect()} == {("operator_data", 1, "好"), ("operator_data", 2, None), ("operator_data", 3, ""), ("story_lines", 1, "3 < 5"), ("story_lines", 2, "好"), ("story_lines", 3, "坏")}


def test_names(spark):
    ops = spark.createDataFrame([("戈莫·维巴", "Gomo Veba"), ("维戈·莫巴", "Vego Moba"), ("巴莫·戈维", "Bamo Gove"), ("莫维·巴戈", "Move Bago")], "name_zh string, name_en string")
    al = spark.createDataFrame([("小戈", "戈莫·维巴")], "alias string, canonical string")
    story = spark.createDataFrame([(x,) for x in ["戈莫·维巴", "戈莫・维巴", "GOMO VEBA", "Veba, Gomo", "G. Veba", "小戈", "维戈·莫巴", "旁白", "？？？", None, "", "士兵甲", "士兵乙"]], "speaker string")
    lines = spark.createDataFrame([("Vego Moba",), ("维戈·莫巴",)], "interlocutor string")
    got = {tuple(r) for r in names.name_pairs(names.name_groups(story, lines, ops, al)).collect()}
    one = ["戈莫·维巴", "戈莫・维巴", "GOMO VEBA", "Veba, Gomo", "G. Veba", "小戈"]
    want = {tuple(sorted((a, b))) for a in one for b in one if a != b} | {("Vego Moba", "维戈·莫巴")}
    assert got == want
    assert names.name_groups(story.limit(0), lines.limit(0), ops.limit(0), al.limit(0)).count() == 0


def test_names_with_a_slip_link_among_many(spark):
    abc = "hijklmnopqrstuvwyzd"
    crowd = ["abc" + abc[i] + abc[j] + abc[(i + 2 * j) % 19] + "efg" for i in range(19) for j in range(19) if i != j and j != (i + 2 * j) % 19]
    story = spark.createDataFrame([(x,) for x in [*crowd, "abcdefg", "abcxefg", "abcefxy", "abcfexy"]], "speaker string")
    none = spark.createDataFrame([], "interlocutor string, name_zh string, name_en string, alias string, canonical string")
    got = {tuple(r) for r in names.name_pairs(names.name_groups(story, none, none, none)).collect()}
    assert got == {("abcdefg", "abcxefg"), ("abcefxy", "abcfexy")}


def test_transliteration_is_learned_from_a_sample_by_hash(spark):
    ops = spark.createDataFrame([(f"{chr(0x4E00 + i)}戈", f"Go {i}") for i in range(300)], "name_zh string, name_en string")
    assert len(names._fit(ops, 1000)) == 300
    some = names._fit(ops, 50)
    assert some == names._fit(ops.orderBy(F.desc("name_en")), 50) and some != sorted(tuple(r) for r in ops.collect())[:50]


def test_views_and_checks():
    v = lambda n, **k: names.views(n, k.get("observed", True), k.get("label"), k.get("famed", False), {"戈": "go", "莫": "mo", "维": "ve", "巴": "ba"}, ["小"], ["姐"])
    assert ("ci", "戈 维巴", "t") in v("戈莫·维巴") and ("ri", "g veba", "t") in v("戈莫·维巴") and ("r", "gomo veba", "t") in v("戈莫·维巴")
    assert v("G. Veba") == [("ri", "g veba", "q")] and v("G·维巴") == [("ci", "g 维巴", "q")]
    assert ("sc-", "莫", "q") in v("莫姐") and ("sc-", "莫", "q") in v("莫莫") and ("sc", "戈莫", "t") in v("戈莫·维巴", label="戈莫·维巴", famed=True)
    assert names.counted_stem("士兵甲") == ("士兵", "甲") and names.counted_stem("guard 3") == ("guard", "3") and names.counted_stem("戈莫") is None and v("...") == []
    assert names.learn_address([("老枭", "赤枭·无"), ("薇洛那", "薇洛娜·绥"), ("阿苏", "罗苏恩·里"), ("坦嬷", "布朗坦·钨")], ([], [])) == (["阿"], ["嬷"])


def test_one_edit_against_brute_force():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(80)]
    for a in words:
        near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert all(names.one_edit(a, b) == (b in near) for b in words)


def test_names_edges(spark):
    long_ = "长" * 9000
    ops = spark.createDataFrame([(None, "Solo"), ("甲乙丙·丁戊己", None), (f"{long_}·尾巴", ""), ("", ""), ("甲乙丙·丁戊己", "Jia Ding")], "name_zh string, name_en string").withColumn("id", F.lit(1)).withColumn("label", F.lit("x"))
    al = spark.createDataFrame([(None, "甲乙丙·丁戊己"), ("小乙", None), ("长长", f"{long_}·尾巴"), ("阿丙", "甲乙丙·丁戊己")], "alias string, canonical string").withColumn("kind", F.lit(1))
    story = spark.createDataFrame([(x,) for x in [long_, long_ + "长", f"{long_}·尾巴", "阿丙", "甲乙丙", "···", " ", "a" * 5000, "💥", "船员A", "船员B", "船员", "甲乙丙·丁戊己", "甲乙丙·丁戊己", None]], "speaker string").withColumn("name", F.lit("clash"))
    lines = spark.createDataFrame([("甲乙丙",), (None,)], "interlocutor string").withColumn("entity", F.lit(3))
    groups = names.name_groups(story, lines, ops, al)
    got = {r["name"]: r["entity"] for r in groups.collect()}
    assert len({got[x] for x in ("阿丙", "甲乙丙", "甲乙丙·丁戊己")}) == 1 and got[long_] == got[long_ + "长"]
    assert not {"···", " ", "船员A", "船员B", "💥"} & set(got) and groups.count() == len(got)


def test_average_linkage_decides(spark):
    # of two spellings of one rarely seen name, the nearer goes to the known name and the far one stays out by the average
    assert names.grow_groups(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.5}, {}, 0.3) == {"a": "a", "b": "a", "c": "c"}
    assert names.grow_groups(["k", "b", "c"], {("b", "k"): 0.9, ("c", "k"): 0.8}, {"k": "k"}, 0.3) == {"k": "k", "b": "k", "c": "k"}
    chain = [(f"n{i}", f"n{i + 1}", 0.9 - 0.1 * (i % 2)) for i in range(9)]
    edges, comp = names.bounded_components(spark.createDataFrame(chain, "a string, b string, sim double"), 4)
    assert comp.count() == 10 and comp.groupBy("component").count().agg(F.max("count")).first()[0] <= 4 and edges.count() == 5


def test_large_components_lose_no_link(spark):
    # p: six alike, one group that is larger than a task's share; q: a chain with equal steps; r: known names, a spelling of one, and spellings between them
    edges = {(f"p{i}", f"p{j}"): 0.5 for i in range(6) for j in range(i + 1, 6)} | {(f"q{i}", f"q{i + 1}"): 0.7 for i in range(9)}
    edges |= {("r0", "r1"): 1.0, ("r0", "r2"): 0.8, ("r0", "r3"): 0.75, ("r2", "r4"): 0.6, ("r3", "r5"): 0.45, ("r4", "r5"): 0.9, ("r5", "r6"): 1.0, ("r4", "r6"): 0.7, ("r0", "r6"): 0.95}
    labels = {"r0": "r0", "r1": "r0", "r6": "r6"}
    want = names.grow_groups(sorted({x for e in edges for x in e}), edges, labels)
    assert len({want[f"p{i}"] for i in range(6)}) == 1 and want["r2"] == "r0" and want["r5"] == "r6"
    df = spark.createDataFrame([(*e, s) for e, s in edges.items()], "a string, b string, sim double")
    inside, comp = names.bounded_components(df, 4, spark.createDataFrame(list(labels.items()), "id string, label string"))
    got, ids, sims = {}, defaultdict(list), defaultdict(dict)
    for r in comp.collect():
        if r["entity"] is None:
            ids[r["component"]].append(r["id"])
        else:
            got[r["id"]] = r["entity"]
    for r in inside.filter("not settled").collect():
        sims[r["component"]][r["a"], r["b"]] = r["sim"]
    for c, some in ids.items():
        assert len(some) <= 4
        got |= names.grow_groups(some, sims[c], {i: labels[i] for i in some if i in labels})
    assert got == want


def test_groups_do_not_depend_on_the_size_of_a_component(spark, monkeypatch):
    story = spark.createDataFrame([(x,) for x in ["stelmarovin", "stelmarovan", "stelmaroven", "stelmarovun"]], "speaker string")
    none = spark.createDataFrame([], "interlocutor string, name_zh string, name_en string, alias string, canonical string")
    pairs = lambda: {tuple(r) for r in names.name_pairs(names.name_groups(story, none, none, none)).collect()}
    want, whole = pairs(), names.bounded_components
    monkeypatch.setattr(names, "bounded_components", lambda edges, **k: whole(edges, 2, **k))
    assert len(want) == 6 and pairs() == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(45)], "a string, b string")
    assert {r["component"] for r in names.components(edges).collect()} == {"n00"}


def test_cosine_join_keeps_every_similar_form(spark):
    rnd = random.Random(5)
    texts = sorted({"stelmarovin" + "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 4))) for _ in range(80)})
    alike = spark.createDataFrame([(x, "r", x) for x in texts], "id string, kind string, text string")
    assert len(texts) > 60 and names.top_cosine(alike, alike, {"r": 0.001}).count() == len(texts) * (len(texts) - 1)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7])
def test_cosine_join_against_brute_force(spark, least):
    rnd = random.Random(8)
    texts = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 7))) for _ in range(70)})
    df = spark.createDataFrame([(x, "r", x) for x in texts], "id string, kind string, text string")
    bags = {x: Counter(names.grams("r", x)) for x in texts}
    seen = Counter(g for b in bags.values() for g in b)
    idf = {g: names.LONE_WEIGHT if n <= 1 else max(names.LONE_WEIGHT, min(names.MOST_WEIGHT, math.log((len(texts) + 1) / (n + 0.5)))) for g, n in seen.items()}
    vec = {x: {g: n * idf[g] for g, n in b.items()} for x, b in bags.items()}
    norm = {x: math.sqrt(sum(w * w for w in v.values())) for x, v in vec.items()}
    cos = {(x, y): sum(w * vec[y].get(g, 0) for g, w in vec[x].items()) / norm[x] / norm[y] for x in texts for y in texts if x != y}
    got = {(r["a"], r["b"]): r["cosine"] for r in names.top_cosine(df, df, {"r": least}).collect()}
    assert set(got) == {p for p, c in cos.items() if c >= least - 1e-9} and all(abs(cos[p] - c) < 1e-6 for p, c in got.items())


def test_average_linkage_keeps_known_names_apart():
    g = names.average_linkage(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.8}, {"a": "A", "c": "C"})
    assert g["a"] == g["b"] != g["c"]
