"""Core operators against brute force and small fixtures."""

import math
import random
import re

from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.operators import canon, catalog, fingerprint, hotkeys, hub, persona, phase, relations, speech, temporal, wiki

LINE = "line_uid bigint, text string, source string, phase string, interlocutor string, situation_type string, speech_acts array<struct<type:string,label:string,confidence:double>>, pos bigint"


def test_per_key_quantiles_match_sorting(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1e6), float(rnd.randint(0, 5)), 7.0])) for _ in range(3000)] + [("none", None), ("one", 3.5), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("field_name", F.lit("clash"))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["k"]: r for r in hotkeys.per_key_quantiles(df, ["k"], F.col("v"), probs, bins=8).collect()}
    for key in {k for k, _ in rows}:
        vals = sorted(v for k, v in rows if k == key and v is not None and v == v)
        assert got[key]["n_rows"] == sum(k == key for k, _ in rows)
        for i, p in enumerate(probs):
            want = vals[max(1, math.ceil(round(p * len(vals), 9))) - 1] if vals else None
            assert got[key][f"q{i}"] == want, (key, p)


def test_hot_keys_edges(spark):
    empty = spark.createDataFrame([], LINE)
    assert hotkeys.hot_keys(empty).count() == 0
    rows = [(i, None if i % 2 else "字" * 3000, "voice", "p", None if i < 5 else "", "x", None, i) for i in range(10)]
    df = spark.createDataFrame(rows, LINE).withColumn("key_value", F.lit(1)).withColumn("n_rows", F.lit(1))
    assert {tuple(r) for r in hotkeys.hot_keys(df).collect()} == {("interlocutor", "unknown"), ("situation_type", "x")}
    assert hotkeys.key_sentences(df).filter("field_name = 'situation_type'").first()["long"] == 5
    assert hotkeys.key_acts(df).count() == 0


def test_hot_keys_are_those_over_the_share(spark):
    rnd = random.Random(9)
    for share in (0.05, 0.3, 0.07):
        keys = [rnd.choice("abcdefghijklmnopqrstuvwxyz"[: rnd.randint(2, 26)]) for _ in range(400)] + ["big"] * 150 + [None, ""] * 20
        df = spark.createDataFrame([(k, k) for k in keys], "interlocutor string, situation_type string")
        n = {k: sum((x or "unknown") == (k or "unknown") for x in keys) for k in keys}
        want = {(f, k or "unknown") for f in ("interlocutor", "situation_type") for k in n if n[k] > share * len(keys)}
        assert {tuple(r) for r in hotkeys.hot_keys(df, share=share).collect()} == want
    even = spark.createDataFrame([(str(i % 20), "x") for i in range(200)], "interlocutor string, situation_type string")
    assert {tuple(r) for r in hotkeys.hot_keys(even).collect()} == {("situation_type", "x")}


def test_speech_acts(spark):
    texts = ["你愿意和我一起吗？", "也许吧…………", "我一定会保护你们。", "我在", None, ""]
    got = [[a["type"] for a in r["speech_acts"]] for r in speech.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()]
    for acts, want in zip(got, ["invite", "evade", "commit", "affirm_presence"], strict=False):
        assert want in acts
    assert got[4] == got[5] == []
    assert {k for k, _, _ in R.ACT_RULES} == set(R.ACT_LABELS)


def test_phase_cascade(spark):
    df = spark.createDataFrame([("魔王在卡兹戴尔归来", "a"), ("在巴别塔的时候......", "b"), ("你好。", "c"), (None, "c")], "text string, who string")
    got = {r["text"]: (r["phase"], r["phase_source"]) for r in phase.infer(df, "who").collect()}
    assert got["魔王在卡兹戴尔归来"] == ("babel", "content_pattern")
    assert got["在巴别塔的时候......"] == ("babel", "content_keyword")
    assert got["你好。"][0] == got[None][0] == "unknown"
    ch = spark.createDataFrame([("BB-ST-3 x", None, "babel"), ("第8章/x", None, "babel"), ("第14章/x", None, "resurrected"), ("DM-ST-1", None, "early"), ("unknown", "巴别塔会议室", "babel"), ("unknown", "卡兹戴尔街道", "babel")], "c string, s string, want string")
    assert ch.filter(phase.story_phase(F.col("c"), F.col("s")) != F.col("want")).count() == 0


def test_rules_keep_the_source_order(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    # a category of the first that the page names; a faction by the four that the source knows
    cats = lambda *c: one(phase.by_categories(F.array(*[F.lit(x) for x in c]) if c else F.lit(None).cast("array<string>")))
    assert cats("属于维多利亚的干员", "属于整合运动的干员")["phase"] == "resurrected" and cats("属于整合运动的干员")["phase"] == "early"
    assert cats("六星干员")["confidence"] == "low" and cats("地图") is None and cats() is None
    f = lambda x: one(phase.by_faction(F.lit(x)))
    assert f("维多利亚") is None and f("整合运动与罗德岛")["phase"] == "resurrected" and f("卡兹戴尔")["phase"] == "early"
    assert one(phase.by_chapter(F.lit("第10章")))["phase"] == "resurrected" and one(phase.by_activity_type(F.lit("主线"), F.lit("第8章")))["phase"] == "babel"
    assert one(phase.by_activity_type(F.lit("支线故事"), F.lit("切尔诺伯格的雪")))["phase"] == "early" and one(phase.by_activity_type(F.lit("纪念活动"), F.lit("伦蒂尼姆"))) is None
    assert [one(phase.activity_page(F.lit(x))) for x in ("DM-ST-1 求生/NBT", "XX-ST-2 长夜/NBT", "XX-3", "无")] == ["生于黑夜", "长夜", None, None]


def test_default_phase_order(spark):
    rec = spark.createDataFrame([("w", "W", "罗德岛"), ("a", "甲", "罗德岛"), ("b", "乙", None), ("c", "丙", ""), ("d", "丁", "罗德岛"), ("e", "戊", None)], "slug string, name_zh string, faction string")
    voices = spark.createDataFrame([("b", "巴别塔的内战"), ("b", None), ("a", "维多利亚")], "slug string, text string")
    cats = spark.createDataFrame([("d", ["属于炎国的干员"]), ("c", ["干员"]), ("e", None)], "slug string, categories array<string>")
    got = {r["slug"]: (r["phase"], r["source"], r["confidence"]) for r in phase.default_phase(rec, voices, cats).collect()}
    assert got == {"w": ("early", "default", "high"), "a": ("resurrected", "faction", "medium"), "b": ("babel", "cluster", "low"), "c": ("early", "category", "low"), "d": ("early", "category", "medium"), "e": ("unknown", "none", "low")}


DATA = "rec_id bigint, slug string, kind string, idx int, title string, text string"
STORY_LINE = "row_id bigint, story_id string, pos bigint, speaker string, text string, narration array<string>, scene string, is_target boolean, reply_to string, phase string"


def test_context_of_voice_story_and_archives(spark):
    rec = spark.createDataFrame([("w", "W", None)], "slug string, name_zh string, faction string")
    data = spark.createDataFrame([(1, "w", "voice", 0, "信赖触摸", "魔王在卡兹戴尔归来"), (2, "w", "voice", 1, "交谈", "你好"), (2, "w", "voice", 1, "交谈", "你好"), (3, "w", "voice", 2, "空", ""), (4, "w", "archive", 0, "档案", ""), (5, "w", "archive", 1, "档案", "履历"), (6, None, "voice", None, None, "x")], DATA)
    story = spark.createDataFrame([(1, "s", 1, "甲", "走", ["点头"], "港", True, "", "late"), (2, "s", 2, "乙", "不", None, None, False, None, None), (3, "a", 5, "甲", "进攻", None, None, True, "乙", None)], STORY_LINE)
    got = {(r["part"], r["line_id"]): r for r in hub.context(rec, data, story).collect()}
    assert set(got) == {("w", "V000"), ("w", "V001"), ("w", "A001"), (None, "V000"), ("a", "S000"), ("s", "S001")}
    assert (got["w", "V000"]["phase"], got["w", "V000"]["inference_source"], got["w", "V000"]["interlocutor"]) == ("babel", "content_pattern", "博士")
    assert (got["w", "V001"]["phase"], got["w", "V001"]["inference_source"]) == ("babel", "cluster")
    assert (got["s", "S001"]["phase"], got["a", "S000"]["phase"], got["a", "S000"]["situation_type"], got["w", "A001"]["scene"]) == ("late", "unknown", "confront", "档案")
    d = {(r["kind"], r["value"]): r["n"] for r in hub.distributions(hub.context(rec, data, story)).collect()}
    assert d["source", "archive"] == 1 and sum(n for (k, _), n in d.items() if k == "situation_type") == 6 and sum(n for (k, _), n in d.items() if k == "phase") == 5
    assert hub.context(rec.limit(0), data.limit(0), story.limit(0)).count() == 0


def test_numbers_of_a_hot_part_run_through(spark):
    rows = [("hot", i * 7 % 1000, i) for i in range(1000)] + [("cold", None, 1), ("cold", 3, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "slug string, idx int, rec_id bigint")
    got = [r for r in hub.number_within(df, ["slug"], "idx", ["rec_id"], width=64).collect()]
    assert sorted((r["n"], r["idx"]) for r in got if r["slug"] == "hot") == [(i, i) for i in range(1000)]
    assert sorted((r["n"], r["rec_id"]) for r in got if r["slug"] != "hot") == [(0, 1), (0, 3), (1, 2)]
    sizes = spark.createDataFrame([(f"k{i:03}", i) for i in range(200)], "k string, n bigint").repartition(7)
    assert sorted((r["k"], r["before"]) for r in hub.running_totals(sizes, "k", "n").collect()) == [(f"k{i:03}", i * (i - 1) // 2) for i in range(200)]


def test_archives_count_by_the_reference(spark):
    a = [("evade", "回避", 0.8)]
    rows = [(1, "x", "archive", "p", "甲", "comfort", a * 9, 1), (2, "y", "voice", "p", "甲", "comfort", a * 2, 2), (3, "z", None, "p", None, None, [], 3)]
    df = spark.createDataFrame(rows, LINE)
    assert tuple(speech.coverage(df).first()) == (2, 1) and tuple(speech.coverage(df.limit(0)).first()) == (0, 0)
    pats = speech.behaviour_patterns(speech.profile(df)).collect()
    assert [r["pattern"] for r in pats] == ["high_evade", "interlocutor_evade"]
    assert pats[1]["rule"] == "对甲的对话中，回避行为占比最高（100%）——用回避的方式回应甲" and pats[0]["rule"].startswith("在被追问时倾向回避直接回答（回避行为占比100%）")


def test_address_type_is_of_counts(spark):
    df = spark.createDataFrame([(i, "阁下" if i == 0 else "海", "voice", None, None, None, None, i) for i in range(2500)], LINE)
    r = fingerprint.fingerprint(df).first()
    assert r["honorific_pct"] == 0.0 and r["address_type"] == "尊称型" and r["rhetoric_traits"] == "极少使用否定句，表达积极正向"
    assert r["summary"].startswith("句式短句型，平均1.0字；几乎不用感叹号，语气极度克制；极少使用第一人称")


def test_script_and_wiki_dialogue(spark):
    pages = [("s", '[name="甲"]你好（招手）。\n[Delay(time=1)]\n[name="乙"]嗯[Image(x)]。\n[dialog]\n[name="甲"]\n[name="丙"]走吧'), ("w", "== 码头 ==\n'''甲'''：早。\n旁白\n'''乙'''：早啊\n=== 船上 ===\n'''甲''': 走"), ("n", None)]
    df = spark.createDataFrame(pages, "path string, value string")
    got = [(r["path"], r["speaker"], r["text"], r["narration"], r["scene"], r["reply_to"]) for r in hub.dialogues(df, "甲").orderBy("path", "pos").collect()]
    assert got == [("s", "甲", "你好。", ["招手"], None, "乙"), ("s", "乙", "嗯。", [], None, None), ("s", "丙", "走吧", [], None, None), ("w", "甲", "早。", [], "码头", "乙"), ("w", "乙", "早啊", [], "码头", None), ("w", "甲", "走", [], "船上", "乙")]


def test_wiki_pages(spark):
    page = "{{CharinfoV2\n|干员名=甲\n|所属组织={{color|red|船队}}\n|稀有度=\n}}\n{{人员档案set\n|种族=[[羽人|羽]]\n|生日=未公开\n}}\n{{人员档案\n|档案1=基础\n|档案1条件=\n|档案1文本=一行<br/>二行{{x|{{y}}}}\n|档案2=空\n|档案2条件=\n|档案2文本=\n}}\n|标题1=问候\n|台词1={{VoiceData/word|中文|你好。}}\n|标题2=空\n|台词2=\n"
    r = wiki.parse_pages(spark.createDataFrame([("p", page), ("q", None)], "path string, value string")).filter("path = 'p'").first()
    assert (r["page_type"], r["name_zh"], r["faction"], r["race"], r["birthday"], r["rarity"]) == ("operator", "甲", "船队", "羽", None, None)
    assert [(a["index"], a["title"]) for a in r["archives"]] == [(1, "基础")]
    assert [(v["label"], v["text"]) for v in r["voice_lines"]] == [("问候", "你好。")]
    assert wiki.body_of("{{a\n{{b}}c}}d", "a") == "{{b}}c" and wiki.body_of("x{{a \n{{b}}c\n}}", "a") == "{{b}}c\n"
    assert wiki.body_of("{{a\n{{b}}c}", "a") is None and wiki.body_of("{{ab\nc}}", "a") is None and wiki.body_of(None, "a") is None
    s = spark.createDataFrame([("特蕾西娅", "te-lei-xi-ya"), ("W", "w"), ("Amiya", "amiya"), ("阿米娅", "a-mi-ya"), ("Red Owl", "red-owl")], "n string, want string")
    assert s.filter(wiki.slug(F.col("n")) != F.col("want")).count() == 0
    c = spark.createDataFrame([("hello<!-- comment -->world", "helloworld"), ("[[罗德岛|罗德岛]]", "罗德岛")], "t string, want string")
    assert c.filter(wiki.clean(F.col("t")) != F.col("want")).count() == 0
    red = spark.createDataFrame([("a", "#REDIRECT [[b]]"), ("b", "#REDIRECT [[c]]"), ("c", "text"), ("d", "#REDIRECT [[nowhere]]")], "path string, value string")
    assert {r["path"]: r["target"] for r in wiki.follow_redirects(red).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d"}


def test_relations(spark):
    names = relations.Names([("特蕾西娅", "特蕾西娅"), ("特雷西斯", "特雷西斯"), ("W", "W"), ("陈", "陈")])
    assert names.entities("特蕾西娅与特雷西斯在卡兹戴尔作战") == ["特蕾西娅", "特雷西斯"]
    assert names.entities("和陈一起") == [] and names.entities("陈，W!") == ["W", "陈"] and names.entities("Wall") == []
    tl = spark.createDataFrame([(0, "early"), (1, "late")], "ord int, id string")
    e = spark.createDataFrame([("early", "a", "b", "t", "low"), ("late", "a", "b", "t", "high"), ("late", "a", "c", "t", "low"), ("early", "a", "d", "t", "low"), ("late", "a", "d", "u", "low")], "phase string, src string, dst string, type string, confidence string")
    got = {(r["dst"], r["type"]): r["evolution"] for r in relations.trajectories(e, tl).collect()}
    assert got == {("b", "t"): "从early到late逐步强化", ("c", "t"): "在late时期新出现", ("d", "t"): "仅在early时期出现后消失；同时late时期为u", ("d", "u"): "在late时期新出现；同时early时期为t"}
    assert relations.trajectories(e.limit(0), tl).count() == 0


def mentioned(spark, texts, *names, patterns=None):
    said = relations.sentences(spark.createDataFrame(list(enumerate(texts)), "i bigint, text string"), ["i"])
    cast = spark.createDataFrame([(n, n) for n in names], "alias string, canonical string")
    return {(r["i"], r["src"], r["dst"], r["type"]): r for r in relations.relation_mentions(said, ["i"], cast, patterns).collect()}


def test_relation_mentions(spark):
    two = ("特蕾西娅", "特雷西斯")
    got = mentioned(spark, ["特蕾西娅没有背叛我们。特雷西斯也在场。", "特雷西斯是特蕾西娅的兄长。", "特蕾西娅的兄长特雷西斯", None, "", "特雷西斯来了。然后走了！特蕾西娅信任他，信任，相信。", "特蕾西娅在。一。二。三。特雷西斯的战友。"], *two)
    assert set(got) == {(1, "特雷西斯", "特蕾西娅", "sibling"), (2, "特雷西斯", "特蕾西娅", "sibling"), (5, "特蕾西娅", "特雷西斯", "trust")}
    assert got[5, "特蕾西娅", "特雷西斯", "trust"]["confidence"] == "high" and got[5, "特蕾西娅", "特雷西斯", "trust"]["context"] == "特蕾西娅信任他，信任，相信"
    assert got[1, "特雷西斯", "特蕾西娅", "sibling"]["confidence"] == "low"
    # a run longer than three times the gap says nothing; one character is a name only where it stands alone
    assert mentioned(spark, ["特雷西斯来了。" + "长" * 240 + "。特蕾西娅的战友。"], *two) == {}
    assert mentioned(spark, ["陈旧的房间里特蕾西娅遇见战友"], "陈", "特蕾西娅") == {} and set(mentioned(spark, ["陈，特蕾西娅的战友"], "陈", "特蕾西娅")) == {(0, "特蕾西娅", "陈", "comrade")}


def test_relation_edges_cases(spark):
    assert mentioned(spark, ["甲一和乙二是战友"]) == {} and mentioned(spark, ["甲一和乙二是战友"], "甲一", "乙二", patterns=[]) == {} and mentioned(spark, ["甲一" * 3000 + "。" * 50 + "乙二战友"], "甲一", "乙二") == {}
    assert set(mentioned(spark, ["甲一战友乙二", "甲一战友乙二", "", "。。"], "甲一", "乙二")) == {(0, "甲一", "乙二", "comrade"), (1, "甲一", "乙二", "comrade")}


def test_relations_are_found_like_pair_by_pair(spark):
    rnd = random.Random(4)
    names, patterns = ["甲一", "乙二", "丙三"], [("t", "友"), ("u", "敌|仇")]
    texts = ["".join(rnd.choice([*names, "友", "敌", "仇", "的", "是", "不是", "和", "。", "。", "走"]) for _ in range(rnd.randint(4, 30))) for _ in range(150)]
    got = {k: (r["confidence"], r["context"]) for k, r in mentioned(spark, texts, *names, patterns=patterns).items()}
    want = {}
    for i, text in enumerate(texts):
        parts = [p for p in text.split("。") if p]
        for x, a in enumerate(sorted(names)):
            for b in sorted(names)[x + 1 :]:
                joint = [(k, k) for k, p in enumerate(parts) if a in p and b in p and "不是" not in p]
                spans = joint or sorted({(min(k, m), max(k, m)) for k, p in enumerate(parts) for m, q in enumerate(parts) if a in p and b in q and abs(k - m) <= 2})
                segs = [seg for seg in ("。".join(parts[k : m + 1]) for k, m in spans) if "不是" not in seg]
                for kind, letters in (("t", "友"), ("u", "敌仇")):
                    seg = next((g for g in segs if any(c in g for c in letters)), None)
                    if seg is None:
                        continue
                    pa, pb, pw = seg.index(a), seg.index(b), min(seg.index(c) for c in letters if c in seg)
                    first = pa < pb
                    gap, tail = (seg[pa + 2 : pb], seg[pb + 2 :][:10]) if first else (seg[pb + 2 : pa], seg[pa + 2 :][:10])
                    fwd = not first if "的" in gap and len(gap) < 15 else first if "是" in gap and "的" in tail else abs(pw - pa) < abs(pw - pb)
                    n = sum(seg.count(c) for c in letters)
                    ctx = next(q for q in seg.split("。") if any(c in q for c in letters) and (a in q or b in q)) if any(any(c in q for c in letters) and (a in q or b in q) for q in seg.split("。")) else ""
                    want[(i, *((a, b) if fwd else (b, a)), kind)] = ("high" if n >= 3 else "medium" if n == 2 else "low", ctx)
    assert got == want and len(want) > 60


def test_contextual_graph(spark):
    tl = spark.createDataFrame([(0, "early"), (1, "late")], "ord int, id string")
    rows = [("s", "early", i, f"甲一和乙二是战友{i}", None) for i in range(3)] + [("s", "late", 10 + i, "甲一和乙二是战友，战友，战友", "voice") for i in range(3)] + [("s", "late", 20, "丙三背叛甲一", "archive"), ("s", "", 25, "走。走。走", None), ("s", "", 30, "丙三", None), ("s", None, 31, "甲一的敌人", None), ("t", "late", 1, "甲一", None), ("t", "late", 2, None, None)]
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_uid bigint, slug string, phase string, pos bigint, text string, source string")
    names = spark.createDataFrame([(n, n) for n in ("甲一", "乙二", "丙三")], "alias string, canonical string")
    got = {(r["slug"], r["src"], r["dst"], r["type"]): r for r in relations.contextual_graph(lines, names, tl).collect()}
    assert set(got) == {("s", "乙二", "甲一", "comrade"), ("s", "甲一", "丙三", "opponent")}
    r = got["s", "乙二", "甲一", "comrade"]
    assert [tuple(p) for p in r["phases"]] == [("early", "low"), ("late", "high")] and r["trajectory"] == "从early到late逐步强化" and r["contexts"] == ["甲一和乙二是战友0"]
    assert got["s", "甲一", "丙三", "opponent"]["phases"] == [] and got["s", "甲一", "丙三", "opponent"]["trajectory"] is None
    assert relations.contextual_graph(lines.limit(0), names, tl).count() == 0


def test_graph_keeps_sources_and_three_contexts(spark):
    rows = [("a", "b", "t", "low", ["x"], ["c4", "c1"]), ("a", "b", "t", "low", ["y", "x"], ["c3", "c2", "c1", ""]), ("a", "c", "t", "medium", None, None)]
    df = spark.createDataFrame(rows, "src string, dst string, type string, confidence string, sources array<string>, contexts array<string>")
    got = [(r["dst"], r["source_count"], r["confidence"], r["sources"], r["contexts"]) for r in relations.graph(df).collect()]
    assert got == [("b", 2, "medium", ["x", "y"], ["c1", "c2", "c3"]), ("c", 0, "medium", [], [])]
    ops = spark.createDataFrame([("甲一", "Jia Yi"), ("乙二", None)], "name_zh string, name_en string")
    al = spark.createDataFrame([("小甲", "甲一"), ("乙二", "甲一"), ("", "x")], "alias string, canonical string")
    n = relations.normalize(spark.createDataFrame([(x,) for x in [" 甲一 ", "小甲", "JIA yi", "乙二", "丁", None, ""]], "name string"), "name", ops, al)
    assert {r["name"]: r["canonical"] for r in n.collect()} == {" 甲一 ": "甲一", "小甲": "甲一", "JIA yi": "甲一", "乙二": "乙二", "丁": None, None: None, "": None}
    ends = {r["name"]: (r["name_en"], r["race"], r["faction"]) for r in relations.nodes(df, ops.selectExpr("'a' as name_zh", "cast(null as string) as name_en", "'r' as race", "cast(null as string) as faction").limit(1)).collect()}
    assert ends == {"a": ("", "r", "unknown"), "b": ("", "unknown", "unknown"), "c": ("", "unknown", "unknown")}


def test_claims_and_misconceptions(spark):
    t = spark.createDataFrame([("x", "种族：萨卡兹。她是萨卡兹。阵营：巴别塔\n"), ("y", "特蕾西娅属于整合运动"), ("z", "错误：特蕾西娅属于整合运动"), ("n", None)], "s string, text string")
    got = {(r["source"], r["field"], r["value"]) for r in canon.claims(t, "s").collect()}
    assert ("x", "race", "萨卡兹") in got and ("x", "faction", "巴别塔") in got and len([g for g in got if g[1] == "race"]) == 1
    assert [(r["source"], r["id"]) for r in canon.misconceptions(t, "s").collect()] == [("y", "M002")]
    c = spark.createDataFrame([("f", "a b", "s1"), ("f", "ab", "s2"), ("g", "x", "s1"), ("g", "y", "s2"), ("h", "x", "s1"), ("h", None, "s2")], "field string, value string, source string")
    assert {r["field"]: r["status"] for r in canon.cross_validate(c).collect()} == {"f": "confirmed", "g": "conflicted", "h": "unverified"}


def test_claims_are_shuffled_without_their_texts(spark):
    long_ = "甲" * 5000
    t = spark.createDataFrame([("x", f"{long_}编号7。编号8。编号7。{long_}", 1)], "s string, text string, n int")
    got = canon.claims(t, "s", [("number", "编号", r"编号(\d+)")])
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [x.split("\n")[1] for x in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", x.strip())]
    assert moved and not any(re.search(r"\b(text|whole)#", x) for x in moved)
    assert {(r["value"], r["context"]) for r in got.collect()} == {("7", f"{long_[:30]}编号7。编号8。编号7。{long_[:21]}"), ("8", f"{long_[:26]}编号7。编号8。编号7。{long_[:25]}")}


def test_persona(spark):
    p = persona.parse("## Layer 0：x\n- 不用感叹号\n- 不说「走开」\n\n## Layer 2：y\n口头禅：「嗯」\n高频词：海、船\n自称：极少\n\n## Layer 5：z\n- 不谈「内鬼」\n\n## Correction 记录\n暂无\n")
    assert p["layer0"] == ["不用感叹号", "不说「走开」"] and p["style"]["frequent_words"] == ["海", "船"] and p["layer5"] == ["不谈「内鬼」"] and p["corrections"] == []
    assert persona.forbidden("不说「走开」") == [("走开", "使用了'走开'")]
    assert persona.forbidden("没有感叹号，从不会哭") == [("[！!]", "使用了感叹号"), ("哭了|流泪|泪流|泪水", "出现了哭泣描写")]
    assert persona.forbidden("不应该「退后」，应该「前进」，从不用“命令”") == [("命令|给我|必须|立刻|马上", "使用了命令式语气"), ("命令", "使用了'命令'"), ("退后", "使用了反例表达'退后'")]
    assert persona.forbidden("温和") == [] and persona.taboo_words("不谈「内鬼」与牺牲") == ["内鬼", "牺牲"]
    assert persona.parse("## Layer 0\n- a\n## 其他\n- b\n## Correction 记录\n### 一\n- c\n## 尾\n- d\n") == {"layer0": ["a", "b"], "style": {}, "layer5": [], "corrections": ["一", "c"]}
    assert persona.parse("") == {"layer0": [], "style": {}, "layer5": [], "corrections": []}
    d = spark.createDataFrame([("「我会记住你们每一个人」", True), ("......我在。", True), ("泰拉历898年，" + "x" * 60, False)], "t string, want boolean")
    assert d.filter(persona.is_dialogue(F.col("t")) != F.col("want")).count() == 0
    lines = spark.createDataFrame([(1, "嗯！", "voice", "a", None, "casual", [], 1), (2, "海船", "voice", "a", None, "casual", [], 2), (3, None, "voice", "a", None, "casual", [], 3)], LINE)
    r = persona.validate(lines, p).filter("dim = 'global'").first()
    assert (r["lines"], r["layer0"], r["layer5"]) == (2, 50.0, 100.0)


def test_versions(spark):
    v = spark.createDataFrame([("v1", "v1.0"), ("v1.0", "v1.0"), ("1.0", "v1.0"), ("2.3", "v2.3")], "v string, want string")
    assert v.filter(catalog.normal_version(F.col("v")) != F.col("want")).count() == 0
    n = spark.createDataFrame([("a", "v1.2"), ("a", "v1.10"), ("b", None), ("c", "v3")], "k string, version string")
    assert {r["k"]: r["next"] for r in catalog.next_version(n, "k").collect()} == {"a": "v1.11", "b": "v1.0", "c": "v1.4"}


def test_fingerprint_edges(spark):
    rows = [(1, "吾辈…", "voice", "p", None, "x", [], 1), (2, "像你们，像你我，像你说", "voice", "p", "", "x", [], 2), (3, "  ", "voice", "unknown", "y", None, [], 3), (4, None, "voice", None, "y", None, None, 4)]
    df = spark.createDataFrame(rows, LINE)
    got = {(r["slice_dim"], r["slice_value"]): r for r in fingerprint.contextual_fingerprint(df).collect()}
    assert got["global", ""]["lines"] == 2 and got["global", ""]["self_refs"] == 3 and got["global", ""]["parallelism_pct"] == 50.0
    assert ("phase", "unknown") not in got and got["interlocutor", "unknown"]["raw_lines"] == 2
    assert fingerprint.fingerprint(df.limit(0)).first()["lines"] == 0


# Counts of speech acts of two sample characters, and the patterns known for them.
SAMPLES = [
    (
        {"global": {"": {"console": 1, "affirm_presence": 1, "invite": 1, "commit": 3, "evade": 18, "soothe": 2}}, "situation_type": {"casual": {"console": 1, "affirm_presence": 1, "invite": 1, "commit": 3, "evade": 16, "soothe": 2}, "comfort": {"evade": 1}, "decide": {"evade": 1}}, "interlocutor": {"unknown": {"console": 1, "affirm_presence": 1, "invite": 1, "commit": 3, "evade": 5, "soothe": 2}, "博士": {"evade": 1}, "孱弱的孩子": {"evade": 1}, "坚强的孩子": {"evade": 11}}, "phase": {"early": {"console": 1, "affirm_presence": 1, "invite": 1, "commit": 3, "evade": 18, "soothe": 2}}},
        [("high_evade", "在被追问时倾向回避直接回答（回避行为占比69%），常用省略号结尾或反问代替回答", 0, 1.0), ("interlocutor_evade", "对坚强的孩子的对话中，回避行为占比最高（100%）——用回避的方式回应坚强的孩子", 4, 0.9)],
    ),
    (
        {"global": {"": {"commit": 9, "evade": 15, "soothe": 1, "affirm_presence": 5, "promise_remember": 1, "farewell": 2}}, "situation_type": {"casual": {"commit": 9, "soothe": 1, "evade": 13, "affirm_presence": 4, "promise_remember": 1, "farewell": 2}, "comfort": {"evade": 1, "affirm_presence": 1}, "reminisce": {"evade": 1}}, "interlocutor": {"博士": {"commit": 2, "affirm_presence": 1, "evade": 3}, "unknown": {"evade": 6, "soothe": 1, "affirm_presence": 4, "commit": 7, "promise_remember": 1, "farewell": 1}, "？？？": {"evade": 2}, "预言家": {"evade": 4, "farewell": 1}}, "phase": {"babel": {"commit": 1, "evade": 12, "farewell": 2}, "resurrected": {"commit": 8, "evade": 3, "soothe": 1, "affirm_presence": 5, "promise_remember": 1}}},
        [("high_evade", "在被追问时倾向回避直接回答（回避行为占比46%），常用省略号结尾或反问代替回答", 0, 1.0), ("interlocutor_evade", "对？？？的对话中，回避行为占比最高（100%）——用回避的方式回应？？？", 4, 0.9), ("interlocutor_evade", "对预言家的对话中，回避行为占比最高（80%）——用回避的方式回应预言家", 4, 0.8), ("phase_shift_babel_evade", "babel时期，回避行为显著增多（偏移34%）", 2, 0.69), ("phase_shift_resurrected_evade", "resurrected时期，回避行为显著减少（偏移29%）", 2, 0.576667), ("interlocutor_evade", "对博士的对话中，回避行为占比最高（50%）——用回避的方式回应博士", 4, 0.5), ("phase_shift_resurrected_commit", "resurrected时期，承诺行为显著增多（偏移17%）", 2, 0.342889)],
    ),
]


def test_patterns_of_sample_characters(spark):
    for counts, want in SAMPLES:
        acts = [(d, v, a, n) for d, slices in counts.items() for v, per in slices.items() for a, n in per.items()]
        rows = [(i, "x", "voice", v if d == "phase" else None, v if d == "interlocutor" else None, v if d == "situation_type" else None, [(a, None, None)] * n, 0) for i, (d, v, a, n) in enumerate(acts) if d != "global"]
        # every dimension alone gives its slices; the whole is that of the situations
        prof = None
        for d in ("situation_type", "interlocutor", "phase"):
            df = spark.createDataFrame([r for r in rows if r[{"phase": 3, "interlocutor": 4, "situation_type": 5}[d]] is not None], LINE)
            part = speech.profile(df).filter(F.col("slice_dim").isin(*([d, "global"] if d == "situation_type" else [d])))
            prof = part if prof is None else prof.unionByName(part)
        assert [tuple(r) for r in speech.behaviour_patterns(prof).collect()] == want


# Mean length, ellipsis, feeling and denial of the slices of the same two, and the shifts known for them.
SLICES = [
    (
        [("global", "", 15.4, 17.8, "信任", 13.2), ("situation_type", "casual", 15.2, 17.2, "信任", 13.1), ("situation_type", "comfort", 27.1, 25.0, "信任", 25.0), ("situation_type", "decide", 14.5, 50.0, "孤独", 0.0), ("interlocutor", "博士", 34.4, 75.0, "信任", 25.0), ("interlocutor", "unknown", 17.0, 11.4, "信任", 17.7), ("interlocutor", "坚强的孩子", 10.9, 21.1, "孤独", 7.0), ("interlocutor", "孱弱的孩子", 11.2, 25.0, "悲伤", 8.3), ("phase", "early", 15.4, 17.8, "信任", 13.2)],
        {("comfort", "sentence_length", "偏长", 0.76), ("comfort", "ellipsis", "更多沉默", 0.4), ("comfort", "negation", "更多否定", 0.89), ("decide", "ellipsis", "更多沉默", 1.81), ("decide", "emotion_dominant", "从'信任'偏移到'孤独'", None), ("decide", "negation", "更少否定", 1.0), ("博士", "sentence_length", "偏长", 1.23), ("博士", "ellipsis", "更多沉默", 3.21), ("博士", "negation", "更多否定", 0.89), ("坚强的孩子", "emotion_dominant", "从'信任'偏移到'孤独'", None), ("坚强的孩子", "negation", "更少否定", 0.47), ("孱弱的孩子", "ellipsis", "更多沉默", 0.4), ("孱弱的孩子", "emotion_dominant", "从'信任'偏移到'悲伤'", None)},
    ),
    (
        [("global", "", 18.1, 38.5, "希望", 23.1), ("situation_type", "casual", 17.2, 38.3, "希望", 19.1), ("situation_type", "comfort", 23.4, 25.0, "孤独", 50.0), ("interlocutor", "博士", 16.7, 66.7, "希望", 50.0), ("interlocutor", "unknown", 18.6, 26.3, "孤独", 23.7), ("interlocutor", "？？？", 9.3, 66.7, "unknown", 0.0), ("interlocutor", "预言家", 21.2, 80.0, "信任", 0.0), ("phase", "resurrected", 17.8, 18.9, "希望", 29.7), ("phase", "babel", 18.9, 86.7, "悲伤", 6.7)],
        {("comfort", "emotion_dominant", "从'希望'偏移到'孤独'", None), ("comfort", "negation", "更多否定", 1.16), ("博士", "ellipsis", "更多沉默", 0.73), ("博士", "negation", "更多否定", 1.16), ("unknown", "emotion_dominant", "从'希望'偏移到'孤独'", None), ("？？？", "sentence_length", "偏短", 0.49), ("？？？", "ellipsis", "更多沉默", 0.73), ("？？？", "emotion_dominant", "从'希望'偏移到'unknown'", None), ("？？？", "negation", "更少否定", 1.0), ("预言家", "ellipsis", "更多沉默", 1.08), ("预言家", "emotion_dominant", "从'希望'偏移到'信任'", None), ("预言家", "negation", "更少否定", 1.0), ("resurrected", "ellipsis", "更少沉默", 0.51), ("babel", "ellipsis", "更多沉默", 1.25), ("babel", "emotion_dominant", "从'希望'偏移到'悲伤'", None), ("babel", "negation", "更少否定", 0.71)},
    ),
]


def test_shifts_of_sample_characters(spark):
    for rows, want in SLICES:
        df = spark.createDataFrame(rows, "slice_dim string, slice_value string, avg_length double, ellipsis_pct double, emotion_dominant string, negation_pct double")
        assert {(r["slice_value"], r["dimension"], r["shift"], r["magnitude"]) for r in fingerprint.shifts(df).collect()} == want


def test_period_rules_of_a_sample_character(spark):
    # fixed values: metrics and acts of two periods, and the rules known for them
    m = spark.createDataFrame([("babel", 15, 18.9, 86.7, 6.7), ("resurrected", 37, 17.8, 18.9, 27.0)], "phase string, lines bigint, avg_length double, ellipsis_pct double, negation_pct double")
    acts = {"resurrected": {"commit": 8, "evade": 3, "soothe": 1, "affirm_presence": 5, "promise_remember": 1}, "babel": {"commit": 1, "evade": 12, "farewell": 2}}
    shares = spark.createDataFrame([(p, a, n / sum(per.values())) for p, per in acts.items() for a, n in per.items()], "phase string, act string, share double")
    pairs = spark.createDataFrame([("babel", "resurrected")], "a string, b string")
    got = {(r["metric"], r["reading"], min(round(abs(r["shift_pct"]) / 50, 6), 0.95)) for r in temporal._compare(pairs, m, shares, ["phase"]).collect()}
    assert got == {
        ("ellipsis_pct", "沉默/停顿减少（86.7%→18.9%）", 0.95),
        ("negation_pct", "否定表达增多（6.7%→27.0%）", 0.95),
        ("speech_act:evade", "回避行为显著减少（80.0%→16.7%）", 0.95),
        ("speech_act:commit", "承诺行为显著增多（6.7%→44.4%）", 0.756),
        ("speech_act:affirm_presence", "存在确认行为显著增多（0.0%→27.8%）", 0.556),
        ("speech_act:farewell", "告别行为显著减少（13.3%→0.0%）", 0.266),
    }


def _exchanged(df):
    """The columns of every exchange of a plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#", x.split("\n")[1])) for x in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", x.strip())]


def _talk(spark):
    """Lines of four periods in which 24 people speak, one of them once a period at most."""
    rnd = random.Random(5)
    names = [*(f"人{i}" for i in range(20)), "a/b", "a", "", None]
    says = ["没有。", "走吧……", "我在这里等了很久，一直等到天亮为止。", "好！", None]
    rows = [(i, rnd.choice(says), "story", rnd.choice(["p", "p/a", "q", "unknown"]), rnd.choice(names), None, rnd.choice([None, [], [(rnd.choice(["evade", "commit", "奇"]), "", 1.0), (rnd.choice(["evade", None]), "", 1.0)]]), i) for i in range(400)]
    return spark.createDataFrame([*rows, (900, "好", "story", "p", "一次", None, None, 900)], LINE)


def _by_hand(spark, lines):
    """phase, a, b, metric, baseline, comparison of every large difference between two interlocutors of a period, pair by pair."""
    p, keys = temporal.periods(lines).filter("interlocutor <> 'unknown'"), ["phase", "interlocutor"]
    m = {(r["phase"], r["interlocutor"]): r for r in temporal.slice_metrics(p, keys).collect() if r["lines"] >= 2}
    s = {(r["phase"], r["interlocutor"], r["act"]): r["share"] for r in temporal.act_shares(p, keys).collect()}
    want = set()
    for f, a in m:
        for g, b in m:
            if f != g or a.encode() >= b.encode():
                continue
            for metric, col, least in (("avg_sentence_length", "avg_length", 0.25), ("ellipsis_pct", "ellipsis_pct", 0.3), ("negation_pct", "negation_pct", 0.3)):
                x, y = m[f, a][col], m[g, b][col]
                if x > 0 and abs((y - x) / x) > least:
                    want.add((f, a, b, metric, x, y))
            for act in {k[2] for k in s}:
                x, y = s.get((f, a, act), 0.0), s.get((f, b, act), 0.0)
                if abs(y - x) > 0.1:
                    want.add((f, a, b, f"speech_act:{act}", round(x * 100, 1), round(y * 100, 1)))
    return want


def test_pairs_of_interlocutors_are_shuffled_nowhere(spark, monkeypatch):
    monkeypatch.setattr(temporal, "CELL", 3, raising=False)
    lines = _talk(spark)
    got = temporal.interlocutor_differences(lines)
    assert not any({"a", "b"} <= c for c in _exchanged(got))
    rows = [(r["phase"], r["a"], r["b"], r["metric"], r["baseline"], r["comparison"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) > 500 and set(rows) == _by_hand(spark, lines)
    assert temporal.interlocutor_differences(lines.limit(0)).count() == 0


def test_surest_rules_need_no_more_pairs_than_can_win(spark, monkeypatch):
    lines = _talk(spark)
    timeline = spark.createDataFrame([(1, "q"), (2, "p")], "ord int, id string")
    order = lambda r: (-r["confidence"], r["layer"], r["scope"].encode(), r["metric"].encode())
    four = temporal.interlocutor_differences(lines).selectExpr("4 as layer", "concat_ws('/', phase, a, b) as scope", "metric", "confidence").collect()
    two = temporal.period_shifts(lines, timeline).selectExpr("2 as layer", "concat_ws('->', from_phase, to_phase) as scope", "metric", "confidence").collect()
    whole = sorted(four + two, key=order)
    made, pairs = [], temporal._interlocutor_pairs
    monkeypatch.setattr(temporal, "HEADS", 4)
    monkeypatch.setattr(temporal, "_interlocutor_pairs", lambda first, second: made.append(first.count()) or pairs(first, second))
    for k in (1, 20, 400, len(whole) + 1):
        got = temporal.temporal_rules(lines, timeline, k)
        assert not any({"a", "b"} <= c for c in _exchanged(got))
        assert [order(r) for r in got.collect()] == [order(r) for r in whole[:k]]
    everyone = temporal.interlocutor_profiles(lines).count()
    assert made[0] <= 4 and made[1] < everyone and made[-1] == everyone  # one head at first, all of them where k rules are too few
    assert temporal.temporal_rules(lines.limit(0), timeline).count() == 0
