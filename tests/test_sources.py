"""Readers, writers, streaming forms and pages in files."""

import json

import pytest
from pyspark.sql import functions as F

from murmur.operators import catalog, wiki
from murmur.sources import readers
from murmur.streaming import lines as streaming


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# 注\n问候：你好: 再见\n\n没有标签\n键: 值|x\n甲|乙\n", encoding="utf-8")
    got = [(r["n"], r["label"], r["text"]) for r in readers.labelled_text(spark, str(tmp_path / "a.txt")).orderBy("n").collect()]
    assert got == [(2, "问候：你好", "再见"), (4, "line_4", "没有标签"), (5, "键", "值|x"), (6, "甲", "乙")]
    (tmp_path / "b.csv").write_text("label,text\n问候,你好,世界\n只有文字\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("问候,你好\n", encoding="utf-8")
    rows = lambda n: [(r["n"], r["label"], r["text"]) for r in readers.labelled_csv(spark, str(tmp_path / n)).orderBy("n").collect()]
    assert rows("b.csv") == [(2, "问候", "你好,世界"), (3, "line_3", "只有文字")] and rows("c.csv") == [(1, "问候", "你好")]
    assert [r["text"] for r in readers.dialogue_texts(spark, str(tmp_path / "b.csv"), "csv").orderBy("n").collect()] == ["你好,世界", "只有文字"]
    (tmp_path / "empty.txt").write_text("", encoding="utf-8")
    assert readers.labelled_text(spark, str(tmp_path / "empty.txt")).count() == 0


def test_record_and_story_readers(spark, tmp_path):
    rec = {"slug": "w", "name_zh": "W", "voice_lines": [{"label": "问候", "text": "你好"}, {"label": "空", "text": ""}], "archives": [{"index": 1, "title": "x", "text": "档"}], "extra": 3}
    old = {"slug": "v", "archives": [{"index": 2, "title": "y", "text": "旧"}]}
    for n, r in (("w.json", rec), ("v.json", old)):
        (tmp_path / n).write_text(json.dumps(r, ensure_ascii=False), encoding="utf-8")
    d = readers.records(spark, str(tmp_path))
    assert {r["slug"]: r["name_zh"] for r in d.collect()} == {"w": "W", "v": None}
    assert sorted((r["slug"], r["pos"], r["label"], r["text"]) for r in readers.voice_or_archive(d).collect()) == [("v", 0, "2", "旧"), ("w", 0, "问候", "你好"), ("w", 1, "空", "")]
    assert [(r["n"], r["text"]) for r in readers.dialogue_texts(spark, str(tmp_path / "*.json"), "json").collect()] == [(1, "你好")]
    story = {"dialogues": [{"speaker": "甲", "text": "走", "is_target": True}, {"speaker": "乙", "narration": ["点头"]}]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text(json.dumps(story, ensure_ascii=False), encoding="utf-8")
    got = [(r["pos"], r["speaker"], r["text"], r["narration"], r["is_target"]) for r in readers.stories(spark, str(tmp_path / "s")).orderBy("pos").collect()]
    assert got == [(0, "甲", "走", [], True), (1, "乙", "", ["点头"], False)]


def test_page_readers(spark):
    page = "前言 1099-1100 x\n### 1031-1094 早期\n### 1095 – 1097 后来 \n"
    df = spark.createDataFrame([("a", page), ("b", "没有"), ("c", None)], "path string, value string")
    assert [(r["ord"], r["range"], r["label"]) for r in readers.timeline(df.filter("path = 'a'")).orderBy("ord").collect()] == [(0, "1031-1094", "早期"), (1, "1095-1097", "后来")]
    assert [r["label"] for r in readers.timeline(df.filter("path = 'b'")).orderBy("ord").collect()] == ["early", "babel", "resurrected"]
    md = spark.createDataFrame([("m", "# 一\n" + "长" * 30 + "\n## 二\n短\n"), ("p", "段" * 25 + "\n\n短\n\n" + "落" * 25), ("s", "短")], "path string, value string")
    assert [(r["path"], r["k"], len(r["section"])) for r in readers.sections(md).orderBy("path", "k").collect()] == [("m", 0, 32), ("p", 0, 25), ("p", 1, 25), ("s", 0, 1)]
    local = "---\nname: \"甲\"\nurl: 'http://x'\nbad\n---\n\n# 背景\n一\n二\n## 空\n# 背景\n三"
    got = readers.local_records(spark.createDataFrame([("x", local), ("y", "无"), ("z", None)], "path string, value string"))
    assert {r["path"]: r["fields"] for r in got.collect()} == {"x": {"name": "甲", "url": "http://x", "section_空": "", "section_背景": "三"}, "y": {}, "z": None}


def test_wiki_extras(spark):
    enemy = "{{敌人信息/level2\n|名称=影\n|能力=一段红<br/>二段\n续行\n|种类=兽\n}}"
    old = "== 干员档案 ==\n'''履历'''" + "字" * 600 + "\n== 语音 ==\n|标题1=问\n|台词1=好\n| 种族 = 羽人 |阵营=船队\n|职业=木匠|"
    pages = spark.createDataFrame([("影", enemy), ("旧", old), ("甲", "{{CharinfoV2\n|干员名=甲\n}}"), ("甲/语音记录", "|标题1=问候\n|台词1={{VoiceData/word|中文|你好}}\n"), ("n", None)], "path string, value string")
    rec = {r["path"]: r for r in wiki.with_voice_pages(wiki.parse_pages(pages), pages).collect()}
    assert (rec["影"]["name_zh"], rec["影"]["race"], rec["影"]["abilities"]) == ("影", "兽", "一段红\n二段\n续行")
    assert len(rec["旧"]["archives"][0]["text"]) == 500 and rec["旧"]["archives"][0]["text"].startswith("履历字") and rec["甲"]["archives"] is None
    assert [(v["label"], v["text"]) for v in rec["甲"]["voice_lines"]] == [("问候", "你好")] and [v["text"] for v in rec["旧"]["voice_lines"]][0].startswith("好")
    legacy = {r["path"]: r for r in wiki.legacy_records(pages).collect()}
    assert (legacy["旧"]["race"], legacy["旧"]["faction"], legacy["旧"]["profession"], len(legacy["旧"]["archives"])) == ("羽人", "船队", "木匠", 1) and legacy["n"]["race"] is None
    links = spark.createDataFrame([("甲", 1, "分类:属于巴别塔的干员"), ("甲", 0, "杂项"), ("甲", 2, None)], "title string, pos int, category string")
    assert [tuple(r) for r in wiki.page_categories(links).collect()] == [("甲", ["杂项", "属于巴别塔的干员"])]
    ring = spark.createDataFrame([(x, f"#REDIRECT [[{y}]]") for x, y in ("ab", "bc", "ca", "da")] + [("e", "")], "path string, value string")
    got = {r["path"]: r["target"] for r in wiki.follow_redirects(ring).collect()}
    assert set(got) == set("abcde") and got["e"] == "e" and wiki.follow_redirects(ring.limit(0)).count() == 0


ACTS = "array<struct<type:string,label:string,confidence:double>>"
HUB = f"line_uid bigint, text string, source string, phase string, captured_at timestamp, speech_acts {ACTS}, inference_source string, inference_confidence string"


def hub_lines(spark):
    rows = [(1, "我在", "voice", "p", None), (2, "我在", "archive", None, [("x", "y", 0.1)]), (3, None, "story", "", [])]
    return spark.createDataFrame([(i, t, s, p, None, a, "n", "low") for i, t, s, p, a in rows], HUB)


def test_writers(spark, tmp_path):
    readers.write_acts(hub_lines(spark), str(tmp_path / "hub"))
    back = {r["line_uid"]: r for r in spark.read.parquet(str(tmp_path / "hub")).collect()}
    assert [a["type"] for a in back[1]["speech_acts"]] == ["affirm_presence"] and back[2]["speech_acts"] == [] == back[3]["speech_acts"] and "inference_source" not in back[1].asDict()
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_acts(hub_lines(spark), str(tmp_path / "hub"))
    edges = spark.createDataFrame([("b", "a", "t"), ("a", "b", "t")], "src string, dst string, type string").coalesce(1)
    readers.write_relations(edges, str(tmp_path / "edges"))
    assert [r["src"] for r in spark.read.parquet(str(tmp_path / "edges")).collect()] == ["a", "b"]
    readers.write_reports({"one": edges, "two": edges.limit(0)}, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports" / "one")).count() == 2


def test_versions_on_disk(spark, tmp_path):
    d = spark.createDataFrame([("w", 1)], "slug string, x int")
    catalog.snapshot(d, str(tmp_path / "v"), "v1.9")
    catalog.snapshot(d.withColumn("x", F.lit(2)), str(tmp_path / "v"), "v1.10")
    assert catalog.restore(spark, str(tmp_path / "v"), "v1.9").first()["x"] == 1
    every = spark.read.parquet(str(tmp_path / "v"))
    assert catalog.latest(every, "slug").first()["x"] == 2 and catalog.version_list(every, "slug").first()["versions"] == ["v1.10", "v1.9"]
    r = catalog.rolled_back(every.filter("x = 2"), "1.9").first()
    assert (r["rolled_back_from"], r["rolled_back_to"], r["version"]) == ("v1.10", "v1.9", "v1.9")
    new = catalog.scaffold(spark.createDataFrame([("w", "W", None)], "slug string, name string, name_en string")).first()
    assert (new["version"], new["profile"]["mbti"], new["tags"]["personality"], new["name_en"]) == ("v1.0", "unknown", [], "")


def test_streaming_counts_like_a_batch(spark, tmp_path):
    lines = spark.createDataFrame([(1, "2025-01-01 10:00:00", "p", [("a", "l", 0.5), ("b", "l", 0.5)]), (1, "2025-01-01 10:00:00", "p", [("a", "l", 0.5), ("b", "l", 0.5)]), (2, "2025-01-01 23:00:00", None, [("a", "l", 0.5)]), (3, "2025-01-03 00:00:00", "", None)], f"line_uid bigint, t string, phase string, speech_acts {ACTS}")
    lines.select("line_uid", F.col("t").cast("timestamp").alias("captured_at"), "phase", "speech_acts", F.lit("我在…").alias("text")).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.act_counts(source()).writeStream.format("memory").queryName("acts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["phase"], r["act"], r["n"]) for r in spark.table("acts").collect()) == [("p", "a", 1), ("p", "b", 1), ("unknown", "a", 1)]
    q = streaming.features(source()).select("line_uid", "ellipsis", "self_refs").writeStream.format("memory").queryName("feats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("feats").collect()} == {(i, True, 1) for i in (1, 2, 3)}


def test_written_tables_are_released(spark):
    from murmur import session

    session.release(spark)
    a = session.materialize(spark.range(5), "test")
    assert a.count() == 5 and session.fits_broadcast(a) and not session.fits_broadcast(a, 4)
    assert session.release(spark) == 1 and session.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not.?exist|not_exist|FILE_NOT"):
        a.count()
