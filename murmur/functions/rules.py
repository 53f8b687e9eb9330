"""The zh rule pack. Everything below is a fixed value: word lists, patterns, codes and weights."""

from dataclasses import dataclass, field

# Words of feeling by category.
EMOTIONS = {
    "温柔": ["温柔", "轻声", "微笑", "柔和", "温暖", "关怀", "呵护", "怜惜"],
    "悲伤": ["悲伤", "哀伤", "沉默", "叹息", "泪水", "遗憾", "失去", "怀念", "痛"],
    "愤怒": ["愤怒", "不可饶恕", "绝不允许", "休想", "愚蠢", "可恶", "不可原谅"],
    "坚定": ["坚定", "决不", "一定", "必须", "绝不", "无论如何", "必然", "必将"],
    "恐惧": ["恐惧", "害怕", "可怕", "战栗", "颤抖", "不安", "危险"],
    "希望": ["希望", "未来", "黎明", "明天", "一定会", "终将"],
    "孤独": ["孤独", "独自", "一个人", "无人", "寂寞", "空旷", "遥远"],
    "信任": ["信任", "相信", "托付", "交付", "依靠", "在一起", "同行"],
}
# Words of nature by category.
NATURE = {
    "植物": ["花朵", "花瓣", "花开", "花落", "草木", "树叶", "枝头", "藤蔓", "森林", "丛林", "花草"],
    "天文": ["星空", "星辰", "月光", "阳光", "光影", "天空", "云霞", "彩虹", "星光", "夜空", "日光"],
    "气象": ["风雨", "风声", "微风", "暴风", "雨幕", "雪花", "霜降", "雾气", "雷鸣", "露水", "晨露"],
    "大地": ["山河", "大海", "大地", "土地", "岩石", "沙漠", "泉水", "山峦", "河川", "海洋", "山巅"],
    "时间": ["清晨", "日暮", "夜晚", "白昼", "春天", "夏日", "秋色", "冬雪", "黄昏", "黎明", "破晓"],
}
# Pronouns, cues and forms of address.
FIRST_PERSON = ["我", "吾", "本王", "吾辈", "在下", "朕", "本人", "咱"]
RHETORICAL = ["难道", "岂", "何不", "又怎么", "又如何", "不是吗"]
METAPHOR = ["像", "如同", "仿佛", "似", "宛如", "犹如", "好比"]
HONORIFIC = ["大人", "阁下", "殿下", "陛下", "先生", "小姐", "长官", "指挥官"]
INTIMATE = ["亲爱的", "小家伙", "小可爱", "老朋友", "阿米娅", "姐姐", "哥哥", "妹妹", "弟弟", "姐", "哥"]
# Patterns of denial; the short list serves the comparison of periods.
NEGATION = r"(不|未|莫|别)\s*[是能为会有在到想需该]|(不|未|莫|别)\s*[让叫使把给向对]|没有|无法|并非|从不|绝不|决不|无人|无物|无端|无从"
NEGATION_SHORT = r"(不|未|莫|别)\s*[是能为会有在到想需该]|没有|无法|并非|绝不|决不"
# Fixed value: sentence ends.
SENTENCE_END = "[。！？；…—]+"
# Speech acts, their labels, and (act, confidence, pattern) in order of rule.
ACT_LABELS = {"invite": "邀请", "evade": "回避", "question": "质问", "commit": "承诺", "console": "宽慰", "restrain": "克制", "affirm_presence": "存在确认", "promise_remember": "记忆承诺", "farewell": "告别", "soothe": "安抚"}
ACT_RULES = [
    ("invite", 0.85, r"(你|您)(愿意|想|要不要).{1,15}[吗？?]"),
    ("invite", 0.9, r"我们一起.{1,10}"),
    ("invite", 0.8, r"(不如|要不|让我们).{1,10}[吧。]"),
    ("invite", 0.7, r"来吧"),
    ("evade", 0.75, r".{0,8}(?:…{2,}|\.{6,})$"),
    ("evade", 0.7, r"^(?:…{2,}|\.{6,})"),
    ("evade", 0.8, r"你呢[？?]"),
    ("evade", 0.7, r"(也许|或许|大概|可能).{0,10}$"),
    ("evade", 0.65, r"我不知道.{0,5}$"),
    ("question", 0.8, r"为什么.{1,15}[？?]"),
    ("question", 0.75, r"你(觉得|认为|打算).{1,15}[？?]"),
    ("question", 0.85, r"(难道|岂).{1,15}[？?]"),
    ("commit", 0.85, r"我(会|一定|绝不|将).{1,20}$"),
    ("commit", 0.8, r"(一定|必定|绝对).{1,15}"),
    ("commit", 0.75, r"请(相信|放心).{0,10}"),
    ("console", 0.9, r"不是你的错"),
    ("console", 0.85, r"你不必.{1,15}"),
    ("console", 0.85, r"(已经足够|不要紧)"),
    ("console", 0.8, r"没关系(?!.{0,5}[。…])"),
    ("console", 0.75, r"我(理解|明白|知道你的).{0,10}"),
    ("restrain", 0.8, r"[悲伤痛苦遗憾].{0,5}[………]"),
    ("restrain", 0.7, r"我(知道|明白).{0,8}$"),
    ("restrain", 0.7, r"没关系.{0,5}[。…]"),
    ("affirm_presence", 0.9, r"我在"),
    ("promise_remember", 0.85, r"我会记住"),
    ("farewell", 0.8, r"再(见|会)[。…]?"),
    ("farewell", 0.75, r"保重"),
    ("soothe", 0.7, r"(好了|没事|别担心)"),
    ("soothe", 0.75, r"(睡吧|休息吧)"),
]
# Kind of situation by words of scene, text and narration; the first kind that has one wins.
SITUATIONS = {
    "confront": ["战斗", "敌", "进攻", "撤退", "交战", "对峙", "冲突", "攻击", "防线"],
    "comfort": ["安慰", "不必", "没关系", "不是你的错", "不要紧", "已经足够"],
    "decide": ["决定", "必须", "只能如此", "没有选择", "别无选择", "这是我的选择"],
    "reminisce": ["回忆", "过去", "曾经", "记得", "那时候", "还记得", "从前"],
    "command": ["命令", "执行", "立刻", "全员", "出发", "集合"],
}
# Titles of voice lines -> interlocutor, and -> situation, each in order.
VOICE_INTERLOCUTOR = [("信赖触摸", "博士"), ("晋升后交谈1", "博士"), ("晋升后交谈2", "博士"), ("精二晋升后交谈", "博士"), ("任命助理", "博士"), ("4星结束", None), ("3星结束", None)]
VOICE_SITUATION = [("信赖触摸", "comfort"), ("信赖", "comfort"), ("战斗开始", "confront"), ("战斗失败", "confront"), ("精二晋升后交谈", "casual"), ("晋升后交谈", "casual"), ("晋升", "casual"), ("助理", "casual"), ("交谈", "casual"), ("进驻", "casual"), ("编入", "casual"), ("精英化", "casual")]
# Periods, their order, and what names them.
PHASES = ["early", "babel", "resurrected"]
PHASE_PATTERNS = [("babel", r"魔王.{0,10}(?:卡兹戴尔|回归|归来)"), ("resurrected", r"(?:复活|苏醒|重获).{0,10}(?:身体|力量|记忆)")]
PHASE_WORDS = {"babel": ["巴别塔", "内战", "卡兹戴尔重建", "和平协议", "卡兹戴尔的和平"], "resurrected": ["黑冠", "赦罪师", "巫术"]}
CHAPTERS = [
    ("第0章", "early"),
    ("第1章", "early"),
    ("第2章", "early"),
    ("第3章", "early"),
    ("第4章", "early"),
    ("第5章", "early"),
    ("第6章", "early"),
    ("第7章", "early"),
    ("第8章", "babel"),
    ("第9章", "babel"),
    ("第10章", "resurrected"),
    ("第11章", "resurrected"),
    ("第12章", "resurrected"),
    ("第13章", "resurrected"),
    ("第14章", "resurrected"),
    ("BB-", "babel"),
    ("LT-", "resurrected"),
    ("H10-", "resurrected"),
    ("H11-", "resurrected"),
    ("H12-", "resurrected"),
    ("H14-", "resurrected"),
    ("DM-", "early"),
    ("WD-", "early"),
]
ACTIVITIES = [("巴别塔", "babel"), ("慈悲灯塔", "resurrected"), ("伦蒂尼姆", "resurrected"), ("生于黑夜", "early"), ("切尔诺伯格", "early"), ("遗尘漫步", "early")]
CATEGORIES = [
    ("属于巴别塔的干员", "babel"),
    ("属于罗德岛的干员", "resurrected"),
    ("属于整合运动的干员", "early"),
    ("属于卡兹戴尔的干员", "early"),
    ("属于维多利亚的干员", "resurrected"),
    ("属于拉特兰的干员", "early"),
    ("属于莱塔尼亚的干员", "early"),
    ("属于乌萨斯的干员", "early"),
    ("属于炎国的干员", "early"),
    ("属于汐斯塔的干员", "early"),
]
FACTIONS = [("巴别塔", "babel"), ("罗德岛", "resurrected"), ("整合运动", "early"), ("卡兹戴尔", "early")]
# What a category says of a page, codes of chapters and the pages of their activities, the template and fields of those pages.
MEMBER, SIDE_STORY, MAIN_STORY = "干员", "支线故事", "主线"
CODE_PAGES = [("DM", "生于黑夜"), ("BB", "巴别塔"), ("WD", "遗尘漫步"), ("LT", "伦蒂尼姆")]
ACTIVITY_TEMPLATE, ACTIVITY_NAMES, ACTIVITY_TYPE = "活动信息", ["名称缩短", "名称"], "类型"
CLUSTER_WORDS = {
    "early": ["切尔诺伯格", "整合运动", "塔露拉", "天灾", "矿石病", "感染者", "佣兵", "雇佣兵", "战场", "撤退", "行动"],
    "babel": ["巴别塔", "特蕾西娅", "特雷西斯", "卡兹戴尔", "内战", "萨卡兹", "王旗", "正统", "摄政王", "和平协议"],
    "resurrected": ["伦蒂尼姆", "飞空艇", "黑冠", "赦罪师", "巫术", "复活", "飞地", "城防", "维多利亚"],
}
SCENE_WORDS = [("babel", ["巴别塔", "内战", "卡兹戴尔"]), ("resurrected", ["复活", "黑冠", "赦罪师"])]
DEFAULT_PHASES = {"魔王": "resurrected", "W": "early"}
# Kinds of relation by words, in order; vetoes of a sentence; strength of a mention by number of words found.
RELATIONS = [("sibling", "胞兄|哥哥|兄长|亲兄"), ("sibling", "胞妹|妹妹|亲妹|姐姐"), ("parent_child", "父亲|母亲|父|母|养育|抚养"), ("parent_child", "女儿|儿子|孩子|继承者|传人"), ("comrade", "战友|同袍|并肩|一起战斗|共同"), ("subordinate", "部下|追随者|手下|部属"), ("superior", "上级|长官|领袖|领导"), ("opponent", "敌人|对手|对抗|对立|敌对|反对"), ("opponent", "内战|交战|战斗|战争"), ("trust", "信任|相信|托付|依赖|依靠|信赖"), ("betrayal", "背叛|出卖|欺骗"), ("mentor", "教导|教授|培养|训练|指导|师父|师傅"), ("student", "学生|徒弟|学到了|教会"), ("affection", "温柔|关怀|呵护|珍视|在乎|牵挂"), ("hatred", "恨|愤怒|厌恶|憎恨")]
RELATION_VETO = ["≠", "不是", "并非", "不等于", "误解", "错误", "没有", "不曾", "未尝", "并不"]
# Fields of claims with the patterns whose first group is the value.
CLAIMS = [
    ("race", "种族", r"种族[：:]\s*(萨卡兹|卡特斯|佩洛|鲁珀|菲林|瓦伊凡|鬼|德拉克|里拉|黎博利|龙|沃尔珀|阿达克利斯|安努拉|埃德菲尔|菲尼克斯|未知)(?:\s|混血|[，,\n。]|$)"),
    ("race", "种族", r"(?:是|身为)(萨卡兹|卡特斯|佩洛|鲁珀|菲林|瓦伊凡|鬼|德拉克|里拉|黎博利|龙|沃尔珀|未知)"),
    ("faction", "阵营", r"阵营[：:]\s*(巴别塔|罗德岛|整合运动|龙门近卫局|龙门|卡兹戴尔|莱茵生命|喀兰贸易|维多利亚|深池|谢拉格|乌萨斯|炎国|东国|叙拉古|伊比利亚|萨米)(?:\s|[，,\n。]|$)"),
    ("faction", "阵营", r"(巴别塔|罗德岛|整合运动|龙门|卡兹戴尔|莱茵生命|喀兰贸易|维多利亚|深池)(?:的|创始人|成员|领袖|核心)"),
    ("identity", "身份", r"身份[：:]\s*([^\n,，。]{2,30})"),
    ("identity", "身份", r"是([^\n,，。]*?(?:魔王|领袖|摄政王|干员|创始人|指挥官|战士|学者|公爵|骑士|医生|猎人))(?:[，,\n。]|$)"),
    ("mbti", "MBTI", r"MBTI[：:]\s*([A-Z]{4})"),
    ("mbti", "MBTI", r"(INFJ|INTJ|INFP|ENFP|ENTJ|ISTJ|ISFJ|ESFJ|ESTJ|ESTP|ESFP|ISTP|ISFP|ENTP|INTP)"),
]
CORRECTING = ["不是", "并非", "并不", "没有", "错误", "误解", "不等于", "不同于"]
# Well-known errors: id, wrong, correct, patterns, patterns of texts that correct it.
MISCONCEPTIONS = [
    ("M001", "特蕾西娅是维多利亚的实际统治者", "特蕾西娅是卡兹戴尔正统萨卡兹魔王，维多利亚摄政王是特雷西斯", [r"特蕾西娅.*维多利亚.*(统治|摄政|女王|掌权)"], [r"特雷西斯.*维多利亚.*(摄政|统治)", r"维多利亚.*摄政.*特雷西斯", r"特蕾西娅[^，。]*不是.*维多利亚"]),
    ("M002", "特蕾西娅属于整合运动", "特蕾西娅创立的是巴别塔（罗德岛前身），整合运动是塔露拉领导的独立组织", [r"特蕾西娅.*整合运动"], [r"特蕾西娅[^，。]*不属于?整合运动", r"特蕾西娅[^，。]*不是.*整合运动"]),
    ("M003", "「让所有人为我而死，这便是慈悲」是特蕾西娅的理念", "这不是她的理念或原话，她主张和平重建、尽量减少牺牲", [r"为我而死.*慈悲|慈悲.*为我而死", r"让所有人.*死.*慈悲"], [r"不是.{0,5}(特蕾西娅|她)的理念", r"错误归因.{0,5}(特蕾西娅|她)", r"(特蕾西娅|她).{0,10}(不是|并非).{0,10}(理念|原话)"]),
    ("M004", "特雷西斯是纯粹的恶人", "特雷西斯理念与特蕾西娅对立但并非单纯恶人，曾主动放弃魔王之位为胞妹加冕", [r"特雷西斯.*(纯粹|完全|绝对是).*恶|邪恶"], [r"特雷西斯[^，。]*(不是|并非).*(纯粹|完全|绝对).*恶", r"并非单纯.*恶人"]),
]
RELIABILITY = [("wiki", "high"), ("game_text", "high"), ("official", "high"), ("community_research", "medium"), ("fan", "low"), ("unknown", "medium")]
# Words that make a taboo testable.
TABOO_WORDS = ["牺牲", "棋子", "放弃", "消灭", "贱民", "低等", "去死", "杀了", "弄死", "处死"]
# What a rule that forbids something forbids: kind, words in the rule, pattern to look for, description. Of the
# kind quote the pattern is what the words capture, of the kind denied every quotation with a denial before it.
OPENING, CLOSING = "「“‘", "」”’"
FORBIDDEN = [
    ("cue", r"不.*感叹号|没有感叹号|不用！", r"[！!]", "使用了感叹号"),
    ("cue", r"不.*命令", r"命令|给我|必须|立刻|马上", "使用了命令式语气"),
    ("quote", r"不(?:会|用|说|能)?[「“‘]([^」”’]{2,20})[」”’]", None, "使用了'{}'"),
    ("cue", r"不.*(?:哭|流泪|泪水)", r"哭了|流泪|泪流|泪水", "出现了哭泣描写"),
    ("cue", r"不.*(?:咆哮|吼|大喊)", r"咆哮|怒吼|大吼|吼道|大喊", "出现了咆哮描写"),
    ("quote", r"从不(?:会|用|说|能)?[「“‘]([^」”’]{2,20})[」”’]", None, "使用了'{}'"),
    ("denied", r"[「“‘]([^」”’]+)[」”’]", None, "使用了反例表达'{}'"),
]
# Headings of a description's parts, and the entries of its style part.
PERSONA_PARTS = {"layer0": r"Layer\s*0", "style": r"Layer\s*2", "layer5": r"Layer\s*5", "corrections": r"Correction\s*记录"}
PERSONA_STYLE = {"catchphrases": "口头禅", "frequent_words": "高频词", "self_reference": "自称"}
NO_CORRECTIONS = "暂无"


def words(s: list[str]) -> list[str]:
    """The words of a list above."""
    return s


@dataclass(frozen=True)
class PhaseRules:
    """What tells the period of a text: a rule pack of another world is another instance."""

    order: list[str]
    patterns: list[tuple[str, str]] = field(default_factory=list)
    words: dict[str, list[str]] = field(default_factory=dict)
    chapters: list[tuple[str, str]] = field(default_factory=list)
    activities: list[tuple[str, str]] = field(default_factory=list)
    categories: list[tuple[str, str]] = field(default_factory=list)
    factions: list[tuple[str, str]] = field(default_factory=list)
    cluster_words: dict[str, list[str]] = field(default_factory=dict)
    scene_words: list[tuple[str, list[str]]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    code_pages: list[tuple[str, str]] = field(default_factory=list)
    first: str = "early"
    main_story: list[tuple[int, str]] = field(default_factory=list)


#: The rule pack of the lists above. main_story: the least chapter of each period, the latest first.
ZH = PhaseRules(PHASES, PHASE_PATTERNS, PHASE_WORDS, CHAPTERS, ACTIVITIES, CATEGORIES, FACTIONS, CLUSTER_WORDS, SCENE_WORDS, DEFAULT_PHASES, CODE_PAGES, "early", [(10, "resurrected"), (8, "babel"), (0, "early")])
