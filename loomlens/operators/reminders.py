"""Reminder rules: matching texts, choosing what is shown, and cooldown."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of


@dataclass(frozen=True)
class Rule:
    id: str
    mode: str = "notify"
    any_terms: tuple[str, ...] = ()
    all_groups: tuple[tuple[str, ...], ...] = ()
    anti_patterns: tuple[str, ...] = ()
    cooldown: str = "turn_once"
    confidence: str = "high"
    message: str = ""
    suggestion: str = ""
    #: Terms of a guide text that call for the rule, and those whose lines are its evidence.
    guide_terms: tuple[str, ...] = ()
    evidence_terms: tuple[str, ...] = field(default=())


# The six rules that a guide text can call for.
_README = ("README", "包页", "pi.image", "徽章", "元数据", "预览图")
_PUBLISH = ("push", "publish", "commit", "发布", "发版")
_NETWORK = ("网络", "HTTP", "curl", "ping")
GUIDE_RULES = [
    Rule("design-boundary-clarify", "notify", (), (("设计", "方案", "边界", "路线"), ("判断", "确认", "评审", "先看", "先审")), ("直接改", "直接实现", "不用讨论"), "session_once", "high", "这类请求通常先确认：先审方案/边界，还是直接实现。", "可补一句：先判断目标和路线，再动手。", ("设计", "边界", "方案", "路线"), ("设计", "边界", "路线", "方案")),
    Rule("readme-display-scope-clarify", "notify", _README, (), ("只看页面文案，不动发布物",), "turn_once", "high", "这类请求最好先分清：根 README、包内同步、pi.image、包页展示是否都要一起处理。", "可补一句：只改根 README，还是要连包内同步和 pi.image 一起处理？", _README, ("README", "包页", "pi.image", "元数据")),
    Rule("preview-before-release", "notify", ("README", "包页", "展示", "预览", "图片", "badge", "npm pack"), (("提交", "发布", "push", "publish"),), ("不用预览", "直接发", "直接发布"), "turn_once", "medium", "建议先预览 README / 包页效果，再决定是否提交或发布。", "可补一句：先预览，不要先提交/发布。", _README, ("预览", "提交", "发布", "README", "包页")),
    Rule("publish-confirm", "confirm", ("push", "publish", "npm publish", "commit", "发版", "发布"), (), ("不要 push", "不要 publish", "只本地", "先别发", "暂不发布"), "turn_once", "high", "检测到外部发布/推送动作。这类操作最好和本地修改分开确认。", "建议先明确：这次只本地修好，还是要一起 commit / push / publish？", _PUBLISH, _PUBLISH),
    Rule("network-validation-clarify", "notify", (), (("网络", "联网", "HTTP", "curl", "ping"), ("验证", "测试", "检查", "可用", "能不能", "通不通")), ("只改 network 配置说明", "不是在测网络"), "turn_once", "high", "网络验证最好先区分：你要确认的是 HTTP/curl，可不一定要用 ping。", "可补一句：这次是测 HTTP 可用，还是连 ping 也要确认？", _NETWORK, _NETWORK),
    Rule("sandbox-mode-clarify", "notify", ("readonly", "workspace-write", "network", "沙盒", "权限模式"), (("验证", "测试", "检查", "模式"),), ("只是在解释文档里的模式",), "turn_once", "medium", "涉及沙盒/权限时，最好先说明要验证哪种模式和哪类命令。", "可补一句：这次测 readonly / workspace-write / network 哪一种？", ("readonly", "workspace-write", "network", "沙盒", "权限模式"), ("readonly", "workspace-write", "network", "沙盒", "权限")),
]

#: Rules whose terms occur in the tables of invented words.
TABLE_RULES = [
    Rule("scope", "notify", (), (("tion", "ment"), ("that", "que")), ("blees",), "session_once", "high"),
    Rule("release", "confirm", ("orth", "sting"), (), ("eron",), "turn_once", "high"),
    Rule("preview", "notify", ("this", "from"), (("in",),), (), "turn_once", "medium"),
    Rule("length", "notify", ("with", "nicht"), (), (), "session_once", "low"),
]

#: Weights that order matches.
CONFIDENCE_WEIGHT = {"high": 3, "medium": 2, "low": 1}
MODE_WEIGHT = {"confirm": 10, "notify": 0}


def rules_for_guide(guide: str, rules: list[Rule] | None = None) -> list[Rule]:
    """The rules that a guide text calls for."""
    return [r for r in rules or GUIDE_RULES if any(t in guide for t in r.guide_terms)]


def evidence_lines(guide: Column, terms: list[str], k: int = 3) -> Column:
    """The first k lines, stripped, that hold any of the terms."""
    lines = F.transform(F.split(guide, "\n"), lambda x: F.trim(x))
    return F.slice(F.filter(lines, lambda x: (x != "") & any_of(x, terms)), 1, k)


def _count(low: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(low, F.lit(t.lower())).cast("int")
    return out


def score(text: Column, rule: Rule) -> Column:
    """Null without a match; else the any-terms that occur plus the groups with a hit. Terms are substrings, whatever the case."""
    low = F.lower(text)
    n_any = _count(low, rule.any_terms)
    groups = [_count(low, g) > 0 for g in rule.all_groups]
    ok = ~(_count(low, rule.anti_patterns) > 0) if rule.anti_patterns else F.lit(True)
    if rule.any_terms:
        ok = ok & (n_any > 0)
    for g in groups:
        ok = ok & g
    return F.when(ok, n_any + sum((g.cast("int") for g in groups), F.lit(0)))


def matches(turns: DataFrame, rules: list[Rule] = TABLE_RULES) -> DataFrame:
    """One row per turn and matching rule with its rank key; rules are columns, so nothing is joined."""
    each = [F.struct(F.lit(i).alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.mode).alias("mode"), F.lit(r.cooldown).alias("cooldown"), F.lit(MODE_WEIGHT[r.mode] + CONFIDENCE_WEIGHT.get(r.confidence, 1)).alias("weight"), score(F.col("text"), r).alias("score")) for i, r in enumerate(rules)]
    hit = F.explode(F.filter(F.array(*each), lambda m: m["score"].isNotNull()))
    return turns.select("session_file", "turn_index", hit.alias("m")).select("session_file", "turn_index", "m.*").withColumn("rank", F.col("weight") + F.col("score"))


def without_ignored(found: DataFrame, ignored: DataFrame) -> DataFrame:
    return found.join(ignored.select("rule_id"), "rule_id", "left_anti")


def cooled(found: DataFrame) -> DataFrame:
    """Rules of cooldown session_once match only where they do first in a session."""
    first = F.min("turn_index").over(Window.partitionBy("session_file", "rule_id"))
    return found.withColumn("first", first).where((F.col("cooldown") != "session_once") | (F.col("turn_index") == F.col("first"))).drop("first")


def visible(found: DataFrame, notes: int = 2) -> DataFrame:
    """Of a turn's matches the best that asks to confirm; without one, the two best that notify."""
    turn = Window.partitionBy("session_file", "turn_index")
    by_mode = Window.partitionBy("session_file", "turn_index", "mode").orderBy(F.desc("rank"), "rule_ord")
    rows = found.select("*", F.row_number().over(by_mode).alias("place"), F.max(F.col("mode") == "confirm").over(turn).alias("asks"))
    return rows.where(F.when(F.col("asks"), (F.col("mode") == "confirm") & (F.col("place") == 1)).otherwise(F.col("place") <= notes)).drop("asks")


def generated(guide: str, rules: list[Rule] | None = None) -> dict:
    """The rules document for a guide: each rule that it calls for, with the guide's lines that are its evidence."""
    lines = [x.strip() for x in guide.splitlines()]
    found = [{
        "id": r.id, "mode": r.mode, "must_match_any": list(r.any_terms), "must_match_all_groups": [list(g) for g in r.all_groups], "anti_patterns": list(r.anti_patterns), "message": r.message,
        "suggestion": r.suggestion, "evidence": [x for x in lines if x and any(t in x for t in r.evidence_terms)][:3], "cooldown": r.cooldown, "confidence": r.confidence, "enabled": True,
    } for r in rules_for_guide(guide, rules)]
    return {"version": "v1", "default_enabled": True, "rules": found}


def loaded(document: dict) -> list[Rule]:
    """The rules of a document that are enabled and hold what a rule must."""
    if not document.get("default_enabled", True):
        return []
    rows = [r for r in document.get("rules", []) if r.get("enabled", True) and r.get("id") and r.get("message") and r.get("mode") in MODE_WEIGHT]
    return [
        Rule(r["id"], r["mode"], tuple(r.get("must_match_any", ())), tuple(map(tuple, r.get("must_match_all_groups", ()))), tuple(r.get("anti_patterns", ())), r.get("cooldown", "turn_once"), r.get("confidence", "medium"), r["message"], r.get("suggestion", ""))
        for r in rows
    ]


def valid(rules: DataFrame) -> DataFrame:
    """Rules with an id, a known mode and a message: what a rules document must hold."""
    return rules.withColumn("valid", F.coalesce((F.col("id") != "") & F.col("mode").isin("notify", "confirm") & (F.col("message") != ""), F.lit(False)))
