"""Pattern tables: the fixed set for Chinese session logs and a set for the invented-word tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PatternSet:
    """Categories in order of priority, and rules in order of definition, each with its regular expressions."""

    categories: dict[str, list[str]]
    rules: dict[str, list[str]]
    dense_marker: str
    late_rule: str = "late_constraint"
    chain_rules: tuple[str, ...] = ("scope_clarification", "token_budget_control", "late_constraint")
    suggestions: dict[str, str] = field(default_factory=dict)


# Priority order, labels, default constraints and suggestions of the categories.
PRIORITY = ["direction_mismatch", "verbosity_mismatch", "style_mismatch", "format_mismatch", "late_constraint"]
CATEGORY_LABELS = {
    "direction_mismatch": "方向/对象理解偏了",
    "verbosity_mismatch": "长度/密度不对",
    "style_mismatch": "表达风格不对",
    "format_mismatch": "输出形式/展示方式不对",
    "late_constraint": "关键限制说晚了",
}
CATEGORY_SUGGESTIONS = {
    "direction_mismatch": "首条 prompt 先写清对象、边界、不要处理什么，再开始执行。",
    "verbosity_mismatch": "把长度、密度、是否展开写成固定前置要求。",
    "style_mismatch": "提前说明语气、正式度、是否允许 AI 味。",
    "format_mismatch": "提前说明输出形式：代码块/列表/可复制文本/不要表格。",
    "late_constraint": "把“先讨论还是先执行、是否允许大搜索、token 预算”放到首条 prompt。",
}
MISSING_CONSTRAINT = {
    "direction_mismatch": "对象/边界",
    "verbosity_mismatch": "长度/信息密度",
    "style_mismatch": "风格/语气",
    "format_mismatch": "输出格式/展示方式",
    "late_constraint": "执行顺序/操作边界/预算限制",
}
# Descriptions and suggestions of the rules.
RULE_TEXTS = {
    "scope_clarification": ("用户需要反复收窄对象或纠正 agent 的理解范围。", "把对象、边界、不要做什么放进首条需求里，而不是等 agent 跑偏后再纠正。"),
    "token_budget_control": ("用户明显在意 token 成本，并多次强调约束。", "把 token 预算、禁止大搜索、优先局部检查写成固定前置模板。"),
    "exploratory_request": ("请求偏探索/观察，没有明确成功标准。", "测试型请求最好明确输入、预期输出、是否只做演示。"),
    "late_constraint": ("关键约束出现在后续纠偏回合，而不是最开始。", "把关键限制（对象、边界、验证方式）提前到首轮 prompt。"),
}
# The patterns for Chinese logs.
SESSION_LOGS = PatternSet(
    categories={
        "direction_mismatch": ["不是这个意思", "我指的是", "这里指的其实就是", "我们先对齐", "先对齐一下", "明白我意思吗", "你理解错", "你为什么会执行", "真正要解决的目标", "根目标", "风险边界", "定义清楚"],
        "verbosity_mismatch": ["简洁一点", "高密度短答案", "只在必要时展开", "不要输出长篇大论", "太长了", "短一点", "别展开太多", "简洁总结", "简短一点"],
        "style_mismatch": [r"不要这么\s*ai", r"太\s*ai", "太正式", "太死板", "这个介绍有点太土", "风格不对"],
        "format_mismatch": ["代码块", "markdown", "方便复制", "竖着的", "列向量", "control o to expand", "显示其实有点奇怪", "格式不对", "图片有点太大"],
        "late_constraint": ["先不要", "先别", "先讨论", "先判断", "不要直接执行", "最小充分", "控制 token", "避免.?大范围 grep", "无目标搜索", "过量上下文", "低价值步骤", "不要做任何改动"],
    },
    rules={
        "scope_clarification": ["我指的是", "不是这个意思", "先对齐", "明白我意思吗", "你为什么", "我说的是", "这里指的其实就是"],
        "token_budget_control": ["最小充分操作", "控制 token", "避免.?大范围 grep", "无目标搜索", "过量上下文", "低价值步骤", "大范围 grep", "注意控制 token"],
        "exploratory_request": ["随便用", "看一下工具的效果", "试一下", "什么情况", "看一下"],
        "late_constraint": ["注意控制 token", "先对齐", "你先等一下", "我们先对齐", "先看一下"],
    },
    dense_marker="请保持分析深度",
)


def word(w: str) -> str:
    """A whole ASCII word, without word boundaries, on which engines differ."""
    return f"(^|[^A-Za-z]){w}([^A-Za-z]|$)"


INVENTED_WORDS = PatternSet(
    categories={c: [word(w)] for c, w in zip(PRIORITY, ("that", "with", "der", "la", "from"), strict=True)},
    rules={"scope_clarification": [word("that")], "token_budget_control": [word("with")], "exploratory_request": [word("this")], "late_constraint": [word("from"), word("der")]},
    dense_marker="tion",
)


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs, whatever the case; one alternation, compiled once per task."""
    return text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def matched(text: Column, table: dict[str, list[str]], order: list[str] | None = None) -> Column:
    """Names of the matching entries in order."""
    return F.array_compact(F.array(*[F.when(matches(text, table[c]), F.lit(c)) for c in order or table]))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A constant per key, as one CASE."""
    items = list(table.items())
    return reduce(lambda out, kv: out.when(key == kv[0], kv[1]), items[1:], F.when(key == items[0][0], items[0][1]))
