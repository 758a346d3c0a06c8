"""The rules document and the list of ignored rules of a project: where they lie, reading them again when they change, writing.

All on the driver; both files are small, and their rules become columns or a broadcast table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from ..operators.reminders import Rule, loaded

#: The setting that names a rules file, and where files lie below a project.
RULES_SETTING = "LOOMLENS_RULES_PATH"
RULES_PLACES = (".loomlens/final/reminder_rules.json", "reminder_rules.json")
IGNORED_PLACE = ".loomlens/reminder_rules_ignored.json"
#: What may be decided on a rule that asks to confirm.
DECISIONS = ("send", "cancel", "send_and_ignore")

_KEPT: dict[str, tuple[float, object]] = {}


def _again(path: Path, read: Callable[[dict], object]):
    """What ``read`` makes of the file, kept until the file's time changes."""
    key, time = str(path), path.stat().st_mtime_ns
    if key not in _KEPT or _KEPT[key][0] != time:
        _KEPT[key] = (time, read(json.loads(path.read_text(encoding="utf-8"))))
    return _KEPT[key][1]


def rules_path(project: str | Path) -> Path | None:
    """The first rules file that is there: the one that the setting names, then the project's places."""
    named = os.environ.get(RULES_SETTING)
    places = [Path(named)] if named else []
    places += [Path(project) / p for p in RULES_PLACES]
    return next((p for p in places if p.exists()), None)


def load_rules(project: str | Path, warn: Callable[[str], None] = lambda _: None) -> list[Rule]:
    """The project's enabled rules; none if there is no file, or (with a warning) if it cannot be read."""
    path = rules_path(project)
    if path is None:
        return []
    try:
        return _again(path, loaded)
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        warn(f"{path}: {error}")
        return []


def _ids(document: dict) -> frozenset[str]:
    if not isinstance(document, dict) or not isinstance(document.get("ignored_rule_ids"), list):
        raise ValueError("ignored_rule_ids must be an array")
    return frozenset(document["ignored_rule_ids"])


def load_ignored(project: str | Path, warn: Callable[[str], None] = lambda _: None) -> frozenset[str]:
    """Ids of the rules that the project ignores; a file that cannot be read counts as empty."""
    path = Path(project) / IGNORED_PLACE
    if not path.exists():
        return frozenset()
    try:
        return _again(path, _ids)
    except ValueError as error:
        warn(f"{path}: {error}")
        return frozenset()


def _save(project: str | Path, ids: frozenset[str]) -> None:
    path = Path(project) / IGNORED_PLACE
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"ignored_rule_ids": sorted(ids)}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    _KEPT.pop(str(path), None)


def ignore(project: str | Path, rule_id: str) -> None:
    _save(project, load_ignored(project) | {rule_id})


def reset_ignored(project: str | Path) -> None:
    _save(project, frozenset())


def decide(project: str | Path, rule: Rule, decision: str, seen: set[str]) -> bool:
    """Carries out a decision on a rule; tells whether the text is sent. A sent rule of cooldown session_once is seen from then on."""
    if decision not in DECISIONS:
        raise ValueError(f"unknown decision: {decision}")
    if decision == "cancel":
        return False
    if decision == "send_and_ignore":
        ignore(project, rule.id)
    if rule.cooldown == "session_once":
        seen.add(rule.id)
    return True
