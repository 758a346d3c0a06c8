"""Settings of a run: from the environment, with overrides; where its folders are, and why analysis is skipped."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

#: How settings are named in the environment, words that switch a flag on, what modes there are.
PREFIX = "LOOMLENS_"
ON = ("1", "true", "yes", "on")
MODES = ("experiment", "project", "dry-run")


def env_flag(name: str, env: Mapping[str, str] | None = None) -> bool:
    return str((os.environ if env is None else env).get(name)).lower() in ON


@dataclass(frozen=True)
class Config:
    """Defaults are those of a run without any setting."""

    mode: str = "experiment"
    project_root: str | None = None
    sessions_root: str | None = None
    compiled_root: str | None = None
    runtime_root: str | None = None
    final_root: str | None = None
    experiment_name: str = "default"
    runner: str = "fake"
    prompt_version: str = "v1"
    model: str | None = None
    thinking: str | None = None
    only_chunk: str | None = None
    analysis_only: bool = False
    max_validation_retries: int = 2
    validation_threshold: float = 35.0
    write_final_to_project_root: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> Config:
        """Settings of the environment (an empty one counts as absent); ``overrides`` that are not None go first."""
        env = os.environ if env is None else env
        found: dict = {}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            if isinstance(f.default, bool):
                found[f.name] = env_flag(name, env)
            elif env.get(name):
                found[f.name] = type(f.default)(env[name]) if isinstance(f.default, (int, float)) else env[name]
        out = replace(cls(**found), **{k: v for k, v in overrides.items() if v is not None})
        if out.mode not in MODES:
            raise ValueError(f"unknown mode: {out.mode}")
        return out

    def folders(self, root: str | Path) -> dict[str, Path]:
        """Workspace, runtime and final folder; experiments lie below ``root``, a project's below the project."""
        if self.mode == "project":
            if not self.project_root:
                raise ValueError("project mode needs the project's folder")
            work = Path(self.project_root) / ".loomlens"
            runtime = Path(self.runtime_root) if self.runtime_root else work
            final = Path(self.project_root) if self.write_final_to_project_root else Path(self.final_root) if self.final_root else runtime / "final"
        else:
            work = Path(root) / "experiments" / self.experiment_name
            runtime = Path(self.runtime_root) if self.runtime_root else work / "runtime"
            final = Path(self.final_root) if self.final_root else work / "final"
        return {"workspace": work, "runtime": runtime, "final": final}

    @property
    def skip_reason(self) -> str:
        """Why the synthesis is left out."""
        return f"only_chunk={self.only_chunk}" if self.only_chunk else "analysis_only" if self.analysis_only else "disabled"


def session_cache_name(session_file: str) -> str:
    return f"{Path(session_file).stem}.json"
