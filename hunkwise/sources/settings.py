"""Settings of a driver, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import lru_cache

# Settings that must be there, and those with defaults.
REQUIRED = ["MODEL_LLM", "BASE_URL", "OPENROUTER_API_KEY", "GITLAB_URL", "GITLAB_TOKEN", "GITLAB_PROJECT_ID", "JIRA_URL", "JIRA_EMAIL", "JIRA_API_TOKEN", "MATTERMOST_URL", "MATTERMOST_BOT_TOKEN"]
DEFAULTS = {"AGENT_CONTEXT_PATH": "AGENT.md", "LOG_DIR": "logs", "LOG_LEVEL": "INFO", "LOG_FILE_NAME": "review.log", "LOG_BACKUP_DAYS": "30"}
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def load(env: Mapping[str, str]) -> dict[str, str | int]:
    """All settings by name; the first that is missing, empty or not allowed raises."""
    for name in REQUIRED:
        if not env.get(name):
            raise ValueError(f"{name} is required")
    out: dict[str, str | int] = {n: env[n] for n in REQUIRED} | {n: env.get(n, d) for n, d in DEFAULTS.items()}
    out["LOG_LEVEL"] = str(out["LOG_LEVEL"]).upper()
    if out["LOG_LEVEL"] not in LEVELS:
        raise ValueError(f"LOG_LEVEL {out['LOG_LEVEL']} is none of {', '.join(sorted(LEVELS))}")
    return out | {"LOG_BACKUP_DAYS": int(out["LOG_BACKUP_DAYS"])}


@lru_cache
def settings() -> dict[str, str | int]:
    return load(os.environ)
