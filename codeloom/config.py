"""Project files: JSON with ${variables}, defaults, and environment variables over them.

CODELOOM_NAME sets `name`; two underscores lead into a nested object, so that
CODELOOM_LIMITS__FILE_MB sets `limits.file_mb`.  A value takes the type of the one
it replaces; where there is none, it is read as JSON if it is a number, a truth
value, a list or an object, and else stays text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from string import Template
from typing import Any

PREFIX = "CODELOOM_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def substituted(value: Any, variables: Mapping[str, str]) -> Any:
    """The value with ${name} replaced in all its texts; unknown names stay."""
    if isinstance(value, dict):
        return {k: substituted(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, variables) for v in value]
    return Template(value).safe_substitute(variables) if isinstance(value, str) else value


def typed(text: str, old: Any = None) -> Any:
    low = text.strip().lower()
    if isinstance(old, bool) or old is None and low in TRUE[1:] + FALSE[1:]:
        if low not in TRUE + FALSE:
            raise ValueError(f"{text!r} is no truth value")
        return low in TRUE
    if isinstance(old, str):
        return text
    if isinstance(old, int | float):
        return type(old)(text)
    try:
        return json.loads(text)
    except ValueError:
        return text


def set_at(config: dict, path: list[str], text: str) -> None:
    """Sets a nested key, with objects made on the way where there are none."""
    for key in path[:-1]:
        if not isinstance(config.get(key), dict):
            config[key] = {}
        config = config[key]
    config[path[-1]] = typed(text, config.get(path[-1]))


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, objects within each other."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def load(path: str, defaults: dict | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """The project file over the defaults, its variables (`folder` is where it lies) filled in, and the environment over all."""
    env = os.environ if environment is None else environment
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no object")
    config = substituted(merged(defaults or {}, config), {"folder": os.path.dirname(os.path.abspath(path)), **env})
    for name in sorted(env):
        if name.startswith(PREFIX) and name != PREFIX:
            set_at(config, name.removeprefix(PREFIX).lower().split("__"), env[name])
    return config


def projects(folder: str) -> dict[str, str]:
    """Project files of a folder by the name in them; files that are none are left out."""
    out = {}
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.name.endswith(".json"):
            try:
                with open(entry.path, encoding="utf-8") as f:
                    name = json.load(f).get("name")
            except (ValueError, AttributeError):
                continue
            if name:
                out[name] = entry.path
    return out
