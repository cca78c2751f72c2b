"""JSON and YAML files: every key an entity, with containment, references and dependencies."""

from __future__ import annotations

import json
import re
from typing import Any

import yaml

from codeloom.extract.base import Edge, Parsed, Unit

MAX_DEPTH = 10
# Keys of configuration sections.
SECTIONS = frozenset(
    "config configuration settings options env environment database db server api auth security logging cache redis mongodb postgres mysql docker k8s "
    "kubernetes aws azure gcp scripts dependencies devdependencies peerdependencies optionaldependencies eslintconfig babel webpack jest husky lint-staged".split()
)
DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def without_comments(text: str) -> str:
    """JSON text with // and /* */ comments outside strings as spaces, and without trailing commas."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = n if (j := text.find("*/", i + 2)) < 0 else j + 2
        else:
            out.append(c)
            i += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def is_section(key: str) -> bool:
    return key.lower() in SECTIONS or key.endswith(("Config", "Settings", "Options"))


def signature(name: str, value: Any) -> str:
    if isinstance(value, dict):
        return f'"{name}": {{ {len(value)} properties }}'
    if isinstance(value, list):
        return f'"{name}": [ {len(value)} items ]'
    if isinstance(value, str):
        return f'"{name}": "{value[:50]}{"..." if len(value) > 50 else ""}"'
    return f'"{name}": {json.dumps(value, default=str)}'


def kind_of(value: Any) -> str:
    return "class" if isinstance(value, dict) else "variable" if isinstance(value, list) else "constant"


def flatten(value: Any, path: str = "$", depth: int = 0) -> list[tuple[str, str, Any]]:
    """(path, key, value) of all nested members, down to ten levels."""
    if depth > MAX_DEPTH:
        return []
    out = []
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        here = f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}"
        out += [(here, str(k), v), *flatten(v, here, depth + 1)]
    return out


class Finder:
    """First line of a key, looked up once."""

    def __init__(self, text: str, pattern: str):
        self.first: dict[str, int] = {}
        for m in re.finditer(pattern, text, re.M):
            self.first.setdefault(next(g for g in m.groups() if g is not None), m.start())

    def __call__(self, key: str) -> int:
        return self.first.get(key, 0)


def document(value: Any, path: str, find: Finder, root: str, units: list[Unit], edges: list[Edge], line_of) -> None:
    units.append(Unit("module", root, 0, 0, "$", signature(root, value)))
    for here, key, v in flatten(value):
        if isinstance(v, dict | list) or not here.endswith("]"):
            at = find(key)
            units.append(Unit(kind_of(v), key, at, at + len(key), here, signature(key, v)))
            parent = re.sub(r"(\.[^.\[\]]+|\[\d+\])$", "", here)
            edges.append(Edge("contains", parent or "$", here, line_of(at)))
        if key == "$ref" and isinstance(v, str):
            edges.append(Edge("references", re.sub(r"\.\$ref$", "", here), v, line_of(find("$ref"))))
    if isinstance(value, dict):
        for key, v in value.items():
            if is_section(str(key)):
                at = find(str(key))
                units.append(Unit("namespace", str(key), at, at + len(str(key)), f"$.{key}", signature(str(key), v)))
            if key in DEPENDENCIES and isinstance(v, dict):
                edges.extend(Edge("depends_on", f"$.{key}", str(d), line_of(find(str(d)))) for d in v)


def parse_json(text: str, path: str) -> Parsed:
    units: list[Unit] = []
    edges: list[Edge] = []
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value = json.loads(without_comments(text))
        except (ValueError, RecursionError) as e:
            return Parsed([], [], [f"{getattr(e, 'lineno', 0)}: {e}"])
    line_of = lambda at: text.count("\n", 0, at) + 1
    document(value, path, Finder(text, r'"((?:[^"\\]|\\.)*)"\s*:'), path.rpartition("/")[2], units, edges, line_of)
    return Parsed(units, edges)


def parse_yaml(text: str, path: str) -> Parsed:
    units: list[Unit] = []
    edges: list[Edge] = []
    line_of = lambda at: text.count("\n", 0, at) + 1
    try:
        documents = list(yaml.safe_load_all(text))
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return Parsed([], [], [f"0: {e}"])
    find = Finder(text, r"""^[ \t-]*(?:"([^"]+)"|'([^']+)'|([\w./$-]+))\s*:""")
    name = path.rpartition("/")[2]
    for i, value in enumerate(documents):
        document(value, path, find, name if len(documents) == 1 else f"{name}#{i}", units, edges, line_of)
    anchors: dict[str, int] = {}
    for m in re.finditer(r"(?<=[\s:\[,-])([&*])([\w-]+)", text):  # an alias refers to the last anchor of its name before it
        if m[1] == "&":
            anchors[m[2]] = line_of(m.start())
        elif m[2] in anchors:
            edges.append(Edge("references", f"*{m[2]}@{line_of(m.start())}", f"&{m[2]}@{anchors[m[2]]}", line_of(m.start())))
    return Parsed(units, edges)
