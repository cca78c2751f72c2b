"""Python files, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from codeloom.extract.base import Edge, Lines, Parsed, Unit


def visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__") and len(name) > 4:
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def offsets(lines: Lines, node: ast.AST) -> tuple[int, int]:
    """Character offsets of a node; the tree counts columns in bytes."""
    def at(line: int, column: int) -> int:
        start = lines.starts[line - 1]
        if lines.ascii:
            return start + column
        end = lines.starts[line] if line < len(lines.starts) else len(lines.text)
        return start + len(lines.text[start:end].encode()[:column].decode(errors="ignore"))

    return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{head} {node.name}({ast.unparse(node.args)}){back}"


def longest_valid(text: str) -> tuple[ast.Module | None, list[str]]:
    """The tree, or that of the text with the lines that do not parse blanked, up to fifty of them."""
    errors, lines = [], text.split("\n")
    for _ in range(50):
        try:
            return ast.parse("\n".join(lines)), errors
        except (SyntaxError, ValueError, RecursionError) as e:
            n = getattr(e, "lineno", None)
            errors.append(f"{n or 0}: {getattr(e, 'msg', e)}")
            if not n or n > len(lines) or not lines[n - 1].strip():
                break
            indent = lines[n - 1][: len(lines[n - 1]) - len(lines[n - 1].lstrip())]
            lines[n - 1] = f"{indent}pass" if len(indent) + 4 <= len(lines[n - 1]) else ""
    return None, errors


def parse(text: str, path: str) -> Parsed:
    tree, errors = longest_valid(text)
    units: list[Unit] = []
    edges: list[Edge] = []
    if tree is None:
        return Parsed(units, edges, errors)
    lines = Lines(text)
    module = path.rpartition("/")[2].rpartition(".")[0] or path

    def visit(body: list[ast.stmt], outer: tuple[str, ...], in_class: bool, in_function: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = ".".join((*outer, node.name))
                bases = tuple(ast.unparse(b) for b in node.bases)
                units.append(Unit("class", node.name, *offsets(lines, node), name, f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), ast.get_docstring(node) or "", visibility(node.name), bases=bases))
                edges.extend(Edge("inherits", name, b, node.lineno) for b in bases)
                edges.extend(Edge("decorates", ast.unparse(d), name, d.lineno) for d in node.decorator_list)
                visit(node.body, (*outer, node.name), True, False)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                name = ".".join((*outer, node.name))
                units.append(Unit("method" if in_class else "function", node.name, *offsets(lines, node), name, signature(node), ast.get_docstring(node) or "", visibility(node.name), isinstance(node, ast.AsyncFunctionDef)))
                if in_class:
                    edges.append(Edge("contains", ".".join(outer), name, node.lineno))
                edges.extend(Edge("decorates", ast.unparse(d), name, d.lineno) for d in node.decorator_list)
                edges.extend(Edge("calls", name, ast.unparse(c.func), c.lineno) for c in calls(node))
                visit(node.body, (*outer, node.name), False, True)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                origin = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
                for a in node.names:
                    target = f"{origin}.{a.name}".strip(".") if isinstance(node, ast.ImportFrom) else a.name
                    units.append(Unit("import", a.asname or a.name, *offsets(lines, node), target, ast.unparse(node), targets=(target,)))
                    edges.append(Edge("imports", module, target, node.lineno))
            elif isinstance(node, ast.Assign | ast.AnnAssign) and not in_function:
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                names = [t for x in targets for t in (x.elts if isinstance(x, ast.Tuple | ast.List) else [x]) if isinstance(t, ast.Name)]
                for t in names:
                    kind = "constant" if t.id.isupper() and "_" in t.id else "variable"
                    shown = f"{t.id}: {ast.unparse(node.annotation)}" if isinstance(node, ast.AnnAssign) else t.id
                    units.append(Unit(kind, t.id, *offsets(lines, node), ".".join((*outer, t.id)), shown, visibility=visibility(t.id)))
            else:
                for part in ("body", "orelse", "finalbody"):
                    inner = getattr(node, part, None)
                    if isinstance(inner, list) and inner and isinstance(inner[0], ast.stmt):
                        visit(inner, outer, in_class, in_function)
                for h in getattr(node, "handlers", []):
                    visit(h.body, outer, in_class, in_function)

    def calls(node: ast.AST):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(child, ast.Call):
                yield child
            yield from calls(child)

    visit(tree.body, (), False, False)
    return Parsed(units, edges, errors)


def tree_rows(text: str, max_nodes: int = 1000, max_depth: int = 15, max_children: int = 20) -> list[tuple[int, int | None, str, int, int]]:
    """(id, parent, node type, line, depth) of the syntax tree, within the caps."""
    tree, _ = longest_valid(text)
    out: list[tuple[int, int | None, str, int, int]] = []
    todo: list[tuple[ast.AST, int | None, int]] = [(tree, None, 0)] if tree else []
    while todo and len(out) < max_nodes:
        node, parent, depth = todo.pop(0)
        out.append((len(out), parent, type(node).__name__, getattr(node, "lineno", 0), depth))
        if depth < max_depth:
            todo += [(c, len(out) - 1, depth + 1) for c in list(ast.iter_child_nodes(node))[:max_children]]
    return out
