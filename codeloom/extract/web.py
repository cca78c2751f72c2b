"""HTML and CSS files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from codeloom.extract.base import Edge, Lines, Parsed, Unit, blanked, block_ends, contained
from codeloom.functions.markup import COMPONENT, CUSTOM, MEDIA, VOID


class Reader(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.text, self.lines = text, Lines(text)
        self.units: list[Unit] = []
        self.edges: list[Edge] = []
        self.open: list[tuple[str, list[Unit]]] = []
        self.forms: list[Unit] = []

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        start = self.here()
        end = start + len(self.get_starttag_text() or "")
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        label = tag + (f"#{a['id']}" if a.get("id") else "") + "".join(f".{c}" for c in a.get("class", "").split())
        hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "")
        kinds = ["html_element"]
        custom = bool(re.match(CUSTOM, tag))
        kinds += ["html_component"] if custom or tag in COMPONENT else []
        kinds += ["html_form"] if tag in ("form", "input", "textarea", "select", "button") else []
        kinds += ["html_media"] if tag in MEDIA else []
        kinds += ["html_link"] if tag in ("a", "link") else []
        kinds += ["html_meta"] if tag in ("meta", "title", "base") else []
        kinds += ["html_script"] if tag == "script" else []
        kinds += ["html_style"] if tag == "style" or tag == "link" and a.get("rel") == "stylesheet" else []
        made = []
        for kind in kinds:
            made.append(Unit(kind, a.get("id") or a.get("name") or tag, start, end, label, f"<{label}>", visibility="private" if hidden else "public", extra={"tag": tag, **a}))
        if a.get("style"):
            made.append(Unit("html_style", f"{tag}[style]", start, end, f"{label}[style]", a["style"]))
        line = self.getpos()[0]
        if tag in ("a", "link") and a.get("href"):
            self.edges.append(Edge("style_imports" if a.get("rel") == "stylesheet" else "links", label, a["href"], line))
        if tag == "script" and a.get("src"):
            self.edges.append(Edge("script_imports", label, a["src"], line))
        if tag == "form":
            self.forms.append(made[0])
        elif self.forms and self.forms[-1] is not self.open[-1][1][0] and tag in ("input", "textarea", "select", "button"):
            self.edges.append(Edge("contains", self.forms[-1].qualified, label, line))
        if self.open:
            self.edges.append(Edge("contains", self.open[-1][1][0].qualified, label, line))
        self.units += made
        if tag not in VOID:
            self.open.append((tag, made))

    def handle_endtag(self, tag: str) -> None:
        if tag in [t for t, _ in self.open]:
            end = self.text.find(">", self.here()) + 1 or len(self.text)
            while self.open:
                t, made = self.open.pop()
                for u in made:
                    u.end = end
                if t == "form" and self.forms:
                    self.forms.pop()
                if t == tag:
                    break


def parse_html(text: str, path: str) -> Parsed:
    reader = Reader(text)
    reader.feed(text)
    reader.close()
    for _, made in reader.open:  # never closed
        for u in made:
            u.end = len(text)
    return Parsed(reader.units, reader.edges)


def parse_css(text: str, path: str) -> Parsed:
    code = blanked(text, line_marks=(), quotes="\"'")
    ends = block_ends(code)
    units: list[Unit] = []
    edges: list[Edge] = []
    lines = Lines(text)
    line_of = lambda at: lines.place(at)[0]
    rules: list[Unit] = []
    for m in re.finditer(r"([^{};]+)([{;])", code):
        start = m.start() + len(m[1]) - len(m[1].lstrip())
        head = " ".join(text[start : m.end(1)].split())
        if not head:
            continue
        inside = [o for o in ends if o < start < ends[o]]
        if head.startswith("@"):
            kind = re.match(r"@([\w-]+)", head)[1]
            end = ends[m.start(2)] if m[2] == "{" else m.end()
            if kind == "import":
                target = re.search(r"""@import\s+(?:url\()?["']?([^"')\s;]+)""", head)
                name = target[1] if target else "unknown"
                units.append(Unit("css_import", name, start, end, name, head, targets=(name,)))
                edges.append(Edge("imports", path, name, line_of(start)))
            else:
                units.append(Unit("css_at_rule", head[len(kind) + 1 :].strip() or kind, start, end, head, head))
        elif m[2] == "{":
            rule = Unit("css_rule", head, start, ends[m.start(2)], head, f"{head} {{}}")
            units.append(rule)
            rules.append(rule)
            for s in head.split(","):
                if s.strip():
                    units.append(Unit("css_selector", s.strip(), start, m.end(1), s.strip(), s.strip()))
                    edges.append(Edge("contains", head, s.strip(), line_of(start)))
        if inside and m[2] == ";" or inside and not head.startswith("@") and m[2] == ";":
            add_property(text, start, m.end(1), rules, units, edges, line_of)
    for o in ends:  # a last property without a semicolon
        body = code[o + 1 : ends[o] - 1]
        cut = max(body.rfind(";"), body.rfind("}"), body.rfind("{"))
        rest = body[cut + 1 :]
        if ":" in rest and rest.strip():
            at = o + 1 + cut + 1 + len(rest) - len(rest.lstrip())
            add_property(text, at, o + 1 + cut + 1 + len(rest.rstrip()), rules, units, edges, line_of)
    variables = {u.name for u in units if u.kind == "css_variable"}
    for u in list(units):
        if u.kind in ("css_property", "css_variable"):
            for v in re.findall(r"var\(\s*(--[\w-]+)", u.signature):
                if v in variables:
                    edges.append(Edge("uses_variable", u.qualified, v, line_of(u.start)))
    return Parsed(units, edges)


def add_property(text: str, start: int, end: int, rules: list[Unit], units: list[Unit], edges: list[Edge], line_of) -> None:
    name, colon, value = text[start:end].partition(":")
    name = name.strip()
    if not colon or not re.fullmatch(r"-{0,2}[A-Za-z][\w-]*", name):
        return
    owner = next((r for r in reversed(rules) if r.start <= start < r.end), None)
    qualified = f"{owner.name}.{name}" if owner else name
    units.append(Unit("css_variable" if name.startswith("--") else "css_property", name, start, end, qualified, f"{name}: {' '.join(value.split())}"))
    if owner:
        edges.append(Edge("contains", owner.name, qualified, line_of(start)))


__all__ = ["parse_css", "parse_html", "contained"]
