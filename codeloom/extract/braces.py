"""Languages with braces: JavaScript, TypeScript, Go, Rust, Java, C and C++, each a table of declaration patterns.

Patterns run over the source with comments and strings blanked, so offsets stay
and nothing inside them is taken for code.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from codeloom.extract.base import Edge, Lines, Nest, Parsed, Unit, block_ends, blanked, comment_before, contained

NAME = r"[A-Za-z_$][\w$]*"
NOT_CALLS = frozenset("if for while switch catch return function sizeof typeof new await super else do throw case defined alignof decltype static_assert".split())


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    where: str = "any"  # any, top (outside all blocks), class (directly in one)
    block: bool = True  # extends over the block that follows


def rule(kind: str, pattern: str, where: str = "any", block: bool = True) -> Rule:
    return Rule(kind, re.compile(pattern, re.M), where, block)


#: Where a declaration can begin: a line, or right after a brace or semicolon.
START = r"(?:^|(?<=[{};]))[ \t]*"

# The named groups: name, and where there are any bases, target, recv (receiver).
JAVASCRIPT = (
    rule("class", rf"\bclass\s+(?P<name>{NAME})(?:\s+extends\s+(?P<bases>[\w$.]+))?"),
    rule("function", rf"(?P<async>\basync\s+)?\bfunction\s*\*?\s*(?P<name>{NAME})\s*(?:<[^>]*>)?\s*\([^)]*\)"),
    rule("method", START + rf"(?:(?:static|get|set|public|private|protected|readonly|override)\s+)*(?P<async>async\s+)?\*?(?P<name>#?{NAME})\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{{;=]+)?(?=\{{)", "class"),
    rule("constant", rf"^[ \t]*(?:export\s+)?const\s+(?P<name>{NAME})\s*(?::[^=]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=;]+)?=>)", "top", False),
    rule("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=]+)?=\s*(?P<async>async\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=]+)?=>", "top", False),
    rule("variable", rf"^[ \t]*(?:export\s+)?(?:let|var)\s+(?P<name>{NAME})\b(?![^;\n]*=>)", "top", False),
    rule("import", r"""^[ \t]*import\s+(?:(?P<name>[^'"]+?)\s+from\s+)?(?P<target>['"])""", "top", False),
    rule("export", rf"^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:class|function\*?|const|let|var|interface|type|enum)?\s*(?P<name>{NAME})", "top", False),
)
TYPESCRIPT = (
    *JAVASCRIPT,
    rule("interface", rf"\binterface\s+(?P<name>{NAME})(?:\s*<[^>{{]*>)?(?:\s+extends\s+(?P<bases>[\w$., ]+))?"),
    rule("type", rf"^[ \t]*(?:export\s+)?type\s+(?P<name>{NAME})\s*(?:<[^=]*>)?\s*=", "any", False),
    rule("enum", rf"\benum\s+(?P<name>{NAME})"),
    rule("namespace", r"\b(?:namespace|module)\s+(?P<name>[\w$.]+)\s*(?=\{)"),
)
GO = (
    rule("module", r"^package\s+(?P<name>\w+)", "top", False),
    rule("struct", r"^[ \t]*(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
    rule("interface", r"^[ \t]*(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
    rule("type", r"^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b|\()[\w\[\]*.]+", "top", False),
    rule("method", r"^func\s+\((?P<recv>[^)]*)\)\s*(?P<name>\w+)\s*\(", "top"),
    rule("function", r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", "top"),
    rule("variable", r"^var\s+(?P<name>\w+)", "top", False),
    rule("constant", r"^const\s+(?P<name>\w+)", "top", False),
)
RUST = (
    rule("module", START + r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"),
    rule("import", START + r"(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<name>[^;]+);", "any", False),
    rule("struct", START + r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
    rule("enum", START + r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
    rule("trait", START + r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
    rule("implementation", START + r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:<>, ]+?)\s+for\s+)?(?P<name>\w+)"),
    rule("function", START + r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|unsafe\s+|extern\s+\S+\s+)*(?P<async>async\s+)?fn\s+(?P<name>\w+)"),
    rule("constant", START + r"(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<name>[A-Z_]\w*)\s*:", "any", False),
    rule("variable", START + r"(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<name>\w+)\s*:", "any", False),
    rule("type", START + r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "any", False),
    rule("macro", START + r"macro_rules!\s*(?P<name>\w+)"),
)
JAVA_HEAD = START + r"(?P<mods>(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|default|synchronized|native|transient|volatile|strictfp)\s+)*)"
JAVA = (
    rule("module", START + r"package\s+(?P<name>[\w.]+)\s*;", "top", False),
    rule("import", START + r"import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;", "top", False),
    rule("class", JAVA_HEAD + r"(?:class|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.]+))?"),
    rule("interface", JAVA_HEAD + r"interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<bases>[\w., ]+))?"),
    rule("enum", JAVA_HEAD + r"enum\s+(?P<name>\w+)"),
    rule("class", JAVA_HEAD + r"@interface\s+(?P<name>\w+)"),
    rule("method", JAVA_HEAD + r"(?:<[^>]*>\s+)?(?!return\b|new\b|else\b|throw\b)(?:[\w.<>\[\], ?]+\s+)?(?P<name>\w+)\s*\([^;{)]*\)\s*(?:throws\s+[\w., ]+)?(?=[{;])", "class"),
    rule("variable", JAVA_HEAD + r"(?!return\b|package\b|import\b|throw\b)[\w.<>\[\], ?]+\s+(?P<name>\w+)\s*(?:=[^;]*)?;", "class", False),
)
C = (
    rule("import", r"^[ \t]*#[ \t]*include\s*(?P<name>[<\"])", "any", False),
    rule("constant", r"^[ \t]*#[ \t]*define\s+(?P<name>\w+)", "any", False),
    rule("class", r"\b(?:struct|union)\s+(?P<name>\w+)\s*(?=\{)"),
    rule("class", r"\btypedef\s+(?:struct|union)\s*(?:\w+\s*)?\{[^{}]*\}\s*(?P<name>\w+)\s*;", "any", False),
    rule("enum", r"\benum\s+(?P<name>\w+)\s*(?=\{)"),
    rule("enum", r"\btypedef\s+enum\s*(?:\w+\s*)?\{[^{}]*\}\s*(?P<name>\w+)\s*;", "any", False),
    rule("type_alias", r"^[ \t]*typedef\s+(?!struct\b[^;]*\{|union\b[^;]*\{|enum\b[^;]*\{)[^;{]*?\b(?P<name>\w+)\s*;", "any", False),
    rule("function", r"^(?!\s*(?:else|return|typedef|if|for|while|switch)\b)[ \t]*[A-Za-z_][\w \t*&:<>,]*?[ \t*&](?P<name>\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?=\{)", "top"),
    rule("variable", r"^(?!\s*(?:typedef|return|struct\s+\w+\s*\{|using|namespace|class|enum|#))[ \t]*(?:static\s+|extern\s+|const\s+|volatile\s+)*[A-Za-z_][\w:<>]*(?:\s*\*+\s*|\s+)(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;{]*)?;", "top", False),
)
CPP = (
    *(r for r in C if r.kind not in ("function",)),
    rule("class", r"(?<!enum )\bclass\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[^{;]+))?(?=\{)"),
    rule("class", r"\bstruct\s+(?P<name>\w+)\s*:\s*(?P<bases>[^{;]+)(?=\{)"),
    rule("enum", r"\benum\s+class\s+(?P<name>\w+)"),
    rule("module", r"\bnamespace\s+(?P<name>[\w:]+)\s*(?=\{)"),
    rule("type_alias", r"^[ \t]*using\s+(?P<name>\w+)\s*=", "any", False),
    rule("method", START + r"(?:(?:virtual|static|inline|explicit|constexpr|friend)\s+)*(?:[\w:<>,*& \t]+?[ \t*&])?(?P<name>~?\w+|operator\S+)\s*\([^;{}]*\)\s*(?:const|override|final|noexcept|\s)*(?:=\s*(?:0|default|delete)\s*|:[^{};]*)?(?=[{;])", "class"),
    rule("function", r"^(?!\s*(?:else|return|typedef|if|for|while|switch|using)\b)[ \t]*[A-Za-z_][\w \t*&:<>,]*?[ \t*&](?P<name>(?:[\w:]+::)?operator\s*[^\s\w(]+|[\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|\s)*(?=\{)", "module"),
)


#: What may stand on a line before the keyword of a declaration, so that its comment is the one before the line.
MODIFIERS = re.compile(r"\s*(?:(?:export|default|declare|abstract|async|pub(?:\([^)]*\))?|static|public|private|protected|final|unsafe|extern|const|inline|template\s*<[^>]*>)\s+)*")
USES = re.compile(rf"(?<![\w.>:])(?<!struct )(?<!union )(?<!enum )(?P<type>{NAME})(?:<[^;<>(){{}}]*>)?(?:\s*[*&]+\s*|\s+)(?P<name>{NAME})\s*(?=[=;\[])")


def visibility(language: str, u: Unit, head: str) -> str:
    if language in ("javascript", "typescript"):
        return "private" if u.name[:1] in "_#" or re.search(r"\bprivate\b", head) else "protected" if re.search(r"\bprotected\b", head) else "public"
    if language == "go":
        return "public" if u.name[:1].isupper() else "private"
    if language == "java":
        return next((v for v in ("public", "protected", "private") if re.search(rf"\b{v}\b", head)), "package_private")
    if language == "rust":
        return "public" if re.match(r"\s*pub\b", head) else "private"
    return "public"


class Access:
    """Access of C++ members: the label that stands last before one in its class, else that of the keyword."""

    def __init__(self, code: str, nest: Nest):
        self.code, self.nest = code, nest
        self.labels: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for m in re.finditer(r"\b(public|protected|private)\s*:(?!:)", code):
            if around := next(nest.around(m.start()), None):
                self.labels[around[0]].append((m.start(), m[1]))

    def of(self, at: int, owner: Unit) -> str:
        held = self.labels.get(owner.extra["brace"], [])
        i = bisect.bisect_left(held, (at, ""))
        if i:
            return held[i - 1][1]
        return "private" if re.match(r"class\b", self.code[owner.start :]) else "public"


LANGUAGES: dict[str, tuple[Rule, ...]] = {"javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST, "java": JAVA, "c": C, "cpp": CPP}
CONTAINERS = {"class", "interface", "struct", "enum", "trait", "implementation", "namespace", "module"}
QUOTES = {"rust": '"', "java": "\"'", "c": "\"'", "cpp": "\"'"}


def parse(language: str) -> Callable[[str, str], Parsed]:
    rules = LANGUAGES[language]

    def run(text: str, path: str) -> Parsed:
        code = blanked(text, quotes=QUOTES.get(language, "\"'`"))
        ends = block_ends(code)
        nest, lines = Nest(ends.items()), Lines(text)
        access = Access(code, nest) if language == "cpp" else None
        owners: dict[int, Unit] = {}  # by the brace that opens them
        found: dict[tuple[int, str], Unit] = {}

        def owner_at(at: int) -> Unit | None:
            around = next((o for o, _ in nest.around(at) if o < at), None)
            return owners.get(around) if around is not None else None

        def fits(r: Rule, at: int) -> bool:
            if r.where == "any":
                return True
            around = [o for o, _ in nest.around(at) if o < at]
            if r.where in ("top", "module"):
                inside = r.where == "module" or language in ("cpp", "typescript")
                return all(inside and o in owners and owners[o].kind in ("module", "namespace") for o in around)
            owner = owners.get(around[0]) if around else None
            if owner is None or owner.kind not in ("class", "interface", "struct", "enum"):
                return False
            return r.kind != "variable" or owner.kind != "enum" or ";" in code[around[0] : at]  # before it stand the enum's constants

        for r in sorted(rules, key=lambda r: r.where != "any"):
            for m in r.pattern.finditer(code):
                name = (m.groupdict().get("name") or "").strip()
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                if language != "rust" and r.kind in ("method", "function") and name in NOT_CALLS or not fits(r, m.start("name") if m["name"] else start):
                    continue
                end, brace = m.end(), None
                if r.block:
                    stop = code.find(";", m.end())
                    open_at = code.find("{", m.end() - (code[m.end() - 1] == "{"))
                    if open_at >= 0 and (stop < 0 or open_at < stop):
                        brace, end = open_at, ends[open_at]
                    elif stop >= 0:
                        end = stop + 1
                else:
                    stop = code.find("\n" if language in ("c", "cpp") and m[0].lstrip().startswith("#") else ";", m.end() - 1)
                    line = code.find("\n", m.end())
                    end = max(m.end(), stop + 1 if 0 <= stop and (language in ("rust", "java", "c", "cpp") or stop < line) else line if line >= 0 else len(code))
                head = " ".join(text[start : (brace if brace is not None else end)].split()).rstrip("{;").strip()
                targets: tuple[str, ...] = ()
                if r.kind == "import":
                    line = text[m.start() : text.find("\n", m.end()) if text.find("\n", m.end()) >= 0 else len(text)]
                    quoted = re.search(r"""["'<]([^"'>]+)["'>]""", line)
                    targets = (quoted[1] if quoted and language in ("javascript", "typescript", "c", "cpp") else name.split(" as ")[0].strip(),)
                    name = targets[0]
                if not name:
                    continue
                bases = tuple(b.split("<")[0].split()[-1] for b in re.split(r",", m.groupdict().get("bases") or "") if b.strip())
                begin = text.rfind("\n", 0, start) + 1
                before = begin if MODIFIERS.fullmatch(text, begin, start) else start
                u = Unit(r.kind, name, start, end, signature=head[:300], docstring=comment_before(text, before), is_async=bool(m.groupdict().get("async")), bases=bases, targets=targets, extra={"brace": brace, "recv": (m.groupdict().get("recv") or "").replace("*", " ").split()[-1:]})
                u.visibility = visibility(language, u, text[start : start + 120])
                if access and (owner := owner_at(start)) and owner.kind == "class":
                    u.visibility = access.of(start, owner)
                if language == "go" and r.kind in ("function", "method") and brace is not None:
                    u.is_async = bool(re.search(r"\bgo\s+[\w(]", code[brace:end]))
                if (start, r.kind) not in found and not (r.kind == "variable" and (start, "constant") in found):
                    found[start, r.kind] = u
                    if r.kind in CONTAINERS and brace is not None:
                        owners.setdefault(brace, u)
        if language == "go":
            for m in re.finditer(r"^import\s*(\((?:[^)]*)\)|[^\n]*)", text, re.M):
                for q in re.finditer(r'"([^"]+)"', m[1]):
                    found[m.start(1) + q.start(), "import"] = Unit("import", q[1], m.start(1) + q.start(), m.start(1) + q.end(), signature=f'import "{q[1]}"', targets=(q[1],))
            for m in re.finditer(r"^(const|var)\s*\(([^)]*)\)", code, re.M):
                for q in re.finditer(r"^[ \t]*(\w+)\b", m[2], re.M):
                    kind = "constant" if m[1] == "const" else "variable"
                    at = m.start(2) + q.start(1)
                    found[at, kind] = Unit(kind, q[1], at, at + len(q[1]), signature=f"{m[1]} {q[1]}", visibility="public" if q[1][:1].isupper() else "private")
        if language in ("javascript", "typescript"):
            for m in re.finditer(r"^[ \t]*export\s*(?:type\s*)?\{([^}]*)\}", code, re.M):
                for q in re.finditer(rf"({NAME})(?:\s+as\s+({NAME}))?", m[1]):
                    at = m.start(1) + q.start()
                    found[at, "export"] = Unit("export", q[2] or q[1], at, m.start(1) + q.end(), signature=f"export {{ {q[0]} }}")
        units = sorted(found.values(), key=lambda u: (u.start, -u.end))
        parents = {id(a): b for a, b in contained(units) if b.kind in CONTAINERS}
        edges: list[Edge] = []
        line_of = lambda at: lines.place(at)[0]
        for u in units:
            owner = parents.get(id(u))
            if u.kind == "function" and owner is not None and owner.kind in ("implementation", "trait"):
                u.kind = "function"
            prefix = (owner.qualified or owner.name) if owner is not None else "".join(u.extra.get("recv") or [])
            u.qualified = f"{prefix}.{u.name}" if prefix and u.kind != "import" else u.name
            if owner is not None and u.kind in ("method", "function", "variable", "constant"):
                edges.append(Edge("contains", owner.qualified or owner.name, u.qualified, line_of(u.start)))
            edges += [Edge("implements" if u.kind == "implementation" else "inherits", u.qualified, b, line_of(u.start)) for b in u.bases]
            edges += [Edge("imports", path, t, line_of(u.start)) for t in u.targets]
            if u.kind == "export":
                edges.append(Edge("exports", path, u.name, line_of(u.start)))
        bodies = {(u.start, u.end): u for u in units if u.kind in ("function", "method") and u.extra.get("brace") is not None}
        within = Nest(bodies)
        if language in ("javascript", "typescript", "c", "cpp"):
            for m in re.finditer(rf"(?<![\w$.])((?:{NAME}(?:\.|->|::))*{NAME})\s*\(", code):
                if m[1].split(".")[-1] not in NOT_CALLS and (u := bodies.get(next(within.around(m.start()), ()))) and m.start() > u.extra["brace"]:
                    edges.append(Edge("calls", u.qualified, m[1], line_of(m.start())))
        if language in ("c", "cpp"):
            types = {u.name for u in units if u.kind in ("class", "enum", "type_alias")}
            for m in USES.finditer(code):
                if m["type"] in types and not ((owner := owner_at(m.start())) and owner.kind == "class"):
                    edges.append(Edge("uses_type", m["name"], m["type"], line_of(m.start())))
        for u in units:
            u.extra = {}
        errors = [] if code.count("{") == code.count("}") else ["0: unbalanced braces"]
        return Parsed(units, edges, errors)

    return run
