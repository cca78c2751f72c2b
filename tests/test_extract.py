"""Parsers on inline snippets: expected names, types and relations."""

import pytest

from codeloom.extract import registry
from codeloom.extract.base import Lines

SNIPPETS = {
    "m.py": (
        '''"""Doc."""
import os
from a.b import c as d
MAX_SIZE = 3
limit: int = 4

class Reader(Base, Other):
    """Reads."""
    size = 1

    @property
    def name(self) -> str:
        """A name."""
        return os.path.join(self.x, helper("é"))

    async def _load(self, n: int = 2): ...

def helper(x):
    def inner(): return x
    return inner()
''',
        {("class", "Reader"), ("method", "name"), ("method", "_load"), ("function", "helper"), ("function", "inner"), ("import", "os"), ("import", "d"), ("constant", "MAX_SIZE"), ("variable", "limit"), ("variable", "size")},
        {("inherits", "Reader", "Base"), ("inherits", "Reader", "Other"), ("calls", "Reader.name", "os.path.join"), ("calls", "Reader.name", "helper"), ("imports", "m", "a.b.c"), ("contains", "Reader", "Reader.name"), ("decorates", "property", "Reader.name"), ("calls", "helper", "inner")},
    ),
    "a.js": (
        """// class Hidden {}
import x, { y } from './lib.js';
export class Cart extends Base {
  constructor(a) { super(a); }
  async total() { return sum(this.items); }
}
export async function load(url) { const s = "class Fake {"; return fetch(url); }
const LIMIT = 5;
const add = (a, b) => a + b;
let state = null;
""",
        {("class", "Cart"), ("method", "constructor"), ("method", "total"), ("function", "load"), ("constant", "LIMIT"), ("function", "add"), ("variable", "state"), ("import", "./lib.js"), ("export", "Cart"), ("export", "load")},
        {("inherits", "Cart", "Base"), ("calls", "Cart.total", "sum"), ("calls", "load", "fetch"), ("imports", "a.js", "./lib.js"), ("contains", "Cart", "Cart.total"), ("exports", "a.js", "Cart")},
    ),
    "t.ts": (
        """interface Shape extends Named, Sized { area(): number; }
type Id = string | number;
enum Color { Red, Green }
namespace Geo { export const x = 1; }
export class Box implements Shape { area(): number { return 1; } }
""",
        {("interface", "Shape"), ("type", "Id"), ("enum", "Color"), ("namespace", "Geo"), ("class", "Box"), ("method", "area")},
        {("inherits", "Shape", "Named"), ("inherits", "Shape", "Sized")},
    ),
    "s.go": (
        """package main

import (
	"fmt"
	"net/http"
)

const (
	MaxItems = 5
	minItems = 1
)

type Server struct { name string }
type Handler interface { Serve() error }
type ID int

// Run starts it.
func (s *Server) Run(n int) error { go s.loop(); return nil }
func helper() {}
var count int
""",
        {("module", "main"), ("import", "fmt"), ("import", "net/http"), ("struct", "Server"), ("interface", "Handler"), ("type", "ID"), ("method", "Run"), ("function", "helper"), ("variable", "count"), ("constant", "MaxItems"), ("constant", "minItems")},
        {("imports", "s.go", "net/http")},
    ),
    "l.rs": (
        """use std::collections::HashMap;
pub mod inner { pub fn go() {} }
pub struct Point { x: i32 }
struct Unit;
enum Kind { A, B }
pub trait Draw { fn draw(&self); }
impl Draw for Point { fn draw(&self) {} }
const LIMIT: usize = 3;
static NAME: &str = "n";
type Alias = u8;
macro_rules! say { () => {} }
pub async fn run<'a>(s: &'a str) -> u8 { 1 }
""",
        {("import", "std::collections::HashMap"), ("module", "inner"), ("function", "go"), ("struct", "Point"), ("struct", "Unit"), ("enum", "Kind"), ("trait", "Draw"), ("implementation", "Point"), ("function", "draw"), ("constant", "LIMIT"), ("variable", "NAME"), ("type", "Alias"), ("macro", "say"), ("function", "run")},
        {("implements", "Point", "Draw"), ("imports", "l.rs", "std::collections::HashMap")},
    ),
    "J.java": (
        """package com.x.y;
import java.util.List;
/** A cart. */
public class Cart extends Base {
  private int size = 0;
  public List<String> items(int n) { return null; }
  Cart() { }
}
interface Shape { double area(); }
enum Color { RED }
@interface Marker { }
""",
        {("module", "com.x.y"), ("import", "java.util.List"), ("class", "Cart"), ("variable", "size"), ("method", "items"), ("method", "Cart"), ("interface", "Shape"), ("method", "area"), ("enum", "Color"), ("class", "Marker")},
        {("inherits", "Cart", "Base"), ("imports", "J.java", "java.util.List")},
    ),
    "c.c": (
        """#include <stdio.h>
#include "own.h"
#define LIMIT 10
struct point { int x; };
typedef struct { int y; } node;
enum color { RED };
typedef unsigned int uint;
static int counter = 0;
int add(int a, int b) { return helper(a) + b; }
""",
        {("import", "stdio.h"), ("import", "own.h"), ("constant", "LIMIT"), ("class", "point"), ("class", "node"), ("enum", "color"), ("type_alias", "uint"), ("variable", "counter"), ("function", "add")},
        {("imports", "c.c", "stdio.h"), ("calls", "add", "helper")},
    ),
    "v.cpp": (
        """#include <vector>
namespace geo {
class Shape : public Base, private Other {
 public:
  virtual double area() const { return size(); }
};
enum class Kind { A };
using Id = int;
double scale(double f) { return f; }
}
""",
        {("import", "vector"), ("module", "geo"), ("class", "Shape"), ("method", "area"), ("enum", "Kind"), ("type_alias", "Id"), ("function", "scale")},
        {("inherits", "geo.Shape", "Base"), ("inherits", "geo.Shape", "Other")},
    ),
    "p.html": (
        """<html><head><meta charset="utf-8"><link rel="stylesheet" href="a.css"><script src="x.js" async></script><style>p{}</style></head>
<body><form id="f"><input name="q" required></form><img src="i.png"><my-card></my-card><a href="/about">About</a><p style="color:red">x</p></body></html>""",
        {("html_meta", "meta"), ("html_link", "link"), ("html_style", "link"), ("html_script", "script"), ("html_form", "f"), ("html_form", "q"), ("html_media", "img"), ("html_component", "my-card"), ("html_link", "a"), ("html_style", "p[style]"), ("html_element", "body")},
        {("style_imports", "link", "a.css"), ("script_imports", "script", "x.js"), ("contains", "form#f", "input"), ("links", "a", "/about")},
    ),
    "s.css": (
        """@import url("base.css");
:root { --gap: 4px; }
/* .no { } */
.card, #main > p { margin: var(--gap); color: red }
@media (min-width: 3px) { .wide { width: 9px; } }
""",
        {("css_import", "base.css"), ("css_rule", ":root"), ("css_variable", "--gap"), ("css_rule", ".card, #main > p"), ("css_selector", ".card"), ("css_selector", "#main > p"), ("css_property", "margin"), ("css_property", "color"), ("css_at_rule", "(min-width: 3px)"), ("css_rule", ".wide"), ("css_property", "width")},
        {("imports", "s.css", "base.css"), ("contains", ".card, #main > p", ".card"), ("uses_variable", ".card, #main > p.margin", "--gap")},
    ),
    "package.json": (
        """{ // comment
  "name": "x", "scripts": {"test": "run // not"}, "dependencies": {"left": "1"}, "list": [1, {"deep": true}], "schema": {"$ref": "#/x"},
}""",
        {("module", "package.json"), ("constant", "name"), ("class", "scripts"), ("namespace", "scripts"), ("class", "dependencies"), ("variable", "list"), ("constant", "deep")},
        {("contains", "$", "$.name"), ("contains", "$.list[1]", "$.list[1].deep"), ("references", "$.schema", "#/x"), ("depends_on", "$.dependencies", "left")},
    ),
    "c.yaml": (
        """base: &b
  port: 80
services:
  web:
    <<: *b
---
other: 1
""",
        {("module", "c.yaml#0"), ("module", "c.yaml#1"), ("class", "base"), ("constant", "port"), ("class", "web"), ("constant", "other")},
        {("contains", "$.base", "$.base.port"), ("references", "*b@5", "&b@1")},
    ),
}


@pytest.mark.parametrize("path", SNIPPETS)
def test_snippet(path):
    text, units, edges = SNIPPETS[path]
    got = registry.parse(text, path)
    assert units - {(u.kind, u.name) for u in got.units} == set()
    assert edges - {(e.kind, e.source, e.target) for e in got.edges} == set()
    assert not any(u.name in ("Hidden", "Fake", ".no") for u in got.units)


@pytest.mark.parametrize("path", SNIPPETS)
@pytest.mark.parametrize("text", ["", "\x00", "}{)(", "é" * 50, "<<<<", '"""', "{" * 500])
def test_bad_input(path, text):
    got = registry.parse(text, path)
    assert all(0 <= u.start <= max(u.end, u.start) for u in got.units)


def test_python_recovers():
    got = registry.parse("def a(): pass\ndef b(: pass\nclass C: pass\n", "x.py")
    assert {u.name for u in got.units} >= {"a", "C"} and got.errors


def test_lines():
    x = Lines("aé\nbc\n")
    assert x.place(0) == (1, 0) and x.place(3) == (2, 0) and x.byte(3) == 4 and Lines("").place(0) == (1, 0)


def test_table_functions(spark):
    rows = [(p, t) for p, (t, _, _) in SNIPPETS.items()] + [("none.py", None), ("bad.json", "{")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    e = registry.entities(files)
    ids = [r.entity_id for r in e.select("entity_id").collect()]
    assert len(ids) == len(set(ids)) > 80
    r = e.where("file_path = 'm.py' and entity_name = 'name'").first()
    assert r.qualified_name == "Reader.name" and r.signature == "def name(self) -> str" and r.docstring == "A name." and r.start_line == 12
    assert len(registry.payload(e).columns) == 28
    assert registry.relations(files).where("relation_type = 'calls'").count() > 5
    assert registry.errors(files).where("file_path = 'bad.json'").count() == 1
    s = registry.parse_stats(files).first()
    assert s.files == 14 and s.failed == 1 and 0.9 < s.success_rate < 1


def test_registry():
    registry.register("toml", [".toml"], lambda text, path: registry.Parsed([], []))
    assert registry.can_parse("a.toml") and registry.language_for("x.h") == "cpp" and not registry.can_parse("x.unknown")
    registry.unregister("toml")
    assert not registry.can_parse("a.toml")


def units_of(text, path):
    got = registry.parse(text, path)
    return {(u.kind, u.name): u for u in got.units}, {(e.kind, e.source, e.target) for e in got.edges}


def test_cpp_access_and_uses():
    u, e = units_of("/* A shape */\nclass Shape : public Base {\n  int hidden() { return 1; }\npublic:\n  virtual double area() const = 0;\n  struct In { void open(); };\nprotected:\n  void low();\n};\nenum class Color { Red };\nShape *one = 0;\nbool operator==(const Shape& a, const Shape& b) { Color c = a.color; return true; }\n", "s.cpp")
    assert [u["method", n].visibility for n in ("hidden", "area", "open", "low")] == ["private", "public", "public", "protected"]
    assert u["class", "Shape"].docstring == "A shape" and ("class", "Color") not in u and ("enum", "Color") in u and ("function", "operator==") in u
    assert {("uses_type", "one", "Shape"), ("uses_type", "c", "Color")} <= e


def test_declarations_that_look_alike():
    u, e = units_of("/** Doc */\nexport default class A {\n  run() { go(1); }\n}\nexport { A as B, c };\nconst f = async (x: number): Promise<void> => {};\n", "x.ts")
    assert u["class", "A"].docstring == "Doc" and ("calls", "A.run", "go") in e and {("export", "B"), ("export", "c")} <= set(u)
    assert ("function", "f") in u and ("constant", "f") not in u
    u, _ = units_of("// Colours\n@Deprecated\nenum Color { RED, GREEN; int code; }\n", "Color.java")
    assert u["enum", "Color"].docstring == "Colours" and ("variable", "code") in u and ("variable", "GREEN") not in u
    u, _ = units_of('#include "a.h"\n#define X 1\n', "a.c")
    assert u["constant", "X"].docstring == ""


@pytest.mark.parametrize(("path", "part"), [("a.js", "class C{0} {{ m(x) {{ return f{0}(x); }} }}\n"), ("a.cpp", "class C{0} {{ public: int m(int x) {{ return f(x); }} }};\n"), ("a.css", ".c{0} {{ color: red; }}\n"), ("a.html", "<div id='d{0}'><a href='x'>y</a></div>\n"), ("a.json", None), ("a.yaml", "k{0}: {{a: 1}}\n")])
def test_large_files_take_linear_time(path, part):
    import time

    size = 4000
    text = "{" + ",".join(f'"k{i}": {{"a": {i}}}' for i in range(size)) + "}" if part is None else "".join(part.format(i) for i in range(size))
    began = time.process_time()
    assert len(registry.parse(text, path).units) >= size
    assert time.process_time() - began < 5
