"""HTML and CSS expressions: attribute maps, classes of elements, links, metas and scripts; selectors, properties and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element classes.
COMPONENT = ("article", "section", "aside", "header", "footer", "nav", "main", "figure", "figcaption", "details", "summary", "dialog", "template")
FORM = ("form", "input", "textarea", "select", "option", "optgroup", "button", "fieldset", "legend", "label", "datalist", "output")
MEDIA = ("img", "video", "audio", "source", "track", "picture", "canvas", "svg", "object", "embed", "iframe")
INTERACTIVE = ("a", "button", "input", "select", "textarea", "details", "dialog")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
STANDARD_ATTRIBUTES = ("id", "class", "style", "title", "lang", "dir", "hidden", "tabindex", "accesskey", "contenteditable", "draggable", "spellcheck")
SEO_NAMES = ("description", "keywords", "author", "robots", "viewport", "title", "canonical")
CUSTOM = "^[a-z][a-z0-9]*(-[a-z0-9]+)+$"

# Property classes and value keywords.
LAYOUT = (
    "display", "position", "top", "right", "bottom", "left", "z-index", "float", "clear", "width", "height", "min-width", "max-width", "min-height",
    "max-height", "margin", "padding", "border", "box-sizing", "overflow", "visibility",
)
TYPOGRAPHY = (
    "font-family", "font-size", "font-weight", "font-style", "font-variant", "line-height", "letter-spacing", "word-spacing", "text-align",
    "text-decoration", "text-transform", "text-indent", "color",
)
ANIMATION = (
    "animation", "animation-name", "animation-duration", "animation-timing-function", "animation-delay", "animation-iteration-count",
    "animation-direction", "animation-fill-mode", "animation-play-state", "transition", "transition-property", "transition-duration",
    "transition-timing-function", "transition-delay", "transform", "transform-origin",
)
SHORTHAND = ("margin", "padding", "border", "font", "background", "animation", "transition", "flex", "grid", "outline", "list-style")
COLOURS = ("red", "green", "blue", "black", "white", "transparent", "inherit", "initial", "currentcolor")


def tags(html: Column) -> Column:
    """array<struct<tag, attributes text>> of the start tags, in order; comments and the insides of scripts and styles are not looked at."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*>).*?(?=</\2)", "$1")
    whole = F.regexp_extract_all(body, F.lit(r"<[a-zA-Z][^<>]*>"), F.lit(0))
    return F.transform(whole, lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"), F.regexp_extract(t, r"^<[a-zA-Z][a-zA-Z0-9-]*(.*?)/?>$", 1).alias("attributes")))


def attributes(text: Column) -> Column:
    """map<name, value> of an attribute list; a name alone has an empty value, the first of a repeated name counts."""
    found = F.regexp_extract_all(text, F.lit(r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""), F.lit(0))
    pairs = F.transform(found, lambda a: F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("k"), F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"""^["']|["']$""", "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def text_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def has(a: Column, name: str) -> Column:
    return F.map_contains_key(a, name)


def get(a: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(name)), F.lit(""))


def is_custom(tag: Column) -> Column:
    return tag.rlike(CUSTOM)


def element_class(tag: Column) -> Column:
    return F.when(tag.isin(*FORM), "form").when(tag.isin(*MEDIA), "media").when(tag.isin(*COMPONENT), "component").when(tag.isin(*INTERACTIVE), "interactive").when(is_custom(tag), "custom").otherwise("standard")


def component_class(tag: Column) -> Column:
    return F.when(is_custom(tag), "custom_element").when(tag.isin(*COMPONENT), "semantic_component").otherwise("standard_component")


def component_properties(a: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~k.isin(*STANDARD_ATTRIBUTES) & ~k.rlike("^(aria-|data-|on)"))


def uses_shadow_dom(a: Column) -> Column:
    return has(a, "slot") | has(a, "part") | has(a, "exportparts")


def slots(html: Column) -> Column:
    """array<string>: names of the slots in a component's markup, "default" for one without."""
    found = F.filter(tags(html), lambda t: t["tag"] == "slot")
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(attributes(t["attributes"]), F.lit("name")), F.lit("default")))


def is_self_closing(element: Column) -> Column:
    """Whether the element's text ends with />."""
    return F.endswith(element, F.lit("/>"))


def accessibility(a: Column) -> Column:
    return F.map_filter(a, lambda k, v: k.startswith("aria-") | k.isin("alt", "title", "role", "tabindex"))


def data_attributes(a: Column) -> Column:
    return F.map_filter(a, lambda k, v: k.startswith("data-"))


def event_handlers(a: Column) -> Column:
    return F.transform_keys(F.map_filter(a, lambda k, v: k.startswith("on")), lambda k, v: F.substring(k, F.lit(3), F.length(k)))


def validation(a: Column) -> Column:
    return F.map_filter(a, lambda k, v: k.isin("required", "pattern", "min", "max", "step", "minlength", "maxlength"))


def form_accessibility(a: Column) -> Column:
    return F.map_filter(a, lambda k, v: k.isin("aria-label", "aria-describedby", "aria-required", "aria-invalid"))


def link_class(rel: Column, href: Column) -> Column:
    return (
        F.when(rel == "stylesheet", "stylesheet").when(rel.isin("icon", "shortcut icon"), "icon").when(rel == "canonical", "canonical")
        .when(href.startswith("mailto:"), "email").when(href.startswith("tel:"), "phone").when(href.startswith("http"), "external").otherwise("internal")
    )


def meta_class(a: Column) -> Column:
    return F.when(has(a, "charset"), "charset").when(has(a, "http-equiv"), "http_equiv").when(has(a, "name"), "name").when(has(a, "property"), "property").otherwise("unknown")


def is_seo_meta(a: Column) -> Column:
    return get(a, "name").isin(*SEO_NAMES)


def is_social_meta(a: Column) -> Column:
    return get(a, "property").rlike("^(og|twitter|fb):")


def script_loading(a: Column) -> Column:
    return F.when(has(a, "async"), "async").when(has(a, "defer"), "defer").when(get(a, "type") == "module", "module").otherwise("blocking")


def html_visibility(a: Column) -> Column:
    return F.when(has(a, "hidden") | F.regexp_replace(get(a, "style"), r"\s", "").contains("display:none"), "private").otherwise("public")


def is_void(tag: Column) -> Column:
    return tag.isin(*VOID)


# CSS


def specificity(selector: Column) -> Column:
    """struct(ids, classes, elements, total): ids count 100, classes, pseudo parts and attributes 10, elements 1."""
    n = lambda p: F.regexp_count(selector, F.lit(p))
    ids, classes = n(r"#[\w-]+"), n(r"\.[\w-]+") + n(r"::?[\w-]+") + n(r"\[[^\]]+\]")
    elements = n(r"(?<![#.\w-])(?:[a-zA-Z][\w-]*|[*])")
    return F.struct(ids.alias("ids"), classes.alias("classes"), elements.alias("elements"), (ids * 100 + classes * 10 + elements).alias("total"))


def selector_class(s: Column) -> Column:
    return (
        F.when(s.startswith("#"), "id").when(s.startswith("."), "class").when(s.startswith("["), "attribute").when(s.contains("::"), "pseudo_element")
        .when(s.contains(":"), "pseudo_class").when(s == "*", "universal").otherwise("element")
    )


def pseudo_elements(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("::([a-zA-Z-]+)"), F.lit(1))


def pseudo_classes(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?<!:):([a-zA-Z-]+)"), F.lit(1))


def selector_parts(s: Column, mark: str) -> Column:
    """Names after `#` or `.`, or element names for an empty mark."""
    return F.regexp_extract_all(s, F.lit(rf"\{mark}([a-zA-Z_][\w-]*)" if mark else r"(?<![#.\w-])([a-zA-Z][\w-]*)"), F.lit(1))


def combinators(s: Column) -> Column:
    return F.array_compact(F.array(F.when(s.contains(">"), "child"), F.when(s.contains("+"), "adjacent_sibling"), F.when(s.contains("~"), "general_sibling"), F.when(F.trim(s).contains(" "), "descendant")))


def property_class(p: Column) -> Column:
    return F.when(p.isin(*LAYOUT), "layout").when(p.isin(*TYPOGRAPHY), "typography").when(p.isin(*ANIMATION), "animation").when(p.startswith("--"), "custom").otherwise("other")


def is_shorthand(p: Column) -> Column:
    return p.isin(*SHORTHAND)


def value_class(v: Column) -> Column:
    t = F.trim(v)
    return (
        F.when(t.rlike("^#[0-9a-fA-F]{3,8}$"), "color_hex").when(t.startswith("rgb"), "color_rgb").when(t.rlike(r"^\d+(\.\d+)?(px|em|rem|%|vh|vw|vmin|vmax)$"), "length")
        .when(t.rlike(r"^\d+$"), "number").when(v.startswith("var("), "variable").when(v.contains("(") & v.contains(")"), "function").otherwise("keyword")
    )


def is_colour(v: Column) -> Column:
    t = F.lower(F.trim(v))
    return t.startswith("#") | t.startswith("rgb") | t.startswith("hsl") | t.isin(*COLOURS)


def is_length(v: Column) -> Column:
    return F.trim(v).rlike(r"^\d+(\.\d+)?(px|em|rem|%|vh|vw|vmin|vmax|pt|pc|in|cm|mm)$")


def at_rule(text: Column) -> Column:
    """struct(type, name, media_type) of an at-rule's text."""
    kind = F.regexp_extract(text, r"^\s*@([a-zA-Z-]+)", 1)
    grab = lambda p, default: F.when(F.regexp_extract(text, p, 1) != "", F.trim(F.regexp_extract(text, p, 1))).otherwise(default)
    name = (
        F.when(kind == "keyframes", grab(r"@keyframes\s+([a-zA-Z_][\w-]*)", "anonymous")).when(kind == "media", grab(r"@media\s+([^{]+)", "all"))
        .when(kind == "import", grab(r"""@import\s+(?:url\()?["']?([^"')\s]+)""", "unknown")).when(kind == "charset", F.concat(F.lit('"'), grab(r"""@charset\s+["']([^"']+)["']""", "UTF-8"), F.lit('"')))
        .when(kind == "font-face", grab(r"""font-family:\s*["']([^"']+)["']""", "custom")).when(kind == "supports", grab(r"@supports\s+\(([^)]+)\)", "unknown")).otherwise(kind)
    )
    return F.struct(kind.alias("type"), name.alias("name"), grab(r"@media\s+([a-zA-Z]+)", "all").alias("media_type"))


# visibility of code entities


def python_visibility(name: Column) -> Column:
    return F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def script_visibility(name: Column) -> Column:
    return F.when(name.rlike("^[_#]"), "private").otherwise("public")


def go_visibility(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")


def java_visibility(modifiers: Column) -> Column:
    return F.when(modifiers.rlike(r"\bpublic\b"), "public").when(modifiers.rlike(r"\bprotected\b"), "protected").when(modifiers.rlike(r"\bprivate\b"), "private").otherwise("package_private")


def rust_visibility(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*pub\b"), "public").otherwise("private")
