"""Transforms that match style rules against the elements of pages: one page with its own sheets at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitegrove.extract.css import declarations, split_selectors
from sitegrove.extract.dom import Node, parse_html
from sitegrove.extract.javascript import _TOKEN, tokens
from sitegrove.extract.selectors import matches, specificity
from sitegrove.graph import Graph
from sitegrove.operators.query import Query, predicate
from sitegrove.plans.pipeline import transform


def rules(sheet: str, media: tuple[str, ...] = ("", "all", "screen")) -> list[tuple[str, list[str]]]:
    """(selector list, declarations) of the style rules that apply to these media, in order."""
    out: list[tuple[str, list[str]]] = []
    last: tuple[str, ...] | None = None
    for kind, around, body in declarations(sheet):
        if kind == "prelude":
            last = None
        elif kind == "declaration" and around and not around[-1].startswith("@"):
            queries = [a.partition(" ")[2].strip().lower() for a in around[:-1] if a.lower().startswith("@media")]
            if any(a.startswith("@") and not a.lower().startswith("@media") for a in around[:-1]) or not all(q in media for q in queries):
                continue
            if last != around:
                out.append((around[-1], []))
                last = around
            out[-1][1].append(body)
    return out


def with_inline_styles(page: str, sheets: list[str]) -> str:
    """The page with every matching declaration in style attributes: by specificity, then order; own styles come last."""
    flat = [(specificity(s), n, s, body) for n, (selectors, body) in enumerate(r for sheet in sheets for r in rules(sheet)) for s in split_selectors(selectors)]
    edits: list[tuple[int, int, str]] = []
    for node in parse_html(page).walk():
        if node.tag.startswith(("#", "?")) or node.in_head or node.tag in ("html", "head"):
            continue
        found = sorted(((key, n, body) for key, n, s, body in flat if matches(node, s, static=False)), key=lambda x: x[:2])
        if not found:
            continue
        own = [d.strip() for d in (node.get("style") or "").split(";") if d.strip()]
        chosen: dict[str, str] = {}
        for d in [d for _, _, body in found for d in body] + own:
            name = d.partition(":")[0].strip().lower()
            if "!important" in chosen.get(name, "") and "!important" not in d:
                continue
            chosen.pop(name, None)
            chosen[name] = re.sub(r"\s*:\s*", ": ", d, count=1)
        value = "; ".join(chosen.values()).replace('"', "&quot;")
        head = page[node.start : node.open_end]
        bare = re.sub(r"\sstyle\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)", "", head, flags=re.I)
        edits.append((node.start, node.open_end, re.sub(r"(\s*/?>)$", lambda m: f' style="{value}"{m.group(1)}', bare)))
    out, at = [], 0
    for start, end, text in sorted(edits):
        out += [page[at:start], text]
        at = end
    return "".join([*out, page[at:]])


def critical_rules(page: str, sheets: list[str]) -> str:
    """The rules of the sheets that match an element of the body before its first style sheet."""
    critical: list[Node] = []
    for node in parse_html(page).walk():
        if node.in_head or node.tag.startswith(("#", "?")):
            continue
        if node.tag == "style" or (node.tag == "link" and "stylesheet" in node.tokens("rel")):
            break
        critical.append(node)
    kept = [(selector, body) for sheet in sheets for selector, body in rules(sheet) if any(matches(n, selector) for n in critical)]
    return "".join(f"{selector}{{{';'.join(body)}}}" for selector, body in kept)


def with_critical_css(page: str, sheets: list[str]) -> str:
    """The page with its critical rules in a style element at the end of the head."""
    css = critical_rules(page, sheets)
    m = re.search(r"</head\s*>", page, re.I) if css else None
    return f"{page[: m.start()]}<style>{css}</style>{page[m.start() :]}" if m else page


def _sheets(graph: Graph, pages: DataFrame) -> DataFrame:
    """id, text and the texts of each page's styles in order."""
    texts = graph.assets.where(F.col("type") == "Css").select(F.col("id").alias("to_id"), F.col("text").alias("_css"))
    styles = graph.relations.where(F.col("type") == "HtmlStyle").join(texts, "to_id").where(F.col("_css").isNotNull())
    own = styles.groupBy(F.col("from_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_css"))), lambda x: x["_css"]).alias("_sheets"))
    return pages.select("id", "text").join(own, "id")


def _rewrite(graph: Graph, wanted: Query, f) -> Graph:
    @F.pandas_udf(StringType())
    def work(text: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, list(s)) for t, s in zip(text, sheets)], dtype=object)

    pages = graph.find_assets({"type": "Html"} | dict(wanted or {}))
    changed = _sheets(graph, pages).select("id", work("text", "_sheets").alias("_text"))
    return graph.with_(assets=graph.assets.join(changed, "id", "left").withColumn("text", F.coalesce("_text", "text")).select(*graph.assets.columns))


@transform
def convert_stylesheets_to_inline_styles(graph: Graph, wanted: Query = None) -> Graph:
    """Style rules become style attributes of the elements they match; the pages' HtmlStyle relations go."""
    out = _rewrite(graph, wanted, with_inline_styles)
    pages = graph.find_assets({"type": "Html"} | dict(wanted or {})).select(F.col("id").alias("from_id"))
    gone = graph.relations.where(F.col("type") == "HtmlStyle").join(pages, "from_id", "left_semi").select("id")
    return out.with_(relations=graph.relations.join(gone, "id", "left_anti"))


@transform
def inline_critical_css(graph: Graph, wanted: Query = None) -> Graph:
    return _rewrite(graph, wanted, with_critical_css)


@transform
def inline_html_templates(graph: Graph, wanted: Query = None) -> Graph:
    """Templates that a page refers to with HtmlTemplate or HtmlInlineScriptTemplate relations become script elements at
    the end of its body, named by their file."""
    names = F.regexp_extract(F.coalesce("url", F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    templates = graph.find_assets({"url": re.compile(r"\.(?:ko|template)$")} | dict(wanted or {})).where(F.col("text").isNotNull()).select(F.col("id").alias("to_id"), names.alias("_name"), F.col("text").alias("_t"))
    used = graph.relations.join(templates, "to_id").groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("_name", "_t"))).alias("_ts"))
    scripts = F.array_join(F.transform("_ts", lambda t: F.concat(F.lit('<script type="text/html" id="'), t["_name"], F.lit('">'), t["_t"], F.lit("</script>"))), "")
    at = F.regexp_instr(F.col("text"), F.lit(r"(?i)</body\s*>"))
    joined = graph.assets.join(used, "id", "left")
    text = F.when(at > 0, F.concat(F.substr("text", F.lit(1), at - 1), scripts, F.substr("text", at))).otherwise(F.concat("text", scripts))
    return graph.with_(assets=joined.withColumn("text", F.when((F.col("type") == "Html") & F.col("_ts").isNotNull(), text).otherwise(F.col("text"))).select(*graph.assets.columns))


def replace_symbols(text: str, values: dict[str, str]) -> str:
    """JavaScript with free names (dotted ones too) replaced by expressions; not where they are assigned or members."""
    if not values or not any(v.split(".")[0] in text for v in values):
        return text
    out, at = [], 0
    previous = ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        end, piece = m.end(), m.group()
        if m.lastgroup == "name" and previous not in (".", "var", "let", "const", "function"):
            for name in sorted(values, key=len, reverse=True):
                after = re.compile(r"(?![\w$])(?!\s*(?:=(?!=)|:(?!:)|\+\+|--|[-+*/%&|^]=))").match(text, at + len(name))
                if text.startswith(name, at) and after and not (name == piece and re.compile(r"\s*\.").match(text, at + len(name)) and any(o.startswith(name + ".") and text.startswith(o, at) for o in values)):
                    piece, end = values[name], at + len(name)
                    break
        if m.lastgroup not in ("space", "comment"):
            previous = m.group()
        out.append(piece)
        at = end
    return "".join(out)


@transform
def replace_symbols_in_javascript(graph: Graph, values: dict[str, str], wanted: Query = None) -> Graph:
    match: Column = predicate(graph.assets, {"type": "JavaScript"} | dict(wanted or {}))

    @F.pandas_udf(StringType())
    def work(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replace_symbols(t, values) for t in text], dtype=object)

    return graph.with_(assets=graph.assets.withColumn("text", F.coalesce(work(F.when(match, F.col("text"))), F.col("text"))))


@transform
def serialize_source_maps(graph: Graph) -> Graph:
    """A SourceMap asset beside each script or sheet whose property source_map holds a map's text, with its relation; maps
    that nothing refers to any more go."""
    held = F.try_element_at(F.coalesce("props", F.create_map().cast("map<string,string>")), F.lit("source_map_text"))
    owners = graph.assets.where(held.isNotNull() & F.col("url").isNotNull()).withColumn("_map", F.md5(F.concat(F.lit("map|"), F.col("id"))))
    columns = {"id": F.col("_map"), "type": F.lit("SourceMap"), "url": F.concat("url", F.lit(".map")), "text": held}
    maps = owners.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in graph.assets.schema.fields])
    edge = {"id": F.md5(F.concat(F.lit("map-of|"), F.col("id"))), "type": F.when(F.col("type") == "Css", "CssSourceMappingUrl").otherwise("JavaScriptSourceMappingUrl"), "from_id": F.col("id"), "to_id": F.col("_map"), "href": F.concat(F.regexp_extract("url", r"([^/]+)$", 1), F.lit(".map"))}
    edges = owners.select(*[edge.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in graph.relations.schema.fields])
    comments = F.col("type").isin("CssSourceMappingUrl", "JavaScriptSourceMappingUrl")
    rest = graph.relations.join(owners.select(F.col("id").alias("from_id")), "from_id", "left_semi").where(comments).select("id")
    relations = graph.relations.join(rest, "id", "left_anti").unionByName(edges)
    orphans = graph.assets.where(F.col("type") == "SourceMap").select("id").join(relations.select(F.col("to_id").alias("id")), "id", "left_anti")
    return graph.with_(assets=graph.assets.join(orphans, "id", "left_anti").unionByName(maps), relations=relations)


def global_uses(text: str) -> dict[str, int]:
    """How often each dotted name that starts with a free name is used in a script."""
    out: dict[str, int] = {}
    code = [t for t in tokens(text) if t[0] != "comment"]
    for i, (kind, value) in enumerate(code):
        if kind == "name" and not value[0].isdigit() and (i == 0 or code[i - 1][1] != "."):
            name, j = value, i + 1
            while j + 1 < len(code) and code[j][1] == "." and code[j + 1][0] == "name":
                name += "." + code[j + 1][1]
                j += 2
                out[name] = out.get(name, 0) + 1
    return out
