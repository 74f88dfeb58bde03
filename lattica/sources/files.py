"""Graph files: Parquet, delimited edge lists, adjacency lists, node-link JSON, GraphML, GEXF, DOT and Mermaid.

Line formats and Parquet are read and written by Spark in parallel. The document formats are single files
by their nature: read through Spark's text source as one row, parsed in one task, written by one task.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import GraphError
from lattica.operators.model import Graph

# fixed values: file endings and their formats
FORMATS = {
    ".csv": "edgelist", ".tsv": "edgelist", ".edgelist": "edgelist", ".txt": "edgelist", ".adjlist": "adjacency", ".json": "json",
    ".graphml": "graphml", ".gexf": "gexf", ".dot": "dot", ".gv": "dot", ".mmd": "mermaid", ".parquet": "parquet",
}


def _format(path: str, format: str | None) -> str:
    if format:
        return format
    ending = re.search(r"\.[a-z]+$", path.rstrip("/"))
    if not ending or ending[0] not in FORMATS:
        raise GraphError(f"unknown format: {path}")
    return FORMATS[ending[0]]


def read(spark: SparkSession, path: str, format: str | None = None, **kw) -> Graph:
    return {
        "edgelist": read_edgelist, "adjacency": read_adjacency_list, "json": read_json, "graphml": read_graphml, "gexf": read_gexf,
        "dot": read_dot, "mermaid": read_mermaid, "parquet": read_parquet,
    }[_format(path, format)](spark, path, **kw)


def write(g: Graph, path: str, format: str | None = None, **kw) -> None:
    {
        "edgelist": write_edgelist, "adjacency": write_adjacency_list, "json": write_json, "graphml": write_graphml, "gexf": write_gexf,
        "dot": write_dot, "mermaid": write_mermaid, "parquet": write_parquet,
    }[_format(path, format)](g, path, **kw)


def read_parquet(spark: SparkSession, path: str) -> Graph:
    """A folder with nodes and edges tables."""
    nodes, edges = (spark.read.parquet(f"{path.rstrip('/')}/{x}") for x in ("nodes", "edges"))
    return Graph(nodes, edges.drop("directed"), bool((edges.select("directed").first() or [False])[0]))


def write_parquet(g: Graph, path: str) -> None:
    g.nodes.write.parquet(f"{path.rstrip('/')}/nodes")
    g.edges.withColumn("directed", F.lit(g.directed)).write.parquet(f"{path.rstrip('/')}/edges")


# lines


def _typed(edges: DataFrame, nodes: DataFrame | None = None):
    """Ids as longs where all of them are canonical integers, else as they are; 007 stays text."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")) if nodes is None else edges.select(F.explode(F.array("src", "dst")).alias("id")).union(nodes.select("id"))
    whole = ids.where("id is not null").where(~F.col("id").rlike(r"^(0|-?[1-9][0-9]{0,17})$")).isEmpty()
    if not whole:
        return edges, nodes
    e = edges.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
    return e, None if nodes is None else nodes.withColumn("id", F.col("id").cast("long"))


def _value(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def read_edgelist(spark: SparkSession, path: str, delimiter: str | None = None, directed: bool = False, header: bool | str = "auto", comments: str = "#") -> Graph:
    """src and dst come first, a third unnamed column is w; a row without dst is a node alone."""
    head = [r[0] for r in spark.read.text(path).where(~F.col("value").startswith(comments)).where("trim(value) <> ''").limit(20).collect()]
    if not head:
        empty = spark.range(0)
        return Graph(empty.withColumn("ord", F.col("id")), empty.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("id").alias("ord")), directed)
    if delimiter is None:
        delimiter = next((d for d in (",", "\t", ";", "|") if all(d in x for x in head)), " ")
    first = [x.strip().strip('"').lower() for x in head[0].split(delimiter)]
    named = header is True or header == "auto" and first[0] in ("source", "src", "from", "u", "node1")
    df = spark.read.csv(path, sep=delimiter, header=named, comment=comments, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cols = df.columns
    if len(cols) < 2:
        raise GraphError("an edge list has two columns at least")
    rest = [c if named else ("w" if k == 0 else f"col{k}") for k, c in enumerate(cols[2:])]
    df = df.toDF("src", "dst", *rest)
    df = df.select(_value("src").alias("src"), _value("dst").alias("dst"), *[_value(c).alias(c) for c in rest]).where("src is not null")
    for c in rest:
        if df.where(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).isEmpty():
            df = df.withColumn(c, F.col(c).cast("double"))
    nodes = df.select(F.col("src").alias("id")).distinct()
    edges, nodes = _typed(df.where("dst is not null"), nodes)
    return Graph.from_edges(edges, directed=directed, nodes=nodes)


def write_edgelist(g: Graph, path: str, delimiter: str = ",", header: bool = True, isolates: bool = True) -> None:
    e = g.edges.drop("ord").select(*[F.col(c).cast("string").alias({"src": "source", "dst": "target"}.get(c, c)) for c in g.edges.columns if c != "ord"])
    if isolates:
        alone = g.nodes.join(g.edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti").select(F.col("id").cast("string").alias("source"))
        e = e.unionByName(alone, allowMissingColumns=True)
    e.write.csv(path, sep=delimiter, header=header)


def read_adjacency_list(spark: SparkSession, path: str, delimiter: str = " ", directed: bool = False, comments: str = "#") -> Graph:
    """A node and its neighbours on each line."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comments)).where("trim(value) <> ''")
    parts = F.filter(F.split(F.trim("value"), r"\s+" if delimiter == " " else re.escape(delimiter)), lambda x: x != "")
    rows = lines.select(parts.alias("p"))
    edges = rows.select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("dst"))
    edges, nodes = _typed(edges, rows.select(F.get("p", F.lit(0)).alias("id")).distinct())
    return Graph.from_edges(edges, directed=directed, nodes=nodes)


def write_adjacency_list(g: Graph, path: str, delimiter: str = " ") -> None:
    near = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("n"))
    line = F.concat_ws(delimiter, F.col("id").cast("string"), F.array_join(F.col("n").cast("array<string>"), delimiter))
    g.nodes.join(near, "id", "left").select(F.when(F.col("n").isNull(), F.col("id").cast("string")).otherwise(line).alias("value")).write.text(path)


# documents


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _emit(g: Graph, path: str, text: str) -> None:
    g.nodes.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _build(spark: SparkSession, nodes: dict, edges: list[tuple], directed: bool) -> Graph:
    """nodes: {id: attributes} in order; edges: (src, dst, attributes); repeated edges merge, the last value wins."""
    at: dict = {}
    for u, v, _ in edges:
        nodes.setdefault(u, {})
        nodes.setdefault(v, {})
    for k in nodes:
        at[k] = len(at)
    merged: dict = {}
    for u, v, attrs in edges:
        key = (u, v) if directed or at[u] <= at[v] else (v, u)
        merged.setdefault(key, {}).update({k: x for k, x in attrs.items() if x is not None})
    whole = bool(nodes) and all(isinstance(k, int) for k in nodes)
    kind = "long" if whole else "string"
    as_id = (lambda x: x) if whole else str

    def table(rows: list[tuple], names: list[str], attrs: list[dict]) -> DataFrame:
        keys = list(dict.fromkeys(k for a in attrs for k in a))
        types = {k: _type([a[k] for a in attrs if a.get(k) is not None]) for k in keys}
        cast = {"boolean": bool, "long": int, "double": float, "string": lambda x: x if isinstance(x, str) else json.dumps(x)}
        data = [(*r, *[None if a.get(k) is None else cast[types[k]](a[k]) for k in keys]) for r, a in zip(rows, attrs)]
        schema = ", ".join([*names, *[f"`{k}` {types[k]}" for k in keys]])
        return spark.createDataFrame(data, schema)

    n = table([(as_id(k), i) for k, i in at.items()], [f"id {kind}", "ord long"], list(nodes.values()))
    e = table([(as_id(u), as_id(v), i) for i, (u, v) in enumerate(merged)], [f"src {kind}", f"dst {kind}", "ord long"], list(merged.values()))
    return Graph(n, e, directed)


def _type(values: list) -> str:
    """The narrowest of boolean, long, double and string that holds all values."""
    if values and all(isinstance(x, bool) for x in values):
        return "boolean"
    if values and all(isinstance(x, int) and not isinstance(x, bool) for x in values):
        return "long"
    if values and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        return "double"
    return "string"


def _rows(df: DataFrame, drop: tuple[str, ...]) -> list[tuple[dict, dict]]:
    return [({k: r[k] for k in drop if k in r}, {k: x for k, x in r.items() if k not in drop and x is not None}) for r in (x.asDict(True) for x in df.orderBy("ord").collect())]


def to_json(g: Graph) -> str:
    nodes = [{"id": k["id"], **a} for k, a in _rows(g.nodes, ("id", "ord"))]
    edges = [{"source": k["src"], "target": k["dst"], **a} for k, a in _rows(g.edges, ("src", "dst", "ord"))]
    return json.dumps({"directed": g.directed, "multigraph": False, "nodes": nodes, "edges": edges}, indent=1, default=str)


def from_json(spark: SparkSession, text: str) -> Graph:
    """Node-link documents; edges may be called links, and name their ends by place where no node has an id."""
    d = json.loads(text)
    listed = d.get("nodes", [])
    by_place = bool(listed) and not any("id" in n for n in listed)
    key = lambda k, n: n.get("name", k) if by_place else n["id"]
    names = [key(k, n) for k, n in enumerate(listed)]
    nodes = {i: {k: x for k, x in n.items() if k != "id"} for i, n in zip(names, listed)}
    end = lambda x: x.get("id") if isinstance(x, dict) else names[x] if by_place and isinstance(x, int) else x
    edges = [(end(e["source"]), end(e["target"]), {k: x for k, x in e.items() if k not in ("source", "target", "key")}) for e in d.get("edges", d.get("links", []))]
    return _build(spark, nodes, edges, bool(d.get("directed") or d.get("dag")))


def read_json(spark: SparkSession, path: str) -> Graph:
    return from_json(spark, _text(spark, path))


def write_json(g: Graph, path: str) -> None:
    _emit(g, path, to_json(g))


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parsed(text: str, kind: str):
    return text in ("true", "1") if kind == "boolean" else int(text) if kind in ("int", "integer", "long") else float(text) if kind in ("float", "double") else text


def _ids(found: list[str]):
    """Whole numbers if all ids are canonical ones."""
    whole = bool(found) and all(re.fullmatch(r"0|-?[1-9][0-9]{0,17}", x) for x in found)
    return int if whole else str


def from_graphml(spark: SparkSession, text: str) -> Graph:
    root = ET.fromstring(text)
    keys, defaults = {}, {}
    for k in (x for x in root.iter() if _plain(x.tag) == "key"):
        if k.get("attr.name"):
            keys[k.get("id")] = (k.get("attr.name"), k.get("attr.type", "string"))
            for d in k:
                if _plain(d.tag) == "default" and d.text is not None:
                    defaults.setdefault(k.get("for", "all"), {})[k.get("attr.name")] = _parsed(d.text, k.get("attr.type", "string"))

    def attrs(x, domain: str) -> dict:
        out = {**defaults.get("all", {}), **defaults.get(domain, {})}
        for d in x:
            if _plain(d.tag) == "data":
                if d.get("key") not in keys:
                    raise GraphError(f"a key isn't declared: {d.get('key')}")
                name, kind = keys[d.get("key")]
                out[name] = _parsed(d.text or "", kind)
        return out

    if any(_plain(x.tag) == "hyperedge" for x in root.iter()):
        raise GraphError("hyperedges aren't edges")
    graph = next(x for x in root.iter() if _plain(x.tag) == "graph")
    found = [x for x in root.iter() if _plain(x.tag) == "node"]
    as_id = _ids([x.get("id") for x in found])
    nodes = {as_id(x.get("id")): attrs(x, "node") for x in found}
    edges = [(as_id(x.get("source")), as_id(x.get("target")), attrs(x, "edge")) for x in root.iter() if _plain(x.tag) == "edge"]
    return _build(spark, nodes, edges, graph.get("edgedefault") == "directed")


def read_graphml(spark: SparkSession, path: str) -> Graph:
    return from_graphml(spark, _text(spark, path))


def _xml(x) -> str:
    return quoteattr(str(x).lower() if isinstance(x, bool) else str(x))


def to_graphml(g: Graph) -> str:
    n, e = _rows(g.nodes, ("id", "ord")), _rows(g.edges, ("src", "dst", "ord"))
    out, key = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'], {}
    for domain, rows in (("node", n), ("edge", e)):
        for name in dict.fromkeys(k for _, a in rows for k in a):
            key[domain, name] = f"d{len(key)}"
            out.append(f'<key id="{key[domain, name]}" for="{domain}" attr.name={_xml(name)} attr.type="{_type([a[name] for _, a in rows if name in a])}"/>')
    data = lambda d, a: "".join(f'<data key="{key[d, k]}">{_xml(x)[1:-1]}</data>' for k, x in a.items())
    out.append(f'<graph edgedefault="{"directed" if g.directed else "undirected"}">')
    out += [f"<node id={_xml(k['id'])}>{data('node', a)}</node>" for k, a in n]
    out += [f"<edge source={_xml(k['src'])} target={_xml(k['dst'])}>{data('edge', a)}</edge>" for k, a in e]
    return "\n".join([*out, "</graph>", "</graphml>"])


def write_graphml(g: Graph, path: str) -> None:
    _emit(g, path, to_graphml(g))


def from_gexf(spark: SparkSession, text: str) -> Graph:
    root = ET.fromstring(text)
    graph = next(x for x in root.iter() if _plain(x.tag) == "graph")
    keys: dict = {}
    for block in (x for x in graph.iter() if _plain(x.tag) == "attributes"):
        for a in block:
            keys[block.get("class"), a.get("id")] = (a.get("title"), a.get("type", "string"))

    def attrs(x, domain: str) -> dict:
        out = {k: x.get(k) for k in ("label",) if x.get(k) is not None}
        if x.get("weight") is not None:
            out["weight"] = float(x.get("weight"))
        for v in (y for y in x.iter() if _plain(y.tag) == "attvalue"):
            name, kind = keys[domain, v.get("for")]
            out[name] = _parsed(v.get("value"), kind)
        for v in x:
            if _plain(v.tag) == "position":
                out |= {"x": float(v.get("x")), "y": -float(v.get("y"))}
            elif _plain(v.tag) == "size":
                out["size"] = float(v.get("value"))
        return out

    found = [x for x in graph.iter() if _plain(x.tag) == "node"]
    as_id = _ids([x.get("id") for x in found])
    edges = [(as_id(x.get("source")), as_id(x.get("target")), attrs(x, "edge")) for x in graph.iter() if _plain(x.tag) == "edge"]
    return _build(spark, {as_id(x.get("id")): attrs(x, "node") for x in found}, edges, graph.get("defaultedgetype") == "directed")


def read_gexf(spark: SparkSession, path: str) -> Graph:
    return from_gexf(spark, _text(spark, path))


def to_gexf(g: Graph) -> str:
    n, e = _rows(g.nodes, ("id", "ord")), _rows(g.edges, ("src", "dst", "ord"))
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', f'<graph defaultedgetype="{"directed" if g.directed else "undirected"}">']
    own = {"node": ("label",), "edge": ("label", "weight")}
    key: dict = {}
    for domain, rows in (("node", n), ("edge", e)):
        names = [k for k in dict.fromkeys(k for _, a in rows for k in a) if k not in own[domain]]
        key |= {(domain, k): i for i, k in enumerate(names)}
        if names:
            out.append(f'<attributes class="{domain}">' + "".join(f'<attribute id="{i}" title={_xml(k)} type="{_type([a[k] for _, a in rows if k in a])}"/>' for i, k in enumerate(names)) + "</attributes>")

    def item(domain: str, head: str, a: dict) -> str:
        head += "".join(f" {k}={_xml(a[k])}" for k in own[domain] if k in a)
        values = "".join(f'<attvalue for="{key[domain, k]}" value={_xml(x)}/>' for k, x in a.items() if (domain, k) in key)
        return f"<{head}>{f'<attvalues>{values}</attvalues>' if values else ''}</{domain}>"

    out += ["<nodes>", *[item("node", f"node id={_xml(k['id'])}", a) for k, a in n], "</nodes>", "<edges>"]
    out += [item("edge", f'edge id="{i}" source={_xml(k["src"])} target={_xml(k["dst"])}', a) for i, (k, a) in enumerate(e)]
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>"])


def write_gexf(g: Graph, path: str) -> None:
    _emit(g, path, to_gexf(g))


class DotSyntaxError(GraphError):
    """A DOT text isn't one; names the line and column."""


_DOT = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^\#[^\n]*)|(?P<id>[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*|-?(?:\.\d+|\d+(?:\.\d*)?)|"(?:[^"\\]|\\.)*")|(?P<op>->|--|[{}\[\];,=:])""", re.S | re.M)


def from_dot(spark: SparkSession, text: str) -> Graph:
    """Nodes, edge chains, subgraphs as ends (cross products), nested defaults, ports (dropped)."""
    tokens, at = [], 0
    while at < len(text):
        m = _DOT.match(text, at)
        if not m:
            raise DotSyntaxError(f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}")
        if m.lastgroup != "skip":
            tokens.append((m[0] if m.lastgroup == "op" or m[0][0] != '"' else re.sub(r"\\\n", "", m[0][1:-1]).replace('\\"', '"'), m.lastgroup, at))
        at = m.end()
    pos = 0

    def peek(k: int = 0):
        return tokens[pos + k][0] if pos + k < len(tokens) else None

    def take(want: str | None = None):
        nonlocal pos
        if pos >= len(tokens) or want is not None and tokens[pos][0] != want:
            place = tokens[pos][2] if pos < len(tokens) else len(text)
            raise DotSyntaxError(f"line {text.count(chr(10), 0, place) + 1}, column {place - text.rfind(chr(10), 0, place)}: wants {want or 'more'}")
        pos += 1
        return tokens[pos - 1][0]

    if (peek() or "").lower() == "strict":
        take()
    kind = take().lower()
    if kind not in ("graph", "digraph"):
        raise DotSyntaxError("line 1, column 1: wants graph or digraph")
    directed, nodes, edges = kind == "digraph", {}, []
    if peek() != "{":
        take()

    def attributes() -> dict:
        out: dict = {}
        while peek() == "[":
            take("[")
            while peek() != "]":
                name = take()
                value: object = "true"
                if peek() == "=":
                    take("=")
                    value = take()
                    if re.fullmatch(r"-?[0-9]+", str(value)):
                        value = int(str(value))
                    elif re.fullmatch(r"-?(?:\.\d+|\d+\.\d*)", str(value)):
                        value = float(str(value))
                out[name] = value
                if peek() in (",", ";"):
                    take()
            take("]")
        return out

    def node(name: str, defaults: dict) -> str:
        if name not in nodes:
            nodes[name] = dict(defaults)
        if peek() == ":":
            take(":")
            take()
            if peek() == ":":
                take(":")
                take()
        return name

    def block(n_def: dict, e_def: dict) -> list[str]:
        n_def, e_def, members = dict(n_def), dict(e_def), []
        take("{")
        while peek() != "}":
            if peek() in (";", ","):
                take()
                continue
            word = peek()
            if isinstance(word, str) and word.lower() in ("node", "edge", "graph") and peek(1) == "[":
                take()
                {"node": n_def, "edge": e_def, "graph": {}}[word.lower()].update(attributes())
                continue
            if peek(1) == "=" and word != "{":
                take()
                take("=")
                take()
                continue
            chain = [operand(n_def, e_def)]
            while peek() in ("->", "--"):
                if (take() == "->") is not directed:
                    raise DotSyntaxError("-> is for digraphs, -- for graphs")
                chain.append(operand(n_def, e_def))
            a = attributes()
            if len(chain) == 1 and len(chain[0]) == 1:
                nodes[chain[0][0]].update(a)
            for left, right in zip(chain, chain[1:]):
                edges.extend((u, v, {**e_def, **a}) for u in left for v in right)
            members += [x for c in chain for x in c]
        take("}")
        return list(dict.fromkeys(members))

    def operand(n_def: dict, e_def: dict) -> list[str]:
        if (peek() or "").lower() == "subgraph":
            take()
            if peek() != "{":
                take()
            return block(n_def, e_def)
        return block(n_def, e_def) if peek() == "{" else [node(take(), n_def)]

    block({}, {})
    as_id = _ids(list(nodes))
    return _build(spark, {as_id(k): a for k, a in nodes.items()}, [(as_id(u), as_id(v), a) for u, v, a in edges], directed)


def read_dot(spark: SparkSession, path: str) -> Graph:
    return from_dot(spark, _text(spark, path))


def to_dot(g: Graph, name: str = "G") -> str:
    quote = lambda x: str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else '"' + str(x).replace('"', '\\"') + '"'
    listed = lambda a: f" [{', '.join(f'{quote(str(k))}={quote(x)}' for k, x in a.items())}]" if a else ""
    mark = "->" if g.directed else "--"
    out = [f"{'digraph' if g.directed else 'graph'} {quote(name)} {{"]
    out += [f"  {quote(k['id'])}{listed(a)};" for k, a in _rows(g.nodes, ("id", "ord"))]
    out += [f"  {quote(k['src'])} {mark} {quote(k['dst'])}{listed(a)};" for k, a in _rows(g.edges, ("src", "dst", "ord"))]
    return "\n".join([*out, "}"])


def write_dot(g: Graph, path: str) -> None:
    _emit(g, path, to_dot(g))


_SHAPE = r"(?:\(\[(.*?)\]\)|\[\[(.*?)\]\]|\(\((.*?)\)\)|\{\{(.*?)\}\}|\[(.*?)\]|\((.*?)\)|\{(.*?)\}|>(.*?)\])"
_NODE = re.compile(rf"\s*([A-Za-z0-9_]+)\s*(?:{_SHAPE})?")
_LINK = re.compile(r"\s*(?:--\s+([^-=.]*?)\s+-->|(-->|---|-\.->|==>|--[xo]|~~~))\s*(?:\|([^|]*)\|)?")


def from_mermaid(spark: SparkSession, text: str) -> Graph:
    """Flowcharts: shapes with labels, links with labels, chains, & lists, subgraphs (their names as cluster)."""
    nodes, edges, clusters, arrow = {}, [], [], False
    lines = [x.strip() for x in re.split(r"[\n;]", re.sub(r"%%[^\n]*", "", text)) if x.strip()]
    if not lines or not re.match(r"(graph|flowchart)\b", lines[0]):
        raise GraphError("not a flowchart")
    for line in lines[1:]:
        if line.startswith("subgraph"):
            clusters.append(line[8:].strip())
            continue
        if line == "end":
            clusters.pop()
            continue
        if re.match(r"(style|classDef|class|click|linkStyle|direction)\b", line):
            continue
        at, left, link = 0, None, None
        while at < len(line):
            group = []
            while m := _NODE.match(line, at):
                a = nodes.setdefault(m[1], {})
                label = next((x for x in m.groups()[1:] if x is not None), None)
                if label is not None:
                    a["label"] = label.strip('"')
                if clusters:
                    a["cluster"] = clusters[-1]
                group.append(m[1])
                at = m.end()
                if not (amp := re.match(r"\s*&", line[at:])):
                    break
                at += amp.end()
            if not group:
                raise GraphError(f"not a flowchart's line: {line}")
            if left is not None:
                edges += [(u, v, dict(link)) for u in left for v in group]
            m = _LINK.match(line, at)
            if not m:
                break
            arrow |= m[2] in (None, "-->", "-.->", "==>", "--x", "--o")
            link = {"label": (m[1] or m[3] or "").strip()} if (m[1] or m[3]) else {}
            left, at = group, m.end()
    as_id = _ids(list(nodes))
    return _build(spark, {as_id(k): a for k, a in nodes.items()}, [(as_id(u), as_id(v), a) for u, v, a in edges], arrow)


def read_mermaid(spark: SparkSession, path: str) -> Graph:
    return from_mermaid(spark, _text(spark, path))


def to_mermaid(g: Graph, direction: str = "TD") -> str:
    n = _rows(g.nodes, ("id", "ord"))
    plain = all(re.fullmatch(r"[A-Za-z0-9_]+", str(k["id"])) for k, _ in n)
    name = {k["id"]: str(k["id"]) if plain else f"n{i}" for i, (k, _) in enumerate(n)}
    code = lambda x: str(x).replace("&", "#amp;").replace('"', "#quot;")
    out = [f"flowchart {direction}", *[f'  {name[k["id"]]}["{code(a.get("label", k["id"]))}"]' for k, a in n]]
    mark = "-->" if g.directed else "---"
    out += [f"  {name[k['src']]} {mark}{'|' + code(a['label']) + '|' if 'label' in a else ''} {name[k['dst']]}" for k, a in _rows(g.edges, ("src", "dst", "ord"))]
    return "\n".join(out)


def write_mermaid(g: Graph, path: str) -> None:
    _emit(g, path, to_mermaid(g))


# tables


def from_pandas(spark: SparkSession, edges, nodes=None, source: str = "source", target: str = "target", node_id: str = "id", directed: bool = False) -> Graph:
    """Pandas tables of edges and, optionally, nodes; missing ends are errors, missing cells nulls."""
    if edges[[source, target]].isna().any().any():
        raise GraphError("an edge has no end")
    e = spark.createDataFrame(edges.rename(columns={source: "src", target: "dst"}))
    return Graph.from_edges(e, directed=directed, nodes=None if nodes is None else spark.createDataFrame(nodes.rename(columns={node_id: "id"})))


def to_pandas(g: Graph):
    return g.nodes.orderBy("ord").drop("ord").toPandas(), g.edges.orderBy("ord").drop("ord").toPandas()


def from_numpy(spark: SparkSession, a, directed: bool | None = None) -> Graph:
    """A square matrix; zeros are no edges; a symmetric one is undirected unless told otherwise."""
    import numpy as np

    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise GraphError("not a square matrix")
    directed = not bool((a == a.T).all()) if directed is None else directed
    i, j = np.nonzero(a if directed else np.triu(a))
    rows = [(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)]
    return Graph(spark.range(a.shape[0]).withColumn("ord", F.col("id")), spark.createDataFrame(rows, "src long, dst long, w double").withColumn("ord", F.struct("src", "dst")), directed)


def to_numpy(g: Graph, weight: str | None = "w", nonedge: float = 0.0):
    import numpy as np

    ids = {r[0]: k for k, r in enumerate(g.nodes.orderBy("ord").select("id").collect())}
    out = np.full((len(ids), len(ids)), nonedge)
    for s, d, w in g.arcs(weight if weight in g.edges.columns else None).collect():
        out[ids[s], ids[d]] = w
    return out


# other libraries' objects


def to_dict(g: Graph) -> dict:
    """{id: {neighbour: the edge's columns}} of a graph that the driver holds; an undirected edge stands both ways."""
    out: dict = {r["id"]: {} for r in g.nodes.select("id").collect()}
    for r in g.edges.drop("ord").collect():
        rest = {k: v for k, v in r.asDict().items() if k not in ("src", "dst")}
        out[r["src"]][r["dst"]] = rest
        if not g.directed:
            out[r["dst"]][r["src"]] = rest
    return out


def from_dict(spark: SparkSession, data: dict, directed: bool = False) -> Graph:
    """Of {id: neighbours}, where neighbours are a list, or a dict of a weight or of columns each."""
    edges = []
    for u, near in data.items():
        for v in near:
            own = near[v] if isinstance(near, dict) else {}
            edges.append((u, v, dict(own) if isinstance(own, dict) else {"w": own}))
    for _, v, _ in edges:
        data = data if v in data else {**data, v: ()}
    return _build(spark, {k: {} for k in data}, edges, directed)


def from_networkx(spark: SparkSession, graph) -> Graph:
    """Of any object with is_directed(), nodes(data=True) and edges(data=True); weight becomes w."""
    named = lambda d: {"w" if k == "weight" else k: v for k, v in d.items()}
    return _build(spark, {n: dict(d) for n, d in graph.nodes(data=True)}, [(u, v, named(d)) for u, v, d in graph.edges(data=True)], graph.is_directed())


def to_networkx(g: Graph):
    """A networkx graph; that library must be there."""
    import networkx

    out = networkx.DiGraph() if g.directed else networkx.Graph()
    for r in g.nodes.drop("ord").collect():
        d = r.asDict()
        out.add_node(d.pop("id"), **d)
    for r in g.edges.drop("ord").collect():
        d = r.asDict()
        out.add_edge(d.pop("src"), d.pop("dst"), **{"weight" if k == "w" else k: v for k, v in d.items()})
    return out


def from_scipy_sparse(spark: SparkSession, matrix, directed: bool | None = None) -> Graph:
    """Of any square matrix with tocoo(): nodes are row numbers, entries weights; symmetric ones are undirected unless told."""
    m = matrix.tocoo()
    if m.shape[0] != m.shape[1]:
        raise GraphError("the matrix is not square")
    cells = {(int(i), int(j)): float(x) for i, j, x in zip(m.row, m.col, m.data) if x != 0}
    if directed is None:
        directed = any(cells.get((j, i)) != x for (i, j), x in cells.items())
    edges = [(i, j, {"w": x}) for (i, j), x in sorted(cells.items()) if directed or i <= j]
    return _build(spark, {k: {} for k in range(m.shape[0])}, edges, directed)


def to_scipy_sparse(g: Graph, weight: str | None = "w"):
    """(rows, columns, values, ids): the adjacency matrix's coordinates in graph order, for scipy.sparse.coo_array."""
    ids = [r[0] for r in g.nodes.orderBy("ord").select("id").collect()]
    at = {k: i for i, k in enumerate(ids)}
    cells = sorted((at[s], at[d], w) for s, d, w in g.arcs(weight if weight in g.edges.columns else None).collect())
    return [c[0] for c in cells], [c[1] for c in cells], [float(c[2]) for c in cells], ids
