"""Graphs as text and as HTML. A rendered graph is what one answer retrieved, so a group is small and fits a worker."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edge = tuple[str, str, str, dict]


def _roots(edges: list[Edge]) -> list[str]:
    distinct = {(s, p, o) for s, p, o, _ in edges}
    count: dict[str, int] = {}
    for s, _, _ in distinct:
        count[s] = count.get(s, 0) + 1
    return sorted(count, key=lambda n: (-count[n], n))


def _outgoing(edges: list[Edge]) -> dict[str, list[tuple[str, str, dict]]]:
    """Edges of each subject, grouped by the order in which neighbours of either direction first appear."""
    seen: dict[str, dict[str, int]] = {}
    for s, _, o, _ in edges:
        for a, b in ((s, o), (o, s)):
            seen.setdefault(a, {}).setdefault(b, len(seen[a]))
    out: dict[str, list] = {}
    for s, p, o, attrs in edges:
        out.setdefault(s, []).append((o, p, attrs))
    return {s: sorted(x, key=lambda e, s=s: seen[s][e[0]]) for s, x in out.items()}


def trees(edges: list[Edge], attributes: list[str] | None = None) -> str:
    """Indented trees from the busiest subjects down. A node seen before is named but not opened again."""
    out, done, blocks = _outgoing(edges), set(), []
    for root in _roots(edges):
        if root in done:
            continue
        lines, seen, ahead = [], set(), [(root, "", "")]
        while ahead:
            node, prefix, title = ahead.pop()
            lines.append(prefix + node + title)
            if node in seen:
                continue
            seen.add(node)
            below = out.get(node, [])
            stem = prefix[:-4] + ("" if not prefix else "    " if prefix.endswith("└── ") else "|   ")
            for other, label, attrs in reversed(below):
                corner = "└── " if other == below[-1][0] else "├── "
                shown = "" if attributes is None else f" <{', '.join(f'{a}={attrs[a]}' for a in attributes if a in attrs)}>"
                ahead.append((other, stem + corner, f" ─── ({label}{shown})"))
        done |= seen
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks).strip()


def paths(edges: list[Edge], by: str = "label") -> str:
    """A line for each path from a root to where it ends or meets a node seen before."""
    out, done, lines = _outgoing(edges), set(), []
    for root in _roots(edges):
        if root in done:
            continue
        seen: set[str] = set()
        ahead: list[tuple[str, tuple | None]] = [(root, None)]  # a path is its last step and the path before
        while ahead:
            node, path = ahead.pop()
            below = [] if node in seen else sorted(out.get(node, []), key=lambda e: e[1] if by == "label" else e[2][by])
            seen.add(node)
            ahead += [(other, (f"{node}, {label}, {other}", path)) for other, label, _ in reversed(below)]
            if not below:
                steps = []
                while path is not None:
                    step, path = path
                    steps.append(step)
                lines.append(" -> ".join(reversed(steps)))
        done |= seen
    return "\n".join(lines).strip()


def triple_lines(edges: DataFrame, key: str = "qid", by: str = "label") -> DataFrame:
    """(key, text): distinct triples as lines, by label or by round, then by insertion."""
    last = edges.groupBy(key, "subject", "label", "object").agg(F.max("ord").alias("ord"), *([] if by == "label" else [F.max_by(by, "ord").alias(by)]))
    line = F.struct(F.col(by).alias("by"), "ord", F.concat_ws(", ", "subject", "label", "object").alias("line"))
    return last.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("x")).select(key, F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("text"))


def render(edges: DataFrame, style: str = "trees", key: str = "qid", by: str = "label", attributes: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(key, text) of each key's edges in one of the styles trees, paths and triples. With ``nodes`` (key, id), a graph of
    one node is its name, edges or none."""
    if style not in ("trees", "paths", "triples"):
        raise ValueError(f"no such style: {style}")
    if nodes is not None:
        single = nodes.groupBy(key).agg(F.min("id").alias("text"), F.max("id").alias("__last")).where("text = __last").select(key, "text")
        return render(edges.join(single, key, "left_anti"), style, key, by, attributes).unionByName(single)
    if style == "triples":
        return triple_lines(edges, key, by)
    rest = [c for c in edges.columns if c not in (key, "ord", "subject", "label", "object")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        rows = [(r.subject, r.label, r.object, {c: getattr(r, c) for c in rest}) for r in pdf.itertuples()]
        text = trees(rows, attributes) if style == "trees" else paths(rows, by)
        return pd.DataFrame({key: pdf[key].iloc[:1], "text": [text]})

    return edges.groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, text string")


def summary(nodes: int, edges: int) -> str:
    return f"{nodes} entities, {edges} relations"


def gradient(steps: int) -> list[str]:
    """So many colours from blue over green and yellow to red, by a polynomial close to the turbo map."""
    def channel(x: float, c: tuple[float, ...]) -> int:
        return round(255 * min(1.0, max(0.0, sum(k * x**i for i, k in enumerate(c)))))

    red = (0.1357, 4.5974, -42.3277, 130.5887, -150.5666, 58.1375)
    green = (0.0914, 2.1856, 4.8052, -14.0195, 4.2109, 2.7747)
    blue = (0.1067, 12.5925, -60.1097, 109.0745, -88.5066, 26.8183)
    return ["#" + "".join(f"{channel(i / max(1, steps - 1), c):02x}" for c in (red, green, blue)) for i in range(steps)]


def chain_colors(chains: DataFrame, edges: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, color_index) and (ord, color_index) for chains (chain, pos, comm): community i has 2i, what leads to it 2i - 1.

    The least index over all chains counts. A node has the index of its community if it has an edge within, else the
    least odd one of the bridges it's an end of.
    """
    here = chains.select("chain", "pos", "comm")
    last = here.select("chain", (F.col("pos") + 1).alias("pos"), F.col("comm").alias("last"))
    steps = here.join(last, ["chain", "pos"]).select("pos", F.least("comm", "last").alias("a"), F.greatest("comm", "last").alias("b"))
    a = membership.select(F.col("comm").alias("cs"), F.col("node").alias("subject"))
    b = membership.select(F.col("comm").alias("co"), F.col("node").alias("object"))
    placed = edges.join(a, "subject").join(b, "object").withColumns({"a": F.least("cs", "co"), "b": F.greatest("cs", "co")})
    bridge = placed.where("cs <> co").join(steps, ["a", "b"]).select("ord", "subject", "object", (2 * F.col("pos") - 1).alias("i"))
    inner = placed.where("cs = co").join(here.select(F.col("comm").alias("cs"), "pos"), "cs").select("ord", "subject", "object", (2 * F.col("pos")).alias("i"))
    edge_index = inner.unionByName(bridge).groupBy("ord").agg(F.min("i").alias("color_index"))
    ends = lambda df, name: df.select(F.explode(F.array("subject", "object")).alias("node"), "i").groupBy("node").agg(F.min("i").alias(name))
    node_index = ends(inner, "own").join(ends(bridge, "odd"), "node", "full").select("node", F.coalesce("own", "odd").alias("color_index"))
    return node_index, edge_index


def _colored(kg, node_index: DataFrame, edge_index: DataFrame, colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes (id, color) and edges with color of a graph; what has no index has no colour."""
    color = F.try_element_at(F.array(*[F.lit(c) for c in colors]), (F.col("color_index") + 1).cast("int")).alias("color")
    nodes = kg.nodes.select("id").join(node_index.withColumnRenamed("node", "id"), "id", "left").select("id", color)
    edges = kg.edges.join(edge_index, "ord", "left").select("ord", "subject", "label", "object", color)
    return nodes, edges


def colored_chains(kg, chains: DataFrame, membership: DataFrame, colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph in the colours of :func:`chain_colors`; edges parallel to a coloured one share its
    colour when drawn."""
    return _colored(kg, *chain_colors(chains, kg.edges, membership), colors)


def colored_rounds(kg, used: DataFrame, colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph in the colours of the first round that used an edge between the same two ends (used:
    subject, object, round)."""
    lo, hi = F.least("subject", "object"), F.greatest("subject", "object")
    pair = used.groupBy(lo.alias("lo"), hi.alias("hi")).agg((F.min("round") - 1).alias("color_index"))
    node_index = pair.select(F.explode(F.array("lo", "hi")).alias("node"), "color_index").groupBy("node").agg(F.min("color_index").alias("color_index"))
    edge_index = kg.edges.select("ord", lo.alias("lo"), hi.alias("hi")).join(pair, ["lo", "hi"]).select("ord", "color_index")
    return _colored(kg, node_index, edge_index, colors)


_PAGE = """<!doctype html><meta charset="utf-8"><title>graph</title><canvas id="c" width="1200" height="800"></canvas><script>
const N=%s,E=%s,c=document.getElementById("c").getContext("2d"),at={};
N.forEach((n,i)=>{const a=2*Math.PI*i/N.length;at[n.id]=[600+340*Math.cos(a),400+340*Math.sin(a)]});
E.forEach(e=>{const p=at[e.s],q=at[e.o];c.strokeStyle=e.color;c.beginPath();c.moveTo(...p);c.lineTo(...q);c.stroke();c.fillStyle="gray";c.fillText(e.p,(p[0]+q[0])/2,(p[1]+q[1])/2)});
N.forEach(n=>{const p=at[n.id];c.fillStyle=n.color;c.beginPath();c.arc(...p,n.size/2,0,7);c.fill();c.fillStyle="black";c.fillText(n.id,...p)});
</script>"""


def save_html(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a page that draws the graph: nodes (id, color), edges (ord, subject, label, object[, color]).

    Rows are fetched a partition at a time and written as they come, so the driver never holds the graph.
    """
    from .graph import last_edge_colors

    shown = edges if "color" in edges.columns else edges.withColumn("color", F.lit(None).cast("string"))
    drawn = shown.drop("color").join(last_edge_colors(shown), "ord").orderBy("ord")
    ends = drawn.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    head, middle, tail = _PAGE.split("%s")
    points = ({"id": r["id"], "color": r["color"] or "lightgray", "size": 20} for r in nodes.join(ends, "id", "left_semi").toLocalIterator())
    lines = ({"s": r["subject"], "p": r["label"], "o": r["object"], "color": r["color"]} for r in drawn.toLocalIterator())
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for before, rows in ((head, points), (middle, lines)):
            f.write(before + "[")
            for i, x in enumerate(rows):
                f.write(("," if i else "") + json.dumps(x, ensure_ascii=False).replace("<", "\\u003c"))
            f.write("]")
        f.write(tail)
