"""Writers of covers, networks and reports. Tables are lines written by Spark; small documents are made on the driver."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(cover: DataFrame) -> DataFrame:
    """(c, value): a community's nodes, ascending, in a line."""
    m = cover.groupBy("c").agg(F.array_sort(F.collect_set("node")).alias("m"))
    return m.select("c", F.array_join(F.transform("m", lambda x: x.cast("string")), " ").alias("value"))


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """df's value column as text in the given order, in one file."""
    df.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path) if order else df.select("value").write.mode("overwrite").text(path)


def write_cover(cover: DataFrame, path: str) -> None:
    write_lines(members(cover), path, "c")


def write_edges(edges: DataFrame, path: str, both: bool = False) -> None:
    """Target, tab, source; in both directions as (source, target) pairs if wished."""
    one = edges.select(F.concat_ws("\t", "dst", "src").alias("value"))
    write_lines(one.union(edges.select(F.concat_ws("\t", "src", "dst"))) if both else one, path)


def module_lines(modules: DataFrame, only_large: bool = False) -> DataFrame:
    """(c, part, value): the header and members of each module; modules: c, node, score."""
    m = modules.groupBy("c").agg(F.array_sort(F.collect_set("node")).alias("m"), F.first("score").alias("bs"))
    if only_large:
        m = m.filter(F.size("m") > 1)
    head = F.concat(F.lit("#module "), F.col("c"), F.lit(" size: "), F.size("m"), F.lit(" bs: "), F.col("bs").cast("string"))
    body = F.array_join(F.transform("m", lambda x: x.cast("string")), " ")
    return m.select("c", F.posexplode(F.array(head, body)).alias("part", "value"))


def write_modules(modules: DataFrame, path: str, only_large: bool = False) -> None:
    write_lines(module_lines(modules, only_large), path, "c", "part")


def write_network(network: DataFrame, path: str) -> None:
    """Lines of a module network (c1, c2, n)."""
    write_lines(network.select("c1", "c2", F.concat_ws("\t", "c1", "c2", "n").alias("value")), path, "c1", "c2")


def level_statistics(cover: DataFrame, everyone: DataFrame, degree: DataFrame) -> DataFrame:
    """(coverage, modules, average_memberships, average_size, homeless, homeless_degree, homeless_degree_deviation)."""
    m = cover.distinct()
    a = m.agg(F.count_distinct("node").alias("coverage"), F.count_distinct("c").alias("modules"), F.count("*").alias("k"))
    a = a.select("coverage", "modules", (F.col("k") / F.col("coverage")).alias("average_memberships"), (F.col("k") / F.col("modules")).alias("average_size"))
    out = everyone.join(m.select("node"), "node", "left_anti").join(degree, "node", "left").na.fill(0, ["degree"])
    return a.crossJoin(out.agg(F.count("*").alias("homeless"), F.avg("degree").alias("homeless_degree"), F.stddev_pop("degree").alias("homeless_degree_deviation")))


def tree_lines(partition: DataFrame, flow: DataFrame) -> DataFrame:
    """(c, place, value): modules by flow descending with their nodes, as "module:place flow \"node\""."""
    from pyspark.sql import Window

    x = partition.join(flow, "node")
    total = x.groupBy("c").agg(F.sum("flow").alias("t"))
    rank = total.withColumn("module", F.row_number().over(Window.orderBy(F.desc("t"), "c")))  # a row for each module
    y = x.join(F.broadcast(rank), "c").withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("flow"), "node")))
    return y.select("module", "place", F.format_string('%d:%d %.9f "%d"', "module", "place", "flow", "node").alias("value"))


def pajek_text(nodes: DataFrame, edges: DataFrame, kind: str = "Edges") -> str:
    """A Pajek document; nodes: id (from 1), name and optionally x, y, colour; edges: src, dst, weight."""
    n = nodes.orderBy("id").collect()
    place = lambda r: f" {r['x']:.4f} {r['y']:.4f} 0.0" if "x" in nodes.columns else ""
    colour = lambda r: f" ic {r['colour']}" if "colour" in nodes.columns and r["colour"] else ""
    body = [f"*Vertices {len(n)}", *(f'{r["id"]} "{r["name"]}"{place(r)}{colour(r)}' for r in n), f"*{kind}"]
    return "\n".join(body + [f"{r['src']} {r['dst']} {r['weight']:g}" for r in edges.orderBy("src", "dst").collect()]) + "\n"


def classes_text(partition: DataFrame) -> str:
    rows = partition.orderBy("node").collect()
    return "\n".join([f"*Vertices {len(rows)}", *(str(r["c"]) for r in rows)]) + "\n"


def gexf_text(nodes: DataFrame, edges: DataFrame) -> str:
    """A GEXF document; nodes: id and any of clusters, truth, r, g, b; edges: src, dst and any of r, g, b."""
    names = [(k, t) for k, t in (("clusters", "Clusters"), ("truth", "GroundTruth")) if k in nodes.columns]
    colour = lambda r, frame: f'<viz:color r="{int(r["r"])}" g="{int(r["g"])}" b="{int(r["b"])}"/>' if "r" in frame.columns and r["r"] is not None else ""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">', '<graph defaultedgetype="undirected">']
    out.append('<attributes class="node">' + "".join(f'<attribute id="{k}" title="{t}" type="string"/>' for k, t in names) + "</attributes><nodes>")
    for r in nodes.orderBy("id").collect():
        values = "".join(f'<attvalue for="{k}" value={quoteattr(str(r[k] or ""))}/>' for k, _ in names)
        out.append(f'<node id="{r["id"]}" label="{r["id"]}"><attvalues>{values}</attvalues>{colour(r, nodes)}</node>')
    out.append("</nodes><edges>")
    for i, r in enumerate(edges.orderBy("src", "dst").collect()):
        out.append(f'<edge id="{i}" source="{r["src"]}" target="{r["dst"]}">{colour(r, edges)}</edge>')
    return "\n".join([*out, "</edges></graph></gexf>", ""])


def model_text(polynomial: DataFrame, n: int, p: int, dialect: str = "lp") -> str:
    """The p-median model of a polynomial (vars, coef) as text for a solver; y0 to y(n-1) are 1 where no facility is opened."""
    rows = sorted((sorted(r["vars"]), r["coef"]) for r in polynomial.collect())
    terms, extra, zs = [], [], 0
    for vars_, coef in rows:
        if not vars_:
            terms.append(f"{coef:+.12g}" if dialect == "lp" else f"{coef:+.12g} one")
        elif len(vars_) == 1:
            terms.append(f"{coef:+.12g} y{vars_[0]}")
        else:
            terms.append(f"{coef:+.12g} z{zs}")
            both = " + ".join(f"y{v}" for v in vars_)
            extra.append(f"{both} - z{zs} <= {len(vars_) - 1}")
            if dialect != "lp":
                extra.append(f"{both} - z{zs} >= 0")
            zs += 1
    total = " + ".join(f"y{i}" for i in range(1, n + 1)) + f" = {n - p}"
    ys, z = [f"y{i}" for i in range(1, n + 1)], [f"z{i}" for i in range(zs)]
    if dialect == "lp":
        body = ["min: " + " ".join(terms) + ";", total + ";", *(e + ";" for e in extra), "bin " + ",".join(ys) + ";"]
        return "\n".join(body + (["int " + ",".join(z) + ";"] if z else [])) + "\n"
    head = ["Minimize", " obj: " + " ".join(terms), "Subject To", *(f" c{i}: {e}" for i, e in enumerate([total, *extra])), "Bounds", " one = 1", *(f" {x} >= 0" for x in z)]
    return "\n".join([*head, "Binary", " " + " ".join(ys), *(["General", " " + " ".join(z)] if z else []), "End"]) + "\n"


def write_scores(scores: DataFrame, path: str) -> None:
    scores.coalesce(1).write.mode("overwrite").csv(path, header=True)


def dump_text(cover: DataFrame) -> str:
    """The number of communities, then each one's size and nodes."""
    rows = [r["value"] for r in members(cover).orderBy("c").collect()]
    return "\n".join([str(len(rows)), *(f"{len(r.split())} {r}" for r in rows)]) + "\n"


def clique_lines(cliques: DataFrame) -> DataFrame:
    """(clique, value): "i: v1 v2 ..." from (clique, node)."""
    m = members(cliques.select(F.col("clique").alias("c"), "node"))
    return m.select(F.col("c").alias("clique"), F.concat(F.col("c").cast("string"), F.lit(": "), F.col("value")).alias("value"))
