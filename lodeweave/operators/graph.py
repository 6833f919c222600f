"""Hierarchies and graphs: closure, depth, cycles, levels, degrees, RDF rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import cut


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(node, ancestor, depth)``: all ancestors with the least number of steps; nodes on a cycle are their own ancestors.

    Paths double in each round: only the pairs found last are joined with all found so far. It ends when none is new.
    """
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct().withColumn("depth", F.lit(1))
    reach = last = cut(step, loop=True)
    while last.limit(1).count():
        far = last.select("node", F.col("ancestor").alias("via"), F.col("depth").alias("d1")).join(reach.select(F.col("node").alias("via"), "ancestor", F.col("depth").alias("d2")), "via")
        found = far.groupBy("node", "ancestor").agg(F.min(F.col("d1") + F.col("d2")).alias("depth"))
        last = cut(found.join(reach.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), loop=True)
        reach = cut(reach.unionByName(last), loop=True)
    return reach


def depths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(node, depth)``: the longest way from a root, 0 for roots; links between nodes of one cycle are left out.

    A round passes the depths that grew on to the children; there are as many as the longest way has steps.
    """
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null").distinct()
    loops = closure(edges, child, parent).select(F.col("node").alias("up"), F.col("ancestor").alias("node"))
    down = cut(e.join(loops, ["node", "up"], "left_anti"), loop=True)
    nodes = cut(edges.select(F.col(child).alias("node")).unionByName(edges.select(F.col(parent).alias("node"))).where("node is not null").distinct(), loop=True)
    deep = cut(nodes.withColumn("depth", F.lit(0)), loop=True)
    front = deep
    while front.limit(1).count():
        reached = down.join(front.withColumnRenamed("node", "up"), "up").groupBy("node").agg((F.max("depth") + 1).alias("new"))
        front = cut(deep.join(reached, "node").where("new > depth").select("node", F.col("new").alias("depth")), loop=True)
        deep = cut(deep.join(front.withColumnRenamed("depth", "new"), "node", "left").select("node", F.coalesce("new", "depth").alias("depth")), loop=True)
    return deep


def on_cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that are their own ancestors; unlike a count of back edges it does not depend on where one starts."""
    return closure(edges, child, parent).where("node = ancestor").select("node")


def orphans(nodes: DataFrame, edges: DataFrame, child: str = "child") -> DataFrame:
    return nodes.select("node").distinct().join(edges.select(F.col(child).alias("node")).distinct(), "node", "left_anti")


def levels(edges: DataFrame, root: str | DataFrame) -> DataFrame:
    """``(node, level)``: steps from a root (or the rows of ``root(node)``) along undirected edges; nodes that cannot be reached have none."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), loop=True)
    nodes = both.select(F.col("a").alias("node")).distinct()
    first = nodes.where(F.col("node") == root) if isinstance(root, str) else nodes.join(root.select("node"), "node", "left_semi")
    seen = front = cut(first.withColumn("level", F.lit(0)), loop=True)
    k = 0
    while front.limit(1).count():
        k += 1
        front = cut(front.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(k)), loop=True)
        seen = cut(seen.unionByName(front), loop=True)
    return nodes.join(seen, "node", "left").select("node", "level")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, out_degree, in_degree, degree)``."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.where("node is not null").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def root(edges: DataFrame, preferred: str | None = None) -> DataFrame:
    """One node: the first whose name contains the text preferred, else the one with the highest 3 * out - 2 * in + degree; ties go to the last name."""
    d = degrees(edges).withColumn("score", 3 * F.col("out_degree") - 2 * F.col("in_degree") + F.col("degree"))
    liked = F.lower("node").contains(preferred.lower()) if preferred else F.lit(False)
    return d.agg(F.max_by("node", F.struct(liked, "score", F.col("degree"), F.col("node"))).alias("node"))


def confident_edges(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges with enough confidence (1 where it is missing or no number); of parallel ones the last."""
    conf = F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0))
    return edges.withColumn("confidence", conf).where(F.col("confidence") >= least).groupBy("source", "target").agg(F.max_by("label", "ord").alias("label"), F.max_by("confidence", "ord").alias("confidence"))


def top_labels(df: DataFrame, by: list[str], label: str, k: int = 5) -> DataFrame:
    """``(by, labels)``: the k most frequent labels as ``label (n)``."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "_l")
    top = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    rows = F.array_sort(F.collect_list(F.struct("_r", F.concat("_l", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias("t"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), ", ").alias("labels"))


BASE = "http://example.org/resource/"
RDF, RDFS, OWL, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#"


def rdf_rows(df: DataFrame, triples: list[tuple[Column, Column, Column, bool]]) -> DataFrame:
    """``(s, p, o, o_is_literal)``: several statements per row, each once in all; those with a null part are left out."""
    rows = F.array(*[F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(lit).alias("o_is_literal")) for s, p, o, lit in triples])
    return df.select(F.inline(rows)).where("s is not null and p is not null and o is not null").distinct()


def kg_rdf(triples: DataFrame, base: str = BASE) -> DataFrame:
    """Statements of a knowledge graph: the triple itself, labels and types of its nodes, and a node for the assertion with its source."""
    iri = lambda kind, c: F.concat(F.lit(f"{base}{kind}/"), F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"[^A-Za-z0-9_.-]", "_"))
    s, o, p = iri("node", F.col("subject_id")), iri("node", F.col("object_id")), iri("relation", F.col("predicate_id"))
    t = iri("triple", F.col("triple_id"))
    lit = F.lit
    return rdf_rows(
        triples,
        [
            (s, p, o, False), (s, lit(f"{RDFS}label"), F.col("subject_label"), True), (o, lit(f"{RDFS}label"), F.col("object_label"), True), (p, lit(f"{RDFS}label"), F.col("predicate_label"), True),
            (s, lit(f"{RDF}type"), iri("concept", F.col("subject_type")), False), (o, lit(f"{RDF}type"), iri("concept", F.col("object_type")), False),
            (t, lit(f"{RDF}type"), lit(f"{RDF}Statement"), False), (t, lit(f"{RDF}subject"), s, False), (t, lit(f"{RDF}predicate"), p, False), (t, lit(f"{RDF}object"), o, False),
            (t, lit(f"{base}confidence"), F.col("confidence"), True), (t, lit(f"{base}sourceChunk"), F.col("chunk_id"), True), (t, lit(f"{base}justification"), F.col("justification"), True),
        ],
    )


def ontology_rdf(concepts: DataFrame, relations: DataFrame, links: DataFrame, axioms: DataFrame, base: str = BASE, literal_targets: bool = False) -> DataFrame:
    """Statements of an ontology: classes, properties, subclass links, and axioms by their predicate.

    Domains and ranges are IRIs (literals for old readers); parents named in hints are declared too.
    """
    lit = F.lit
    iri = lambda kind, c: F.concat(F.lit(f"{base}{kind}/"), F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"))
    c = rdf_rows(concepts, [(iri("concept", F.col("concept_id")), lit(f"{RDF}type"), lit(f"{OWL}Class"), False), (iri("concept", F.col("concept_id")), lit(f"{RDFS}label"), F.col("label"), True)])
    r = rdf_rows(relations, [(iri("relation", F.col("relation_id")), lit(f"{RDF}type"), lit(f"{OWL}ObjectProperty"), False), (iri("relation", F.col("relation_id")), lit(f"{RDFS}label"), F.col("label"), True)])
    li = rdf_rows(
        links,
        [
            (iri("concept", F.col("child_id")), lit(f"{RDFS}subClassOf"), iri("concept", F.col("parent_id")), False),
            (iri("concept", F.col("parent_id")), lit(f"{RDF}type"), lit(f"{OWL}Class"), False), (iri("concept", F.col("parent_id")), lit(f"{RDFS}label"), F.col("parent_label"), True),
        ],
    )
    pred = F.col("predicate")
    full = (
        F.when(pred.isin("domain", "rdfs:domain"), f"{RDFS}domain").when(pred.isin("range", "rdfs:range"), f"{RDFS}range").when(F.lower(pred).endswith("subclassof"), f"{RDFS}subClassOf")
        .when(F.lower(pred).endswith("subpropertyof"), f"{RDFS}subPropertyOf").when(pred.isin("rdfs:description", "rdfs:comment"), f"{RDFS}comment").when(pred == "skos:prefLabel", f"{SKOS}prefLabel")
        .when(pred == "skos:altLabel", f"{SKOS}altLabel").when(pred == "rdf:type", f"{RDF}type").when(pred == "owl:sameAs", f"{OWL}sameAs").otherwise(F.concat(lit(base), F.regexp_replace(pred, r"[^A-Za-z0-9_]", "_")))
    )
    kind = F.when(F.col("axiom_type").isin("relation_domain", "relation_range", "subproperty"), "relation").otherwise("concept")
    subject = F.concat(lit(base), kind, lit("/"), F.regexp_replace("subject_id", r"[^A-Za-z0-9_.-]", "_"))
    as_literal = F.col("literal_value").isNotNull() | (F.lit(literal_targets) & F.col("axiom_type").isin("relation_domain", "relation_range"))
    target = F.when(F.col("literal_value").isNotNull(), F.col("literal_value")).when(as_literal, F.col("object_label")).otherwise(iri("concept", F.col("object_id")))
    a = axioms.select(subject.alias("s"), full.alias("p"), target.alias("o"), as_literal.alias("o_is_literal")).where("s is not null and o is not null")
    return c.unionByName(r).unionByName(li).unionByName(a).distinct()


def _term() -> Column:
    """The object of a statement in N-Triples and Turtle."""
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.when(F.col("o_is_literal"), F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))


def ntriples(rows: DataFrame) -> DataFrame:
    """``(value)``: statements as lines of N-Triples."""
    return rows.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), _term(), F.lit(" .")).alias("value"))


def turtle(rows: DataFrame) -> DataFrame:
    """``(value)``: statements as Turtle, one block per subject, its types first (as ``a``), the rest in order.

    IRIs are written in full, so every file of an output is valid on its own. A block is as long as its subject has
    distinct statements. Null parts are left out.
    """
    verb = F.when(F.col("p") == f"{RDF}type", F.lit("a")).otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    one = rows.where("s is not null and p is not null and o is not null").select("s", F.concat(verb, F.lit(" "), _term()).alias("po"))
    lists = one.groupBy("s").agg(F.collect_set("po").alias("po"))
    first = lambda kind: F.array_sort(F.filter("po", lambda x: x.startswith("a ") if kind else ~x.startswith("a ")))
    body = F.array_join(F.concat(first(True), first(False)), " ;\n    ")
    return lists.select(F.concat(F.lit("<"), F.col("s"), F.lit("> "), body, F.lit(" .")).alias("value"))


def ontology_index(rdf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes ``(iri, label, comment)`` and properties ``(iri, label, domains, ranges)`` of RDF rows."""
    local = F.regexp_extract("iri", r"([^/#]+)$", 1)
    of = lambda p: rdf.where(F.col("p") == p)
    typed = lambda *names: of(f"{RDF}type").where(F.col("o").isin(*names)).select(F.col("s").alias("iri")).distinct()
    one = lambda p, name: of(p).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias(name))
    many = lambda p, name: of(p).groupBy(F.col("s").alias("iri")).agg(F.array_sort(F.collect_set("o")).alias(name))
    classes = typed(f"{OWL}Class", f"{RDFS}Class").join(one(f"{RDFS}label", "label"), "iri", "left").join(one(f"{RDFS}comment", "comment"), "iri", "left").withColumn("label", F.coalesce("label", local))
    props = typed(f"{OWL}ObjectProperty", f"{OWL}DatatypeProperty", f"{RDF}Property").join(one(f"{RDFS}label", "label"), "iri", "left").join(many(f"{RDFS}domain", "domains"), "iri", "left").join(many(f"{RDFS}range", "ranges"), "iri", "left")
    return classes, props.withColumn("label", F.coalesce("label", local))


def inverse_closure(triples: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Triples that follow by turning round relations that have an inverse."""
    table = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])
    return triples.where(F.col("relation").isin(*pairs)).select(F.col("tail").alias("head"), F.try_element_at(table, F.col("relation")).alias("relation"), F.col("head").alias("tail")).distinct().join(triples.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_anti")


def two_hop(triples: DataFrame, first: str, second: str, to: str) -> DataFrame:
    """Triples ``head -to-> tail`` that follow from ``head -first-> x -second-> tail``."""
    a = triples.where(F.col("relation") == first).select("head", F.col("tail").alias("x"))
    b = triples.where(F.col("relation") == second).select(F.col("head").alias("x"), "tail")
    out = a.join(b, "x").where("head <> tail").select("head", F.lit(to).alias("relation"), "tail").distinct()
    return out.join(triples.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_anti")


def node_table(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    """``(case, label, type, origin)``: candidates first, then nodes that only triples have; one per case and lower-case label."""
    from lodeweave.operators.keys import keep_first

    c = candidates.select("case", "label", "type", F.lit(0).alias("rank"), "ord")
    ends = [triples.select("case", F.col(f"{s}_label").alias("label"), F.col(f"{s}_type").alias("type"), F.lit(1).alias("rank"), "ord") for s in ("subject", "object")]
    every = c.unionByName(ends[0]).unionByName(ends[1]).where("trim(label) <> ''")
    once = keep_first(every, ["case", F.lower(F.trim("label"))], ["rank", "ord", "label"])
    return once.select("case", "label", "type", F.when(F.col("rank") == 0, "candidate").otherwise("triple").alias("origin"))


def case_summary(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, relations, predicates and mean confidence of each case; confidences that are no numbers do not count."""
    t = triples.groupBy("case").agg(F.count("*").alias("relations"), F.count_distinct("predicate_label").alias("predicates"), F.round(F.avg(F.expr("try_cast(confidence as double)")), 4).alias("avg_confidence"))
    return nodes.groupBy("case").agg(F.count("*").alias("nodes")).join(t, "case", "full_outer")
