"""Mixing sources to target weights.

Hierarchical budgeting over a tree corpus - domain - language - source. Weights go
down the tree as token budgets; a leaf that cannot take its budget, even with every
repeat allowed, passes the shortage to its siblings first (other sources of its domain
and language), then to those of its ancestors (other languages of the domain, other
domains). Each leaf fills its budget from seeded epochs: whole passes over its
documents, then a prefix of one more pass in the order of a seeded hash.

Source weights are given. Domains are groups of sources (a parameter); a domain weighs
what its sources do. Languages weigh what a parameter says, else what a source's
shares of tokens make of its weight, in which case all sources meet their targets as
long as no one is short.

The prefix is found without sorting a leaf: token sums by ranges of the hash
(partial aggregation), a running sum over those, and an order within the one
range only that the budget ends in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import canonical_source
from tablelens.llm.encoding import TOKENIZER, TOKENIZER_DIR, count_tokens
from tablelens.shared import exact, materialize

RANGE_BITS = 12
RANGE_DOCUMENTS = 65_536  # of a leaf with more ranges than 2^RANGE_BITS hold, each has about so many
OTHER = "other"


@dataclass
class Node:
    """A node of the budget tree. capacity counts every repeat allowed."""

    name: str
    weight: float
    tokens: int = 0
    repeats: int = 1
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else float(self.tokens * self.repeats)


def spread(node: Node, budget: float) -> float:
    """Gives a budget to a node and shares it out below; returns the shortage.

    Children get it by weight; what some cannot take goes to their siblings by
    weight, again and again, before any is left over for the parent's siblings.
    """
    node.budget = min(budget, node.capacity())
    if not node.children:
        return budget - node.budget
    given = {id(c): 0.0 for c in node.children}
    open_, rest = [c for c in node.children if c.weight > 0 and c.capacity() > 0], node.budget
    while open_ and rest > 1e-9:
        total = sum(c.weight for c in open_)
        full = [c for c in open_ if given[id(c)] + rest * c.weight / total >= c.capacity()]
        if not full:
            for c in open_:
                given[id(c)] += rest * c.weight / total
            rest = 0.0
            break
        for c in full:
            rest -= c.capacity() - given[id(c)]
            given[id(c)] = c.capacity()
        open_ = [c for c in open_ if c not in full]
    for c in node.children:
        spread(c, given[id(c)])
    node.budget = sum(c.budget for c in node.children)
    return budget - node.budget


def largest_exact(sources: dict[str, tuple[float, float]]) -> float:
    """The largest total at which every source (weight, capacity) that has anything
    keeps its share, the shares of empty ones being passed to the others."""
    there = [(w, c) for w, c in sources.values() if w > 0 and c > 0]
    total = sum(w for w, _ in there)
    return min((c * total / w for w, c in there), default=0.0)


def language(column: Column) -> Column:
    """The primary subtag of a language, so that spellings belong together; und
    for null and for anything else. There are at most 27^3 values."""
    tag = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    two = F.create_map(*[F.lit(x) for pair in (("eng", "en"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es")) for x in pair])
    return F.when(F.coalesce(tag, F.lit("")) == "", "und").otherwise(F.coalesce(two[tag], tag))


def clean_weights(weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per source: shares of several
    spellings add up, the greatest number of repeats holds. Rows without a source
    or a positive share weigh nothing; a null number of repeats is 1."""
    return (
        weights.filter(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy(canonical_source(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).cast("int").alias("max_repeats"))
    )


#: (source, language, tokens) of a leaf.
Leaf = tuple[str, str, int]


def budget_tree(leaves: list[Leaf], weights: dict[str, tuple[float, int]], domains: dict[str, str] | None = None, languages: dict[str, float] | None = None) -> Node:
    """The tree of all leaves that hold tokens. weights: share and repeats by source;
    domains: the domain of each source, OTHER where it has none; languages: the weight of
    each language within a domain ("*" for those not named), by default what its sources'
    weights, shared out by their tokens, come to."""
    held: dict[str, int] = {}
    for source, _, n in leaves:
        held[source] = held.get(source, 0) + n
    root = Node("corpus", 1.0)
    by_domain: dict[str, Node] = {}
    for source, lang, n in sorted(leaves):
        if n <= 0 or source not in weights:
            continue
        share, repeats = weights[source]
        name = (domains or {}).get(source, OTHER)
        if name not in by_domain:
            by_domain[name] = Node(name, sum(w for s, (w, _) in weights.items() if (domains or {}).get(s, OTHER) == name and held.get(s)))
            root.children.append(by_domain[name])
        domain = by_domain[name]
        below = next((c for c in domain.children if c.name == lang), None)
        if below is None:
            below = Node(lang, 0.0 if languages is None else languages.get(lang, languages.get("*", 0.0)))
            domain.children.append(below)
        own = share * n / held[source] if languages is None else share
        if languages is None:
            below.weight += own
        below.children.append(Node(source, own, n, repeats))
    root.children.sort(key=lambda c: c.name)
    for domain in root.children:
        domain.children.sort(key=lambda c: c.name)
    return root


@dataclass
class Plan:
    """leaves: (source, lang, tokens, epochs, rest), whole passes, and tokens of one more;
    nodes: (domain, lang, source, weight of all, wanted, capacity, budget), lang and
    source null at the levels above them."""

    leaves: list[tuple[str, str, int, int, int]]
    nodes: list[tuple[str, str | None, str | None, float, float, float, float]]


def plan_budgets(leaves: list[Leaf], weights: dict[str, tuple[float, int]], total: float | None = None, domains: dict[str, str] | None = None, languages: dict[str, float] | None = None) -> Plan:
    """Budgets of all nodes. Without total the largest at which all sources meet their
    shares."""
    root = budget_tree(leaves, weights, domains, languages)
    held: dict[str, int] = {}
    for source, _, n in leaves:
        held[source] = held.get(source, 0) + n
    whole = largest_exact({s: (w, float(held.get(s, 0) * r)) for s, (w, r) in weights.items()}) if total is None else float(total)
    spread(root, whole)
    out, nodes = [], []

    def report(node: Node, names: tuple[str, ...], share: float, siblings: float) -> None:
        share = share * node.weight / siblings if siblings else 0.0
        nodes.append((*(names + (None, None))[:3], share, share * whole, node.capacity(), node.budget))
        inside = sum(c.weight for c in node.children)
        for c in node.children:
            report(c, (*names, c.name), share, inside)
        if len(names) == 3:
            _, lang, source = names
            budget = round(node.budget)
            epochs = min(budget // node.tokens, node.repeats)
            out.append((source, lang, node.tokens, int(epochs), int(budget - epochs * node.tokens) if epochs < node.repeats else 0))

    for domain in root.children:
        report(domain, (domain.name,), 1.0, sum(c.weight for c in root.children))
    return Plan(out, nodes)


@dataclass
class Mix:
    """documents: (doc_id, source, lang, tokens, repeats), those used at least once;
    shares: the report by source; tree: that by node of the tree, with target_share (by
    the weights alone), wanted, capacity and budget in tokens, and the tokens it got."""

    documents: DataFrame
    shares: DataFrame
    tree: DataFrame


def mix_sources(docs: DataFrame, weights: DataFrame, seed: int = 42, total: float | None = None, epochs: float | None = None, domains: dict[str, str] | None = None, languages: dict[str, float] | None = None, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Mix:
    """Combines documents so that each source has its target share of all tokens.

    total is the size wanted in tokens, or epochs times what the listed sources hold;
    by default the largest at which no source is short. domains and languages are as in
    budget_tree(). What a node cannot take goes to its siblings, then up the tree.

    No document is used more often than its source's max_repeats. Documents of
    unlisted or null sources and those without tokens (null, empty) are not used.
    Sources without any document are reported with share 0, their target going to
    the others by weight. Budgets are met to within one document a leaf. The
    same seed gives the same choice.
    """
    spark = docs.sparkSession
    wanted = clean_weights(exact(weights, "source", "target_share", "max_repeats"))
    listed = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted.collect()}
    named = exact(docs, "doc_id", "text", "lang", "source").select("doc_id", canonical_source(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), "text")
    used = named.join(F.broadcast(wanted.select("source")), "source", "left_semi")  # the weights table is the configuration: one row a source
    counted = count_tokens(used, ["doc_id", "source", "lang"], tokenizer, folder).filter(F.col("tokens") > 0)
    counted = materialize(counted, "tokens")

    leaves = counted.groupBy("source", "lang").agg(F.sum("tokens").alias("n"), F.count("*").alias("documents")).collect()  # one row a leaf
    if epochs is not None:
        total = epochs * sum(r["n"] for r in leaves)
    plan = plan_budgets([(r["source"], r["lang"], r["n"]) for r in leaves], listed, total, domains, languages)
    bits = {(r["source"], r["lang"]): max(RANGE_BITS, (r["documents"] // RANGE_DOCUMENTS).bit_length()) for r in leaves}
    schema = "source string, lang string, leaf_tokens bigint, epochs int, rest bigint, bits int"
    budgets = spark.createDataFrame([(*row, bits[row[:2]]) for row in plan.leaves], schema)

    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    ranged = counted.join(F.broadcast(budgets), ["source", "lang"]).withColumn("h", order).withColumn("range", F.expr("shiftrightunsigned(h, 64 - bits)"))
    sums = ranged.groupBy("source", "lang", "range", "rest").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select("source", "lang", F.col("range").alias("last_range"), "before")
    placed = ranged.join(F.broadcast(last), ["source", "lang"], "left")  # at most one row a leaf

    whole = placed.filter(F.col("last_range").isNull() | (F.col("range") != F.col("last_range")))
    whole = whole.withColumn("repeats", F.col("epochs") + F.coalesce((F.col("range") < F.col("last_range")).cast("int"), F.lit(0)))
    running = Window.partitionBy("source", "lang").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(F.col("range") == F.col("last_range")).withColumn("end", F.col("before") + F.sum("tokens").over(running))
    nearer = F.col("end") - F.col("tokens") / 2 <= F.col("rest")  # the document that the budget ends in counts if most of it is inside
    edge = edge.withColumn("repeats", F.col("epochs") + nearer.cast("int"))
    columns = ["doc_id", "source", "lang", "tokens", "repeats"]
    chosen = whole.select(*columns).unionByName(edge.select(*columns)).filter(F.col("repeats") > 0)

    by_source = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    report = wanted.join(by_source, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    everything = F.sum(zero("tokens")).over(Window.partitionBy(F.lit(1)))  # one row a source
    shares = report.select(
        "source", "target_share", F.coalesce(zero("tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("actual_share"), zero("documents").alias("documents"),
        zero("tokens").alias("tokens"), "max_repeats", zero("most_repeats").alias("most_repeats"),
    )
    by_leaf = chosen.groupBy("source", "lang").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    nodes = spark.createDataFrame(plan.nodes, "domain string, lang string, source string, target_share double, wanted double, capacity double, budget double")
    place = nodes.filter("source is not null").select("domain", "lang", "source").join(by_leaf, ["source", "lang"], "left")
    got = place.rollup("domain", "lang", "source").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).filter("domain is not null").select(F.col("domain").alias("gd"), F.col("lang").alias("gl"), F.col("source").alias("gs"), "tokens")
    tree = nodes.join(got, (F.col("domain") == F.col("gd")) & F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs"))).drop("gd", "gl", "gs")
    return Mix(chosen, shares, tree)
