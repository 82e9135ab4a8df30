"""Entailment and consistency of triples, as joins with the small schema graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .shapes import LEXICAL
from .triples import RDF_TYPE, RDFS, XSD

#: Datatypes by value space: integer lies in decimal, the others share no value.
SPACES = {XSD + "integer": "decimal", XSD + "decimal": "decimal", XSD + "float": "float", XSD + "boolean": "boolean", XSD + "dateTime": "dateTime", XSD + "string": "string"}

def closure(pairs: DataFrame) -> DataFrame:
    """The transitive closure of (low, high), kept in the shared folder; cycles end.

    Pairs are found with the steps of their shortest way. The round after `reach` steps appends to all that is found
    the pairs that are exactly `reach` apart, which gives those up to twice as far: a chain of n takes about log2(n)
    rounds, a pair is found in one of them, and what is far from nothing, as in a tree or a small circle, is not
    joined again. Names that nothing lies below, most of a wide tree, take no part: what is above them comes by one
    join at the end. Nothing passes through the driver, and whether a side is broadcast is left to its size.
    """
    pairs = stored(pairs.select("low", "high").distinct())
    below = pairs.select(F.col("high").alias("low")).distinct()
    found, reach = stored(pairs.join(below, "low", "left_semi").withColumn("steps", F.lit(1))), 1
    while True:
        far = found.where(F.col("steps") == reach).select(F.col("low").alias("high"), F.col("high").alias("top"))
        ways = found.join(far, "high").groupBy("low", F.col("top").alias("high")).agg((F.min("steps") + reach).alias("steps"))
        new = stored(ways.join(found, ["low", "high"], "left_anti"))
        if new.isEmpty():
            break
        found, reach = found.unionByName(new), 2 * reach
    inner = found.select("low", "high")
    leaves = pairs.join(below, "low", "left_anti")
    higher = leaves.join(inner.select(F.col("low").alias("high"), F.col("high").alias("top")), "high").select("low", F.col("top").alias("high"))
    return inner.unionByName(stored(leaves.unionByName(higher).distinct()))


def hierarchies(tbox: DataFrame, *relations: str) -> list[DataFrame]:
    """The closures of subclass and subproperty relations, each as (low, high), found together: names carry their relation."""
    rows = tbox.where(F.col("p").isin([RDFS + r for r in relations]))
    found = closure(rows.select(F.concat_ws(" ", "p", "s").alias("low"), F.concat_ws(" ", "p", "o").alias("high")))
    bare = lambda c, r: F.substr(c, F.lit(len(RDFS + r) + 2)).alias(c)
    return [found.where(F.startswith("low", F.lit(f"{RDFS}{r} "))).select(bare("low", r), bare("high", r)) for r in relations]


def type_rules(tbox: DataFrame, above: DataFrame) -> DataFrame:
    """(p, side, cls): a triple with the property p types its subject (`s`) or object (`o`), by p's own rules and by those of the properties above it.

    One more row says that the property of types states a type itself (`t`).
    """
    named = {"domain": "s", "range": "o"}
    side = F.when(F.col("p") == RDFS + "domain", named["domain"]).otherwise(named["range"])
    rows = tbox.where(F.col("p").isin([RDFS + r for r in named]) & ~F.col("o").startswith(XSD)).select(F.col("s").alias("p"), side.alias("side"), F.col("o").alias("cls"))
    inherited = above.join(rows, above["high"] == rows["p"]).select(F.col("low").alias("p"), "side", "cls")
    stated = tbox.sparkSession.createDataFrame([(RDF_TYPE, "t", None)], "p string, side string, cls string")
    return rows.unionByName(inherited).distinct().unionByName(stated)


def rdfs_closure(triples: DataFrame, tbox: DataFrame) -> DataFrame:
    """A set of triples with what subproperties, domains, object ranges and subclasses entail.

    The schema graph is closed first, and its rules are joined with the data. What is entailed are types and
    copies of triples under higher properties: only those are made distinct, with the triples that may equal
    them; literals of other properties are passed on as they are.
    """
    above, classes = hierarchies(tbox, "subPropertyOf", "subClassOf")
    # Stored, so that their sizes are known when the joins are planned; a class that has others above it keeps itself too.
    rules = stored(type_rules(tbox, above))
    upward = stored(classes.unionByName(classes.select("low", F.col("low").alias("high"))).distinct())
    found = triples.join(rules, "p").where((F.col("side") != "o") | (F.col("o_kind") == "iri"))
    types = found.select(F.when(F.col("side") == "o", F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("cls", "o").alias("cls"), (F.col("side") == "t").alias("stated"))
    raised = types.join(upward, types["cls"] == upward["low"], "left").select("s", F.coalesce("high", "cls").alias("cls"), (F.col("stated") & (F.coalesce("high", "cls") == F.col("cls"))).alias("stated"))
    new = raised.groupBy("s", "cls").agg(F.max("stated").alias("stated")).where(~F.col("stated"))
    typed = new.select("s", F.lit(RDF_TYPE).alias("p"), F.col("cls").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
    if above.isEmpty():
        return triples.unionByName(typed)
    copies = triples.join(above, triples["p"] == above["low"]).select("s", F.col("high").alias("p"), "o", "o_kind", "datatype", F.lit(False).alias("stated"))
    there = triples.join(above.select(F.col("high").alias("p")).distinct(), "p", "left_semi").select("s", "p", "o", "o_kind", "datatype", F.lit(True).alias("stated"))
    more = copies.unionByName(there).groupBy("s", "p", "o", "o_kind", "datatype").agg(F.max("stated").alias("stated")).where(~F.col("stated")).drop("stated")
    return triples.unionByName(typed).unionByName(more)


def property_ranges(tbox: DataFrame) -> DataFrame:
    """(p, ranges): the datatypes that all tables declare for a property."""
    return tbox.where((F.col("p") == RDFS + "range") & F.col("o").startswith(XSD)).groupBy(F.col("s").alias("p")).agg(F.array_sort(F.collect_set("o")).alias("ranges"))


def space_of(datatype: Column) -> Column:
    """The value space of a datatype; others than those known are their own."""
    found = None
    for name, space in SPACES.items():
        found = F.when(datatype == name, space) if found is None else found.when(datatype == name, space)
    return found.otherwise(datatype)


def malformed(text: Column, datatype: Column) -> Column:
    """Whether the text is no value of its datatype; each pattern is a literal, compiled once."""
    found = None
    for name, pattern in LEXICAL.items():
        wrong = ~text.rlike(pattern)
        found = F.when(datatype == name, wrong) if found is None else found.when(datatype == name, wrong)
    return found.otherwise(F.lit(False))


def inconsistencies(triples: DataFrame, tbox: DataFrame) -> DataFrame:
    """(s, p, o, datatype, reason): literals that don't lie in every range of their property.

    reason is `disjoint` if the ranges share no value, `datatype` if the literal's own type has another
    value space, `lexical` if its text is no value of its type.
    """
    spaces = F.array_distinct(F.transform("ranges", space_of))
    ranges = property_ranges(tbox).select("p", F.element_at(spaces, 1).alias("space"), (F.size(spaces) > 1).alias("apart"), F.array_contains("ranges", XSD + "integer").alias("whole"))
    literals = triples.where(F.col("o_kind") == "literal").join(F.broadcast(ranges), "p", "left")
    own = F.coalesce("datatype", F.lit(XSD + "string"))
    other = (F.col("space") != space_of(own)) | F.col("whole") & (own == XSD + "decimal")
    reason = F.when(F.col("apart"), "disjoint").when(F.col("space").isNotNull() & other, "datatype").when(malformed(F.col("o"), own), "lexical")
    return literals.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("s", "p", "o", "datatype", "reason")


def consistent(triples: DataFrame, tbox: DataFrame) -> bool:
    return inconsistencies(triples, tbox).isEmpty()
