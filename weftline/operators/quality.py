"""Data-quality summaries and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import TableSchema
from .numbering import name_of


#: Distinct subjects are counted by sketches of 2**SKETCH_BITS registers.
SKETCH_BITS = 12
#: Where triples are made distinct, a task holds about so many.
TRIPLES_PER_TASK = 1 << 18


def is_empty(c: Column) -> Column:
    """Null or the empty text."""
    return c.isNull() | (c.cast("string") == "")


def required_empty(df: DataFrame, schema: TableSchema) -> DataFrame:
    """(column_name, n_empty) of the required columns present that have empty values; one scan."""
    names = [f.name for f in schema.fields if f.required and f.name in df.columns]
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column_name string, n_empty long")
    counts = df.agg(*(F.count_if(is_empty(name_of(n))).alias(f"c{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("n_empty")) for i, n in enumerate(names)))
    return counts.select(F.inline(rows)).where(F.col("n_empty") > 0)


def shape_of(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def conforms(violations: DataFrame) -> bool:
    return violations.isEmpty()


def violation_summary(violations: DataFrame) -> DataFrame:
    """(path, constraint, n) of a violations table."""
    return violations.groupBy("path", "constraint").agg(F.count("*").alias("n"))


def dealt_set(triples: DataFrame) -> DataFrame:
    """The distinct triples, dealt by subject and property to as many tasks as their number asks for, so that a task holds no more of a larger graph."""
    n = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return triples.repartition(max(n, triples.count() // TRIPLES_PER_TASK + 1), "s", "p").distinct()


def triple_statistics(triples: DataFrame, is_set: bool = False) -> DataFrame:
    """(p, n_triples, n_subjects) over the set of triples; is_set where they are one already.

    Triples are dealt by subject and property once, so that both counts of a pair are made where it lies.
    """
    rows = triples.select("s", "p", "o", "o_kind", "datatype")
    if not is_set:
        rows = dealt_set(rows)
    pairs = rows.groupBy("s", "p").agg(F.count("*").alias("n"))
    return pairs.groupBy("p").agg(F.sum("n").alias("n_triples"), F.count("*").alias("n_subjects"))


def with_sketches(triples: DataFrame) -> DataFrame:
    """(p, n_triples, subjects): counts and mergeable sketches of the subjects of a set of triples, by property."""
    return triples.groupBy("p").agg(F.count("*").alias("n_triples"), F.hll_sketch_agg("s", F.lit(SKETCH_BITS)).alias("subjects"))


def merged_statistics(*parts: DataFrame) -> DataFrame:
    """The statistics of with_sketches() of parts that share no triple, without reading the triples again."""
    found, *rest = parts
    for part in rest:
        found = found.unionByName(part)
    return found.groupBy("p").agg(F.sum("n_triples").alias("n_triples"), F.hll_union_agg("subjects").alias("subjects"))


def estimated(statistics: DataFrame) -> DataFrame:
    """(p, n_triples, n_subjects): the counts exact, the distinct subjects within about 1.6 % (one standard error)."""
    return statistics.select("p", "n_triples", F.hll_sketch_estimate("subjects").alias("n_subjects"))


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones whatever the partitions: the smallest MD5 hashes of seed and key."""
    columns = [name_of(k) for k in key]
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))), *columns).limit(n)
