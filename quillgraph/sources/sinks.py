"""Sinks (inventory section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is taken, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet at a path that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """JSON lines with sorted keys, rows in order over the files of a fresh path."""
    keys = sorted(df.columns)
    ordered = df.select(*keys)
    ranged = ordered.repartitionByRange(partitions, *order) if partitions else ordered.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A snapshot: nodes by id, edges by (relation, source, target)."""
    write_jsonl(nodes, f"{folder}/nodes.jsonl", ["id"])
    write_jsonl(edges, f"{folder}/edges.jsonl", ["relation", "source", "target"])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed column order."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True)


def checkpointed(df: DataFrame, key: str, path: str) -> DataFrame:
    """Rows that a resumable job has still to do: those whose key is not yet in ``path``."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def append_done(df: DataFrame, path: str) -> None:
    """Adds finished rows to a resumable job's table."""
    df.write.mode("append").parquet(path)


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``new`` put in place of those with the same key."""
    return base.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cypher_script(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements that load a graph into a graph database, one per row, nodes before edges."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    made = nodes.select(
        F.lit(0).alias("step"), F.col("id").alias("key"),
        F.concat(F.lit("MERGE (n:"), "label", F.lit(" {id: "), quote("id"), F.lit("}) SET n.name = "), quote("name"), F.lit(";")).alias("statement"),
    )
    linked = edges.select(
        F.lit(1).alias("step"), F.concat_ws("|", "relation", "source", "target").alias("key"),
        F.concat(F.lit("MATCH (a {id: "), quote("source"), F.lit("}), (b {id: "), quote("target"), F.lit("}) MERGE (a)-[:"), "relation", F.lit("]->(b);")).alias("statement"),
    )
    return made.unionByName(linked)
