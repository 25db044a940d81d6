"""The training-data queries over texts. Only p7_check has SQL: their tests hold brute force and round trips against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from .leaks import find_leaks
from .packing import pack, token_counts
from .reading import fit_levels, reading_levels

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document and piece."""
    return pack(table(spark, sf_dir, "documents"))


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: their number, the least possible number, the share of unused space."""
    p = pack(table(spark, sf_dir, "documents")).groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return p.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("tokens") / 2048).alias("least"), F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * 2048), 6).alias("unused"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"))


@query
def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing against its rules: every document placed, whole unless longer than a container, no token lost, none overfull."""
    docs = table(spark, sf_dir, "documents")
    p = pack(docs)
    one = p.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("start_token") != F.col("piece") * 2048).alias("gaps"))
    each = token_counts(docs, doc_id="doc_id", text="text").join(one, "doc_id", "left")
    full = p.groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    off = F.col("pieces") != F.ceil(F.col("n_tokens") / 2048)
    rules = each.agg(F.count(F.lit(1)).alias("docs"), F.count("tokens").alias("placed"), F.count_if(off).alias("cut_wrongly"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.sum(F.col("n_tokens") - F.coalesce("tokens", F.lit(0))).alias("lost_tokens"))
    return rules.join(full, how="cross")  # one row each


ORACLE["p7_check"] = "select count(*) as docs, count(*) as placed, 0::bigint as cut_wrongly, 0::bigint as gaps, 0::bigint as lost_tokens, 0::bigint as overfull from documents where length(text) > 0"


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least two fifths of an evaluation passage."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


@query
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked test item: the documents that hold it and the largest share of its words found in one."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 6).alias("max_share"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reading_levels(docs.where("n_chars >= 300"), fit_levels(docs, table(spark, sf_dir, "grade_labels")))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents long enough to judge that are of level 4 or 5."""
    return _levels(spark, sf_dir).where("level >= 3.5").select("doc_id").distinct()


@query
def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by source and reading level (0: no prose)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    level = F.coalesce(F.round("level").cast("int"), F.lit(0))
    return _levels(spark, sf_dir).join(docs, "doc_id").groupBy("source", level.alias("level")).agg(F.count(F.lit(1)).alias("n_docs"))
