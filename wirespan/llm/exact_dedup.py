"""Exact duplicates by content-defined chunk recipes.

A text is cut where its content says so: after the first sentence end (of Latin,
CJK, Arabic or Indic scripts) at least ``min_chars`` on; where ``max_chars`` / 2
have none, after a punctuation mark or white space; and after ``max_chars`` in a
run without any. A document's recipe is the ordered list of its chunks' hashes.
Documents whose recipes differ differ for certain, so only those that share a
recipe look at contents: each chunk gets an identifier that is verified by its
content (two chunks of one hash get different ordinals), and documents are equal
when their ordered identifier lists are. A Bloom filter of a bounded size tells
the second scan which texts share a recipe; of these only distinct chunks move.
A text that the filter passes wrongly adds chunks and changes no result.
Everything runs in DataFrame functions.

Nulls count as empty texts, and all empty texts are equal. Rows that repeat an
id *and* a text share one decision: they stay or go together, each counted in
``group_size``. A null id sorts after all others. Only the id and the text are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.bloom import Bloom
from wirespan.llm.common import SPACE, by_group, materialised, read, text_of


def normalised(column: str) -> Column:
    return F.regexp_replace(text_of(column), f"[{SPACE}]+", " ")


def chunks(text: Column, min_chars: int = 256, max_chars: int = 8192) -> Column:
    """The text's content-defined chunks in order; they join to the text again. The empty text has none."""
    sentence = rf".{{{min_chars - 1},{max_chars // 2 - 1}}}?(?:(?<=[.!?]) |(?<=[。！？।؟۔]))"
    mark = rf".{{{min_chars - 1},{max_chars - 1}}}?(?<=[\s\p{{P}}])"
    return F.regexp_extract_all(text, F.lit(rf"(?s){sentence}|{mark}|.{{1,{max_chars}}}"), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    keep_id is the smallest id among the rows with an equal text.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))  # joins by it also match null ids
    text = docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), normalised(text_col).alias("norm"), F.xxhash64(text_of(text_col)).alias("text_key"))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    hashes = text.select("doc_id", "name", sha, "text_key", F.length("norm").alias("n"), F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c)).alias("keys"))
    recipes = materialised(hashes.withColumn("recipe", F.xxhash64("keys")))
    row, same_recipe = ["name", "text_sha256"], ["n", "recipe"]

    # One row for each id and text whose recipe another row has too.
    shared = materialised(recipes.groupBy(*same_recipe).agg(F.count("*").alias("rows")).where("rows > 1"))
    rows = by_group(recipes, shared, same_recipe, "rows", "name")
    suspects = materialised(rows.select(F.col("text_key").alias("key")).distinct())
    rows = materialised(rows.groupBy(*row, "n", "keys").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))

    # A chunk's identifier: its hash, and its place among the contents of that hash, which is 0 unless hashes collide.
    found = Bloom(suspects, suspects.count(), 0.01).filtered(text, F.col("text_key"))
    pieces = found.select("name", sha, F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk")).withColumn("key", chunk_hash(F.col("chunk")))
    contents = pieces.groupBy("key", "chunk").agg(F.lit(1).alias("one"))
    collided = materialised(contents.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1").select("key"))
    if collided.limit(1).count():
        contested = contents.join(collided, "key").groupBy("key").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
        contested = contested.select("key", F.posexplode("all").alias("ordinal", "chunk")).where("ordinal > 0")
        places = pieces.join(contested, ["key", "chunk"]).groupBy(*row).agg(F.map_from_entries(F.collect_set(F.struct("pos", "ordinal"))).alias("ordinals"))
        rows = rows.join(places, row, "left")
        ids = F.transform("keys", lambda key, i: F.struct(key.alias("key"), F.coalesce(F.element_at("ordinals", i), F.lit(0)).alias("ordinal")))
    else:
        ids = F.transform("keys", lambda key: F.struct(key.alias("key"), F.lit(0).alias("ordinal")))
    lists = materialised(rows.select(*row, "doc_id", "copies", "n", ids.alias("ids")))

    groups = materialised(lists.groupBy("n", "ids").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("rows")))
    decided = by_group(lists.select(*row, "n", "ids"), groups, ["n", "ids"], "rows", "name").select(*row, "keep_id", "group_size")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return recipes.join(decided, row, "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", F.size("keys").alias("n_chunks")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
"""
