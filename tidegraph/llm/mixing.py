"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Golden-ratio points walk through the sources' cumulative targets, so every stretch of the schedule holds each source
in proportion. A source's documents, shuffled by a hash, form one stream of tokens that is cut into equal blocks; the
r-th slot of a source takes the r-th block of its stream, which goes on from its start (a second epoch) at its end.

Scale: texts are read once, for their sizes. Ranks and running sums are taken in two levels (a sum for each chunk,
then rows inside a chunk), so no window holds a whole source. One row a source meets in one task, after aggregation.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null ids are ordinary
ids; repeated rows are documents of their own; a document of size 0 takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
CELLS = 4096
CHUNK = 65536
#: Names of passing columns beside those of an input that is handed on.
ROW, TAKEN = "_mix_row_", "_mix_taken_"


def sizes(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 42) -> DataFrame:
    """doc_id, source, size (words) and h, a hash that shuffles the documents of a source."""
    doc = F.col(id_column).cast("long")
    return docs.select(
        doc.alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """A row for each source: source, rank (from 1), source_size, target, and lo and hi, its tokens among all targets.

    The level that all uncapped sources share is the largest of the levels found by capping the i sources of the
    least size for their weight, for each i.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    )
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = W.partitionBy()
    level = (
        ranked.withColumn("capped", F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * epochs)
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least((F.col("source_size") * epochs).cast("double"), F.col("level") * F.col("weight"))
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return (
        level.withColumn("target", target)
        .withColumn("hi", F.sum(F.round("target").cast("long")).over(upto))
        .withColumn("lo", F.col("hi") - F.round("target").cast("long"))
        .select("source", "rank", "source_size", "target", "lo", "hi")
    )


def slots(spark: SparkSession, by_source: DataFrame, total: int, block: int) -> DataFrame:
    """slot, source's rank, and nth, the slot's number among those of its source."""
    width = max(1, -(-total // CELLS))
    point = F.col("id") * F.lit(GOLDEN)
    points = (
        spark.range(max(0, round(total / block)))
        .withColumn("at", F.floor((point - F.floor(point)) * F.lit(float(total))).cast("long"))
        .withColumn("cell", F.expr(f"`at` div {width}"))
    )
    cells = (
        by_source.where("hi > lo")
        .withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
        .select("rank", "lo", "hi", "cell")
    )
    dealt = (
        points.join(cells, "cell")
        .where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .select(F.col("id").alias("slot"), "rank", F.expr(f"id div {CHUNK}").alias("chunk"))
    )
    before = (
        dealt.groupBy("rank", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("rank").orderBy("chunk")) - F.col("n"))
        .drop("n")
    )
    numbered = dealt.withColumn("k", F.row_number().over(W.partitionBy("rank", "chunk").orderBy("slot")) - 1)
    return numbered.join(before, ["rank", "chunk"]).select("slot", "rank", (F.col("before") + F.col("k")).cast("long").alias("nth"))


def streams(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """sized with rank, source_size, target and start, the document's place in its source's shuffled stream."""
    sized = sized.withColumn("part", F.substring("h", 1, 3))
    parts = (
        sized.groupBy("source", "part")
        .agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n"))
    )
    parts = parts.alias("p").join(by_source.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("p_source"), F.col("p.part").alias("p_part"), "before", "rank", "source_size", "target"
    )
    inside = W.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return (
        sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .select("doc_id", "source", "size", "rank", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))
    )


def schedule(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: int = 2, block: int = 1024, least_slots: int = 131072, **columns) -> tuple[DataFrame, DataFrame]:
    """(pieces, rows): the mix as slot, doc_id, first word and n_words of each piece of a document, and every document.

    A block has `block` words, or fewer where the whole mix would have under least_slots blocks. rows has a row for
    each document with rank and start; pieces has rank and start too, by which a document is known in its source.
    """
    spark = docs.sparkSession
    sized = common.written(sizes(docs, **columns), "mix-sizes")
    by_source = common.written(targets(sized, weights, share, epochs), "mix-sources")
    total = by_source.agg(F.max("hi")).first()[0] or 0
    block = max(1, min(block, total // least_slots))
    rows = common.written(streams(sized, by_source), "mix-streams")
    virtual = rows.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "begin", F.col("start") + F.col("epoch") * F.col("source_size")
    )
    first, last = F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")
    cut = virtual.withColumn("nth", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("from", F.greatest("begin", F.col("nth") * block)).withColumn("to", F.least(F.col("begin") + F.col("size"), (F.col("nth") + 1) * block))
    pieces = cut.join(slots(spark, by_source, total, block), ["rank", "nth"]).select(
        "slot", "rank", "start", "doc_id", "source", (F.col("from") - F.col("begin")).alias("first_word"), (F.col("to") - F.col("from")).alias("n_words")
    )
    return pieces, rows


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words that the mix takes of the document, for each row of docs."""
    pieces, rows = schedule(docs, **parameters)
    taken = pieces.groupBy("rank", "start").agg(F.sum("n_words").alias("taken"))
    full = rows.where("size > 0").join(taken, ["rank", "start"], "left")
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return full.select(*columns).union(empty.select(*columns))


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """docs as mixed: each row as many times as the mix takes it whole (rounded), with all its columns.

    A row is known by its id, source and size. Rows that share these share what the mix takes of them: as many copies
    each, and one more for the first of them (by a hash of all columns) as long as there are some left.
    """
    columns = docs.columns
    per_row = (
        mix(docs, **parameters)
        .where("size > 0")
        .groupBy("doc_id", "source", "size")
        .agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("long").alias("copies"), F.count("*").alias("n"))
        .where("copies > 0")
        .select(F.struct("doc_id", "source", "size", "copies", "n").alias(TAKEN))
    )
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.withColumn(ROW, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    same = [F.col(f"{ROW}.{c}").eqNullSafe(F.col(f"{TAKEN}.{c}")) for c in ("doc_id", "source", "size")]
    joined = own.join(per_row, same[0] & same[1] & same[2])
    copies, n = F.col(f"{TAKEN}.copies"), F.col(f"{TAKEN}.n")
    order = W.partitionBy(F.col(TAKEN)).orderBy(F.xxhash64(*columns))
    rest = F.row_number().over(order) <= copies % n
    alone = joined.where(n == 1).withColumn(ROW, copies)
    several = joined.where(n > 1).withColumn(ROW, F.floor(copies / n) + F.when(rest, 1).otherwise(0))
    taken = alone.select(*columns, ROW).unionByName(several.select(*columns, ROW)).where(F.col(ROW) > 0)
    return taken.withColumn(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col(ROW)))).select(columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).drop("source")


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM by_source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) * 1.5::DOUBLE
     - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aimed AS (SELECT source, rank, source_size, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
spans AS (SELECT *, sum(round(target)::BIGINT) OVER (ORDER BY rank)::BIGINT AS hi FROM aimed),
size_of AS (SELECT max(hi) AS total, greatest(1, least(1024, max(hi) // 131072)) AS block FROM spans),
points AS (
  SELECT i AS slot, floor((i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE)) * total::DOUBLE)::BIGINT AS place
  FROM size_of, LATERAL (SELECT unnest(range(round(total::DOUBLE / block)::BIGINT)) AS i)),
slots AS (
  SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth
  FROM points JOIN spans ON place >= hi - round(target)::BIGINT AND place < hi),
counts AS (SELECT rank, count(*) AS n FROM slots GROUP BY rank),
placed AS (
  SELECT s.*, t.rank, t.source_size, t.target,
    (sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized s JOIN spans t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, coalesce(n, 0) * block) - start)
   + greatest(0, least(start + source_size + size, coalesce(n, 0) * block) - start - source_size))::BIGINT AS taken
FROM placed LEFT JOIN counts USING (rank), size_of
"""
