"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sources are numbered by code point (null last) and weigh ``weights`` in turn. Together they share all
words; a target stops at ``cap`` times its source's words, and the excess is reshared by weight. Targets
become whole numbers of equal blocks of words: the highest quotients ``weight / (2 k + 1)`` get the
blocks, first among sources, then among the shards of a source (hash-dealt, ``shard_docs`` documents on
average). Within a shard documents stand in a seeded order; its quota goes round that order block by
block, so each document is taken a whole number of times, but for the one where the last block ends.

Defined results: a null text has no words; a null source is a source of its own; a table without words
gives targets and takes of 0; an empty table gives no rows. Rows with one id are documents of their own.

Limits: the sources' targets are set in one task, a row for each source, and a source's blocks are dealt over its
shards in one task, a row for each ``shard_docs`` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 16
SHARD_DOCS = 1024
SEED = "7"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` with ``source_no`` and ``target``. There is one row for each source.

    Sorted by capped words per weight, the capped sources come first; the level is set by the first
    source that its share does not fill.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    fill = every.orderBy("full_at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    n = len(weights)
    out = (
        sources.withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % n + 1).cast("int")))
        .withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(fill), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(every)["level"])
    )
    return out.withColumn("target", F.coalesce(F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")), F.lit(0.0))).drop("full_at", "level", "weight")


def apportion(parties: DataFrame, scope: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Seats by highest quotients (Sainte-Lague) within each scope; ties go to the smaller key.

    Rounding each ideal share leaves a surplus or a gap of at most half a seat a party; the quotients
    next to the rounded shares settle it, so that no row is made for a seat. With n parties, the shares
    of n / 2 seats more (or fewer) round to as many seats as there are at least (at most). So no party
    moves further than its share of n / 2 seats, rounded up, and all have 2.5 n rows at most; nor does
    it by more than the gap. One quotient goes beyond, for shares that double arithmetic puts next to a half.
    """
    every = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    cols = parties.columns
    share = F.coalesce(F.try_divide(F.col(weight) * F.col(seats), F.sum(weight).over(every)), F.lit(0.0))
    x = parties.withColumn("_base", F.floor(share + 0.5).cast("long")).withColumn("_gap", F.col(seats) - F.sum("_base").over(every))
    most = F.ceil(F.coalesce(F.try_divide(F.col(weight) * F.count("*").over(every), 2 * F.sum(weight).over(every)), F.lit(0.0))).cast("long")
    x = x.withColumn("_reach", F.least(most, F.greatest(F.abs("_gap") - 1, F.lit(0)).cast("long")))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), "_reach")))
    quotient = F.when(F.col("_gap") >= 0, -F.col(weight) / (2 * (F.col("_base") + F.col("_k")) + 1)).when(F.col("_k") < F.col("_base"), F.col(weight) / (2 * (F.col("_base") - F.col("_k")) - 1))
    order = every.orderBy(F.col("_q").asc_nulls_last(), *[F.when(F.col("_gap") >= 0, F.col(k)).asc() for k in key], *[F.col(k).desc() for k in key], "_k")
    x = x.withColumn("_q", quotient).withColumn("_rank", F.row_number().over(order))
    moved = F.sum(F.when((F.col("_rank") <= F.abs("_gap")) & F.col("_q").isNotNull(), F.signum("_gap")).otherwise(0.0)).cast("long")
    return x.groupBy(*cols, "_base").agg(moved.alias("_moved")).select(*cols, (F.col("_base") + F.col("_moved")).alias(out))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row for each row of the input."""
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
    sized = cut_lineage(sized.withColumn("pick", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)))))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(per_source, weights, cap).withColumn("_all", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    goals = cut_lineage(apportion(goals, [], ["source_no"], "target", "_all", "source_blocks"))
    goals = goals.withColumn("shards", F.ceil(F.col("docs") / shard_docs).cast("long")).select("source", "source_no", "source_size", "target", "source_blocks", "shards")
    dealt = (
        sized.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("shard", F.conv(F.substring("pick", 1, 8), 16, 10).cast("long") % F.col("shards"))
        .drop("source", "_s", "shards")
    )
    shards = dealt.groupBy("source_no", "shard", "source_blocks").agg(F.sum("size").cast("double").alias("shard_size"))
    quotas = apportion(shards, ["source_no"], ["shard"], "shard_size", "source_blocks", "blocks")
    quotas = quotas.select("source_no", "shard", F.col("shard_size").cast("long").alias("shard_size"), (F.col("blocks") * block_words).alias("quota"))
    before = Window.partitionBy("source_no", "shard").orderBy("pick", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rounds = F.coalesce(F.floor(F.try_divide("quota", "shard_size")).cast("long"), F.lit(0))
    x = dealt.join(quotas, ["source_no", "shard"]).withColumn("rounds", rounds).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("rounds") * F.col("shard_size") - F.col("before")))
    return x.select("doc_id", "size", "source_size", "target", F.least(cap * F.col("size"), F.col("rounds") * F.col("size") + last).cast("long").alias("taken"))


def taken_rows(df: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mixed rows themselves, with the columns of the input: the whole text for each full round, and the first words for a part.

    Rows that share an id are matched to its takes by size, in order, which brings an id's rows to one task. Where an
    id, or null, may have very many rows, give the rows a key of their own.
    """
    cols = df.columns
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    rows = df.withColumn("_own", F.col(id_col).cast("long"))
    same = F.col("_own").eqNullSafe(F.col("_id"))
    again = cut_lineage(plan.groupBy(F.col("_id").alias("_again")).count().where("count > 1").select("_again"))
    if again.isEmpty():
        x = rows.join(plan, same)
    else:
        repeated = lambda x, c, how: x.join(again, F.col(c).eqNullSafe(F.col("_again")), how)
        numbered = lambda x, by, *order: x.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        mine = numbered(repeated(rows, "_own", "left_semi").withColumn("_words", words(text_col)), "_own", "_words").drop("_words")
        takes = numbered(repeated(plan, "_id", "left_semi"), "_id", "_size", "_taken").withColumnRenamed("_at", "_to")
        x = repeated(rows, "_own", "left_anti").join(repeated(plan, "_id", "left_anti"), same)
        x = x.unionByName(mine.join(takes, same & (F.col("_at") == F.col("_to"))).drop("_at", "_to"))
    x = x.where(F.col("_taken") > 0)
    part = F.try_mod(F.col("_taken"), F.col("_size"))
    whole = F.floor(F.try_divide("_taken", "_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    x = x.withColumn("_words", F.explode(copies))
    cut = F.when(F.col("_words") == 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col("_words")))
    x = x.withColumn(text_col, cut)
    if chars_col and chars_col in cols:
        x = x.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType))
    return x.select(*cols)


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, with the white space between them as it is."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")
