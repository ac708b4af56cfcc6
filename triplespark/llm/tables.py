"""What the operators share when they read tables: chosen columns, checked broadcasts, rows kept or dropped by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of a side that is broadcast; a larger side is joined by shuffle, with the same result.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values take at most ``most`` bytes, else as it is. The size is measured by an
    aggregate over all rows, so df should be a written table."""
    width: Column = F.lit(24 + 8 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def integer_id(docs: DataFrame, column: str = "doc_id") -> Column:
    """The id as a long. Ids of other types than whole numbers are refused: a cast would make them null or merge them."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{column} must be a whole number of up to 64 bits, not {kind}; map other ids to such numbers first")
    return F.col(column).cast("long")


#: The most copies of a row that one task makes where copies are spread.
CHUNK_COPIES = 1 << 16


def repeated(df: DataFrame, times: str, number: str, spread: bool, chunk: int = CHUNK_COPIES) -> DataFrame:
    """Each row of df as often as its long column ``times`` says, numbered from 0 in ``number``; times itself goes.

    The numbers come from two explodes, of the starts of chunks and of each chunk, so a large count makes no long
    array. With ``spread`` the chunks of a row of more than one are shuffled, so no task makes all of its copies; df is
    then read twice, and should be a written table.
    """
    end = F.least(F.col(times), F.col("__start") + chunk) - 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(chunk).cast("long")))
    some = df.where(F.col(times) > 0)
    if spread:
        many = some.where(F.col(times) > chunk).withColumn("__start", starts)
        many = many.repartition(F.xxhash64(*[c for c, t in many.dtypes if t in ("bigint", "int", "string")]))
        split = some.where(F.col(times) <= chunk).withColumn("__start", F.lit(0).cast("long")).unionByName(many)
    else:
        split = some.withColumn("__start", starts)
    return split.withColumn(number, F.explode(F.sequence(F.col("__start"), end))).drop("__start", times)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of df has it in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def unit_hash(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the seed and the parts; nulls hash as the word null."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def words(text: Column) -> Column:
    """The number of runs of characters other than space, tab, line feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def without(docs: DataFrame, drop: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of docs but for those whose (doc_id, hash of text) is in ``drop``; of the rows that share a key in
    ``again`` one stays. Both tables have the columns doc_id and th and distinct non-null rows. Docs keep all their
    columns; rows with a null doc_id or text stay."""
    own = fresh(docs, "__doc_id", "__th")
    kept = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumns({own[0]: F.col("doc_id"), own[1]: F.xxhash64("text")})
    gone = small(drop.select(F.col("doc_id").alias(own[0]), F.col("th").alias(own[1])))
    twice = small(again.select(F.col("doc_id").alias(own[0]), F.col("th").alias(own[1])))
    rest = keyed.join(gone, own, "left_anti")
    if again.isEmpty():
        return rest.select(*kept)
    once = rest.join(twice, own, "left_anti").select(*kept)
    one = rest.join(twice, own, "left_semi").dropDuplicates(own).select(*kept)
    return once.unionByName(one)
