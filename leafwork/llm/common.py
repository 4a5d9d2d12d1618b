"""What several operators of this subpackage share: inputs, checkpoints, joins that survive hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

#: A key with more than 1/PARTS of all rows is split by ``join_by_weight``; there can be PARTS such keys at most.
PARTS = 100_000
#: Keys of fewer rows than this are never split.
PIECE = 2_000
#: Tables of a few numbers a row are broadcast up to so many rows (a few MB); beyond that they are shuffled.
SMALL = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for; every other column is left out before anything is read."""
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct, ``_row``, beside the columns asked for, so that no column of ``docs`` can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def unpacked(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``packed`` rows again; with ``text`` for the text, and its length for n_chars, where it isn't null."""
    if text is not None:
        row, new = F.col("_row"), rows.select(text.alias("t"), "_row").schema
        kinds = {f.name: f.dataType for f in new["_row"].dataType.fields}
        changed = row.withField("text", text)
        if "n_chars" in kinds:
            changed = changed.withField("n_chars", F.length(text).cast(kinds["n_chars"]))
        rows = rows.select(F.when(text.isNull(), row).otherwise(changed).alias("_row"))
    return rows.select("_row.*")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def held_out(of: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``of`` is ``remainder``; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one of our own only where none is named and all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafwork-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and each reader takes only its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes ``written`` tables that nothing reads any more; with ``shuffles`` also lets Spark's cleaner remove those of plans that are gone."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        SparkSession.getActiveSession()._jvm.System.gc()


def _dealt_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salt: Column, how: str) -> DataFrame:
    """A join whose ``hot`` keys, by hash, are split into pieces: the row of ``right`` is repeated for each, the rows of ``left`` are dealt to them.

    Only ``hot`` (_code, _pieces), with PARTS rows at most, is broadcast; what ``right`` holds is shuffled, however long.
    """
    values = [c for c in right.columns if c not in keys]
    code, pieces = F.xxhash64(*keys), F.coalesce("_pieces", F.lit(1)).cast("int")
    hot = F.broadcast(hot.groupBy("_code").agg(F.max("_pieces").alias("_pieces")))
    dealt = left.withColumn("_code", code).join(hot, "_code", "left").withColumn("_piece", F.pmod(salt, pieces).cast("int")).drop("_code", "_pieces")
    copies = right.select(*keys, code.alias("_code"), F.struct(*values).alias("_got")).join(hot, "_code", "left")
    copies = copies.select(*keys, "_got", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    both = dealt.join(copies, [*keys, "_piece"], how)
    return both.select(*left.columns, *(F.col(f"_got.{c}").alias(c) for c in values))


def _hot(counts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    piece = max(PIECE, -(-total // PARTS))
    return counts.filter(F.col(weight) > piece).select(F.xxhash64(*keys).alias("_code"), F.ceil(F.col(weight) / piece).alias("_pieces"))


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, salt: Column) -> DataFrame:
    """Left join on ``keys``, where ``right`` has each key once and ``weight`` is how many rows of ``left`` hold it: keys with more than 1/PARTS of the ``total`` rows are split by ``salt``."""
    return _dealt_join(left, right, keys, _hot(right, keys, weight, total), salt, "left")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Inner join on ``keys``, which ``right`` has once; ``left``, a written table, is counted first, and its frequent keys are split as in ``join_by_weight``."""
    rows = left.count()
    if rows <= PIECE:  # no key can have more
        return left.join(right, keys)
    hot = checkpointed(_hot(left.groupBy(*keys).agg(F.count("*").alias("_weight")), keys, "_weight", rows))
    return left.join(right, keys) if hot.isEmpty() else _dealt_join(left, right, keys, hot, salt, "inner")


def claims(keys: DataFrame, name: str, bits: int | None = None) -> Column:
    """A filter over the column ``name`` of ``keys``, as a test of a column of that name in another table.

    It claims every key and few others: it saves shuffles and decides nothing. It has 16 bits a key, or ``bits``, between 2**16 and 2**26
    (8 MB); beyond 4 million keys it claims more others.
    """
    bits = bits or min(1 << 26, max(1 << 16, 16 * keys.count()))
    words = bits // 63
    place = [F.pmod(F.xxhash64(name, F.lit(i)), F.lit(words * 63)) for i in range(3)]
    rows = keys.select(F.explode(F.array(*place)).alias("p")).groupBy(F.expr("p div 63").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 63 as int))")).alias("b"))
    # at most ``words`` rows come to the driver, whatever the input
    found = rows.toArrow()
    table = np.zeros(words, np.int64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        sure = np.ones(len(a), bool)
        for p in (a.to_numpy(), b.to_numpy(), c.to_numpy()):
            sure &= (shared.value[p // 63] >> (p % 63)) & 1 == 1
        return pd.Series(sure)

    return test(*place)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node, component its smallest node.

    Large-star and small-star in turn: every round hangs nodes on smaller ones until each component is a star around
    its smallest node, which edges may be from the start. The edges stay distributed, each round is checkpointed, and the
    driver sees whether there is a node that isn't settled. Rounds add no edges, so what is broadcast has twice ``SMALL`` rows at most.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    side = F.broadcast if e.count() <= SMALL else lambda least: least
    for _ in range(most_rounds):
        # a node of a star hangs on one other, or others hang on it
        hung = e.select(F.col("u").alias("a"), F.lit(1).alias("on"), F.lit(0).alias("of")).union(e.select("v", F.lit(0), F.lit(1)))
        if hung.groupBy("a").agg(F.sum("on").alias("on"), F.max("of").alias("of")).filter("`on` + `of` > 1").isEmpty():
            break
        both = e.union(e.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(side(least), "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = checkpointed(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
