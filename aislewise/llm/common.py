"""Small helpers shared by the operators: reading tables, words, Arrow batches, checkpoints."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislewise.session import scratch_path

#: A word: any run without blanks, tabs and line ends.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def default_tokenizer(name: str) -> str:
    """Place of a public tokenizer file. The operators take any path; this is the queries' default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def columns_of(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, as ``id`` and ``c0, c1, ..``: other columns of the input, whatever
    their names, cannot clash with those an operator makes."""
    return df.select(df[id_col].alias("id"), *[df[c].alias(f"c{i}") for i, c in enumerate(cols)])


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to ``rows`` rows and about ``size`` bytes of a text column; a longer text
    is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        done = int(ends[begin - 1]) if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, done + size, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, rows: int = 256) -> DataFrame:
    """Rows of ``df`` (first column the id, second a text) through ``make()(ids, texts)`` in slices
    of up to ``rows`` rows and about a megabyte. ``make`` runs once a task (it loads models); the result
    maps names to lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows):
                out = work(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of what a task function returns. Operators call it as they build a pass of such a
    function, so it also sees to the size of the batches: where the session leaves Spark's default of 10,000 rows an
    Arrow batch, which may take hundreds of megabytes of texts on both sides of the pipe, it sets 1,000."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return to_arrow_schema(StructType.fromDDL(ddl))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back. This cuts the
    lineage, and a lost executor cannot lose it. It is deleted when the session's JVM ends."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """crc32 of the id's text modulo ``parts`` equals ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


#: Least and most bits of the map of ids. The table that holds it has at most ``2**(bits - 6)`` rows, half
#: a million at most.
MAP_BITS = (22, 25)


def maybe_in(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """``df`` with a boolean column ``maybe``: false only if the value is not in ``ids`` (one column).

    A bit map of hashed ids decides, with 8 bits or more for each row of ``ids`` up to 2**25 in all, so
    that the broadcast table has at most half a million rows of two numbers however many ids there are. It
    says true for one other value in 8 at most up to four million ids, and more often beyond, never false
    wrongly; a caller then joins more rows than it needs. A null is never in ``ids``."""
    bits = min(MAP_BITS[1], max(MAP_BITS[0], (8 * ids.count()).bit_length()))
    size = 1 << bits
    slot = f"cast(pmod(xxhash64(`{ids.columns[0]}`), {size}) as int)"
    marks = ids.groupBy(F.expr(f"shiftright({slot}, 6)").alias("map_word")).agg(F.expr(f"bit_or(shiftleft(1L, {slot} & 63))").alias("map_bits"))
    out = df.withColumn("map_slot", F.expr(f"cast(pmod(xxhash64(`{col}`), {size}) as int)"))
    out = out.join(F.broadcast(marks), F.expr("shiftright(map_slot, 6)") == F.col("map_word"), "left")
    found = F.expr(f"`{col}` IS NOT NULL AND map_bits IS NOT NULL AND (shiftright(map_bits, map_slot & 63) & 1L) = 1L")
    return out.withColumn("maybe", found).drop("map_slot", "map_word", "map_bits")


def chosen_by_hash(rows: DataFrame, key: str, each: int) -> DataFrame:
    """Of ``rows`` (``id`` and ``key``, without nulls) the ``each`` rows of every key with the least hashes
    of their ids. A key with over 1/10,000 of all rows (there are fewer than 10,000, so their counts are
    broadcast) is thinned where its rows are, to about ``4 * each``; no other has more. So no task sorts
    more of a key, however many rows and partitions there are."""
    counts = written(rows.groupBy(key).agg(F.count("*").alias("key_rows")), "key-counts")
    total = counts.agg(F.sum("key_rows")).first()[0] or 0
    heavy = counts.where(F.col("key_rows") * 10_000 > total).withColumnRenamed(key, "heavy_key")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy_key"), "left").withColumn("place", place)
    near = near.where(F.col("key_rows").isNull() | (F.col("place") * F.col("key_rows") <= F.lit(4 * each << 30)))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place", "id")))
    return ranked.where(F.col("rank") <= each).select("id", key)
