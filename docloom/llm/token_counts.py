"""Token counts of flat, unindexed token files by a separator scan.

A flat file is token ids one after another, each document ended by an end-of-document id, with no
index. Files are cut into blocks of a fixed number of tokens wherever the cuts fall; each block is
searched for separators by one vectorised comparison, and a prefix scan over the small block
summaries tells every block how many documents ended before it and how long the open one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.shipping import ship

from .bpe import default_ranks, read_ranks, text_encoder
from .common import as_binary, decoded, hadoop_fs, save, scratch_path, small_batches, text_rows

BLOCK_TOKENS = 1 << 16
#: Blocks in a group of the prefix scan: no window holds more rows of a file.
GROUP = 1024
_NAMES = 4096


def flat_file_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files below a path, read by ranges of block_tokens ids of `width` bytes.

    The driver lists names and lengths only. Executors read through pyarrow's file systems, so the
    files must be in a store that these open (a mounted path, HDFS, S3, GCS).
    """
    import pyarrow.fs as pafs

    ship(spark)
    fs, top = hadoop_fs(spark, path)
    found = [s for s in (fs.listStatus(top) if fs.exists(top) else []) if not s.isDirectory() and not s.getPath().getName().startswith((".", "_"))]
    files = sorted((s.getPath().toString(), s.getLen()) for s in found)
    for name, size in files:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are not a whole number of {width}-byte ids")
    step = block_tokens * width
    wanted = spark.createDataFrame([(f, n) for f, n in files], "file string, size long")
    wanted = wanted.select("file", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / step) - 1))).alias("block"), "size").where("size > 0")
    wanted = wanted.repartition(max(1, min(100_000, sum(n for _, n in files) // (64 << 20) + 1)), "file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = pafs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
                with store.open_input_file(inner) as source:
                    source.seek(block * step)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([source.read(step)], pa.binary())], ["file", "block", "data"])

    return wanted.select("file", F.col("block").cast("long")).mapInArrow(read, "file string, block long, data binary")


def id_width(eod: int, ranks_path: str | None = None) -> int:
    """Bytes of an id: two where the vocabulary's ids and the end of a document all fit. The end must be no id of the vocabulary."""
    ids = set(read_ranks(ranks_path or default_ranks()).values())
    if eod in ids:
        raise ValueError(f"{eod} is a token of the vocabulary and cannot end documents")
    return 2 if max(eod, *ids) < 1 << 16 else 4


def write_flat(docs: DataFrame, folder: str, eod: int, ranks_path: str | None = None, width: int | None = None) -> DataFrame:
    """Encode docs into flat files below a folder that executors share, one for each partition; returns names(file, ordinal, doc_id).

    A file is nothing but ids. It is written under a name of the attempt and moved to its own at the
    end, so a task that fails, or runs twice, leaves a whole file or none. The names say whose
    document the n-th of a file is; nothing in a file points at documents.
    """
    import pyarrow.fs as pafs

    width = width or id_width(eod, ranks_path)
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = text_encoder(ranks_path), TaskContext.get()
        store, inner = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        store.create_dir(inner, recursive=True)
        name = f"part-{context.partitionId():08d}.bin"
        draft, end = f"{inner}/.{name}.{context.taskAttemptId()}", np.array([eod], dtype).tobytes()
        ids: list[int | None] = []
        named = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([named], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "first", "names"])

        try:
            with store.open_output_stream(draft) as out:
                for batch in small_batches(batches):
                    for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch), strict=True):
                        packed = np.frombuffer(encoder.packed(decoded(text)), "<u4")
                        out.write(packed.astype(dtype).tobytes() + end)
                        ids.append(doc_id)
                        if len(ids) == _NAMES:
                            yield row()
                            named, ids = named + len(ids), []
        except BaseException:
            store.delete_file(draft)  # a failed attempt leaves nothing
            raise
        if store.get_file_info(f"{inner}/{name}").type != pafs.FileType.NotFound:
            store.delete_file(f"{inner}/{name}")  # of an attempt before this one
        store.move(draft, f"{inner}/{name}")
        if ids:
            yield row()

    made = save(as_binary(docs).mapInArrow(run, "file string, first long, names array<long>"), "names")
    return made.select("file", "first", F.posexplode("names").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")


def block_summaries(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, block, n_tokens, n_ends, head, tail, inner): ends found, ids before the first and after the last, and lengths between."""
    ship(blocks.sparkSession)
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", dtype)
                ends = np.flatnonzero(ids == eod)
                some = len(ends) > 0
                row = (len(ids), len(ends), int(ends[0]) if some else len(ids), len(ids) - 1 - int(ends[-1]) if some else len(ids), (np.diff(ends) - 1).tolist())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.list_(pa.int64()))], ["file", "block", "n_tokens", "n_ends", "head", "tail", "inner"])

    return blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(run, "file string, block long, n_tokens long, n_ends long, head long, tail long, inner array<long>")


def document_lengths(summaries: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document of the scanned files, ordinals from 0 in each file.

    A document may span any number of blocks. Ids after a file's last end are one more document with
    ended = false; two ends in a row are a document of 0 tokens. Blocks but a file's last must hold
    block_tokens ids. The scan has two levels, groups of blocks and blocks in a group.
    """
    start = F.col("block") * F.lit(block_tokens)
    last_end = F.when(F.col("n_ends") > 0, start + F.col("n_tokens") - F.col("tail") - 1)
    found = save(summaries.withColumn("last_end", last_end).withColumn("g", F.floor(F.col("block") / GROUP)), "scan")
    groups = found.groupBy("file", "g").agg(F.sum("n_ends").alias("ends"), F.max("last_end").alias("at"), F.max("block").alias("last_block"))
    earlier = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "g", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("ends_before"), F.max("at").over(earlier).alias("at_before"), F.max("last_block").over(Window.partitionBy("file")).alias("last_block"))
    before = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.join(groups, ["file", "g"])
    base = F.col("ends_before") + F.coalesce(F.sum("n_ends").over(before), F.lit(0))
    at = F.coalesce(F.greatest("at_before", F.max("last_end").over(before)), F.lit(-1))
    placed = placed.select("file", "block", "n_ends", "head", "tail", "inner", "last_block", base.alias("base"), (start - at - 1).alias("carry"))
    ended = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    open_end = F.when((F.col("block") == F.col("last_block")) & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    each = placed.select("file", "base", "n_ends", F.posexplode(F.concat(ended, open_end)).alias("k", "n_tokens"))
    return each.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("n_ends")).alias("ended"))


def count_documents(docs: DataFrame, eod: int = 50_256, ranks_path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) of every row of docs: encoded to flat files, then counted from these alone.

    Null and empty texts have 0 tokens; what is not UTF-8 counts as replacement characters. Repeated rows and null ids are counted row by row; an empty
    table gives no rows. file is the number of the flat file.
    """
    spark, width = docs.sparkSession, id_width(eod, ranks_path)
    folder = scratch_path(spark, "flat")
    names = write_flat(docs, folder, eod, ranks_path, width)
    lengths = document_lengths(block_summaries(flat_file_blocks(spark, folder, width, block_tokens), eod, width), block_tokens)
    lengths = lengths.withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return names.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens", number.alias("file"), "ordinal")
