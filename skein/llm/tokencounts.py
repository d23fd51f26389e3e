"""Token counts of documents in flat token files, which hold nothing but ids, with an end-of-document id after each.

The files have no index. They are read in blocks of BLOCK ids by byte range, wherever a range lies; a vectorised search
finds the separators of each block. What a block alone can't know, where its first document began and how many came
before, follows from a prefix scan over the blocks of a file: the running number of separators, and the last one's place.

Defined results. Documents are numbered within their file from 0. Two separators in a row enclose a document of 0
tokens, as does a null or an empty text. Ids after a file's last separator form a document with terminated false. An
empty file or table has no documents. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import END_OF_DOCUMENT, VOCABULARY, encoder, vocabulary
from .common import fresh_path, running, slices, written
from .tokenids import id_type

BLOCK = 1 << 22
#: Bytes of ids gathered before a write.
CHUNK = 4 << 20


def filesystem(uri: str):
    """The file system and path of a URI of the shared folder."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_files(docs: DataFrame, path: str = VOCABULARY, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Writes one flat file a partition into the shared folder; returns file, uri, n_ids and id_bytes of each.

    A task that is made again writes another file; only the files of tasks that were counted are in the result.
    """
    spark = docs.sparkSession
    data, folder = vocabulary(spark, path), fresh_path(spark, "flat")

    def run(batches):
        bpe = encoder(data.value)
        kind = id_type(max(len(bpe.width), separator + 1))
        name = f"{TaskContext.get().partitionId():06d}"
        uri = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.bin"
        out, held, size, total = None, [], 0, 0

        def flush():
            nonlocal out, held, size
            if out is None:
                fs, at = filesystem(uri if "://" in uri else f"file://{uri}")
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(at)
            for x in held:
                out.write(x)
            held, size = [], 0

        for batch in batches:
            for b in slices(batch):
                ids, n = bpe.ids(b.column("text"))
                flat = np.insert(ids.astype(kind), np.cumsum(n), separator)
                held.append(flat.tobytes())
                size, total = size + flat.nbytes, total + len(flat)
                if size >= CHUNK:
                    flush()
        if total:
            flush()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "uri": uri, "n_ids": total, "id_bytes": kind.itemsize}])

    return written(docs.select("text").mapInArrow(run, "file string, uri string, n_ids bigint, id_bytes bigint"), "files")


def scan(files: DataFrame, separator: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """One row a document: file, doc_ordinal, start_token, n_tokens, terminated."""
    ranges = files.filter("n_ids > 0").select("file", "uri", "n_ids", "id_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_ids") - 1) / F.lit(block)).cast("bigint"))).alias("block"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_ids", pa.int64()), ("found", pa.list_(pa.int64()))])

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                width, first = r["id_bytes"], r["block"] * block
                count = min(block, r["n_ids"] - first)
                fs, at = filesystem(r["uri"] if "://" in r["uri"] else f"file://{r['uri']}")
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(count * width, first * width), np.dtype(f"<u{width}"))
                if len(ids) != count:
                    raise OSError(f"{r['uri']} is shorter than {r['n_ids']} ids")
                found = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_pylist([{"file": r["file"], "block": r["block"], "n_ids": r["n_ids"], "found": found.tolist()}], schema=schema)

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    blocks = ranges.repartition(n, "file", "block").mapInArrow(search, "file string, block bigint, n_ids bigint, found array<bigint>")
    blocks = written(blocks, "blocks")
    # the scan moves three numbers a block, in ranges that cut a file of many blocks, too
    some = blocks.select("file", "block", F.size("found").alias("n"), F.element_at("found", F.when(F.size("found") > 0, F.lit(-1)).otherwise(F.lit(None).cast("int"))).alias("last"))
    known = running(written(running(some, "file", ["block"], "n", "ordinal"), "ordinals"), "file", ["block"], "last", "carry", most=True)
    scanned = blocks.join(known, ["file", "block"]).withColumn("carry", F.coalesce("carry", F.lit(-1).cast("bigint")))
    # the end of a file closes what the last separator left open
    ends = (F.col("block") + 1) * block >= F.col("n_ids")
    open_ = F.coalesce("last", "carry") < F.col("n_ids") - 1
    scanned = scanned.withColumn("found", F.when(ends & open_, F.concat("found", F.array("n_ids"))).otherwise(F.col("found")))
    each = F.transform("found", lambda p, i: F.struct((F.col("ordinal") + i).alias("doc_ordinal"), F.when(i == 0, F.col("carry")).otherwise(F.col("found")[i - 1]).alias("prior"), p.alias("p")))
    rows = scanned.select("file", "n_ids", F.inline(each))
    return rows.select("file", "doc_ordinal", (F.col("prior") + 1).alias("start_token"), (F.col("p") - F.col("prior") - 1).alias("n_tokens"), (F.col("p") < F.col("n_ids")).alias("terminated"))


def count_tokens(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Flat files from docs, and the token counts that a scan of the files finds."""
    return scan(write_files(docs, path), block=block)


def existing(spark: SparkSession, uris: list[str], id_bytes: int = 2) -> DataFrame:
    """A table of flat files made elsewhere, for scan."""
    rows = []
    for u in uris:
        fs, at = filesystem(u if "://" in u else f"file://{u}")
        rows.append((at.rsplit("/", 1)[-1], u, fs.get_file_info(at).size // id_bytes, id_bytes))
    return spark.createDataFrame(rows, "file string, uri string, n_ids bigint, id_bytes bigint")
