"""Files of token ids in ascending order of documents, written and read by Spark.

Every row of a file is a segment: whole documents in order, their ids with end ids appended and coded by ``range_coder``, and the
documents' ids and numbers of tokens. Rows lie in a Parquet container, so that writing is committed by Spark, lost tasks are
repeated and any store that Spark reaches will do. Documents are dealt by ranges of their id, each task sorts and codes
its own range in segments of about ``SEGMENT`` ids, and places in the whole follow from the segments' lengths alone.

Defined results: null and empty texts are a single end id; rows with one id are kept, in any order among themselves; null ids come
first; other columns are ignored; an empty table gives files without segments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm import range_coder
from sightline.llm import wordarrays as wa
from sightline.llm.tables import id_and_text
from sightline.llm.tokens import default_path, worker_tokens

END_ID = 2
SEGMENT = 1 << 23
TEXT_SLICE = 1 << 21
SCHEMA = "part int, segment int, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    model = tokenizer or default_path()

    def code(batches):
        tokens, part, segment = worker_tokens(model), TaskContext.get().partitionId(), 0
        held, names, sizes, n = [], [], [], 0

        def flush():
            payload = range_coder.encode_blocks(np.concatenate(held), max(len(tokens.lengths), end_id + 1))
            size = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([sum((x.to_pylist() for x in names), [])], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())],
                ["part", "segment", "n_ids", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text"), TEXT_SLICE):
                ids, bounds = tokens.encode(data, offsets)
                held.append(np.insert(ids, bounds[1:], end_id))
                names.append(batch.column("doc_id").slice(lo, hi - lo))
                sizes.append(np.diff(bounds) + 1)
                n += len(held[-1])
                if n >= SEGMENT:
                    yield flush()
                    segment += 1
                    held, names, sizes, n = [], [], [], 0
        if n:
            yield flush()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(code, SCHEMA).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` of every document in the files."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    places = segments.select("part", "segment", "n_ids").withColumn(
        "base", F.sum("n_ids").over(Window.orderBy("part", "segment")) - F.col("n_ids"),
    ).drop("n_ids")

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = range_coder.decode_blocks(row.column("payload")[0].as_py()).astype("<u4")
                size = row.column("n_tokens").flatten().to_numpy()
                start = wa.prefix(size)
                if start[-1] != len(ids):
                    raise ValueError("segment and documents differ in length")
                view = memoryview(ids).cast("B")
                checks = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
                columns = [
                    row.column("doc_ids").flatten(), pa.array(start[:-1] + row.column("base")[0].as_py()), pa.array(size),
                    pa.array(checks, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return segments.join(places, ["part", "segment"]).select("base", "doc_ids", "n_tokens", "payload").mapInArrow(decode, schema)
