"""Pages to elements: one parse per page, shared by every rule.

``with_dom`` adds the element list of a page to its row. Nothing about a page ever needs another
page, so the rules run where the page was read and the list never crosses a shuffle. ``elements``
lays the same list out as one row per element for relational work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sightline import vocab
from sightline.operators.html_tree import Page

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("subtree_end", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("has_text", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("markup", T.StringType()),
    T.StructField("outer_len", T.IntegerType()),
])
PIECES = [T.StructField("lead", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("at", T.IntegerType())]

BATCH_CHARS = 1_000_000
SMALL_INPUT_BYTES = 1 << 30
SPLIT_BYTES = 1 << 16


class _Batch:
    """Column buffers for the element lists of a run of pages."""

    def __init__(self, markup: bool, pieces: bool):
        self.markup, self.pieces = markup, pieces
        self.pages = 0
        self.chars = 0
        self.offsets = [0]
        self.cols: dict[str, list] = {name: [] for name in NODE.names}
        self.cols |= {"lead": [], "tail": [], "at": []}
        self.attr_offsets, self.keys, self.values = [0], [], []
        self.errors: list[str | None] = []
        self.prologs: list[str | None] = []

    def add(self, html: str | None) -> None:
        self.pages += 1
        self.chars += len(html or "")
        try:
            page = Page(html or "")
        except Exception as problem:  # one unreadable page must not stop the scan
            page = Page("")
            self.errors.append(f"{type(problem).__name__}: {problem}")
        else:
            lost = page.left_out
            self.errors.append(f"the page ends inside a tag; its last {lost} characters are left out" if lost else None)
        count = len(page.tag)
        cols = self.cols
        cols["node_id"].extend(range(count))
        cols["parent_id"].extend(page.parent)
        cols["depth"].extend(page.depth)
        cols["subtree_end"].extend(page.end)
        cols["tag"].extend(page.tag)
        cols["outer_len"].extend(map(page.outer_len, range(count)))
        cols["has_text"].extend(map(page.has_text, range(count)))
        cols["text"].extend(map(page.text, range(count)))
        if self.markup:
            cols["markup"].extend(page.markup(i, vocab.CONTEXT_CHARS) for i in range(count))
        else:
            cols["markup"].extend([None] * count)
        for attrs in page.attrs:
            self.keys.extend(attrs)
            self.values.extend(attrs.values())
            self.attr_offsets.append(len(self.keys))
        if self.pieces:
            for i in range(count):
                lead, tail = page.pieces(i)
                cols["lead"].append(lead)
                cols["tail"].append(tail)
            cols["at"].extend(map(page.start, range(count)))
            self.prologs.append(page.prolog())
        self.offsets.append(self.offsets[-1] + count)

    def columns(self) -> dict[str, pa.Array]:
        ints, text = pa.int32(), pa.string()
        fields = {
            "node_id": pa.array(self.cols["node_id"], ints),
            "parent_id": pa.array(self.cols["parent_id"], ints),
            "depth": pa.array(self.cols["depth"], ints),
            "subtree_end": pa.array(self.cols["subtree_end"], ints),
            "tag": pa.array(self.cols["tag"], text),
            "attrs": pa.MapArray.from_arrays(
                pa.array(self.attr_offsets, ints), pa.array(self.keys, text), pa.array(self.values, text)
            ),
            "has_text": pa.array(self.cols["has_text"], pa.bool_()),
            "text": pa.array(self.cols["text"], text),
            "markup": pa.array(self.cols["markup"], text),
            "outer_len": pa.array(self.cols["outer_len"], ints),
        }
        if self.pieces:
            fields["lead"] = pa.array(self.cols["lead"], text)
            fields["tail"] = pa.array(self.cols["tail"], text)
            fields["at"] = pa.array(self.cols["at"], ints)
        nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        out = {
            "dom": pa.ListArray.from_arrays(pa.array(self.offsets, ints), nodes),
            "parse_error": pa.array(self.errors, text),
        }
        if self.pieces:
            out["prolog"] = pa.array(self.prologs, text)
        return out


def widened(df: DataFrame) -> DataFrame:
    """Spread a small input, which may sit in a single split, over the cores.

    Decided on the optimizer's size estimate, without running anything. Inputs of a gigabyte and more
    have splits enough and stay where they lie, so at scale no markup is ever shuffled for this.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(df.sparkSession.sparkContext.defaultParallelism, size // SPLIT_BYTES)
    return df.repartition(parts) if size < SMALL_INPUT_BYTES and parts > 1 else df


def parsed_batches(
    batches: Iterator[pa.RecordBatch], names: list[str], markup: bool, pieces: bool
) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` and the element lists of a task's pages, about ``BATCH_CHARS`` of markup at a time.

    Elements take many times the memory of their markup, so a task holds no more of them than those of one run.
    """
    for batch in batches:
        source = batch.column(batch.schema.get_field_index("html"))
        first = 0
        while first < batch.num_rows:
            work = _Batch(markup, pieces)
            while first + work.pages < batch.num_rows and work.chars < BATCH_CHARS:
                work.add(source[first + work.pages].as_py())
            part = batch.slice(first, work.pages)
            columns = {name: part.column(part.schema.get_field_index(name)) for name in names}
            parsed = pa.RecordBatch.from_pydict(columns | work.columns())
            first += work.pages
            del work, part, columns
            yield parsed
            del parsed
        del batch, source  # before the next one is read


def with_dom(pages: DataFrame, *, markup: bool = True, pieces: bool = False) -> DataFrame:
    """Replace ``html`` by ``dom``, the list of the page's elements in document order.

    All other columns are kept. ``markup=False`` leaves out the quoted markup for jobs that only
    count. ``pieces=True`` adds what is needed to write the page back: per element its start tag
    (``lead``), what follows it (``tail``) and where it begins (``at``), and per page a ``prolog``. A page that cannot be
    read keeps its row, with an empty list and a ``parse_error``.
    """
    kept = [field for field in pages.schema.fields if field.name != "html"]
    node = T.StructType(NODE.fields + PIECES) if pieces else NODE
    added = [T.StructField("dom", T.ArrayType(node)), T.StructField("parse_error", T.StringType())]
    if pieces:
        added.append(T.StructField("prolog", T.StringType()))
    names = [field.name for field in kept]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed_batches(batches, names, markup, pieces)

    return widened(pages).mapInArrow(parse, T.StructType(kept + added))


def elements(doms: DataFrame) -> DataFrame:
    """One row per element; takes the output of ``with_dom`` or raw pages."""
    if "dom" not in doms.columns:
        doms = with_dom(doms)
    keys = [name for name in doms.columns if name not in ("dom", "parse_error", "prolog")]
    return doms.select(*keys, F.explode("dom").alias("node")).select(*keys, "node.*")
