"""First-in-first-out searches of whole sites, each in one task over numbered links.

A search that goes by levels needs a round of joins for each, and a site of long chains has as many levels as pages. Here a site's
links are integers in one task, under 50 bytes for each link and page, and a search is a queue over them. The plan sends only sites that
fit; the rows of a site come in one run, its pages before its requests.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Kinds of rows, in the order in which they come: a page with the ids it links to, an address that is fetched as another one, and
# a request with the ids it starts from.
PAGE, ALIAS, REQUEST = 0, 1, 2
# Ids of one row, and about as many of one batch that is handed on.
ROW_IDS = 1 << 16


class _Site:
    """Pages, aliases and requests of one run of rows."""

    def __init__(self, name: str | None):
        self.name = name
        self.ids: dict[int, list] = {PAGE: [], ALIAS: [], REQUEST: []}
        self.sizes: dict[int, list] = {PAGE: [], ALIAS: [], REQUEST: []}
        self.found: dict[int, list] = {PAGE: [], ALIAS: [], REQUEST: []}
        self.asked: list[pa.RecordBatch] = []

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        # Copies, since a view would keep the whole batch.
        lists = rows.column("ids")
        self.sizes[kind].append(np.array(lists.value_lengths(), dtype=np.int64))
        self.found[kind].append(np.array(lists.flatten(), dtype=np.int64))
        if kind == REQUEST:
            self.asked.append(rows.select(["request", "max_pages", "copies"]))
        else:
            self.ids[kind].append(np.array(rows.column("id"), dtype=np.int64))

    def joined(self, parts: dict[int, list], kind: int) -> np.ndarray:
        return np.concatenate(parts.pop(kind) or [np.empty(0, np.int64)])


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` are in the sorted ``ids``; -1 for what is not among them."""
    out = np.empty(len(wanted), np.int32)
    for a in range(0, len(wanted), 1 << 20):
        some = wanted[a:a + (1 << 20)]
        at = np.searchsorted(ids, some)
        at[at == len(ids)] = 0
        out[a:a + len(some)] = np.where(ids[at] == some, at, -1) if len(ids) else -1
    return out


def _searched(starts, begin, end, links, nodes: int, room: int | None) -> tuple[array, array]:
    """The queue of a search in visiting order, ``room`` long at most, and where its levels end."""
    seen, queue, ends, at = bytearray(nodes), array("i"), array("i"), 0
    add = queue.append
    for node in starts:
        if not seen[node]:
            seen[node] = 1
            add(node)
    while at < len(queue):
        if room is not None and len(queue) >= room:
            del queue[room:]
            ends.append(len(queue))
            break
        to = len(queue)
        ends.append(to)
        for k in range(at, to):
            node = queue[k]
            for target in links[begin[node]:end[node]]:
                if not seen[target]:
                    seen[target] = 1
                    add(target)
        at = to
    return queue, ends


class _Out:
    """Rows of results, a run of one level of a request each."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.sites, self.asked, self.levels, self.firsts, self.sizes, self.ids = [], [], [], [], [], []
        self.held = 0

    def add(self, site: str, asked: pa.RecordBatch, ids: np.ndarray, ends: array) -> Iterator[pa.RecordBatch]:
        """``asked`` is the request's row. Yields what is full."""
        last = rows = 0
        for level, end in enumerate(ends):
            for first in range(last, end, ROW_IDS):
                size = min(end - first, ROW_IDS)
                self.levels.append(level)
                self.firsts.append(first)
                self.sizes.append(size)
                self.ids.append(ids[first:first + size])
                self.held += size
                rows += 1
                if self.held >= ROW_IDS:
                    self.name(site, asked, rows)
                    yield self.batch()
                    rows = 0
            last = end
        self.name(site, asked, rows)

    def name(self, site: str, asked: pa.RecordBatch, rows: int) -> None:
        self.sites.extend([site] * rows)
        self.asked.append(asked.take(pa.array(np.zeros(rows, np.int64))))

    def batch(self) -> pa.RecordBatch:
        asked = pa.Table.from_batches(self.asked).combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        columns = {
            "site": pa.array(self.sites, pa.string()),
            **{name: asked.column(name).combine_chunks() for name in asked.column_names},
            "level": pa.array(self.levels, pa.int32()),
            "first": pa.array(self.firsts, pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.ids))),
        }
        self.clear()
        return pa.RecordBatch.from_pydict(columns)


def _walk(site: _Site, out: _Out) -> Iterator[pa.RecordBatch]:
    """All searches of one site."""
    starts, links = site.joined(site.found, REQUEST), site.joined(site.found, PAGE)
    nodes = np.unique(np.concatenate([np.unique(links), starts]))
    links = _places(nodes, links)
    # Of every node the page that is fetched for it, by its place among the pages.
    fetched = nodes.copy()
    alias = _places(nodes, site.joined(site.ids, ALIAS))
    known = alias >= 0
    fetched[alias[known]] = site.joined(site.found, ALIAS)[known]
    pages = site.joined(site.ids, PAGE)
    order = np.argsort(pages)
    page = _places(pages[order], fetched)
    ends = np.cumsum(site.joined(site.sizes, PAGE)).astype(np.int32)
    begin, end = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32)
    linked = page >= 0
    page = order[page[linked]]
    end[linked] = ends[page]
    begin[linked] = np.concatenate([[0], ends])[page]
    del fetched, alias, known, pages, order, page, ends, linked
    starts = _places(nodes, starts)
    upto, k = np.cumsum(site.joined(site.sizes, REQUEST)), 0
    for rows in site.asked:
        for n in range(rows.num_rows):
            asked = rows.slice(n, 1)
            limit, copies = asked.column("max_pages")[0].as_py(), asked.column("copies")[0].as_py()
            room = None if limit is None else max(-(-limit // copies), 0)
            own = starts[upto[k - 1] if k else 0:upto[k]]
            queue, levels = _searched(own.tolist(), memoryview(begin), memoryview(end), memoryview(links), len(nodes), room)
            yield from out.add(site.name, asked, nodes[np.frombuffer(queue, np.int32)], levels)
            k += 1


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``site, bucket, kind, id, ids, request, max_pages, copies``, sorted by the first three, to visits in runs: ``site, request,
    max_pages, copies, level``, and the ``ids`` from place ``first`` of the queue on."""
    key, site, out = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        out = out or _Out(batch.schema)
        names, buckets, kinds = batch.column("site"), np.asarray(batch.column("bucket")), np.asarray(batch.column("kind"))
        codes = np.asarray(names.dictionary_encode().indices)
        changes = (np.diff(codes) != 0) | (np.diff(buckets) != 0) | (np.diff(kinds) != 0)
        bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            here = names[a].as_py(), int(buckets[a])
            if here != key:
                if site:
                    yield from _walk(site, out)
                key, site = here, _Site(here[0])
            site.add(int(kinds[a]), batch.slice(a, b - a))
    if site:
        yield from _walk(site, out)
    if out and out.held:
        yield out.batch()
