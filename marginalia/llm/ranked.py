"""Ranked lexical search on K2-treaps over the term-document grid.

Documents are dealt to tiles of at most ``DOCS`` documents and about ``POSTINGS``
postings.  A tile is a grid of its terms (rows, sorted by hash) and documents
(columns) and becomes one compressed quadtree: cells of a level halve rows and
columns, rows ``LEAD`` levels ahead, down to one row by ``LEAF`` columns.  Every cell
that holds postings keeps the largest impact in it, rounded up and stored as the
difference to the cell above; a cell with a single posting has no cells below, its posting is the
leaf.

Search.  The rows of an item's terms descend jointly: a state is a range of
documents with the cells of all rows over it, its bound the sum of weight times
maximum.  States leave the frontier best first; a range of one leaf is scored
from its postings; the search of a tile ends when no bound reaches the k-th score.
That score starts from what other tiles prove: k tiles hold k different documents,
so the k-th largest of one row's maxima over the tiles is a lower bound.

Distribution.  One pass counts terms and documents, one builds the tiles, which
are stored once with the terms, document frequencies and maxima of their rows as
columns of their own.  Packs of items meet tiles as keyed rows; a task holds one
pack and the tiles of one key, and each tile returns at most k rows per item.

Defined results.  A null text has no terms; documents without terms are not
counted and never ranked.  Repeated rows are documents of their own.  A document
without an id can be ranked, with a null id, after equal scores with one.  Rows
that share an item id are one item.  An item without terms found gives no rows.
Texts of any length are read whole.  Terms are compared by 64-bit hashes.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import U64, mix, stage

DOCS_BITS = 12
DOCS = 1 << DOCS_BITS  # columns of a tile at most
POSTINGS = 1 << 20  # of a tile, passed by its last document only
LEAD = 5  # levels by which rows are split ahead of columns
LEAF = 6  # a leaf cell spans 2^LEAF columns
CHUNK = 1 << 20  # bytes of text that are cut into terms at once
PACK = 256  # items of a pack, about
FRONTIER = 32  # states that leave the frontier together
NO_ID = np.iinfo(np.int64).max
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # for readers and tests; the code below works on bytes
IMPACT = 1_000_000_000
STEP = 16  # of stored maxima

# Bytes of terms: 0-9, A-Z as a-z, a-z, and all bytes of other characters; 0 elsewhere.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58], _FOLD[65:91], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_SPREAD = mix(np.arange(1, 257, dtype=U64))
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, U64))


def term_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every term in UTF-8 bytes."""
    global _POWERS
    a = _FOLD[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([0], (a > 0).view(np.int8), [0])))
    start, length = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, U64), start
    length = length - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    if (most := int(length.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * most, 0xD6E8FEB86659FD93, U64))
    return mix(np.add.reduceat(_SPREAD[a[a > 0]] * _POWERS[within], first) + length.astype(U64)), start


def _pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """UTF-8 bytes of about ``CHUNK``, with the index of a text and the byte at which it starts.

    Texts are joined by a byte that no term holds; a longer text is cut at such a byte.
    """
    data, at, where, size = [], [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        low = 0
        while low < len(raw):
            high = low + CHUNK
            while high < len(raw) and _FOLD[raw[high]]:
                high += 1
            data.append(raw[low:high])
            at.append(i)
            where.append(size)
            size += len(data[-1]) + 1
            low = high
            if size >= CHUNK:
                yield b"\x00".join(data), np.array(at), np.array(where)
                data, at, where, size = [], [], [], 0
    if data:
        yield b"\x00".join(data), np.array(at), np.array(where)


def postings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc, term, tf`` of every posting, by document and term, and the terms of each document with repeats."""
    found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    size = np.zeros(len(texts), np.int64)
    for data, at, where in _pieces(texts):
        term, start = term_hashes(data)
        doc = at[np.searchsorted(where, start, "right") - 1]
        found.append(_count(doc, term, np.ones(len(term), np.int64)))
        size += np.bincount(doc, minlength=len(texts))
    doc, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    # Only a text that was cut has a term twice.
    return *_count(doc, term, tf), size


def _count(doc: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(doc):
        return doc, term, n
    order = np.lexsort((term, doc))
    doc, term, n = doc[order], term[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))))
    return doc[first], term[first], np.add.reduceat(n, first)


class Shape:
    """How the levels of a tile split ``2^rows`` rows and ``2^columns`` columns into cells.

    Rows are single ``LEAD`` levels before columns reach the leaf, so that bounds of
    wide ranges of documents already speak about few rows.
    """

    def __init__(self, rows: int, columns: int):
        self.columns = max(columns, LEAF)
        steps = self.columns - LEAF
        self.depth = max(steps, rows + min(LEAD, steps)) if rows else steps
        lead = min(LEAD, steps)
        self.row_shift = np.array([max(0, min(rows, self.depth - lead - i)) for i in range(self.depth + 1)])
        self.col_shift = np.array([LEAF + min(steps, self.depth - i) for i in range(self.depth + 1)])
        # The path of a cell: at every level the row's next bit, then the column's.
        self.row_bits: list[tuple[int, int]] = []
        self.col_bits: list[tuple[int, int]] = []
        self.below = np.zeros(self.depth + 1, np.int64)  # path bits below a level
        at = 0
        for i in range(self.depth, 0, -1):
            self.below[i] = at
            if self.col_shift[i - 1] > self.col_shift[i]:
                self.col_bits.append((int(self.col_shift[i]), at))
                at += 1
            if self.row_shift[i - 1] > self.row_shift[i]:
                self.row_bits.append((int(self.row_shift[i]), at))
                at += 1
        self.below[0] = at

    @staticmethod
    def _path(x: np.ndarray, bits: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for source, to in bits:
            out |= ((x >> source) & 1) << to
        return out

    def column(self, path: np.ndarray) -> np.ndarray:
        """First column of the leaf at the end of whole paths."""
        out = np.zeros(len(path), np.int64)
        for source, to in self.col_bits:
            out |= ((path >> to) & 1) << source
        return out

    def row_path(self, row: np.ndarray) -> np.ndarray:
        return self._path(row, self.row_bits)

    def col_path(self, column: np.ndarray) -> np.ndarray:
        return self._path(column, self.col_bits)


def _bits(n: int) -> int:
    return max(0, int(n - 1).bit_length())


class Treap:
    """The compressed quadtree of a tile, with maxima; built once, searched from its stored arrays.

    Postings are in the order of their paths.  ``cells`` has, from the last level
    that spans all columns down, the prefixes of cells with several postings and
    the maxima in steps of ``STEP``, rounded up, so that they are bounds.
    """

    def __init__(self, n_rows: int, n_cols: int, path: np.ndarray, column: np.ndarray, tf: np.ndarray, m: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]] | None):
        self.shape = Shape(_bits(n_rows), _bits(n_cols))
        self.path, self.column, self.tf, self.m = path, column, tf, m
        self.impact = impact_of(tf, m[column])
        self.start = int(np.flatnonzero(self.shape.col_shift == self.shape.col_shift[0])[-1])
        self.cells = self._cells() if cells is None else cells

    @classmethod
    def build(cls, row: np.ndarray, column: np.ndarray, tf: np.ndarray, m: np.ndarray, n_rows: int) -> Treap:
        shape = Shape(_bits(n_rows), _bits(len(m)))
        path = shape.row_path(row) | shape.col_path(column)
        order = np.lexsort((column, path))
        return cls(n_rows, len(m), path[order], column[order], tf[order], m, None)

    def _cells(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cells = []
        for below in self.shape.below[self.start :]:
            prefix = self.path >> below
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            many = np.diff(np.append(first, len(prefix))) > 1
            cells.append((prefix[first[many]], -(-np.maximum.reduceat(self.impact, first)[many] // STEP)))
        return cells

    def pack(self) -> bytes:
        """Stored form: numbers as differences, maxima as differences to the cell above, byte by byte compressed."""
        parts = [np.diff(self.path, prepend=0), self.column & ((1 << LEAF) - 1), self.tf, self.m]
        for i, (prefix, top) in enumerate(self.cells):
            parts += [np.diff(prefix, prepend=0), self._above(i, prefix) - top if i else top]
        codec = zstandard.ZstdCompressor(level=3)
        planes = [codec.compress(_planes(x)) for x in parts]
        head = np.array([len(planes), *(len(x) for x in planes)], np.int64)
        return head.tobytes() + b"".join(planes)

    def _above(self, i: int, prefix: np.ndarray) -> np.ndarray:
        """Maxima of the cells above cells of level ``i``."""
        keys, tops = self.cells[i - 1]
        below = self.shape.below
        return tops[np.searchsorted(keys, prefix >> (below[self.start + i - 1] - below[self.start + i]))]

    @classmethod
    def unpack(cls, n_rows: int, n_cols: int, data: bytes) -> Treap:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        ends = 8 + 8 * n + np.cumsum(sizes)
        codec = zstandard.ZstdDecompressor()
        raw = [_numbers(codec.decompress(data[e - s : e])) for s, e in zip(sizes, ends, strict=True)]
        path, shape = np.cumsum(raw[0]), Shape(_bits(n_rows), _bits(n_cols))
        tree = cls(n_rows, n_cols, path, shape.column(path) | raw[1], raw[2], raw[3], [])
        for i, at in enumerate(range(4, n, 2)):
            prefix, top = np.cumsum(raw[at]), raw[at + 1]
            tree.cells.append((prefix, tree._above(i, prefix) - top if i else top))
        return tree

    def maxima(self, level: int, row_path: np.ndarray, first_column: np.ndarray) -> np.ndarray:
        """Bound of the impacts in the cell of each row (across) and range of documents (down) at ``level``; 0 if empty."""
        below = self.shape.below[level]
        prefix = (row_path[None, :] | self.shape.col_path(first_column)[:, None]) >> below
        keys, tops = self.cells[level - self.start]
        out = np.zeros(prefix.shape, np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, prefix), len(keys) - 1)
            many = keys[at] == prefix
            out[many] = tops[at[many]] * STEP
        else:
            many = np.zeros(prefix.shape, bool)
        lone = np.flatnonzero(~many.ravel())
        if len(lone):
            low = prefix.ravel()[lone] << below
            at = np.minimum(np.searchsorted(self.path, low), len(self.path) - 1)
            hit = (self.path[at] >> below) == prefix.ravel()[lone]
            out.ravel()[lone[hit]] = self.impact[at[hit]]
        return out

    def leaf_scores(self, row_path: np.ndarray, weight: np.ndarray, first_column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and whole scores of the documents in leaf ranges."""
        path = (row_path[None, :] | self.shape.col_path(first_column)[:, None]).ravel()
        low, high = np.searchsorted(self.path, path), np.searchsorted(self.path, path, "right")
        n = high - low
        full = np.flatnonzero(n)
        n, low = n[full], low[full]
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        column, gain = self.column[at], self.impact[at] * np.repeat(weight[full % len(weight)], n)
        columns, inverse = np.unique(column, return_inverse=True)
        score = np.zeros(len(columns), np.int64)
        np.add.at(score, inverse, gain)
        return columns, score

    def search(self, row: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best ``k`` documents of at least ``floor``, ties to smaller ids, and the states scored."""
        shape, rows = self.shape, self.shape.row_path(row)
        shift, start = shape.col_shift, self.start
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, column = np.array([start]), np.zeros(1, np.int64)
        bound = self.maxima(start, rows, column) @ weight
        scored = 0
        while True:
            least = max(floor, int(best[-1]) if len(best) == k else 1)
            # An equal bound may still win by a smaller id.
            live = np.flatnonzero(bound >= least)
            if not len(live):
                return best_id, best, scored
            live = live[np.argsort(-bound[live], kind="stable")]
            out, stay = live[:FRONTIER], live[FRONTIER:]
            here, at = level[out], column[out]
            level, column, bound = level[stay], column[stay], bound[stay]
            leaf = here == shape.depth
            if leaf.any():
                scored += int(leaf.sum())
                found, score = self.leaf_scores(rows, weight, at[leaf])
                keep = score >= least
                found_id, score = np.concatenate((best_id, ids[found[keep]])), np.concatenate((best, score[keep]))
                order = np.lexsort((found_id, -score))[:k]
                best_id, best = found_id[order], score[order]
            for lv in np.unique(here[~leaf]):
                down = at[here == lv]
                down = np.concatenate((down, down + (1 << int(shift[lv + 1])))) if shift[lv + 1] < shift[lv] else down
                level = np.append(level, np.full(len(down), lv + 1))
                column = np.append(column, down)
                bound = np.append(bound, self.maxima(int(lv) + 1, rows, down) @ weight)


def impact_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturated frequency of a term in a document of relative length ``m``."""
    return (IMPACT * tf) // (1000 * tf + 8 * m)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 byte by byte, all lowest bytes first, led by the width."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel().astype(np.int64, copy=False)


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            offset = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            inside = _FOLD[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]] > 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            # Every text begins anew.
            first = np.unique(offset[:-1][offset[1:] > offset[:-1]]) - offset[0]
            begins[first] = inside[first]
            if len(first):
                each = np.add.reduceat(begins, first, dtype=np.int64)
                n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select(F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _named(c: str) -> Column:
    """Null ids travel as the largest number."""
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))


TILE = "tile string, n_docs int, n_terms int, n_postings long, terms array<bigint>, dfs array<int>, tops array<int>, ids binary, tree binary"


def build_tiles(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The K2-treaps of all documents, one row per tile."""
    per = 90 * n_docs

    def tile(ids: list, parts: list) -> pd.DataFrame:
        doc, term, tf, size = parts
        m = 10 + per * size // max(1, n_terms)
        terms, row = np.unique(term, return_inverse=True)
        top = np.zeros(len(terms), np.int64)
        np.maximum.at(top, row, impact_of(tf, m[doc]))
        tree = Treap.build(row, doc, tf, m, len(terms))
        name = f"{ids[0]}-{ids[-1]}-{len(ids)}-{int(np.bitwise_xor.reduce(mix(term + size[doc].astype(U64)))):x}"
        return pd.DataFrame({"tile": [name], "n_docs": [len(ids)], "n_terms": [len(terms)], "n_postings": [len(row)], "terms": [terms.view(np.int64)],
                             "dfs": [np.bincount(row).astype(np.int32)], "tops": [top.astype(np.int32)], "ids": [np.array(ids, np.int64).tobytes()], "tree": [tree.pack()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        parts: list = []
        total = 0

        def flush() -> pd.DataFrame:
            shift = np.cumsum([0, *(len(p[3]) for p in parts)])
            return tile(ids, [np.concatenate([p[0] + s for p, s in zip(parts, shift, strict=False)]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))])

        for pdf in frames:
            names = pdf["id"].to_numpy(np.int64)
            texts = pdf["text"].tolist()
            for low in range(0, len(texts), 256):
                doc, term, tf, size = postings(texts[low : low + 256])
                # Documents without terms are no columns.
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                column = np.cumsum(size > 0) - 1
                if total and (total + len(doc) > POSTINGS or len(ids) + len(full) > DOCS):
                    yield flush()
                    ids, parts, total = [], [], 0
                ids += names[low : low + 256][full].tolist()
                parts.append((column[doc], term, tf, size[full]))
                total += len(doc)
        if total:
            yield flush()

    return docs.select(_named(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, TILE)


def item_terms(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of every item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            doc, term, _, _ = postings(pdf["text"].tolist())
            yield pd.DataFrame({"item_id": pdf["id"].to_numpy(np.int64)[doc], "term": term.view(np.int64)})

    return items.select(_named(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, "item_id long, term long").distinct()


def weighted_items(tiles: DataFrame, asked: DataFrame, n_docs: int, k: int) -> DataFrame:
    """``item_id, term, weight, floor``: weights from document frequencies, and a proven lower bound of the k-th score."""
    rows = tiles.select("tile", F.explode(F.arrays_zip("terms", "dfs", "tops")).alias("r")).select(F.col("r.terms").alias("term"), F.col("r.dfs").alias("df"), F.col("r.tops").alias("top"))
    wanted = asked.select("term").distinct()
    kept = stage(rows.join(wanted, "term", "left_semi"), "asked-rows")
    df = kept.groupBy("term").agg(F.sum("df").alias("df"))
    best = Window.partitionBy("term").orderBy(F.desc("top"))
    kth = kept.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).groupBy("term").agg(F.max("at").alias("at"), F.min("top").alias("top"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    per = asked.join(df, "term").join(kth.select("term", F.when(F.col("at") == k, F.col("top")).otherwise(0).alias("kth")), "term").withColumn("weight", weight)
    floors = per.groupBy("item_id").agg(F.max(F.col("weight") * F.col("kth")).alias("floor"))
    return per.join(floors, "item_id").select("item_id", "term", "weight", "floor").filter("weight > 0")


def _packs(weighted: DataFrame, n: int) -> DataFrame:
    """Items as rows ``pack, item_id, floor, terms, weights``."""
    return (weighted.groupBy("item_id", "floor").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
            .select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("pack"), "item_id", "floor", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))


def _search(k: int):
    def run(items: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"item_id": [], "doc_id": [], "score": []}, dtype="int64")]
        for t in tiles.itertuples(index=False) if len(items) else ():
            tree, ids, terms = Treap.unpack(t.n_terms, t.n_docs, t.tree), np.frombuffer(t.ids, np.int64), np.asarray(t.terms).view(U64)
            for item in items.itertuples(index=False):
                term = np.asarray(item.terms).view(U64)
                row = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                here = terms[row] == term
                if not here.any():
                    continue
                doc, score, _ = tree.search(row[here], np.asarray(item.weights)[here], ids, k, int(item.floor))
                if len(doc):
                    found.append(pd.DataFrame({"item_id": item.item_id, "doc_id": doc, "score": score}))
        return pd.concat(found, ignore_index=True)

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    n_docs, n_terms = statistics(docs)
    tiles = stage(build_tiles(docs, n_docs, n_terms), "tiles")
    return search(tiles, items, n_docs, k)


def search(tiles: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item from stored tiles."""
    asked = stage(item_terms(items), "asked-terms")
    n_items = asked.select("item_id").distinct().count()
    packs, sides = -(-n_items // PACK) or 1, max(1, tiles.count())
    left = (stage(_packs(weighted_items(tiles, asked, n_docs, k), packs), "item-packs")
            .withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))))
    right = (tiles.select(F.pmod(F.xxhash64("tile"), F.lit(sides)).cast("int").alias("side"), "n_docs", "n_terms", "terms", "ids", "tree")
             .withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))))
    found = left.groupBy("pack", "side").cogroup(right.groupBy("pack", "side")).applyInPandas(_search(k), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(known("item_id"), "rank", known("doc_id"), "score")
