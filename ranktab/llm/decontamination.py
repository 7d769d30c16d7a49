"""Benchmark passages in training documents, found with a stored positional inverted index.

The index is cut by documents: each shard holds, for every indexed term, where it stands in the
shard's documents. A benchmark window is looked up in each shard from its rarest term there: that
term's positions, moved back by its offset in the window, are candidate starts, and the other terms
cut them down in order of rarity. The shards never meet, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import content, ragged, sliced, texts_of, word_spans, words
from ranktab.llm.tokens import LOWER
from ranktab.sources.staging import stage

WINDOW = 10
BLOCK_BYTES = 4 << 20  # benchmark text whose windows are sent to the workers at a time
CANDIDATES = 1 << 20  # candidate starts that are looked at together
WORD = np.ones(256, bool)
WORD[:128] = False
WORD[[*range(48, 58), *range(97, 123)]] = True

SHARD = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType(), False)),
        T.StructField("terms", T.ArrayType(T.BinaryType(), False)),
        T.StructField("counts", T.ArrayType(T.IntegerType(), False)),
        T.StructField("gaps", T.ArrayType(T.IntegerType(), False)),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


def term_codes(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has."""
    data, offsets = content(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    return words(data, starts, ends, WORD), np.diff(first)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(docs: DataFrame, terms: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``docs``, one row per shard (about 8 MB of text); stage it to keep it.

    Positions count words over a shard, with one empty place after each document, so that no match
    crosses documents. Each term's positions are stored as gaps. ``terms`` (a broadcast Arrow array)
    leaves out postings of other terms; without it every term is indexed. Texts are whole; null is empty.
    ``doc_id`` must be an integer column; null ids stay null.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                coded, n = term_codes(texts)
                code = coded.indices.to_numpy()
                place = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
                if terms is not None:
                    wanted = pc.is_in(coded.dictionary, value_set=terms.value).to_numpy(zero_copy_only=False)
                    kept = wanted[code] if len(code) else np.zeros(0, bool)
                    code, place = code[kept], place[kept]
                order = np.argsort(code, kind="stable")
                code, place = code[order], place[order]
                used, first, counts = np.unique(code, return_index=True, return_counts=True)
                gaps = np.diff(place, prepend=0)
                gaps[first] = place[first]
                arrays = [
                    pa.array([(part << 32) + number], pa.int64()),
                    _one_list(rows.column(0)),
                    _one_list(pa.array(n, pa.int32())),
                    _one_list(coded.dictionary.take(pa.array(used)).cast(pa.binary())),
                    _one_list(pa.array(counts, pa.int32())),
                    _one_list(pa.array(gaps, pa.int32())),
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(arrays, names=SHARD.names)

    return source.mapInArrow(run, SHARD)


@dataclass
class Windows:
    """Distinct windows of a block of items: terms by number (-1 beyond the end) and their items."""

    terms: pa.Array
    rows: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    item_numbers: np.ndarray
    item_ids: list[str]


def windows_of(texts: pa.Array, item_ids: list[str], size: int) -> Windows:
    """All windows of ``size`` words of each text; a shorter text is one window, one without words none."""
    coded, n = term_codes(texts)
    code, first = coded.indices.to_numpy().astype(np.int64), np.cumsum(n) - n
    each = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(n)), each)
    start = ragged(first, each)
    length = np.minimum(size, n[item])
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < length[:, None]
    rows = np.where(inside, code[np.minimum(at, max(len(code) - 1, 0))], -1) if len(code) else np.zeros((0, size), np.int64)
    distinct, which = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Windows(coded.dictionary.cast(pa.binary()), distinct, (distinct >= 0).sum(axis=1), bounds, pairs[:, 1], item_ids)


class Shard:
    """One shard's postings by the numbers of a block's terms."""

    def __init__(self, row: dict, terms: pa.Array):
        own, counts = row["terms"], row["counts"]
        self.n_words = row["n_words"]
        self.doc_first = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.size = int((self.n_words + 1).sum())
        found = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy(zero_copy_only=False)
        first = np.cumsum(counts) - counts
        places = np.cumsum(row["gaps"].astype(np.int64))
        if len(places):
            before = np.zeros(len(counts), np.int64)
            before[1:] = places[first[1:] - 1]
            places -= np.repeat(before, counts)
        self.places = places
        self.count, self.first = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        known = found >= 0
        self.count[found[known]], self.first[found[known]] = counts[known], first[known]
        self.term_at = np.full(self.size + WINDOW + 1, -1, np.int64)
        self.term_at[places] = np.repeat(found, counts)

    def anchors(self, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For windows whose terms all occur: their numbers, columns from the rarest term on, and
        the places of the rarest, in bounded portions."""
        none = windows.rows < 0
        counts = np.where(none, np.iinfo(np.int64).max, self.count[np.where(none, 0, windows.rows)])
        live = np.flatnonzero(counts.min(axis=1) > 0) if len(counts) else np.zeros(0, np.int64)
        order = np.argsort(counts[live], axis=1, kind="stable")
        rarest = windows.rows[live, order[:, 0]]
        n = self.count[rarest]
        portions = np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1)
        for some in portions:
            if len(some):
                yield np.repeat(live[some], n[some]), np.repeat(order[some], n[some], axis=0), self.places[ragged(self.first[rarest[some]], n[some])]

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur word for word, and the places where they start."""
        numbers, starts = [], []
        width = windows.rows.shape[1]
        for window, order, place in self.anchors(windows):
            start = place - order[:, 0]
            kept = start >= 0
            window, order, start = window[kept], order[kept], start[kept]
            for j in range(1, width):
                column = order[:, j]
                term = windows.rows[window, column]
                kept = (term < 0) | (self.term_at[np.minimum(start + column, self.size)] == term)
                window, order, start = window[kept], order[kept], start[kept]
            numbers.append(window)
            starts.append(start)
        return (np.concatenate(numbers), np.concatenate(starts)) if numbers else (np.zeros(0, np.int64),) * 2

    def close(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms stand at most ``slop`` places from one of the rarest, within its
        document, in any order; and the documents' numbers."""
        numbers, docs = [], []
        for window, order, place in self.anchors(windows):
            doc = np.searchsorted(self.doc_first, place, side="right") - 1
            low = np.maximum(place - slop, self.doc_first[doc])
            high = np.minimum(place + slop, self.doc_first[doc] + self.n_words[doc] - 1)
            kept = np.ones(len(window), bool)
            for j in range(1, windows.rows.shape[1]):
                term = windows.rows[window, order[:, j]]
                for t in np.unique(term[kept & (term >= 0)]).tolist():
                    here = np.flatnonzero(kept & (term == t))
                    own = self.places[self.first[t] : self.first[t] + self.count[t]]
                    at = np.searchsorted(own, low[here])
                    kept[here] = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= high[here])
            numbers.append(window[kept])
            docs.append(doc[kept])
        return (np.concatenate(numbers), np.concatenate(docs)) if numbers else (np.zeros(0, np.int64),) * 2

    def items(self, windows: Windows, window: np.ndarray, doc: np.ndarray) -> list[list[str]]:
        """For each document the ids of the items that own the given windows, sorted as text."""
        pairs = np.unique(np.stack([doc, window], axis=1), axis=0)
        n = np.diff(windows.item_bounds)[pairs[:, 1]]
        item = windows.item_numbers[ragged(windows.item_bounds[pairs[:, 1]], n)]
        pairs = np.unique(np.stack([np.repeat(pairs[:, 0], n), item], axis=1), axis=0)
        out: list[set[str]] = [set() for _ in self.n_words]
        for d, i in pairs.tolist():
            out[d].add(windows.item_ids[i])
        return [sorted(x) for x in out]

    def spans(self, start: np.ndarray, length: np.ndarray) -> list[list[dict]]:
        """For each document the maximal runs of words inside the given occurrences."""
        edges = np.zeros(self.size + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + length, -1)
        hit = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
        opens, closes = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        out: list[list[dict]] = [[] for _ in self.n_words]
        for d, a, b in zip((np.searchsorted(self.doc_first, opens, side="right") - 1).tolist(), opens.tolist(), closes.tolist()):
            out[d].append({"start": a - int(self.doc_first[d]), "stop": b - int(self.doc_first[d])})
        return out


def search(index: DataFrame, windows: Broadcast, slop: int | None = None) -> DataFrame:
    """Occurrences of a block's windows in every shard, one row per document.

    ``spans`` are runs of words inside exact occurrences, ``items`` the items that own them;
    ``near_items`` are items with a window whose terms stand together within ``slop`` (null: not asked for).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = windows.value
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {n: batch.column(k)[i].values for k, n in enumerate(batch.schema.names) if n != "shard"}
                row = {n: v if n in ("ids", "terms") else v.to_numpy() for n, v in lists.items()}
                shard = Shard(row, block.terms)
                window, start = shard.phrases(block)
                doc = np.searchsorted(shard.doc_first, start, side="right") - 1
                near = [None] * len(shard.n_words)
                if slop is not None:
                    near = shard.items(block, *shard.close(block, slop))
                arrays = [
                    pa.array(np.full(len(near), batch.column(0)[i].as_py()), pa.int64()),
                    pa.array(np.arange(len(near)), pa.int32()),
                    row["ids"],
                    pa.array(shard.n_words, pa.int64()),
                    pa.array(shard.spans(start, block.lengths[window]), FOUND_SPANS),
                    pa.array(shard.items(block, window, doc), pa.list_(pa.string())),
                    pa.array(near, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=FOUND.names)

    return index.mapInArrow(run, FOUND)


FOUND_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _joined(parts: list[DataFrame]) -> DataFrame:
    """Results of several blocks as one row per document: spans merged, items united."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    one = every.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    merged = """aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).stop >= x.start,
           concat(slice(done, 1, size(done) - 1),
                  array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, x.stop)))),
           concat(done, array(x))))"""
    return one.withColumn("spans", F.expr(merged))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Which words of each document lie in windows of benchmark items.

    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside exact
    occurrences), ``spans`` of them, ``items`` (ids as text, sorted) and ``near_items`` (with
    ``slop``). The benchmark (``item_id``, ``text``) is handled in blocks of bounded size, so any
    size works; with one block only its terms are indexed, with more all terms are. Null texts
    have no words; a null item id counts as the empty text; items of one id are one item; repeated rows and
    null ``doc_id`` stay; empty tables give no rows or no hits; other columns are not read.
    """
    if window > WINDOW:
        raise ValueError(f"windows have at most {WINDOW} words")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    index, parts = None, []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = windows_of(texts_of(pa.array([r["text"] for r in rows], pa.string())), [r["item_id"] for r in rows], window)
        if index is None:
            index = stage(build_index(docs, spark.sparkContext.broadcast(found.terms) if blocks == 1 else None, id_col, text_col))
        parts.append(search(index, spark.sparkContext.broadcast(found), slop))
    out = parts[0] if blocks == 1 else _joined(parts)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", "near_items")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark.

    Decided row by row, whatever the ids: a row without ``doc_id``, or one that shares its id with a
    hit row, stays when its own text is clean. Rows are told apart by their place in the scan, so
    ``docs`` should be a stored table (a retried task reads it again alike); a column named ``_dc_row`` is replaced.
    """
    tagged = docs.withColumn("_dc_row", F.monotonically_increasing_id())
    hit = contamination(tagged, benchmark, window, id_col="_dc_row").where("n_hit > 0").select(F.col("doc_id").alias("_dc_row"))
    return tagged.join(hit, "_dc_row", "left_anti").drop("_dc_row")
