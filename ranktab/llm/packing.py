"""Best-fit packing of token pieces into sequences, certified by dual-feasible bounds.

Pieces are dealt to groups of a bounded number of pieces. Each group is packed by best-fit decreasing
and compared with a lower bound from dual-feasible functions, which certifies its number of bins or
shows a gap. Bins that stay short of the capacity give their pieces back; these are dealt anew to
fewer groups, where pieces of different groups meet, and packed again. The rounds end when the bound
of the whole input certifies the number of sequences, or when another round can't help.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import sliced
from ranktab.llm.tokens import word_encoder
from ranktab.sources.staging import stage

CAPACITY = 4096
GROUP = 16_384  # pieces that one group packs together
SLACK = 64  # a bin is closed when at most this much stays empty


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, from how many pieces have each length (0 to capacity).

    The largest value of ``ceil(sum f(length))`` over two families of dual-feasible functions: one
    drops lengths below a threshold and rounds those above its complement up to a whole bin (the
    threshold 0 is the plain sum), the other is the staircase ``floor((k + 1) x) / k``.
    """
    sizes, counts = np.arange(len(counts), dtype=object), counts.astype(object)
    if not counts.sum():
        return 0
    used = np.flatnonzero(counts)
    sizes, counts = sizes[used], counts[used]
    best = 1
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    number = np.concatenate([[0], np.cumsum(counts)])
    plain = used.astype(np.int64)
    for least in {0, *(int(s) for s in used if 0 < 2 * s <= capacity)}:
        a, b = np.searchsorted(plain, [least, capacity - least + 1])
        total = mass[b] - mass[a] + (number[-1] - number[b]) * capacity
        best = max(best, -(-total // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        steps = [s * k if v % capacity == 0 else v // capacity * capacity for s, v in zip(sizes, scaled)]
        total = sum(s * c for s, c in zip(steps, counts))
        best = max(best, -(-total // (capacity * k)))
    return int(best)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and what each bin holds.

    Pieces go, longest first (equal lengths in the given order), to the bin with the least room that
    is enough. Bins are kept by their room; one bit per room tells which rooms exist.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, place = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = place, filled[place]
        filled[place] += size
        if not by_room[room - size]:
            rooms |= 1 << (room - size)
        by_room[room - size].append(place)
    return bins, offsets, np.array(filled, np.int64)


def _layout(keep: list[str], length: str, capacity: int, slack: int, turn: int):
    """The function that packs one group of a round."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column(length).cast(pa.int64()).to_numpy()
        bins, offsets, filled = best_fit_decreasing(values, capacity)
        certified = len(filled) == lower_bound(np.bincount(values, minlength=capacity + 1), capacity)
        ids = (turn << 56) + (key[0].as_py() << 20) + bins
        table = table.select(keep)
        table = table.append_column("sequence_id", pa.array(ids, pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("certified", pa.array(np.full(len(ids), certified)))
        return table.append_column("_pack_open", pa.array(filled[bins] < capacity - slack))

    return packed


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK, max_rounds: int = 8) -> DataFrame:
    """Give every row of ``pieces`` a ``sequence_id`` and a gapless ``offset`` in it.

    ``pieces`` must be a table that gives the same rows when read again (a staged one), without the
    columns ``sequence_id``, ``offset``, ``certified`` and those starting with ``_pack``; all its
    columns are kept. A null length raises, as does one beyond the capacity. ``certified`` tells
    whether the row's group reached its own lower bound. Equal lengths and repeated rows are packed
    like any others; an empty table gives an empty one. ``max_rounds`` bounds the exchanges only: all
    rows are packed whatever it is.
    """
    keep = pieces.columns
    schema = T.StructType(
        [*pieces.schema.fields]
        + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
        + [T.StructField("certified", T.BooleanType()), T.StructField("_pack_open", T.BooleanType())]
    )
    counted = pieces.groupBy(F.col(length).cast("long").alias("n")).count().collect()  # a row per length
    if any(r["n"] is None or not 0 <= r["n"] <= capacity for r in counted):
        raise ValueError(f"lengths must be from 0 to {capacity}")
    lengths = np.zeros(capacity + 1, np.int64)
    for r in counted:
        lengths[r["n"]] = r["count"]
    bound, rows = lower_bound(lengths, capacity), int(lengths.sum())
    closed: list[DataFrame] = []
    settled, before, current = 0, None, pieces
    for turn in range(max_rounds):
        groups = max(1, -(-rows // group))

        # Dealt by content and a round's own seed: a task that runs again deals alike.
        dealt = current.withColumn("_pack_group", F.pmod(F.xxhash64(F.lit(turn), *keep), F.lit(groups)))
        result = stage(dealt.groupBy("_pack_group").applyInArrow(_layout(keep, length, capacity, slack, turn), schema))
        counts = {
            r["_pack_open"]: r
            for r in result.groupBy("_pack_open").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("offset") == 0).cast("long")).alias("bins")).collect()
        }
        opened = counts[True] if True in counts else None
        total = settled + sum(r["bins"] for r in counts.values())
        final = opened is None or groups == 1 or total <= bound or (before is not None and total >= before) or turn == max_rounds - 1
        closed.append(result if final else result.where(~F.col("_pack_open")))
        if final:
            break
        settled += counts[False]["bins"] if False in counts else 0
        before, rows = total, opened["rows"]
        current = result.where("_pack_open").select(*keep)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("_pack_open")


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text with ``end_id`` after them, cut into pieces of at most ``capacity``.

    One row per piece: ``doc_id`` (as given, null too), ``piece`` from 0, ``start``, ``length`` and
    ``ids``. A null text counts as empty and gives one piece that holds ``end_id`` alone. Repeated rows give repeated
    pieces; an empty table gives none; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                ids, bounds = encoder.encode(texts)
                ids = np.insert(ids, bounds[1:], end_id)  # an end after each text
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), bounds[row] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
                offsets = np.concatenate([at, [len(ids)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                    ],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """Tokenize, cut and pack all documents; ``with_ids`` keeps the ids of each piece."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity)
    return pack(stage(pieces if with_ids else pieces.drop("ids")), capacity=capacity, **options)
