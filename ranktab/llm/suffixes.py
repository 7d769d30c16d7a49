"""Exact repeated substrings, removed everywhere but where they first start.

A byte goes when a string of ``length`` bytes covers it that also starts earlier: in a document with
a smaller id, or earlier in the same one. Only places that can repeat are sorted. Each window of
``length`` bytes has an anchor, the q-gram in it with the least hash, so equal windows have equal anchors;
windows whose anchor occurs in one text once are done. The texts around the other anchors are
gathered by anchor and their suffixes sorted by bucket-pointer refinement: buckets of 8-byte grams are
refined by the bucket numbers of later offsets until they tell whole windows apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.llm.arrowtext import content, ragged, sliced
from ranktab.sources.staging import stage

LENGTH = 100
GRAM = 20
CHUNK = 1 << 20  # windows whose anchors are sought at a time
PLACE = np.uint64((1 << 23) - 1)  # the lowest bits of a key hold the place in the chunk
SLICE = 4 << 20  # bytes of text whose anchors are sought at a time
HELD_ANCHORS = 1 << 20  # anchors that a task combines before it sends them on
HELD_BYTES = 8 << 20  # text around anchors, likewise
REFINED_BYTES = 2 << 20  # text whose suffixes are sorted together
HELD_SPANS = 100_000  # spans that wait to be sent
HOT = 50_000  # texts that share an anchor; beyond, windows go one by one
FIRST_ID = -(1 << 63)  # the place of a null id in the order


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd number modulo 2^64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
    return values, np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    values, up, down = _powers(CHUNK + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: hash, document, and the first and last window of the run."""
    edges = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, offsets[1:][long] - length + 1, -1)
    whole = np.cumsum(edges[:-1], dtype=np.int8) > 0
    out = []
    for start in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[start : start + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        keys = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        least = (_least(keys, length - gram + 1) & PLACE).astype(np.int64)
        windows = np.flatnonzero(whole[start : start + len(least)])
        if len(windows):
            first = np.flatnonzero(np.diff(least[windows], prepend=-1))
            last = np.append(first[1:], len(windows)) - 1
            low = windows[first] + start
            out.append((h[least[windows[first]]].view(np.int64), np.searchsorted(offsets, low, side="right") - 1, low, windows[last] + start))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _shared_here(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text): whether it is known to repeat. Of a repeated hash, one more row goes on for others to meet."""
    order = np.lexsort((tag, h))
    h, tag = h[order], tag[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])
    rows = np.flatnonzero(new)
    first = np.flatnonzero(np.diff(h[rows], prepend=h[rows[:1]] - 1) != 0) if len(rows) else rows
    group = np.zeros(len(rows), np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    size = np.bincount(group, weights=np.diff(np.append(rows, len(h))), minlength=len(first))
    known = size[group] > 1
    forward = np.zeros(len(rows), bool)
    forward[first] = True
    return h[rows], tag[rows], known.astype(np.int8) + 2 * forward.astype(np.int8)


def _repeated_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``tag`` and ``h``: the anchors that occur more than once over distinct texts.

    Tasks combine what they hold, so a hash that very many texts share costs a row or two per task
    in the shuffle; what a task knows to repeat is spread evenly and passes through.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def combined() -> pa.RecordBatch:
            h, tag, state = _shared_here(*(np.concatenate(x) for x in zip(*held)))
            known, on = state % 2 == 1, state >= 2
            held.clear()
            columns = [np.concatenate([h[known], h[on]]), np.concatenate([tag[known], tag[on]]), np.repeat([True, False], [known.sum(), on.sum()])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "tag", "known"])

        size = 0
        for batch in batches:
            for rows, part in sliced(batch, "text", SLICE):
                tag = rows.column(0).to_numpy()
                fresh = np.array([t not in seen and not seen.add(t) for t in tag.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                data, offsets = content(part)
                h, doc, _, _ = anchors(data, offsets, length, gram)
                kept = fresh[doc] if len(doc) else np.zeros(0, bool)
                held.append((h[kept], tag[doc[kept]]))
                size += int(kept.sum())
                if size > HELD_ANCHORS:
                    yield combined()
                    size = 0
        if held:
            yield combined()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, tag = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def answer(h: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
            differs = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            differs[1:] = same & (tag[1:] != tag[:-1])
            first = np.flatnonzero(np.append(True, ~same))[: len(h)] if len(h) else np.zeros(0, np.int64)
            several = np.maximum.reduceat(differs, first) if len(h) else differs
            kept = np.repeat(several, np.diff(np.append(first, len(h))))
            return pa.RecordBatch.from_arrays([pa.array(tag[kept]), pa.array(h[kept])], names=["tag", "h"])

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known = batch.column(2).to_numpy(zero_copy_only=False)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(b[known]), pa.array(a[known])], names=["tag", "h"])
            h, tag = np.concatenate([h, a[~known]]), np.concatenate([tag, b[~known]])
            ready = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last hash may go on
            if ready:
                yield answer(h[:ready], tag[:ready])
                h, tag = h[ready:], tag[ready:]
        if len(h):
            yield answer(h, tag)

    rows = texts.select("tag", "text").mapInArrow(sent, "h long, tag long, known boolean")
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("h", "tag")).otherwise(F.col("h"))).sortWithinPartitions("known", "h", "tag")
    return dealt.mapInArrow(met, "tag long, h long").distinct()


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers: equal for two places exactly when the ``length`` bytes from them on are equal.

    Buckets of 8-byte grams (4, 2 or 1 for short lengths) are split by the bucket numbers of a later offset; the numbers that a
    pass has made serve the next, which so reaches twice as far. Buckets of one place are left alone.
    Places less than ``length`` bytes before the end are compared as if zero bytes followed.
    """
    reach = max(w for w in (1, 2, 4, 8) if w <= length)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n = len(data)
    value = np.zeros(n, np.uint64)
    for k in range(reach):
        value = value << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    _, bucket = np.unique(value, return_inverse=True)
    top = int(bucket.max()) + 1 if n else 0
    active = np.arange(n)
    while reach < length and len(active):
        offset = min(reach, length - reach)
        later = np.full(n, -1, np.int64)
        later[: n - offset] = bucket[offset:] if offset < n else 0
        active = active[np.bincount(bucket[active], minlength=top)[bucket[active]] > 1]
        pairs = bucket[active] * (top + 1) + later[active] + 1
        _, finer = np.unique(pairs, return_inverse=True)
        bucket[active] = top + finer
        top += int(finer.max()) + 1 if len(finer) else 0
        reach += offset
    return bucket


def _later_windows(rows: list[tuple[int, int, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For texts (id, place, bytes) the runs of windows that start earlier in another of them."""
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    begin = np.cumsum(sizes) - sizes
    bucket = refine(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), length)
    n = sizes - length + 1
    row, at = np.repeat(np.arange(len(rows)), n), ragged(begin, n)
    inner = at - begin[row]
    doc = np.array([r[0] for r in rows], np.int64)[row]
    place = np.array([r[1] for r in rows], np.int64)[row] + inner
    b = bucket[at]
    order = np.lexsort((place, doc, b))
    same = np.zeros(len(order), bool)
    same[1:] = b[order][1:] == b[order][:-1]
    # Equal id and place is one occurrence (a row given twice), not a later one.
    firsts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    lead = order[firsts]
    later[order] = same & ((doc[order] != doc[lead]) | (place[order] != place[lead]))
    hits = np.flatnonzero(later)
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    if len(hits):
        breaks = np.flatnonzero((np.diff(hits) != 1) | (np.diff(row[hits]) != 0))
        for a, z in zip(hits[np.append(0, breaks + 1)].tolist(), hits[np.append(breaks, len(hits) - 1)].tolist()):
            out[row[a]].append((int(place[a]), int(place[z]) + length))
    return out


AROUND = pa.schema(
    [("x", pa.int64()), ("y", pa.int64()), ("k", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("around", pa.binary())]
)
FOUND = pa.schema([("k", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (``k``, ``tag``, ``start``, ``stop``) to remove, from texts with lists of repeated anchors.

    ``few`` holds anchors whose surroundings are compared as a whole, ``many`` those whose windows
    are compared one by one by 128-bit hashes, because very many texts share them.
    """
    import xxhash

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        done: list[tuple] = []
        size = 0

        def put(key: tuple, row: tuple) -> None:
            """Keep the first occurrence; the other one is known to repeat."""
            nonlocal size
            was = held.get(key)
            if was is None:
                size += 64 + len(key[2] or b"")
                held[key] = row
            elif (was[0], was[2]) > (row[0], row[2]):
                held[key] = row
                done.append(was)
            elif (was[0], was[2]) != (row[0], row[2]):
                done.append(row)

        def combined() -> pa.RecordBatch:
            nonlocal size
            rows = [(*key[:2], *row, key[2]) for key, row in held.items()] + [(row[2] * 31 + row[0], None, *row, None) for row in done]
            held.clear()
            done.clear()
            size = 0
            columns = list(zip(*rows)) if rows else [[] for _ in AROUND]
            wrapped = [((v + (1 << 63)) % (1 << 64)) - (1 << 63) for v in columns[0]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([wrapped, *columns[1:]], AROUND)], schema=AROUND)

        for batch in batches:
            for rows, part in sliced(batch, "text", SLICE):
                data, offsets = content(part)
                h, doc, low, high = anchors(data, offsets, length, gram)
                k, tag = (rows.column(rows.schema.get_field_index(n)).to_numpy() for n in ("k", "tag"))
                raw = data.tobytes()
                for name in ("few", "many"):
                    lists = rows.column(rows.schema.get_field_index(name))
                    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                    mixed = lambda hashes, docs: hashes.view(np.uint64) ^ (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    chosen = np.flatnonzero(np.isin(mixed(h, doc), mixed(lists.flatten().to_numpy(), owner)))
                    base = offsets[doc[chosen]]
                    each = zip(h[chosen].tolist(), k[doc[chosen]].tolist(), tag[doc[chosen]].tolist(), low[chosen].tolist(), high[chosen].tolist(), base.tolist())
                    for x, key, label, a, b, zero in each:
                        if name == "few":
                            put((x, 0, raw[a : b + length]), (key, label, a - zero, b + length - zero))
                        else:
                            for p in range(a, b + 1):
                                both = xxhash.xxh3_128_intdigest(raw[p : p + length])
                                halves = (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)
                                put((*halves, None), (key, label, p - zero, p + length - zero))
                        if size > HELD_BYTES or len(done) > HELD_SPANS:
                            yield combined()
        yield combined()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        waiting: list[tuple[int, int, bytes]] = []
        labels: list[int] = []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            """Resolve one anchor: later occurrences of equal surroundings go whole; different ones are refined."""
            nonlocal size
            best: dict[tuple, tuple] = {}
            for y, k, tag, start, stop, text in group:
                row, key = (k, start, tag, stop), (y, text)
                was = best.get(key)
                if was is None:
                    best[key] = row
                    continue
                first, second = (row, was) if row[:2] < was[:2] else (was, row)
                best[key] = first
                if first[:2] != second[:2]:
                    out.append((second[0], second[2], second[1], second[3]))
            if len(best) > 1 and group[0][5] is not None:
                for (_, text), (k, start, tag, _) in best.items():
                    waiting.append((k, start, text))
                    labels.append(tag)
                    size += len(text)
            group.clear()

        def resolved() -> pa.RecordBatch:
            nonlocal size
            if waiting:
                for (k, _, _), tag, runs in zip(waiting, labels, _later_windows(waiting, length)):
                    out.extend((k, tag, a, b) for a, b in runs)
            waiting.clear()
            labels.clear()
            columns = list(zip(*out)) if out else [[] for _ in FOUND]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

        before = None
        for batch in batches:
            direct = pc.is_null(batch.column(1))
            if pc.any(direct).as_py():
                yield pa.RecordBatch.from_arrays([c.filter(direct) for c in batch.columns[2:6]], schema=FOUND)
                batch = batch.filter(pc.invert(direct))
            columns = [c.to_pylist() for c in batch.columns]
            for x, *row in zip(*columns):
                if x != before and group:
                    close()
                    if size > REFINED_BYTES or len(out) > HELD_SPANS:
                        yield resolved()
                before = x
                group.append(tuple(row))
        if group:
            close()
        yield resolved()

    sent = texts.mapInArrow(around, "x long, y long, k long, tag long, start long, stop long, around binary")
    # Rows with y are grouped by x (and y, where windows go alone); those without are known and pass through.
    return sent.repartition("x").sortWithinPartitions("x").mapInArrow(compared, "k long, tag long, start long, stop long")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text when repeated strings of ``length`` bytes stay only where they first start.

    Returns one row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (the remaining bytes; a run may end inside a character). A null text counts as
    empty. A null id is smaller than any other. Rows with one id are compared by their starts alone,
    so a row given twice does not remove itself. Texts equal to one with a smaller id are found by
    their digests and go whole, when they have ``length`` bytes. An empty table gives an empty one;
    other columns are not read. ``doc_id`` must be an integer column.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("k"), text.alias("text"))
    base = base.withColumn("tag", F.xxhash64("text"))
    texts = stage(base.select("k", "tag", F.unhex(F.sha2("text", 256)).alias("digest")))
    first = texts.groupBy("digest").agg(F.min("k").alias("first"), F.min("tag").alias("tag"))
    shared = stage(_repeated_anchors(base, length, gram))
    crowded = stage(shared.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("crowded")))
    if crowded.isEmpty():  # nothing to look up
        flagged = shared.withColumn("crowded", F.lit(None).cast("boolean"))
    else:
        flagged = shared.join(crowded, "h", "left")
    lists = flagged.groupBy("tag").agg(
        F.collect_list(F.when(F.col("crowded").isNull(), F.col("h"))).alias("few"), F.collect_list(F.when(F.col("crowded"), F.col("h"))).alias("many")
    )
    lists = stage(lists.join(first.select(F.col("first").alias("k"), "tag"), "tag"))
    spans = _spans(base.join(lists, ["k", "tag"]).select("k", "tag", "text", "few", "many"), length, gram)
    copies = texts.join(first.select("digest", "first"), "digest").where(F.col("k") > F.col("first")).select("k", "tag").distinct()
    found = spans.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.lit(False).alias("copy"))
    found = stage(found.unionByName(copies.select("k", "tag", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(True).alias("copy"))))
    rows = base.join(found, ["k", "tag"], "left").select("doc_id", "text", "spans", "copy")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in sliced(batch, "text", SLICE):
                data, offsets = content(whole)
                removed, runs, kept = [], [], []
                raw = data.tobytes()
                each = zip(offsets.tolist(), offsets[1:].tolist(), part.column(2).to_pylist(), part.column(3).to_pylist())
                for a, b, found, copy in each:
                    own = raw[a:b]
                    marks = [(0, b - a)] if copy and b - a >= length else [] if copy else sorted((s["start"], s["stop"]) for s in found or ())
                    at, gone, count, left = -1, 0, 0, []
                    for s, e in marks:
                        if s > at or at < 0:
                            left.append(own[max(at, 0) : s])
                            count += 1
                            gone += e - s
                            at = e
                        elif e > at:
                            gone += e - at
                            at = e
                    left.append(own[max(at, 0) :])
                    removed.append(gone)
                    runs.append(count)
                    kept.append(b"".join(left))
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
