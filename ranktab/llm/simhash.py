"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the ``2^(radius + 1) - 1`` tables keeps the bits of a structured mask. Bit positions carry
non-zero vectors over two elements; table ``w`` keeps the positions whose vector has an odd product
with ``w``. Any ``radius`` positions span less than the whole space, so some table drops all of
them: every pair within the radius shares a key in some table, with certainty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import content, sliced
from ranktab.llm.components import connected_components
from ranktab.sources.staging import stage

BITS = 64
SEED = 42
BLOCK = 4 << 20  # bytes of one text whose words are held at a time
BUCKET = 2_048  # fingerprints of one key that one task compares; larger ones are split by more masks
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of the XXH64 of all word shingles of a whole text."""
    import xxhash

    text = text.lower()  # of bytes: A-Z alone
    ones, total, carried, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        border = WHITE.search(text, at + BLOCK)
        end = border.start() if border else len(text)
        words = carried + text[at:end].split()
        at = end
        last = at >= len(text) or not text[at:].strip()
        if len(words) < shingle and not (last and not total):
            carried = words
            continue
        if not words:
            break
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        joined = b" ".join(words)
        ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
        hashed = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist()))
        hashes = np.fromiter(hashed, "<u8", len(ends))
        for part in range(0, len(hashes), 65_536):
            some = hashes[part : part + 65_536]
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
        carried = words[len(words) - shingle + 1 :] if shingle > 1 else []
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row; a null or wordless text has 0."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                data, offsets = content(texts)
                raw = data.tobytes()
                found = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return source.mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of them are all outside some mask."""
    tables = (1 << (radius + 1)) - 1
    return [
        sum(1 << p for i, p in enumerate(positions) if bin((1 + i % tables) & w).count("1") % 2) for w in range(1, tables + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))


def stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each group that links within the radius connect: links of its members to one of them.

    Members are found breadth first among those not yet reached, so no pair is looked at twice and
    a dense group shrinks at once.
    """
    left, links = fps.view(np.uint64), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                links.extend((f, int(root.view(np.int64))) for f in found.view(np.int64).tolist())
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (``u``, ``v``) inside lists of fingerprints ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, bounds = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            bounds = bounds - bounds[0]
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            a, b = values[two], values[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            u, v = [a[near]], [b[near]]
            for i in np.flatnonzero(sizes > 2).tolist():
                if links := stars(values[bounds[i] : bounds[i + 1]], radius):
                    x, y = zip(*links)
                    u.append(np.array(x, np.int64))
                    v.append(np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return buckets.select("fps").mapInArrow(run, "u long, v long")


def links_within(distinct: DataFrame, radius: int) -> DataFrame:
    """Links that connect all fingerprints ``fp`` (distinct) whose bits differ in at most ``radius`` places.

    Keys with one member are counted away first. Keys of up to ``BUCKET`` members are compared in
    one task. A larger one (a dense group) is split again by covering masks over the bits that its
    own mask left free; a key of the second level fixes about three quarters of the bits, which
    bounds how many distinct fingerprints it can have.
    """
    masks = covering_masks(list(range(BITS)), radius)
    keyed = distinct.select("fp", _keys(F.col("fp"), masks).alias("x")).select("fp", "x.t", "x.k")
    several = stage(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    lists = keyed.join(several.where(F.col("n") <= BUCKET).select("t", "k"), ["t", "k"]).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    links = _bucket_links(lists, radius)
    large = several.where(F.col("n") > BUCKET).select("t", "k")
    if not large.isEmpty():
        dense = keyed.join(large, ["t", "k"])
        parts = []
        for t, mask in enumerate(masks):
            free = [p for p in range(BITS) if not mask >> p & 1]
            finer = [mask | m for m in covering_masks(free, radius)]
            parts.append((t, finer))
        # One array of keys per row, chosen by the table the row belongs to.
        choice = F.lit(None).cast("array<struct<t:int,k:bigint>>")
        for t, finer in parts:
            these = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(finer)])
            choice = F.when(F.col("t") == t, these).otherwise(choice)
        inner = dense.select("fp", "t", F.explode(choice).alias("x")).groupBy("t", "x.t", "x.k").agg(F.collect_list("fp").alias("fps"))
        links = links.union(_bucket_links(inner.where(F.size("fps") > 1), radius))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Returns one row per input row: ``doc_id``, ``fp`` (signed) and ``component_id``, the smallest
    ``doc_id`` reachable over links of at most ``radius`` differing bits. Texts are lower-cased
    (A-Z) and cut at ASCII white space; a text of fewer words than a shingle is one shingle; a null,
    empty or blank text has fingerprint 0 and links like any other. Equal fingerprints are one node, so copies
    are never paired. A null ``doc_id`` never names a component: one with no other id has a null
    ``component_id``. Repeated rows stay; an empty table gives an empty one; other columns are not read.
    """
    marked = stage(fingerprints(docs, shingle, id_col, text_col))
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links_within(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group whose fingerprints connect.

    Decided row by row: of each component the row with the smallest ``doc_id`` stays; rows without an
    id come after rows with one, and rows of equal id (or none) by their place in the scan. So copies
    without id, and a row given twice, go like any other copy; a row alone in its component stays.
    Rows are told apart by their place in the scan, so ``docs`` should be a stored table; a column
    named ``_fg_row`` is replaced. The choice per component is an aggregate, combined inside tasks.
    """
    tagged = docs.withColumn("_fg_row", F.monotonically_increasing_id())
    found = near_duplicates(tagged, shingle, radius, id_col="_fg_row").select(F.col("doc_id").alias("_fg_row"), "component_id")
    ids = tagged.select("_fg_row", F.col("doc_id").cast("long").alias("_fg_id"))
    order = F.struct(F.col("_fg_id").isNull().alias("none"), F.col("_fg_id").alias("id"), F.col("_fg_row").alias("row"))
    first = found.join(ids, "_fg_row").groupBy("component_id").agg(F.min(order)["row"].alias("_fg_row"))
    return tagged.join(first, "_fg_row", "left_semi").drop("_fg_row")
