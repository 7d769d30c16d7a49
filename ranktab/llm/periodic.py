"""Periodic runs of words, found by recompression and longest-common-extension queries.

A run is a maximal stretch of words with smallest period ``q`` (words ``q`` apart are equal), at
least ``max(24, 3q)`` long. Its positions ``i`` with ``w[i] = w[i+q]`` form a stretch of at least
``2q`` places, so it holds a multiple of ``q``; from the first such place at least nine places
match (``len - 2q + 1`` with ``len >= max(24, 3q)``). The candidates are the harmonic grid,
``b, b + q, b + 2q, ...`` from each text's beginning ``b`` for every ``q`` up to a third of the
text, made in one vectorised step, and the first nine matches are tested in vectorised steps. Each survivor is extended both ways by LCE queries on a
recompression grammar: rounds of block compression (``a^k`` becomes one symbol) and pair
compression (``ab`` with ``a`` on the left side and ``b`` on the right side of a per-round split of
the alphabet) until one symbol is left. Equal names stand for equal words, so a query jumps over
the largest symbol that starts at both places and agrees; locally consistent parsing makes such
jumps long inside periodic text. No suffix array is built.

Texts of a slice of rows are one sequence with a unique separator between texts, so no match
crosses two texts; slices hold a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.llm.arrowtext import _give_back

LEAST = 24
FACTOR = 3
SEEN = 9  # matches from a run's first grid place, at least: min over q of max(24 - 2q, q) + 1
SLICE_WORDS = 1 << 18
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def grammar(ids: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of a recompression of ``ids``, level 0 (the words) first.

    A level holds, per symbol: its start, name and span, and the name and span of its unit: a block
    ``a^k`` has unit ``a``; any other symbol is its own unit. Names are unique across levels, and
    equal names expand to equal words.
    """
    n = len(ids)
    pos, cur, span = np.arange(n, dtype=np.int64), ids.astype(np.int64), np.ones(n, np.int64)
    top = int(cur.max()) + 1 if n else 0
    levels = [(pos, cur, span, cur, span)]
    seed = 0
    while len(cur) > 1:
        before = len(cur)
        # block compression: a maximal run a^k (k > 1) becomes one symbol named by (a, k)
        heads = np.flatnonzero(np.r_[True, cur[1:] != cur[:-1]])
        if len(heads) < len(cur):
            counts = np.diff(np.r_[heads, len(cur)])
            blocks = counts > 1
            _, names = np.unique((cur[heads] * (before + 1) + counts)[blocks], return_inverse=True)
            unit, unit_span = cur[heads], span[heads]
            fresh = unit.copy()
            fresh[blocks] = top + names
            top += int(names.max()) + 1
            pos, cur = pos[heads], fresh
            span = np.diff(np.r_[pos, n])
            levels.append((pos, cur, span, unit, unit_span))
        # pair compression: ab with a on the left side, b on the right side of this round's split
        if len(cur) > 1:
            side = (((cur.astype(np.uint64) + np.uint64(seed) * _STEP) * _MIX) >> np.uint64(40)) & np.uint64(1)
            seed += 1
            left = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
            if len(left):
                _, names = np.unique(cur[left] * (top + 1) + cur[left + 1], return_inverse=True)
                keep = np.ones(len(cur), bool)
                keep[left + 1] = False
                fresh = cur.copy()
                fresh[left] = top + names
                top += int(names.max()) + 1
                pos, cur = pos[keep], fresh[keep]
                span = np.diff(np.r_[pos, n])
                levels.append((pos, cur, span, cur, span))
    return levels


def extension(levels, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension of the places ``a`` and ``b`` (arrays), by jumps over equal symbols.

    At each level, the symbols holding both places may be left together when they have one unit and
    both places sit on unit borders; the jump runs to the nearer end. The longest jump of all levels is taken.
    """
    ext = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a < n) & (b < n))
    while len(live):
        x, y = a[live] + ext[live], b[live] + ext[live]
        step = np.zeros(len(live), np.int64)
        open_ = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        for pos, name, span, unit, unit_span in levels:
            ix = np.searchsorted(pos, x, side="right") - 1
            iy = np.searchsorted(pos, y, side="right") - 1
            ox, oy = x - pos[ix], y - pos[iy]
            ok = open_ & (unit[ix] == unit[iy]) & (ox % unit_span[ix] == 0) & (oy % unit_span[iy] == 0)
            jump = np.where(ok, np.minimum(span[ix] - ox, span[iy] - oy), 0)
            np.maximum(step, jump, out=step)
        ext[live] += step
        live = live[step > 0]
    return ext


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of the given lengths: the range of each element and its place inside it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    firsts = np.cumsum(lengths) - lengths
    return owner, np.arange(int(lengths.sum()), dtype=np.int64) - firsts[owner]


def _grid(begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic grid of every text: places ``begin + m q`` for each period ``q <= length / 3``."""
    tops = lengths // FACTOR
    text, q = _ragged(tops)
    q = q + 1
    per_q = -(-lengths[text] // q)
    which, m = _ragged(per_q)
    return begins[text][which] + m * q[which], q[which]


def runs_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(start, length, period)`` in ``ids``, a sequence of texts each followed by a unique separator.

    ``ends`` holds each text's end (its separator's place). Starts are places in ``ids``. The grammar
    is built over the texts that keep a candidate after the nine-match test only.
    """
    n = len(ids)
    none = (np.zeros(0, np.int64),) * 3
    begins = np.r_[0, ends[:-1] + 1].astype(np.int64)
    lengths = (ends - begins).astype(np.int64)
    cand, per = _grid(begins, np.where(lengths >= LEAST, lengths, 0))
    for t in range(SEEN):
        if not len(cand):
            return none
        at = cand + t
        ok = at + per < n
        cand, per, at = cand[ok], per[ok], at[ok]
        ok = ids[at] == ids[at + per]
        cand, per = cand[ok], per[ok]
    # a grid place whose predecessor passed too lies in the same stretch (q <= SEEN)
    keys = cand * (SEEN + 1) + per
    small = per <= SEEN
    first = ~small | ~np.isin((cand - per) * (SEEN + 1) + per, keys[small])
    cand, per = cand[first], per[first]
    if not len(cand):
        return none
    # the texts that hold candidates, as one sequence of their own
    texts = np.unique(np.searchsorted(ends, cand))
    size = lengths[texts] + 1
    shift = begins[texts] - (np.cumsum(size) - size)
    text_of, inner = _ragged(size)
    sub = ids[begins[texts][text_of] + inner]
    local = cand - shift[np.searchsorted(begins[texts], cand, side="right") - 1]
    m = len(sub)
    after = extension(grammar(sub), m, local, local + per)
    keep = after >= SEEN
    cand, local, per, after = cand[keep], local[keep], per[keep], after[keep]
    before = extension(grammar(sub[::-1].copy()), m, m - local, m - local - per)  # places m-1-(i-1) and m-1-(i+q-1)
    start, length = cand - before, after + before + per
    keep = length >= np.maximum(LEAST, FACTOR * per)
    start, length, per = start[keep], length[keep], per[keep]
    # one run per interval, by its smallest period
    order = np.lexsort((per, length, start))
    start, length, per = start[order], length[order], per[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    return start[first], length[first], per[first]


def _slice_runs(words: pa.ListArray, ids_out: list, n_out: list, runs_out: list, kept_out: list) -> None:
    flat = pc.list_flatten(words)
    counts = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(counts)
    # text r occupies [offset[r], offset[r] + counts[r]), then its separator, a name no word has
    offsets = np.r_[0, np.cumsum(counts + 1)[:-1]].astype(np.int64)
    seq = np.empty(int(counts.sum() + rows), np.int64)
    words_at = np.ones(len(seq), bool)
    words_at[offsets + counts] = False
    seq[~words_at] = (int(codes.max()) + 1 if len(codes) else 0) + np.arange(rows)
    word_places = np.flatnonzero(words_at)
    seq[word_places] = codes
    start, length, period = runs_of(seq, offsets + counts)
    owner = np.searchsorted(offsets, start, side="right") - 1
    dropped = np.zeros(len(seq), np.int32)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped) > 0
    keep_word = ~dropped[word_places]
    kept_counts = np.bincount(np.repeat(np.arange(rows), counts)[keep_word], minlength=rows)
    kept_values = flat.filter(pa.array(keep_word, pa.bool_()))
    kept_lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept_counts)], pa.int32()), kept_values)
    kept_out.append(pc.binary_join(kept_lists, " "))
    n_out.append(counts)
    by_doc: list[list[dict]] = [[] for _ in range(rows)]
    rel = start - offsets[owner]
    for r, s, l, p in zip(owner.tolist(), rel.tolist(), length.tolist(), period.tolist()):
        by_doc[r].append({"start": s, "length": l, "period": p})
    runs_out.extend(sorted(found, key=lambda x: (x["start"], x["period"])) for found in by_doc)


def _runs_in_batches(id_col: str, words_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(batch.schema.get_field_index(words_col))
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
                n_out, runs_out, kept_out = [], [], []
                _slice_runs(words.slice(at, stop - at), [], n_out, runs_out, kept_out)
                ids = batch.column(batch.schema.get_field_index(id_col)).slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(n_out[0], pa.int64()), pa.array(runs_out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), kept_out[0].cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                at = stop
                _give_back()

    return run


def word_lists(docs: DataFrame, text_col: str = "text") -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    parts = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != F.lit(""))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """Runs of every row's word list: ``doc_id, n_words, runs, collapsed``.

    ``runs`` lists ``(start, length, period)`` by start, then period (word numbers from 0);
    ``collapsed`` is the kept words joined by one space, where a word goes if some run holds it after
    that run's first ``period`` words. A null list has no words; an empty one gives no runs and an
    empty ``collapsed``. Rows keep their own id (null too); rows given twice give two rows. Other
    columns are ignored. Each row is handled by itself, in the task that reads it: nothing is shuffled.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_pr_id"), F.col(words_col).cast("array<string>").alias("_pr_words"))
    return narrow.mapInArrow(_runs_in_batches("_pr_id", "_pr_words"), SCHEMA)


def best_run(runs: list[dict]) -> dict | None:
    """The run of greatest ``length / period``, ties by smallest start, then period (for tests)."""
    if not runs:
        return None
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]))
