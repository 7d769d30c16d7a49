"""Exact token counts at every prefix of a text.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token ``t`` for which the
encoding of the rest ends in a token that leaves the boundary to ``t`` alone. One pass from left to
right therefore finds the last token and the count of *every* prefix (dynamic programming), and
stored counts answer "how many tokens has the text up to here" and "how far do N tokens reach"
without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import sliced

SPACE = "▁"  # stands for a blank inside pieces
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KNOWN_UNITS = 400_000  # counted units that a worker keeps before it starts anew
KNOWN_PAIRS = 1_000_000  # likewise, judged pairs of tokens


class PrefixCounter:
    """Counts of every prefix for one sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if spec.model_type != 2 or not spec.byte_fallback or not plain or norm.precompiled_charsmap:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        ordinary = [p for p in proto.pieces if p.type == 1]
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(SPACE in p.piece[1:] and p.piece.strip(SPACE) for p in ordinary):
            raise ValueError("pieces across words are not supported")
        self.rank = {p.piece: -p.score for p in ordinary}
        self.newline_splits = not any("\n" in p for p in self.rank if p != "\n")
        self.pieces = list(self.rank)
        # Pieces by their characters from last to first; the key "" holds a piece's number.
        self.backwards: dict = {}
        for number, piece in enumerate(self.pieces):
            node = self.backwards
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = number
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, bytes]] = {}

    def encode(self, text: str) -> list[str]:
        """The byte-pair merges of one short string; a character without a piece stays alone."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _string(self, number: int) -> str:
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are their own encoding."""
        a, b = self._string(left), self._string(right)
        found = self.fits[left << 32 | right] = self.encode(a + b) == [a, b]
        return found

    def _walk(self, units: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """Count and steps of each unit. Of a sorted list, shared beginnings are walked once."""
        backwards, fits, lone = self.backwards, self.fits, len(self.pieces)
        last, count, steps, before = [-1], [0], bytearray(), ""
        for unit in units:
            if len(fits) > KNOWN_PAIRS:
                fits.clear()
            same = 0
            for a, b in zip(before, unit):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :], steps[same:]
            for end in range(same + 1, len(unit) + 1):
                node, start = backwards, end
                while start:
                    start -= 1
                    node = node.get(unit[start])
                    if node is None:
                        start = -1
                        break
                    token = node.get("")
                    if token is not None:
                        left = last[start]
                        if left < 0:
                            break
                        fit = fits.get(left << 32 | token)
                        if fit is None:
                            fit = self._fit(left, token)
                        if fit:
                            break
                else:
                    start = -1
                if start >= 0:
                    n = count[start] + 1
                else:  # a lone character without a piece: its bytes
                    token = lone + ord(unit[end - 1])
                    n = count[end - 1] + len(unit[end - 1].encode("utf-8", "surrogatepass"))
                steps.append((n - count[-1]) & 255)
                last.append(token)
                count.append(n)
            before = unit
            yield count[-1], bytes(steps)

    def units(self, units: list[str]) -> list[tuple[int, bytes]]:
        """Token count of each unit, and the change of the count at each character as signed bytes."""
        known = self.known
        if len(known) > KNOWN_UNITS:
            known.clear()
        split = self.newline_splits
        parts = [[p for p in re.split("(\n)", u) if p] if split and "\n" in u else None for u in units]
        wanted = {u for u, p in zip(units, parts) if p is None}.union(*(p for p in parts if p))
        new = sorted(wanted - known.keys())
        fresh = dict(zip(new, self._walk(new)))
        look = {**{u: known[u] for u in wanted if u not in fresh}, **fresh}
        known.update((u, found) for u, found in fresh.items() if len(u) <= 40)
        return [
            look[u] if p is None else (sum(look[x][0] for x in p), b"".join([look[x][1] for x in p]))
            for u, p in zip(units, parts)
        ]

    def text(self, text: str) -> tuple[int, bytes]:
        """Token count of a text and the change at each of its characters."""
        if not text:
            return 0, b""
        found = self.units(UNITS.findall(SPACE + text.replace(" ", SPACE)))
        return sum(n for n, _ in found), self._without_dummy(b"".join([step for _, step in found]))

    @staticmethod
    def _without_dummy(steps: bytes) -> bytes:
        """Add the step of the blank that the model puts first to the first character's."""
        first = np.frombuffer(steps[:2], np.int8).sum(dtype=np.int8)
        return first.tobytes() + steps[2:]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Counts and steps of many texts; each distinct word is looked up once."""
        pieces = pc.split_pattern(texts, " ")
        bounds = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        flat = pieces.flatten().dictionary_encode()
        values = flat.dictionary.to_pylist()
        plain = np.array([v != "" and SPACE not in v for v in values], bool)
        counted = self.units([SPACE + v if p else SPACE for v, p in zip(values, plain)])
        codes = flat.indices.to_numpy()
        numbers = np.array([n for n, _ in counted], np.int64)
        steps = [step for _, step in counted]
        sums = np.concatenate([[0], np.cumsum(numbers[codes])]) if len(codes) else np.zeros(1, np.int64)
        easy = np.concatenate([[0], np.cumsum(plain[codes])]) if len(codes) else np.zeros(1, np.int64)
        totals, all_steps = np.zeros(len(texts), np.int64), []
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if easy[b] - easy[a] == b - a and b > a:
                totals[i] = sums[b] - sums[a]
                all_steps.append(self._without_dummy(b"".join([steps[c] for c in codes[a:b].tolist()])))
            else:  # runs of blanks, and texts with no character
                totals[i], step = self.text(texts[i].as_py())
                all_steps.append(step)
        return totals, all_steps


@cache
def counter(model: str) -> PrefixCounter:
    """One counter for each worker process."""
    return PrefixCounter(model)


def prefix_token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every text and of all its prefixes.

    Returns one row per input row, repeated rows included: ``id_col`` (as given, null too),
    ``n_chars``, ``n_bytes``, ``n_tokens`` and ``steps``: one signed byte per character, the change
    of the count at it, so that a running sum gives the count of every prefix. A null text counts as
    empty, an empty text has 0 tokens, an empty table gives an empty one; other columns are not read.
    ``model`` is the path of a sentencepiece model on every executor.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_chars", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("steps", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(model)
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                totals, steps = counting.texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pc.utf8_length(texts).cast(pa.int64()),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(totals),
                        pa.array(steps, pa.binary()),
                    ],
                    names=["id", "n_chars", "n_bytes", "n_tokens", "steps"],
                )

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def tokens_of_prefix(steps: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from stored steps alone."""

    @F.arrow_udf(T.LongType())
    def read(stored: pa.Array, upto: pa.Array) -> pa.Array:
        out = []
        for s, n in zip(stored.to_pylist(), upto.to_pylist()):
            out.append(None if s is None or n is None else int(np.frombuffer(s[: max(n, 0)], np.int8).sum(dtype=np.int64)))
        return pa.array(out, pa.int64())

    return read(steps, n_chars)


def chars_within_budget(steps: Column, budget: Column) -> Column:
    """The longest prefix, in characters, that has at most ``budget`` tokens."""

    @F.arrow_udf(T.LongType())
    def read(stored: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for s, n in zip(stored.to_pylist(), most.to_pylist()):
            if s is None or n is None:
                out.append(None)
                continue
            fits = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= n)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pa.array(out, pa.int64())

    return read(steps, budget)
