"""Token ids of whole texts, each distinct word encoded once.

The vocabulary must drop white space between words and treat words apart, so that the ids of a text
are the ids of its ASCII-white-space words, one after another. ``word_encoder`` checks that.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from ranktab.llm.arrowtext import content, ragged, word_spans, words

KNOWN_WORDS = 400_000  # encoded words that a worker keeps before it starts anew
SIGNS = b"!#$%&*,.:;?"
ENDINGS = frozenset(bytes([b]) for b in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordEncoder:
    """Ids of texts by one ``tokenizers`` vocabulary, with a bounded memory of words."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        known = kinds == {"NFC", "Replace", "Lowercase"} and split.get("behavior") == "Removed" and split.get("invert")
        if not known or any(a["lstrip"] or a["rstrip"] or not a["content"].startswith("<") for a in spec["added_tokens"]):
            raise ValueError("a vocabulary that drops white space and treats words apart is needed")
        self.tokenizer = Tokenizer.from_file(path)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts as one array, and each text's offsets into it."""
        data, offsets = content(texts)
        if not (data == ord("<")).any():  # no special token: lower case first, for fewer distinct words
            data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ~BLANK)
        coded = words(data, starts, ends, ~BLANK)
        ids = self._words(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        bounds = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(n, out=bounds[1:])
        return flat[ragged(begin[codes], n)], bounds[first]

    def _words(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers.

        Signs that end a run of letters or digits are encoded apart: the vocabulary's split puts a
        border there, and no special token or contraction crosses it.
        """
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        split = []
        for w in distinct:
            core = w.rstrip(SIGNS)
            apart = len(core) < len(w) and core[-1:] in ENDINGS and b"'" not in w and b"<" not in w
            split.append((core, w[len(core) :]) if apart else (w,))
        new = list({p for parts in split for p in parts if p not in known})
        fresh = self._new(new)
        look = {p: known[p] for parts in split for p in parts if p not in fresh}
        look.update(fresh)
        known.update((w, i) for w, i in fresh.items() if len(w) <= 40)
        return [look[p[0]] if len(p) == 1 else look[p[0]] + look[p[1]] for p in split]

    def _new(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Encode words not seen before; plain ASCII words in one call, cut where tokens end a word."""
        plain = [w for w in new if w.isalpha()]
        found = {}
        for start in range(0, len(plain), 50_000):
            some = plain[start : start + 50_000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode("ascii"), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a plain word is not one unit of this vocabulary")
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            found.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        rest = [w for w in new if not w.isalpha()]
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, encoded))
        return found


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; it encodes on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
