from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranktab.llm import packing, token_counts
from ranktab.llm.arrowtext import texts_of
from ranktab.llm.tokens import word_encoder

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "é", "é", "▁", "日", "😀", "\x00", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "<|ENDoftext|>", "'s", "'LL",
         " Th", "12", ".", "...", "ß", "\t", "\x1c", "\x85", "\xa0", "İ", "Σ", "$$", "***", "!!", "|", "<", "_", "Ⅷ"]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(0)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "  ", "a "]


def test_word_ids_equal_the_library():
    encoder, given = word_encoder(WORDS), odd_texts(6000)
    ids, bounds = encoder.encode(texts_of(pa.array(given)))
    expected = [e.ids for e in encoder.tokenizer.encode_batch(given, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == expected


def test_prefix_counts_equal_the_library():
    import sentencepiece

    model, counting = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    given = odd_texts(4000)
    totals, steps = counting.texts(texts_of(pa.array(given)))
    assert totals.tolist() == [len(x) for x in model.encode(given)]
    for text, step in list(zip(given, steps))[:300]:
        prefixes = [len(x) for x in model.encode([text[:i] for i in range(1, len(text) + 1)])]
        assert np.cumsum(np.frombuffer(step, np.int8), dtype=int).tolist() == prefixes


def test_token_counts_of_odd_rows(spark, docs, texts, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.prefix_token_counts(docs, PIECES)
    got = Counter((r["doc_id"], r["n_chars"], r["n_bytes"], r["n_tokens"]) for r in found.collect())
    assert got == Counter((i, len(t or ""), len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts)
    assert token_counts.prefix_token_counts(no_docs, PIECES).count() == 0
    one = found.where("doc_id = 5").select(
        token_counts.tokens_of_prefix(F.col("steps"), F.lit(9)).alias("n"), token_counts.chars_within_budget(F.col("steps"), F.lit(4)).alias("c")
    ).first()
    text = dict(texts)[5]
    assert one["n"] == len(model.encode(text[:9]))
    assert one["c"] == max(i for i in range(len(text) + 1) if len(model.encode(text[:i])) <= 4)


def fewest_bins(sizes: list[int], capacity: int) -> int:
    best = len(sizes)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bound_and_layout_against_all_packings():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 10, 24])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        bins, offsets, filled = packing.best_fit_decreasing(np.array(sizes), capacity)
        best = fewest_bins(sizes, capacity)
        assert bound <= best <= len(filled)
        assert max(filled) <= capacity and sum(filled) == sum(sizes)
    assert packing.lower_bound(np.bincount([6, 6, 6, 3], minlength=11), 10) == 3
    assert packing.lower_bound(np.zeros(11, int), 10) == 0


def check_layout(rows, capacity: int) -> int:
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(docs, texts, no_docs):
    encoder = word_encoder(WORDS).tokenizer
    rows = packing.pack_documents(docs, WORDS, with_ids=True, group=40).collect()
    expected = Counter()
    for i, t in texts:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        for p, start in enumerate(range(0, len(ids), 4096)):
            piece = ids[start : start + 4096]
            expected[i, p, start, tuple(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"]), r["ids_crc32"]) for r in rows) == expected
    total = sum(r["length"] for r in rows)
    assert check_layout(rows, 4096) == -(-total // 4096)
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_groups_exchange_what_leaves_gaps(spark):
    # Each small group alone wastes most of a bin; together they fill all of them.
    pieces = spark.createDataFrame([(i, 30) for i in range(300)], "id long, length long")
    path = packing.stage(pieces)
    apart = packing.pack(path, capacity=100, group=10, slack=0, max_rounds=1).collect()
    together = packing.pack(path, capacity=100, group=10, slack=0).collect()
    assert len(apart) == len(together) == 300
    assert check_layout(together, 100) <= check_layout(apart, 100)
    with pytest.raises(ValueError):
        packing.pack(path, capacity=20)
