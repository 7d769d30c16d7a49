from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import xxhash

from ranktab.llm import components, decontamination, lines, simhash, suffixes


def brute_fingerprint(text: str | None, shingle: int) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n: int, near) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if near(a, b):
            parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_every_small_set_of_positions_is_outside_some_mask():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(list(range(24)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for places in itertools.combinations(range(24), radius):
            assert any(not any(m >> p & 1 for p in places) for m in masks)


def test_fingerprint_reads_blocks_like_one_text(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) + "  \n"
        for block in (1, 7, 1 << 22):
            monkeypatch.setattr(simhash, "BLOCK", block)
            assert simhash.fingerprint(text.encode(), 4) & (2**64 - 1) == brute_fingerprint(text, 4)


def test_components_of_odd_rows(docs, texts, no_docs):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_fingerprint(t, 4) for _, t in texts]
    found = groups(len(texts), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    least = {g: min((texts[i][0] for i in range(len(texts)) if found[i] == g and texts[i][0] is not None), default=None) for g in set(found)}
    assert got == Counter((i, p, least[g]) for (i, _), p, g in zip(texts, prints, found))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {x for x in least.values()}


def test_dense_buckets_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)}
    far = {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(near | far)
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    exact = groups(len(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    for bucket in (8, 2_048):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        roots = {r["node"] & (2**64 - 1): r["root"] for r in components.connected_components(simhash.links_within(df, 4)).collect()}
        assert len({roots.get(p, p) for p in prints}) == len(set(exact))
        assert all((roots.get(prints[a], a) == roots.get(prints[b], b)) == (exact[a] == exact[b]) for a, b in itertools.combinations(range(0, len(prints), 7), 2) if prints[a] in roots and prints[b] in roots)


def brute_lines(texts, threshold: int, least: int):
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    key = lambda i: (i is not None, i or 0)
    first: dict[str, tuple] = {}
    for i, t in texts:
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                first[line] = min(first.get(line, (key(i), p)), (key(i), p))
    links, late = Counter(), set()
    for a, b in itertools.combinations(first, 2):
        if abs(len(a) - len(b)) <= threshold and len(set(a) ^ set(b)) <= 2 * threshold and distance(a, b) <= threshold:
            links.update((a, b))
            late.add(max(a, b, key=lambda x: first[x]))
    out = Counter()
    for i, t in texts:
        own = (t or "").split("\n")
        gone = [p for p, x in enumerate(own) if len(x) >= least and (x in late or first[x] != (key(i), p))]
        kept = "\n".join(x for p, x in enumerate(own) if p not in gone)
        out[i, kept if t is not None else None, len(own) if t else 0, len(gone), sum(links[x] for x in own)] += 1
    return out


def edited(texts) -> list:
    """Lines with up to three characters changed, of short texts."""
    rng, out = random.Random(9), []
    for n, (_, t) in enumerate(x for x in texts if x[1] and 60 < len(x[1]) < 900):
        for v in range(2):
            own = list(t)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(own))
                if own[at] != "\n":
                    own[at] = rng.choice(["", "z", "é", own[at] + "y"])
            out.append((1000 + 10 * n + v, "".join(own)))
    return out


def test_lines_of_odd_rows(spark, docs, texts, no_docs):
    more = [x for x in [*texts, *edited(texts)[:40]] if len(x[1] or "") < 3000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in more], "doc_id long, text string, _x int, n_lines int")
    for threshold in (1, 2):
        found = lines.dedup_lines(df, threshold, 16)
        got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["n_links"]) for r in found.collect())
        assert got == brute_lines(more, threshold, 16)
    assert lines.dedup_lines(docs).count() == len(texts)
    assert lines.dedup_lines(no_docs).count() == 0


def test_edit_automaton(spark):
    rng, pairs = random.Random(1), []
    for _ in range(500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        pairs.append((list(a), list("".join(rng.choice([c, c, c, "", "a", c + "b"]) for c in a))))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for threshold in (1, 2, 3):
        wrong = df.selectExpr(f"{lines.edit_expression('a', 'b', threshold)} AS e", "levenshtein(array_join(a, ''), array_join(b, '')) AS d")
        assert wrong.where(f"NOT (e <=> if(d <= {threshold}, d, null))").count() == 0


def brute_repeats(texts, length: int) -> Counter:
    key = lambda i: (i is not None, i or 0)
    first: dict[bytes, tuple] = {}
    raw = [(key(i), (t or "").encode()) for i, t in texts]
    for k, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (k, p)), (k, p))
    out = Counter()
    for (i, _), (k, b) in zip(texts, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (k, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_of_odd_rows(docs, texts, no_docs):
    for length, gram, hot in ((100, 20, 50_000), (100, 20, 2), (30, 8, 50_000)):
        found = suffixes.without_repeats(docs, length, gram, hot).collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found)
        assert got == brute_repeats(texts, length)
    assert suffixes.without_repeats(no_docs).count() == 0


def test_buckets_tell_whole_windows_apart():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 600).astype(np.uint8)
    data[300:450] = data[:150]
    for length in (1, 3, 7, 20, 100):
        bucket = suffixes.refine(data, length)
        windows = [data[p : p + length].tobytes() for p in range(len(data) - length + 1)]
        numbers = {}
        assert all(numbers.setdefault(w, b) == b for w, b in zip(windows, bucket.tolist()))
        assert len(set(numbers.values())) == len(numbers)


def brute_windows(texts, items, size: int) -> Counter:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = Counter()
    for i, t in texts:
        w, hit, own = split(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    own |= windows[tuple(w[p : p + n])]
        out[i, len(w), len(hit), tuple(sorted(own))] += 1
    return out


def test_benchmark_of_odd_rows(spark, docs, texts, no_docs):
    words = dict(texts)[400].split()
    items = [(1, " ".join(words[50:75])), (2, "word"), (3, None), (4, ""), (None, dict(texts)[500][30:260]), (10, "ha ha ha"), (2, " ".join(words[50:62])), (11, "nowhere to be found here")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, spans int")
    for block in (1 << 22, 150):
        found = decontamination.contamination(docs, bench, block_bytes=block, slop=40).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == brute_windows(texts, items, 10)
        assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found)
    assert decontamination.contamination(no_docs, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontamination.uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    hit = {k[0] for k in brute_windows(texts, items, 10) if k[2]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in texts if i not in hit)


def test_proximity_is_within_slop_and_document(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "red x x x x x x blue green"), (3, "green red"), (4, "blue")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "red blue green")], "item_id long, text string")
    near = {r["doc_id"]: r["near_items"] for r in decontamination.contamination(docs, bench, slop=5).collect()}
    assert near == {1: ["9"], 2: [], 3: [], 4: []}
