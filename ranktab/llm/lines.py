"""Line deduplication by a segment-partition edit join, with DataFrame functions alone.

A line splits into ``threshold + 1`` segments; a line within ``threshold`` edits of it holds one of them
unchanged, near its old place. Each line therefore puts its segments into an index, by length and
segment number, and probes the index with the substrings of its own that can stand for a segment of
a line of each shorter length. Lines that meet are verified by a banded bit-parallel automaton.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.sources.staging import stage

THRESHOLD = 2
LEAST_CHARS = 1
LEAST_BLANK = 16  # shorter lines of white space alone part paragraphs and stay
FIRST_ID = -(1 << 63)
COUNTED = "eaionrtshdlugwbcmfpy "  # characters whose numbers are compared first
SENT_KEYS = 1_000_000  # keys that may be sent to every task (16 MB); more are joined by a shuffle of the rows that may have them
SLOT_BITS = 28  # last bits of a key that tell which rows may have one of them


def with_segment_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """Keys of each line: its own segments (``indexed``), and the substrings that probe for others.

    Places follow the multi-match-aware rule: edits left of a segment move it by at most their
    number, and those right of it must make up for the difference in length. Of a length's segments
    the later ones are the longer. The rules are a constant list, so each key is one short expression.
    """
    parts = threshold + 1
    rules = [
        (gap, i, move)
        for gap in range(parts)
        for i in range(parts)
        for move in range(max(-i, gap - (threshold - i)), min(i, gap + (threshold - i)) + 1)
    ]
    listed = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(i).alias("i"), F.lit(m).alias("move")) for g, i, m in rules])
    rows = lines.select("*", F.explode(listed).alias("rule")).where(f"n - rule.gap >= {parts}")
    rows = rows.withColumn("base", F.expr(f"cast((n - rule.gap) div {parts} as int)")).withColumn("short", F.expr(f"{parts} - (n - rule.gap) % {parts}"))
    start = F.expr("base * rule.i + greatest(0, rule.i - short) + 1 + rule.move")
    rows = rows.withColumn("start", start).withColumn("size", F.expr("base + if(rule.i >= short, 1, 0)"))
    # A place before the line or beyond its end holds no segment.
    rows = rows.where("start >= 1 and start + size - 1 <= n")
    # A place in a line of one byte per character needs no count of characters from the line's start; both hashes are of the same bytes.
    part = "substring({}, start, size)"
    key = F.expr(f"if(octet_length(line) = n, xxhash64(n - rule.gap, rule.i, {part.format('cast(line as binary)')}), xxhash64(n - rule.gap, rule.i, {part.format('line')}))")
    return rows.select(*lines.columns, key.alias("key"), F.expr("rule.gap = 0 and rule.move = 0").alias("indexed"))


def rows_of_slots(keyed: DataFrame, met: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """Rows of ``keyed`` whose key shares its last ``bits`` bits with a key of ``met``: all rows of its keys, and few others.

    A line has twelve keys and each carries the line, so rows that meet no other must go before a
    shuffle. The set of last bits goes to every task, of one size for any number of keys (2 ** 28 bits are 32 MB).
    """
    piece, word, bit = f"(key & {(1 << bits) - 1}) div 2048", "cast((key & 2047) div 64 as int)", "cast(key & 63 as int)"
    words = [F.expr(f"bit_or(if({word} = {i}, shiftleft(1L, {bit}), 0L))").alias(f"w{i}") for i in range(32)]
    slots = met.groupBy(F.expr(piece).alias("piece")).agg(*words)
    slots = slots.select("piece", F.array(*[f"w{i}" for i in range(32)]).alias("words"))
    held = keyed.withColumn("piece", F.expr(piece)).join(F.broadcast(slots), "piece")
    return held.where(f"(shiftright(get(words, {word}), {bit}) & 1) = 1").select(*keyed.columns)


def edit_expression(a: str, b: str, threshold: int) -> str:
    """SQL for the edit distance of two arrays of characters if it is at most ``threshold``, else null.

    A bit-parallel automaton over the band of diagonals: in the state for ``e`` errors, bit
    ``threshold + d`` says that with ``e`` edits the characters of ``b`` read so far match ``d`` more
    characters of ``a`` than that. Each character of ``b`` moves all diagonals of a state at once.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    first = ", ".join(f"'s{e}', {sum(1 << (threshold + d) for d in range(e + 1))}" for e in range(threshold + 1))
    mask = " | ".join(f"if(get({a}, j + {d - threshold}) = c, {1 << d}, 0)" for d in range(width))
    # Nested calls bind names in order: the character, the mask, then one state after the other.
    state = "x.s0 & m"
    moves = [state]
    for e in range(1, threshold + 1):
        moves.append(f"(x.s{e} & m) | x.s{e - 1} | shiftright(x.s{e - 1}, 1) | (shiftleft({moves[-1]}, 1) & {full})")
        moves[-1] = f"({moves[-1]})"
    after = ", ".join(f"'s{e}', {m}" for e, m in enumerate(moves))
    step = f"transform(array({mask.replace('= c', f'= get({b}, j)')}), m -> named_struct({after}))[0]"
    end = f"{threshold} + size({a}) - size({b})"
    levels = " ".join(f"when (shiftright(z.s{e}, {end}) & 1) = 1 then {e}" for e in range(threshold + 1))
    return f"""case when abs(size({a}) - size({b})) <= {threshold} then
        aggregate(if(size({b}) > 0, sequence(0, size({b}) - 1), cast(array() as array<int>)), named_struct({first}),
                  (x, j) -> {step}, z -> case {levels} end) end"""


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Lines of at least ``least_chars`` characters, without short blank ones: document (``k``, ``tag``), ``pos`` from 0, ``line``, its length and its digests."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Digests of a text are made below the generator, once.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("k"), F.xxhash64(text).alias("tag"), F.split(text, "\n").alias("lines"))
    rows = rows.select("k", "tag", F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("n", F.char_length("line")).where((F.col("n") >= least_chars) & ((F.col("n") >= LEAST_BLANK) | F.col("line").rlike(r"\S")))
    return rows.select("k", "tag", "pos", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of different lines within ``threshold`` edits: digests ``a1``, ``a2``, ``b1``, ``b2`` and ``edits``.

    ``lines`` needs ``line``, ``n``, ``h1``, ``h2``; repeated lines meet as one. Each pair comes once.
    Lines of at most ``threshold`` characters have no links, as any two of them would be within it.
    """
    keyed = with_segment_keys(lines.select("h1", "h2", "line", "n"), threshold)
    # Counted before the shuffle, so that a line that stands in very many documents is one row per task.
    met = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max(F.col("indexed").cast("int")).alias("any"))
    met = stage(met.where((F.col("low") != F.col("high")) & (F.col("any") == 1)).select("key"))
    if met.count() <= SENT_KEYS:
        found = keyed.join(F.broadcast(met), "key")
    else:
        found = rows_of_slots(keyed, met).join(met, "key")
    members = found.groupBy("key", "h1", "h2", "indexed").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    counted = [(F.col("n") - F.char_length(F.replace(F.col("line"), F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    members = stage(members.select("*", *counted))
    named = lambda side: [F.col(c).alias(f"{side}{i}") for c, i in (("h1", 1), ("h2", 2), ("line", ""), ("n", "n"), *((f"c{i}", f"c{i}") for i in range(len(COUNTED))))]
    a, b = members.where("indexed").select("key", *named("a")), members.select("key", *named("b"))
    smaller = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    differ = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    # An edit changes the counts of characters by two in all, at most.
    apart = sum((F.abs(F.col(f"ac{i}") - F.col(f"bc{i}")) for i in range(len(COUNTED))), F.lit(0))
    pairs = a.join(b, "key").where((apart <= 2 * threshold) & differ & ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & smaller)))
    # A pair that shares several segments is verified once; pairs are dealt to all tasks, as each is some work.
    pairs = pairs.groupBy("a1", "a2", "b1", "b2").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "a1", "b1").withColumn("a", F.split("a", "")).withColumn("b", F.split("b", ""))
    found = pairs.select("a1", "a2", "b1", "b2", F.explode(F.array(F.expr(edit_expression("a", "b", threshold)))).alias("edits"))
    return found.where(F.col("edits").isNotNull())


def line_decisions(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document (``k``, ``tag``) with something to tell: places ``removed``, and ``n_links`` of its lines."""
    lines = lines_of(docs, id_col, text_col, least_chars)
    links = stage(edit_links(lines, threshold))
    # Lines of a document first, then of all: fixed-size values, combined before the shuffle.
    places = stage(lines.select("k", "tag", "pos", "h1", "h2"))
    own = places.groupBy("h1", "h2", "k").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    own = stage(own)
    first_k = own.groupBy("h1", "h2").agg(F.min("k").alias("k"), F.sum("n").alias("n"))
    first = first_k.join(own.select("h1", "h2", "k", "pos"), ["h1", "h2", "k"])
    both = links.select("a1", "a2", "b1", "b2").union(links.select("b1", "b2", "a1", "a2"))
    linked = both.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct()
    starts = stage(first.join(linked, ["h1", "h2"]).select("h1", "h2", "k", "pos"))
    mine = starts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("k").alias("ka"), F.col("pos").alias("pa"))
    other = starts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("k").alias("kb"), F.col("pos").alias("pb"))
    earlier = F.expr("kb < ka or (kb = ka and (pb < pa or (pb = pa and (b1 < a1 or (b1 = a1 and b2 < a2)))))")
    near = both.join(mine, ["a1", "a2"]).join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2"))
    near = near.agg(F.count(F.lit(1)).alias("n_links"), F.max(earlier).alias("late"))
    told = first.join(near, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("n_links").isNotNull())
    told = stage(told.select("h1", "h2", F.col("k").alias("first_k"), F.col("pos").alias("first_pos"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("late", F.lit(False)).alias("late")))
    rows = places.join(told, ["h1", "h2"])
    gone = F.col("late") | (F.col("k") != F.col("first_k")) | (F.col("pos") != F.col("first_pos"))
    # A set of places: rows given twice tell the same once.
    told = rows.groupBy("k", "tag").agg(F.collect_set(F.struct("pos", gone.alias("gone"), "n_links")).alias("told"))
    removed = F.transform(F.filter("told", lambda x: x["gone"]), lambda x: x["pos"])
    return told.select("k", "tag", removed.alias("removed"), F.aggregate("told", F.lit(0).cast("long"), lambda n, x: n + x["n_links"]).alias("n_links"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with repeated and nearly repeated lines taken out of the text.

    Lines end at line feeds and are compared over all documents. A line goes when an equal one, or a
    different one within ``threshold`` edits, first stands earlier: in a document with a smaller id, or
    earlier in the same one. Decisions come from the input, not from what is left. Lines of fewer than ``least_chars`` characters
    and blank ones of fewer than ``LEAST_BLANK`` stay; those of at most ``threshold`` characters go for equal ones only. A
    document whose lines all go keeps its row, with an empty text. A null text stays null; a null id
    comes before all others; rows with one id are compared by places alone, so a row given twice
    stays as it is. The columns ``n_lines``, ``n_removed`` and ``n_links`` (different lines within the
    threshold, summed over the document's lines) are added, or replace columns of these names.
    """
    told = line_decisions(docs, threshold, least_chars, id_col, text_col)
    names = {c: f"_line_{c}" for c in ("k", "tag", "removed", "n_links")}
    told = told.select(*[F.col(c).alias(n) for c, n in names.items()])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(FIRST_ID)) == told["_line_k"]) & (F.xxhash64(text) == told["_line_tag"])
    joined = docs.join(told, same, "left").withColumn("_line_split", F.split(text, "\n"))
    split = F.col("_line_split")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_line_removed"))
    left = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    some = F.size("_line_removed") > 0  # null (no line to tell of) keeps the text
    added = {
        "n_lines": F.when(docs[text_col].isNotNull() & (F.length(text) > 0), F.size(split)).otherwise(0).cast("long"),
        "n_removed": F.greatest(F.lit(0), F.coalesce(F.size("_line_removed"), F.lit(0))).cast("long"),
        "n_links": F.coalesce("_line_n_links", F.lit(0)).cast("long"),
    }
    plain = [docs[c] if c != text_col else F.when(some, left).otherwise(docs[c].cast("string")).alias(c) for c in docs.columns if c not in added]
    return joined.select(*plain, *[v.alias(c) for c, v in added.items()])
