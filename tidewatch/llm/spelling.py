r"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the frequent form of each rare one.

    counts(docs)      words of all whole texts and how often they occur
    near_pairs(words) pairs of words one edit apart, each once
    variants(words)   word, form, root, n, n_near, form_n

Search. A word's index entries are its grams of three code points with their positions. One edit spoils three grams of a word at most, so of any four grams of it one stands in the other word too, at the same place if a code point was replaced, and there or one further if one was inserted. Grams are ranked by how many words have them, and the four rarest of every word (ties by text and place) are its keys: the rarest gram that the edit spared is a key of both words. Rows (gram, place, length) -> word are the inverted index, dealt out by Spark; a word probes it at its own keys, with its own length and the length one more. Where they meet, a task has the positional index of the words under the key: for each probing word the postings of all its grams within the limits of length and place are merged by a heap, and words that come up at least as often as the one-edit bound asks for (grams of the longer word less three) are compared code point by code point. Pairs are found under up to four keys and made distinct.

Words of over LONG code points have two halves as their grams, of which one edit spares one, so that a text without a space costs a few copies of it and no million grams.

Bounds: the ranks are a row per gram of three letters of a fixed alphabet of 90 (729,000 at the most, in practice some thousand) and go to the tasks with the code, if they are RANKS_MOST or fewer; beyond that grams are ranked by their hash, which finds the same pairs. A key with over PART_ROWS words is split into parts, and every pair of parts is a group of its own. A group that a task holds has PART_ROWS words and as many probes. A word of n code points has up to some 180 n words that are one edit away, so pairs don't grow with the square of anything.

Defined results: a null text has no words, a null id counts as an empty one in the hash that spoils words. Repeated rows count each time. The form of a word is its near word with the largest count, of several with that count the first in order of code points, if it is `factor` times as frequent as the word or more. Counts grow along forms, so a chain ends after 28 steps at the most. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, settle, slices

RUN = "[A-Za-zÀ-ÿ]"
GRAM = 3
SPOILT = 3
LONG = 200
PART_ROWS = 2048
RANKS_MOST = 200_000
#: Up to so many words with a form are broadcast when roots are followed; more are joined by shuffle.
BROADCAST_FORMS = 200_000
GROUP_ROWS, GROUP_BYTES = 65_536, 16 << 20

ROW = pa.schema([("key", pa.string()), ("side", pa.int8()), ("longer", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
INDEX, PROBE, BOTH = 0, 1, 2


def spoilt(run: Column, doc_id: Column, every: int) -> Column:
    """The run in lower-case A-Z; where its hash with the document's id is a multiple of `every`, without the code point that the hash names."""
    low = F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low), "UTF-8"))
    at = (h % F.length(low)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """word, n. Shorter runs are not cut out at all, as nothing makes them longer."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least_length},}})"))).alias("run"))
    words = runs.select(spoilt(F.col("run"), F.col("id"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def grams(word: str) -> list[tuple[str, int]]:
    return [(word[k : k + GRAM], k) for k in range(len(word) - GRAM + 1)]


def ranks_of(words: DataFrame) -> dict[str, int] | None:
    """The place of each gram in the order of how many words have it; None if there are too many grams to send."""
    every = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda k: F.substring(F.col("word"), k, F.lit(GRAM)))
    own = words.where(F.length("word").between(GRAM, LONG + 1)).select(F.explode(every).alias("gram")).groupBy("gram").count()
    rows = own.limit(RANKS_MOST + 1).collect()
    if len(rows) > RANKS_MOST:
        return None
    return {g: k for k, (_, g) in enumerate(sorted((r["count"], r["gram"]) for r in rows))}


def keys(word: str, rank) -> Iterator[tuple[str, int, int]]:
    """(key, side, longer): where the word stands in the index, and where it looks. longer is 1 for pairs whose second word is one code point longer; which rule they follow depends on the shorter word."""
    size = len(word)
    if size <= LONG + 1:
        first = sorted((rank(g), g, p) for g, p in grams(word))[: SPOILT + 1]
        for _, g, p in first:
            if size <= LONG:
                yield f"0{g}{p}/{size}", BOTH, 0
                yield f"1{g}{p}/{size + 1}", PROBE, 1
                yield f"1{g}{p + 1}/{size + 1}", PROBE, 1
            yield f"1{g}{p}/{size}", INDEX, 1
    if size > LONG:
        half, less = size // 2, (size - 1) // 2
        yield f"2{size}<{word[:half]}", BOTH, 0
        yield f"2{size}>{word[half:]}", BOTH, 0
        yield f"3{size + 1}<{word[:half]}", PROBE, 1
        yield f"3{size + 1}>{word[half:]}", PROBE, 1
        if size - 1 > LONG:
            yield f"3{size}<{word[:less]}", INDEX, 1
            yield f"3{size}>{word[less + 1:]}", INDEX, 1


def one_edit(a: str, b: str) -> bool:
    """Is b a with one code point replaced, or with one more? b is as long as a or one longer."""
    low, high = 0, len(a)
    while low < high:  # the common start, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low:] == b[low + 1 :] if len(b) > len(a) else low < len(a) and a[low + 1 :] == b[low + 1 :]


def postings_of(words: list[str]) -> dict[tuple[str, int], list[int]]:
    """The positional index: numbers of words, ascending, by gram and place."""
    out: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        for g in grams(w):
            out[g].append(k)
    return out


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that come up at least so often in ascending lists. What does so stands in one of the shorter lists even if it stands in all of the least - 1 longest, so a heap merges the shorter ones and the longest are looked up."""
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    last, times = -1, 0
    for k in heapq.merge(*short, [1 << 62]) if len(short) > 1 else (*short[0], 1 << 62):
        if k != last:
            if times and (times >= least or times + sum(stands_in(last, x) for x in long) >= least):
                yield last
            last, times = k, 0
        times += 1


def stands_in(k: int, ascending: list[int]) -> bool:
    at = bisect.bisect_left(ascending, k)
    return at < len(ascending) and ascending[at] == k


def found(index: list[str], probes: list[str], longer: int) -> Iterator[tuple[int, int]]:
    """(probe, index word) one edit apart, by their numbers; of two words of one length the probe is the smaller. The words meet under a key, so all index words have one length and all probes too."""
    if len(probes[0]) > LONG:
        yield from ((q, k) for q, a in enumerate(probes) for k, b in enumerate(index) if (longer or a < b) and one_edit(a, b))
        return
    postings = postings_of(index)
    least = max(1, len(index[0]) - GRAM + 1 - SPOILT)
    for q, a in enumerate(probes):
        lists = [postings[x] for g, p in grams(a) for x in ((g, p), (g, p + 1))[: 1 + longer] if x in postings]
        # A gram that all have, as the key they meet under, is counted and not merged.
        part = [x for x in lists if len(x) < len(index)]
        rest = least - (len(lists) - len(part))
        for k in merged(part, rest) if rest > 0 else range(len(index)):
            if (longer or a < index[k]) and one_edit(a, index[k]):
                yield q, k


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to about GROUP_ROWS rows or GROUP_BYTES bytes that end where the first column's value changes."""
    held: list[pa.RecordBatch] = []
    for b in slices(batches, 4096):
        held.append(b)
        if sum(x.num_rows for x in held) >= GROUP_ROWS or sum(x.nbytes for x in held) >= GROUP_BYTES:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = pc.index(one.column(0), one.column(0)[one.num_rows - 1]).as_py()
            if cut:
                yield one.slice(0, cut)
            held = [one.slice(cut)]
    if held and (last := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield last[0]


def keyed(words: DataFrame) -> DataFrame:
    """key, side, longer, word, n: every word under its keys."""
    ranks = ranks_of(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = (lambda g: hash_rank(g)) if ranks is None else (lambda g: ranks.get(g, -1))
        for b in slices(batches, 2048):
            rows = [(*k, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in keys(w, rank)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROW.types)], schema=ROW)

    return words.select("word", "n").mapInArrow(run, "key string, side byte, longer byte, word string, n long")


def hash_rank(gram: str) -> int:
    """An order of grams that every task makes alike."""
    h = 0
    for c in gram:
        h = (h * 1_000_003 ^ ord(c)) & 0xFFFFFFFF
    return h


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the words (word, n) that are one edit apart, each pair once. words should be settled, as they are read twice."""
    rows = settle(keyed(words).withColumn("group", F.xxhash64("key")).drop("key"))
    large = settle(rows.groupBy("group").agg(F.sum((F.col("side") != PROBE).cast("long")).alias("i"), F.sum((F.col("side") != INDEX).cast("long")).alias("p")).where(f"i > {PART_ROWS} or p > {PART_ROWS}"))
    ways = lambda c: F.ceil(F.col(c) / PART_ROWS).cast("int")
    marked = rows.join(checked_broadcast(large, 1_000_000), "group", "left")
    plain = marked.where("i is null").select("group", "side", "longer", "word", "n")
    both = marked.where("i is not null").select("*", F.explode(F.when(F.col("side") == BOTH, F.array(F.lit(INDEX), F.lit(PROBE))).otherwise(F.array(F.col("side").cast("int")))).alias("as"))
    here = F.when(F.col("as") == INDEX, F.pmod(F.xxhash64("word"), F.greatest(ways("i"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("word"), F.greatest(ways("p"), F.lit(1))))
    others = F.sequence(F.lit(0), F.greatest(F.when(F.col("as") == INDEX, ways("p")).otherwise(ways("i")), F.lit(1)) - 1)
    cells = both.withColumn("own", here).withColumn("other", F.explode(others))
    cell = F.when(F.col("as") == INDEX, F.concat_ws("|", "group", "own", "other")).otherwise(F.concat_ws("|", "group", "other", "own"))
    split = cells.select(F.xxhash64(cell).alias("group"), F.col("as").cast("byte").alias("side"), "longer", "word", "n")
    dealt = plain.unionByName(split).repartition("group").sortWithinPartitions("group", "longer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            group = b.column(0).to_numpy()
            starts = [0, *((group[1:] != group[:-1]).nonzero()[0] + 1).tolist(), len(group)]
            side, longer, word, n = (b.column(k).to_pylist() for k in range(1, 5))
            out = []
            for lo, hi in zip(starts, starts[1:]):
                if hi - lo < 2:
                    continue
                # Two keys can share a hash: rows are told apart by their kind and by what they search for.
                kinds = defaultdict(lambda: ([], []))
                for k in range(lo, hi):
                    if side[k] != PROBE:
                        kinds[longer[k], len(word[k])][0].append(k)
                    if side[k] != INDEX:
                        kinds[longer[k], len(word[k]) + longer[k]][1].append(k)
                for (more, _), (index, probes) in kinds.items():
                    if index and probes:
                        for q, k in found([word[k] for k in index], [word[k] for k in probes], more):
                            out.append((word[probes[q]], n[probes[q]], word[index[k]], n[index[k]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "n_a", "b", "n_b"])

    return dealt.mapInArrow(run, "a string, n_a long, b string, n_b long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, from rows (word, form). The steps double, so five rounds serve chains of 28."""
    reached = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        nexts = checked_broadcast(reached.select(F.col("word").alias("via"), F.col("root").alias("beyond")), BROADCAST_FORMS)
        step = settle(reached.join(nexts, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(reached)
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row (word, n) of settled words."""
    pairs = settle(near_pairs(words))
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("top"))
    m = -F.col("top.minus")
    own = words.join(best, "word", "left")
    frequent = F.coalesce(m >= factor * F.col("n"), F.lit(False))
    told = settle(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("top.other")).alias("form"), F.when(frequent, m).alias("form_n")))
    ended = roots(told.where("form is not null").select("word", "form"))
    return told.join(checked_broadcast(ended, BROADCAST_FORMS), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of all texts."""
    return variants(settle(counts(docs, id_col, text_col)))
