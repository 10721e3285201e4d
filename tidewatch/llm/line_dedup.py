r"""Line dedup by winnowing over line hashes, then over words. DataFrame functions only.

The rows are numbered and written once, dealt by these numbers, so that every step sees the same numbers and finds the texts where they are: no later join sends a text. Positions are ordered by document id, then row, then place.

Lines (split at \n, trimmed; those of white space only are passed over):

1. Windows: from every line the fewest lines that hold LEAST words. The line with the least hash in a window (the last of equal ones) is selected as a fingerprint. Every run of whole lines that holds LEAST words has such a window, so its copies select a common line.
2. The positions of equal fingerprints are joined by a count of each; texts that hold a fingerprint which stands elsewhere too go on.
3. Matches are extended both ways: in those texts the window that begins at a line and the one that ends at it are joined to their first position in the corpus, and the lines of every later position go. A run of equal lines that holds LEAST words is covered by such windows, whichever copy of it is the first, so no part of it has to share its first copy with another part.

Words (split at white space), for passages that begin or end inside a line or are wrapped at other places, in the lines that are left and less than GRAM words around them:

4. Only words that reach into a line that is left take part. Of any WINDOW places in a row that GRAM words begin at, one at least is selected by these words alone: all words with a hash in the least 1/SHARE, and in windows without one the least hash (the last of equal ones). The fingerprint is the hash of the GRAM words from there on. Copies of GRAM + WINDOW - 1 words select a common one.
5. The words of a fingerprint's later positions go. As selected places are no more than WINDOW apart, these stretches meet within a copied passage; it can reach past the first and the last one by fewer than GRAM words.
6. So matches are extended both ways there: around all positions of a fingerprint at such an end GRAM words from every few words on, and then from every word on, are looked up in the same way, and the words of later positions go.
7. Within one text, a stretch is no copy of itself: a later position counts only GRAM words or more after the first one and after the one before.

The first position of a line or of GRAM words never goes, so what is deleted has an equal before it that stays. Hashes of positions that are compared have 128 bits. A line that is left without words goes as a whole; other lines keep their other words and their line break.

Defined results: a null or empty text has no lines to delete. Within a document later copies of a run go too. n_deleted counts the lines that go as a whole. Rows that share an id are put in the order of the input's partitions, rows without an id last. An id that is no whole number is ordered by its hash. An empty table gives an empty result. Other columns are not looked at by runs() and kept by dedup(), where one named n_deleted is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACES, checked_broadcast, discard, numbered_by_row, order_key, settle, whole

#: Words that a repeated run of whole lines has at least.
LEAST = 2
GRAM, WINDOW = 25, 25
#: One word in so many is a fingerprint's place by its hash alone.
SHARE = 8
#: So often a stretch without such a place is split at its least hash before its windows are looked at one by one.
ROUNDS = 3
#: Words of a text that a place can tell apart.
PLACES = (1 << 31) - 1
#: Up to so many spans or places of words, listed by text, are broadcast; more are joined by shuffle.
BROADCAST_SPANS = 2_000_000


def wide_hash(x: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("again"), x).alias("b"))


def met_again(places: DataFrame) -> DataFrame:
    """The rows (gram, ...) of the settled places whose gram stands more than once. Most stand once; 64 of their bits leave few of those over."""
    shared = settle(places.groupBy(F.col("gram.a").alias("h")).count().where("count > 1").select("h"))
    met = settle(places.join(checked_broadcast(shared, BROADCAST_IDS), F.col("gram.a") == F.col("h"), "left_semi"))
    discard(shared)
    discard(places)
    return met


def later_positions(places: DataFrame) -> DataFrame:
    """The rows (gram, id, row, idx, ...) of places that don't hold the first position of their gram, with that position's row1 and idx1."""
    first = places.groupBy("gram").agg(F.min(F.struct("id", "row", "idx")).alias("f"))
    return places.join(first.select("gram", F.col("f.row").alias("row1"), F.col("f.idx").alias("idx1")), "gram").where("row <> row1 or idx <> idx1")


def lines_of(rows: DataFrame, least: int) -> DataFrame:
    """id, row, idx (of the line in its text), before and upto (the words before it, and with it), the line that its window selects (h, minus: its place counted backwards), and the windows that begin and end at the line: (gram, idx, to). A window reaches up to the next line, over lines of white space."""
    lines = rows.select("id", "row", F.posexplode_outer(F.split("t", "\n")).alias("idx", "line")).select("id", "row", "idx", F.btrim("line", F.lit(SPACES)).alias("line")).where("line <> ''")
    lines = lines.select("id", "row", "idx", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("again"), "line").alias("h2"), F.size(words_of(F.col("line"))).cast("long").alias("w"))
    # All windows have this one order, so that the lines are sorted once; a line has a word at least, so a window has no more lines than words.
    of_text = Window.partitionBy("row").orderBy("idx")
    so_far = F.sum("w").over(of_text.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(of_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lines = lines.select("*", so_far.alias("upto"), (so_far - F.col("w")).alias("before"), total.alias("total"), F.coalesce(F.lead("idx").over(of_text), F.col("idx") + 1).alias("to"))
    lines = lines.withColumn("held", F.struct("idx", "h", "h2", "to", "before", "upto"))
    a = F.array("held", *[F.lead("held", k).over(of_text) for k in range(1, least)])
    b = F.array(*[F.lag("held", k).over(of_text) for k in range(least - 1, 0, -1)], "held")
    lines = lines.select("*", a.alias("a"), b.alias("b"))
    ahead = F.when(F.col("total") - F.col("before") >= least, F.filter("a", lambda y: y["before"] < F.col("before") + least))
    back = F.when(F.col("upto") >= least, F.filter("b", lambda y: y["upto"] > F.col("upto") - least))
    lines = lines.withColumns({"a": ahead, "b": back})
    window = lambda x: F.when(x.isNotNull(), F.struct(wide_hash(F.transform(x, lambda y: F.struct(y["h"], y["h2"]))).alias("gram"), x[0]["idx"].alias("idx"), F.element_at(x, -1)["to"].alias("to")))
    picked = F.array_min(F.transform("a", lambda y: F.struct(y["h"].alias("h"), (-y["idx"]).alias("minus"))))
    return lines.select("id", "row", "idx", F.col("before").cast("int").alias("before"), F.col("upto").cast("int").alias("upto"), picked.alias("picked"), window(F.col("a")).alias("begins"), window(F.col("b")).alias("ends"))


def line_runs(rows: DataFrame, least: int) -> DataFrame:
    """row, gone (the united spans of deleted lines) and left (the words of the other lines, null without any) of the texts with deleted lines."""
    lines = settle(lines_of(rows, least))
    prints = lines.where("picked is not null").select("row", "picked.h", "picked.minus")
    # Windows of one text can select the same line; positions differ if their least and greatest do.
    shared = prints.groupBy("h").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("row", "minus") for f in (F.min, F.max)]).where("min_row < max_row or min_minus < max_minus").select("h")
    met = settle(prints.join(shared, "h", "left_semi").select("row").distinct())
    both = F.explode(F.array_distinct(F.filter(F.array("begins", "ends"), lambda x: x.isNotNull())))
    windows = lines.join(checked_broadcast(met, BROADCAST_IDS), "row", "left_semi").select("id", "row", both.alias("x")).select("id", "row", "x.gram", "x.idx", "x.to")
    windows = met_again(settle(windows))
    gone = settle(merged(later_positions(windows).select("row", "idx", "to")).withColumnRenamed("spans", "gone"))
    stays = lines.select("row", "idx", "before", "upto").join(gone, "row").where(~F.exists("gone", lambda s: (s["from"] <= F.col("idx")) & (F.col("idx") < s["to"])))
    left = stays.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("before").alias("from"), F.col("upto").alias("to")))).alias("left"))
    out = settle(gone.join(left, "row", "left"))
    for done in (lines, met, windows, gone):
        discard(done)
    return out


def words_of(text: Column) -> Column:
    rare = text
    for space in SPACES[1:].replace("\n", ""):
        rare = F.replace(rare, F.lit(space), F.lit(" "))
    # Most texts hold blanks and line breaks only: they are read over twice, not once for each kind.
    text = F.when(F.rlike(text, F.lit(r"[\t\x0B-\r]")), rare).otherwise(text)
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")


def word_hashes(text: Column) -> Column:
    """64 bits of every word: grams are hashed from these, so that each word is read once."""
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


def let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def reaches(idx: Column, gram: int) -> Column:
    """Whether the words from idx on reach into a line that is left."""
    return F.exists("left", lambda r: (r["from"] < idx + gram) & (idx < r["to"]))


def word_prints(rows: DataFrame, gram: int, window: int, share: int) -> DataFrame:
    """id, row, idx (of the word that it begins at) and gram of the selected grams of words, from rows (id, row, t, left): left are the words (from, to) of the lines that are left, null for all."""
    low = F.lit(PLACES).cast("long")
    place = lambda v: (low - v.bitwiseAND(low)).cast("int")
    long = lambda g: g["b"] - g["a"] > window
    places = F.greatest(F.size("words") - (gram - 1), F.lit(0))

    def ranked(g: Column) -> Column:
        """The word's hash above, its place counted backwards below: the least is the last of equal words."""
        return let(g["a"] + 1, lambda at: F.transform(F.slice("words", at + 1, g["b"] - at), lambda x, k: F.shiftleft(x.bitwiseAND(low), 31).bitwiseOR(low - at - k)))

    def of_gap(m: Column) -> Column:
        """The least of each window: the least of 2, 4, 8 ... from each on, as far as a window fits in."""
        least, wide = m, 1
        while wide < window:
            least, wide = let(least, halved(min(wide, window - wide))), wide + min(wide, window - wide)
        return F.transform(F.array_distinct(F.slice(least, F.lit(1), F.size(m) - (window - 1))), place)

    def halved(step: int):
        return lambda x: F.zip_with(x, F.slice(x, F.lit(step + 1), F.size(x)), lambda u, v: F.least(u, v))

    def of_gaps(gaps: Column, rounds: int) -> Column:
        """The least of a gap is that of all windows that hold it; others lie before or after it. Most gaps are done with so, what is left of the rest is looked at window by window."""
        if not rounds:
            return F.flatten(F.transform(gaps, lambda g: let(ranked(g), of_gap)))
        split = F.transform(gaps, lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), place(F.array_min(ranked(g))).alias("p")))
        sides = lambda x: F.array(F.struct(x["a"].alias("a"), x["p"].alias("b")), F.struct(x["p"].alias("a"), x["b"].alias("b")))
        more = lambda found: let(F.filter(F.flatten(F.transform(found, sides)), long), lambda g: F.when(F.size(g) > 0, of_gaps(g, rounds - 1)).otherwise(F.array().cast("array<int>")))
        return let(split, lambda found: F.concat(F.transform(found, lambda x: x["p"]), more(found)))

    def of_text(at: Column) -> Column:
        pairs = F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(places)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.concat(at, let(F.filter(pairs, long), lambda gaps: of_gaps(gaps, ROUNDS)))

    chosen = F.transform(F.slice("words", F.lit(1), places), lambda x, k: F.when(x.bitwiseAND(low) < (PLACES + 1) // share, k).otherwise(-1))
    at = F.filter(let(F.filter(chosen, lambda k: k >= 0), of_text), lambda k: F.col("left").isNull() | reaches(k, gram))
    d = rows.select("id", "row", "left", word_hashes(F.col("t")).alias("words")).select("id", "row", "words", at.alias("at"))
    # The outer form, as for the plain one Spark adds a filter that works all of this out once more.
    return d.select("id", "row", "words", F.explode_outer("at").alias("idx")).where("idx is not null").select("id", "row", "idx", gram_at(gram)).select("id", "row", "idx", wide_hash(F.col("g")).alias("gram"))


def gram_at(gram: int) -> Column:
    return F.slice("words", F.col("idx") + 1, F.lit(gram)).alias("g")


def later_words(places: DataFrame, gram: int) -> DataFrame:
    """gram, row, idx of the later positions, without those of one text that lie within `gram` words of the one before."""
    # The positions in the first one's text come first, so they follow one another in this one order.
    of_gram = Window.partitionBy("gram").orderBy("id", "row", "idx")
    later = places.select("*", F.first("row").over(of_gram).alias("row1"), F.lag("idx").over(of_gram).alias("last"))
    return later.where((F.col("row") != F.col("row1")) | (F.col("idx") - F.col("last") >= gram)).select("gram", "row", "idx")


def word_runs(rows: DataFrame, gram: int, window: int, share: int) -> DataFrame:
    """row, idx and to of the later copies of grams of words, from rows (id, row, t, left)."""
    places = met_again(settle(word_prints(rows, gram, window, share)))
    later = settle(later_words(places, gram))
    coarse = int(gram**0.5) + 1
    for step, reach in ((coarse, gram - 1), (1, coarse - 1)):
        was = places, later
        # Only places that are met again can be the ends of a copy, so no round sends the others.
        places = met_again(settle(around(rows, places, later, gram, step, reach)))
        later = later.unionByName(later_words(places, gram))
        if step > 1:
            later = settle(later)
            discard(was[1])
        discard(was[0])
    return later.select("row", "idx", (F.col("idx") + gram).alias("to"))


def around(rows: DataFrame, places: DataFrame, later: DataFrame, gram: int, step: int, reach: int) -> DataFrame:
    """id, row, idx and gram at every step up to `reach` words before and after a copied passage's ends, in the later texts and at all places of the grams that stand there."""
    of_text = Window.partitionBy("row").orderBy("idx")
    ends = later.select("gram", (F.col("idx") - F.coalesce(F.lag("idx").over(of_text), F.lit(-gram - 1)) > gram).alias("before"), (F.coalesce(F.lead("idx").over(of_text), F.lit(PLACES)) - F.col("idx") > gram).alias("after"))
    ends = ends.where(F.col("before") | F.col("after")).groupBy("gram").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    steps = F.lit(reach // step * step)
    range_of = F.sequence(F.col("idx") - F.when(F.col("before"), steps).otherwise(0), F.col("idx") + F.when(F.col("after"), steps).otherwise(0), F.lit(step))
    at = places.join(ends, "gram").select("row", range_of.alias("a")).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"))
    texts = rows.join(small(settle(at), "a"), "row").select("id", "row", "a", "left", word_hashes(F.col("t")).alias("words"))
    fits = lambda k: (k >= 0) & (k <= F.size("words") - gram) & (F.col("left").isNull() | reaches(k, gram))
    near = texts.select("id", "row", "words", F.filter("a", fits).alias("a")).select("id", "row", "words", F.explode_outer("a").alias("idx")).where("idx is not null")
    return near.select("id", "row", "idx", gram_at(gram)).select("id", "row", "idx", wide_hash(F.col("g")).alias("gram"))


def merged(spans: DataFrame) -> DataFrame:
    """row and spans: the united spans (idx, to) of every row, in order and apart."""
    before = Window.partitionBy("row").orderBy("idx", "to").rowsBetween(Window.unboundedPreceding, -1)
    parts = spans.withColumn("new", F.coalesce(F.col("idx") > F.max("to").over(before), F.lit(True)).cast("int"))
    parts = parts.withColumn("island", F.sum("new").over(Window.partitionBy("row").orderBy("idx", "to")))
    parts = parts.groupBy("row", "island").agg(F.min("idx").alias("from"), F.max("to").alias("to"))
    return parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


def small(settled: DataFrame, *columns: str) -> DataFrame:
    """A settled frame to join the rows with, broadcast if its arrays have BROADCAST_SPANS values or fewer; beyond that it is sent to where the rows are dealt by their numbers, and the texts are neither sent nor sorted."""
    values = sum((F.greatest(F.size(c), F.lit(0)) for c in columns), F.lit(0))
    return F.broadcast(settled) if (settled.agg(F.sum(values)).first()[0] or 0) <= BROADCAST_SPANS else settled.hint("shuffle_hash")


def replaced(items: Column, spans: Column, put) -> Column:
    """The array of items with put(items) in place of the items of every span."""
    ends, size = F.transform(spans, lambda s: s["to"]), F.size(items)
    kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(F.transform(spans, lambda s: s["from"]), F.array(size)), lambda a, b: F.slice(items, a + 1, b - a))
    gone = F.transform(spans, lambda s: put(F.slice(items, s["from"] + 1, s["to"] - s["from"])))
    return F.flatten(F.transform(F.arrays_zip(kept.alias("kept"), F.concat(gone, F.array(F.array().cast("array<string>"))).alias("gone")), lambda x: F.concat(x["kept"], x["gone"])))


def marked(docs: DataFrame, id_col: str, text_col: str, gram: int, window: int, least: int, share: int) -> DataFrame:
    """The numbered rows of docs, and lines: (line without its deleted words, gone) of the texts with something to delete, null for others."""
    own, row_id, text = numbered_by_row(docs, id_col, text_col)
    rows = own.select("row", order_key(row_id).alias("id"), whole(text).alias("t"))
    lines = line_runs(rows, least)
    texts = rows.join(small(lines, "gone"), "row", "left").where("gone is null or left is not null").select("id", "row", "t", "left")
    words = merged(word_runs(texts, gram, window, share))
    cuts = settle(lines.select("row", "gone").join(words, "row", "full"))
    rows = own.join(small(cuts, "gone", "spans"), "row", "left").withColumn("t", whole(text))
    # A text does not hold a mark of its own hash.
    rows = rows.withColumn("mark", F.concat(F.lit("\0"), F.hex(F.xxhash64("t"))))
    without = lambda x: F.array(F.regexp_replace(F.array_join(x, ""), F.lit(r"[^\n]+"), F.col("mark")))
    # Tokens and lines are columns of their own, so that they are split once and not for every span.
    rows = rows.withColumn("tokens", F.when(F.col("spans").isNotNull(), F.split(F.ltrim("t", F.lit(SPACES)), r"(?<=\s)(?=\S)")))
    cut = F.concat(F.regexp_extract("t", r"^\s*", 0), F.array_join(replaced(F.col("tokens"), F.col("spans"), without), ""))
    rows = rows.withColumn("cut", F.split(F.when(F.col("spans").isNotNull(), cut).when(F.col("gone").isNotNull(), F.col("t")), "\n"))
    blank = lambda line: F.btrim(line, F.lit(SPACES)) == ""
    lines_gone = replaced(F.col("cut"), F.col("gone"), lambda x: F.transform(x, lambda line: F.when(blank(line), line).otherwise(F.col("mark"))))
    rows = rows.withColumn("cut", F.when(F.col("gone").isNotNull(), lines_gone).otherwise(F.col("cut")))
    bare = lambda line: F.replace(line, F.col("mark"), F.lit(""))
    empty = lambda line: F.contains(line, F.col("mark")) & blank(bare(line))
    return rows.withColumn("lines", F.transform("cut", lambda line: F.struct(bare(line).alias("line"), empty(line).alias("gone")))).drop("mark", "cut", "tokens", "gone", "spans")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """row and pos of every line that is deleted as a whole."""
    lines = marked(docs, id_col, text_col, gram, window, least, share).select("row", F.posexplode("lines").alias("pos", "x"))
    return lines.where("x.gone").select("row", "pos")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The columns of docs, the text without the deleted lines and words, and n_deleted put last."""
    rows = marked(docs, id_col, text_col, gram, window, least, share)
    kept = F.filter("lines", lambda x: ~x["gone"])
    left = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    shown = [F.when(F.col("lines").isNull(), F.col(f"c{k}")).otherwise(left).alias(n) if n == text_col else F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns) if n != "n_deleted"]
    return rows.select(*shown, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size(kept)).alias("n_deleted"))
