"""Line dedup: a suffix array over line ids by distributed prefix doubling.

A document is the sequence of its lines that hold a word; a line's id is its MD5. Runs of lines
that occur again, within or across documents, and that hold at least MIN_WORDS words, lose
every copy but the first (in order of doc_id, nulls first, then text hash and place).

1. Lines that occur once part the sequences into segments of repeated lines. Segments of fewer
   than MIN_WORDS words can't hold a run. Equal segments are collapsed: all but the first are
   later copies as a whole, and only the first takes part in what follows, so that thousands
   of copies of a document cost no more than one.
2. Suffix array by prefix doubling. Every suffix of a segment has a number `at` that counts on
   through the segment, in the order of first copies. Round k ranks all suffixes by their first
   2^k lines: the distinct pairs (rank, rank 2^(k-1) lines further on) are range-partitioned and
   sorted; a pair's place in that order is the new rank, joined back to the suffixes. Distinct
   pairs are taken first, so that a line with a third of all rows is one row in the sort. Rounds
   go on until 2^k reaches the longest segment: then the order is complete, and suffixes of one
   rank are equal to their ends. The array's places `sa` are counted through range partitions.
3. Longest common prefixes of neighbours in the array: the highest level at which two suffixes
   have one rank tells how many lines at least they share; the next step begins after these, until
   nothing more is shared. That takes no more steps than there were rounds, each on the pairs left.
4. Intervals. Suffixes that share their first n lines are an interval of the array: it begins where
   the prefix shared with the neighbour before is shorter than n. The first suffix of an interval is
   the first copy, all others are later ones. It is enough to ask for the shortest windows of
   MIN_WORDS words that begin, and those that end, at each line: any longer repeated run is covered
   by its own such windows, and each of these is repeated where the run is. What is deleted is thus
   exactly the later copies of all maximal repeated runs of at least MIN_WORDS words.

Lines without a word are kept as they are. Cases: a null or empty text stays as it is; rows
equal in doc_id and text count as one document and are treated alike; lines are compared whole,
with case and white space; other columns pass through, and n_chars, if there, is counted anew;
an empty table gives no rows. In the stage, a document that loses all its lines is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, joined_anew, let, table

MIN_WORDS = 50
DOC = ("doc_id", "th")
SEG = (*DOC, "island")


def _text_hash() -> Column:
    return F.xxhash64("text")


def _spoken(text: Column) -> Column:
    """The lines that hold a word, with their numbers."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(WORD))


def segments(docs: DataFrame, min_words: int) -> DataFrame:
    """Maximal runs of repeated lines: SEG, start, hs (line ids), ws (word counts) and sig."""
    lines = docs.select("doc_id", _text_hash().alias("th"), F.posexplode(_spoken(F.col("text"))).alias("seq", "s"))
    lines = lines.select(*DOC, "seq", F.unhex(F.md5(F.encode("s.x", "UTF-8"))).alias("h"), F.regexp_count("s.x", F.lit(WORD)).alias("w"))
    again = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    # From here on everything is by document: one shuffle serves all that follows.
    own = joined_anew(lines, again, ["h"], "left_semi").repartition(*DOC).dropDuplicates([*DOC, "seq"])
    at = Window.partitionBy(*DOC).orderBy("seq")
    own = own.withColumn("island", F.col("seq") - F.row_number().over(at))
    whole = own.groupBy(*SEG).agg(F.sum("w").alias("words"), F.sort_array(F.collect_list(F.struct("seq", "h", "w"))).alias("l")).where(F.col("words") >= min_words)
    hs = F.transform("l", lambda x: x["h"])
    return whole.select(*SEG, F.col("l")[0]["seq"].alias("start"), hs.alias("hs"), F.transform("l", lambda x: x["w"]).alias("ws"), F.unhex(F.md5(F.to_binary(F.array_join(F.transform(hs, lambda h: F.hex(h)), ""), F.lit("hex")))).alias("sig"))


def _ranked(keys: DataFrame) -> DataFrame:
    """keys, which are distinct, with their place in the order of all of them."""
    names = keys.columns
    return keys.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("rank", F.monotonically_increasing_id())


def suffixes(reps: DataFrame) -> DataFrame:
    """Every suffix of the segments reps (SEG, start, hs, ws): at, pos, left (lines from there to the end), h, and at pos 0 the segment's ws."""
    ordered = reps.repartitionByRange(*SEG).sortWithinPartitions(*SEG)
    rows = ordered.select(*DOC, "start", "ws", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    rows = rows.withColumns({"at": F.monotonically_increasing_id(), "left": F.col("n") - F.col("pos")})
    return cut(rows.select("at", "pos", "left", "h", *DOC, "start", F.when(F.col("pos") == 0, F.col("ws")).alias("ws")))


def prefix_ranks(lines: DataFrame, rounds: int) -> DataFrame:
    """lines (at, pos, left, h) with r0 to r<rounds: the order of the first 2^k lines from there."""
    state = cut(lines.select("at", (F.col("at") - F.col("pos")).alias("top"), "left", "h").join(_ranked(lines.select("h").distinct()), "h").withColumnRenamed("rank", "r0").drop("h"))
    inside = Window.partitionBy("top").orderBy("at")
    for k in range(1, rounds + 1):
        # Beyond the end of a segment comes -1, which sorts first.
        paired = state.withColumn("next", F.coalesce(F.lead(f"r{k - 1}", 1 << (k - 1)).over(inside), F.lit(-1).cast("long")))
        ranks = _ranked(paired.select(f"r{k - 1}", "next").distinct())
        state = cut(paired.join(ranks, [f"r{k - 1}", "next"]).withColumnRenamed("rank", f"r{k}").drop("next"))
    return state


def _in_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in their order, with the range partition (part) that each is in and its number there (nth)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    return cut(placed.withColumns({"part": part, "nth": F.col("__id") - F.shiftleft(part, 33)}).drop("__id"))


def suffix_array(ranked: DataFrame, rounds: int) -> DataFrame:
    """sa, at, and lcp: the lines that a suffix shares with the one before it in the array. Equal suffixes lie in the order of at."""
    levels = F.array(*[f"r{k}" for k in range(rounds + 1)]).alias("r")
    placed = _in_parts(ranked.select("at", "left", levels, F.col(f"r{rounds}").alias("rank")), ["rank", "at"]).drop("rank")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    array = cut(placed.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("nth")).alias("sa"), "at", "left", "r"))
    other = array.select((F.col("sa") + 1).alias("sa"), F.col("at").alias("other"), F.col("left").alias("other_left"), F.col("r").alias("other_r"))
    pairs = array.join(other, "sa").select("sa", "at", "other", F.least("left", "other_left").alias("most"), F.lit(0).alias("lcp"), "r", "other_r")
    done = array.where("sa = 0").select("sa", "at", F.lit(0).alias("lcp"))
    ranks = array.select("at", "r")
    for _ in range(rounds + 2):
        equal = F.size(F.filter(F.zip_with("r", "other_r", lambda a, b: a == b), lambda x: x))
        # Ranks that are equal beyond the end of a segment tell of two ends.
        step = pairs.withColumn("__e", equal).withColumn("lcp", F.when(F.col("__e") > 0, F.least(F.col("lcp") + F.pow(F.lit(2), F.col("__e") - 1).cast("int"), F.col("most"))).otherwise(F.col("lcp")))
        step = cut(step.select("sa", "at", "other", "most", "lcp", ((F.col("__e") > 0) & (F.col("lcp") < F.col("most"))).alias("open")))
        done = done.unionAll(step.where("not open").select("sa", "at", "lcp"))
        open_ = step.where("open").drop("open")
        if open_.isEmpty():
            break
        here = ranks.select(F.col("at").alias("__at"), "r")
        there = ranks.select(F.col("at").alias("__other"), F.col("r").alias("other_r"))
        pairs = open_.join(here, F.col("at") + F.col("lcp") == F.col("__at")).join(there, F.col("other") + F.col("lcp") == F.col("__other")).drop("__at", "__other")
    return done


def intervals(asked: DataFrame) -> DataFrame:
    """asked (sa, lcp, n, ...) with `first`, the place in the array where the interval of the suffixes that share n lines begins.

    Suffixes that share n lines ask for n alike, so that between them in the order of n and sa lies no other.
    """
    placed = _in_parts(asked, ["n", "sa"])
    begin = F.when(F.col("lcp") < F.col("n"), F.col("sa"))
    upto = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    last = placed.groupBy("part").agg(F.max_by(begin, F.when(begin.isNotNull(), F.col("nth"))).alias("begin"))
    carried = last.select("part", F.last("begin", ignorenulls=True).over(before).alias("carried"))
    run = placed.withColumn("begin", F.last(begin, ignorenulls=True).over(upto))
    return run.join(F.broadcast(carried), "part").withColumn("first", F.coalesce("begin", "carried")).drop("begin", "carried", "part", "nth")


def _windows(ws: Column, min_words: int) -> Column:
    """(start, lines) of the shortest windows of min_words words from, and up to, each line."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))

    def needed(some: Column) -> Column:
        add = lambda a, w: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n")))
        return let(F.aggregate(some, zero, add), lambda a: F.when(a["sum"] >= min_words, a["n"]))

    ahead = F.transform(ws, lambda _, i: F.struct(i.alias("s"), needed(F.slice(ws, i + 1, F.lit(min_words))).alias("n")))

    def back(_: Column, i: Column) -> Column:
        low = F.greatest(i - (min_words - 1), F.lit(0))
        return let(needed(F.reverse(F.slice(ws, low + 1, i - low + 1))), lambda n: F.struct((i - n + 1).alias("s"), n.alias("n")))

    return F.array_distinct(F.filter(F.concat(ahead, F.transform(ws, back)), lambda x: x["n"].isNotNull()))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC and gone: the (first, last) numbers among a document's spoken lines that are later copies."""
    segs = cut(segments(docs, min_words))
    which = F.struct(*SEG, "start")
    firsts = cut(segs.groupBy("sig").agg(F.min(which).alias("o"), F.any_value("hs").alias("hs"), F.any_value("ws").alias("ws")))
    ids = segs.select("sig", *SEG, "start", F.size("hs").alias("n"))
    ids = joined_anew(ids, firsts.select("sig", "o"), ["sig"])
    copied = ids.where(which != F.col("o")).select(*DOC, F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    lines = suffixes(firsts.select("o.*", "hs", "ws"))
    longest = lines.agg(F.max("left")).first()[0] or 1
    rounds = (longest - 1).bit_length()
    array = suffix_array(prefix_ranks(lines, rounds), rounds)
    heads = lines.where("pos = 0").select(F.col("at").alias("top"), *DOC, "start", "ws")
    asked = heads.select("top", F.explode(_windows(F.col("ws"), min_words)).alias("w")).select("top", (F.col("top") + F.col("w.s")).alias("at"), "w.n")
    ends = cut(intervals(asked.join(array, "at")))
    interval = ends.groupBy("n", "first").agg(F.min("at").alias("o"), F.count(F.lit(1)).alias("members")).where("members > 1").select("n", "first", "o")
    run = joined_anew(ends, interval, ["n", "first"]).where(F.col("at") != F.col("o")).select("top", "at", "n")
    inside = run.join(heads.select("top", *DOC, "start"), "top")
    first = F.col("start") + F.col("at") - F.col("top")
    parts = inside.select(*DOC, first.cast("int").alias("first"), (first + F.col("n") - 1).cast("int").alias("last"))
    return copied.unionAll(parts).groupBy(*DOC).agg(F.collect_set(F.struct("first", "last")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies in text; __lines and __gone count a document's spoken and deleted lines."""
    found = later_copies(docs, min_words).withColumnsRenamed({"doc_id": "__d", "th": "__t", "gone": "__runs"})
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("__d")) & (_text_hash() == F.col("__t")), "left")

    def numbers(spoken: Column) -> Column:
        """Numbers, among all lines, of the lines that go."""
        return F.array_distinct(F.flatten(F.transform("__runs", lambda g: F.slice(F.transform(spoken, lambda s: s["i"]), g["first"] + 1, g["last"] - g["first"] + 1))))

    def kept(lines: Column, gone: Column) -> Column:
        left = F.array_except(F.transform(lines, lambda _, i: i), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.col("text")
    spoken = _spoken(text)
    changed = let(spoken, lambda s: let(numbers(s), lambda g: let(F.split(text, "\n"), lambda all_: F.struct(kept(all_, g).alias("text"), F.size(g).alias("gone"), F.size(s).alias("lines")))))
    plain = F.struct(text.alias("text"), F.lit(0).alias("gone"), F.coalesce(F.size(spoken), F.lit(0)).alias("lines"))
    out = joined.withColumn("__r", F.when(F.col("__runs").isNotNull(), changed).otherwise(plain))
    made = {"text": F.col("__r.text"), "n_chars": F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("__r.text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    own = [made[c].alias(c) if made.get(c) is not None else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, F.greatest(F.col("__r.lines"), F.lit(0)).alias("__lines"), F.col("__r.gone").alias("__gone"))


def line_dedup_stage(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated runs, and without documents of which nothing is left."""
    out = dedup_lines(docs, min_words)
    return out.where((F.col("__gone") == 0) | (F.col("__gone") < F.col("__lines"))).drop("__lines", "__gone")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__gone").cast("long").alias("n_deleted"), "text")
