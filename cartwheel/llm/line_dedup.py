"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared in lower case with white space trimmed and runs of it as
one space. A line goes when an earlier line (by document id, then line
number) is equal or, for lines of ``min_length`` characters and more,
within an edit distance of one; the earliest stays. Blank lines stay.

One edit means: both lines without the substituted character are equal, or
the longer one without the inserted character equals the shorter one. So each
line emits hashes of its variants with one character deleted, and lines with
equal hashes are linked: those with the same deleted position to the
earliest of them, longer lines to the shorter line that is their variant.
Links number as many as variants, never as many as pairs, and every link
is verified by ``levenshtein``.

Most lines have no neighbour, and emitting a variant per character for them
would be wasted. Two sieves lose no pair: one edit leaves the first or the
last half as it is, and of ``SEGMENTS`` segments all but one, so only lines
that share a half, and then all segments but one, with another line go on,
and only with variants in that segment.

Cases: a null text is an empty one; null ids sort after all ids; rows that
repeat an id count as one document whose lines are numbered per row;
lines with the same position are ties and don't drop each other; an empty
table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm import common

SEGMENTS = 8
MIN_LENGTH = 16
#: line numbers below this; positions are document id times this plus line number.
LINE_ROOM = 2**31
#: stands for a null id: above every long.
NO_ID = Decimal(10**19)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\n\x0b\f\r]+", " ")))


def position(id_col: Column) -> Column:
    """A number that orders (id, line number), null ids last."""
    number = F.coalesce(id_col.cast("decimal(20,0)"), F.lit(NO_ID))
    return (number * F.lit(Decimal(LINE_ROOM))).cast("decimal(38,0)")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of every line, normalised."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "raw")
    return docs.select(F.col(id_col).alias("doc_id"), lines).select("doc_id", "line_no", normal(F.col("raw")).alias("line"))


def first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc_id, line_no, pos, size, line): each different line with text, at its first position."""
    found = occurrences(docs, id_col, text_col).filter("line <> ''")
    keyed = found.withColumn("pos", (position(F.col("doc_id")) + F.col("line_no")).cast("decimal(38,0)"))
    firsts = keyed.groupBy("line").agg(F.min("pos").alias("pos"))
    line_no = F.pmod(F.col("pos"), F.lit(Decimal(LINE_ROOM)))
    doc = ((F.col("pos") - line_no) / F.lit(Decimal(LINE_ROOM))).cast("decimal(20,0)")
    doc_id = F.when(doc < F.lit(NO_ID), doc).cast(docs.schema[id_col].dataType)
    return firsts.select(
        F.monotonically_increasing_id().alias("id"), doc_id.alias("doc_id"), line_no.cast("int").alias("line_no"), "pos", F.length("line").alias("size"), "line"
    )


def sharing(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, id, ...) whose key belongs to two or more lines."""
    shared = common.staged(keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key"))
    return keyed.join(shared, "key")


def half_keys() -> Column:
    """Hashes of the first and last half, for the line as the shorter and as the longer of a pair."""
    keys = []
    for h in (F.floor(F.col("size") / 2), F.floor((F.col("size") - 1) / 2)):
        h = h.cast("int")
        keys += [F.xxhash64(F.lit("first"), h, F.left("line", h)), F.xxhash64(F.lit("last"), h, F.right("line", h))]
    return F.array_distinct(F.array(*keys))


def segment_keys() -> Column:
    """(key, base, segment): everything but one segment, for the line as the shorter and as the longer of a pair."""
    keys = []
    for shorter_by in (0, 1):
        base = F.col("size") - shorter_by
        for j in range(SEGMENTS):
            low, high = F.floor(base * j / SEGMENTS).cast("int"), F.floor(base * (j + 1) / SEGMENTS).cast("int")
            key = F.xxhash64(base, F.lit(j), F.left("line", low), F.right("line", base - high))
            keys.append(F.struct(key.alias("key"), base.alias("base"), low.alias("low"), high.alias("high")))
    return F.array(*keys)


def without(i: Column) -> Column:
    """The line without its character ``i`` (from 0)."""
    return F.concat(F.left("line", i), F.substring("line", i + 2, F.col("size")))


def variants(placed: DataFrame) -> DataFrame:
    """(key, id, pos, role): hashed variants; role 0: substitution, 1: the shorter line itself, 2: a longer line."""
    same = placed.filter("size = base and high > low")
    swapped = same.select(
        "id", "pos", F.explode(F.transform(F.sequence("low", F.col("high") - 1), lambda i: F.xxhash64(F.lit("swap"), i, without(i)))).alias("key"), F.lit(0).alias("role")
    )
    whole = placed.filter("size = base").select("id", "pos", F.xxhash64(F.lit("gap"), F.col("line")).alias("key"), F.lit(1).alias("role"))
    longer = placed.filter("size = base + 1").select(
        "id", "pos", F.explode(F.transform(F.sequence("low", "high"), lambda i: F.xxhash64(F.lit("gap"), without(i)))).alias("key"), F.lit(2).alias("role")
    )
    return swapped.unionByName(whole).unionByName(longer)


def near_later(lines: DataFrame, min_length: int) -> DataFrame:
    """(id): lines that an earlier line within one edit makes redundant. ``lines`` is stored."""
    long_enough = lines.filter(F.col("size") >= min_length)
    halves = sharing(long_enough.select("id", F.explode(half_keys()).alias("key"))).select("id").distinct()
    sieved = common.stored(long_enough.join(halves, "id", "left_semi"), "line-halves")
    cut = sieved.select("id", F.explode(segment_keys()).alias("s")).select("id", "s.*")
    places = sharing(cut).select("id", "base", "low", "high").distinct()
    placed = common.stored(sieved.join(places, "id"), "line-places")

    emitted = variants(placed).distinct()
    starts = F.min(F.when(F.col("role") != 1, F.col("pos"))).alias("first_other")
    heads = common.staged(
        emitted.groupBy("key").agg(starts, F.min(F.when(F.col("role") == 1, F.col("pos"))).alias("whole"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    # substitutions look to the first of their key, longer lines to the shorter line, that one to the first longer line
    earlier = F.when(F.col("role") == 2, F.col("whole")).otherwise(F.col("first_other"))
    links = emitted.join(heads, "key").select("id", "pos", earlier.alias("by")).filter("by < pos").select("id", "by").distinct()
    texts = placed.select("id", "pos", "line").distinct()
    theirs = texts.select(F.col("pos").alias("by"), F.col("line").alias("kept_line"))
    checked = links.join(texts.select("id", "line"), "id").join(theirs, "by")
    return checked.filter(F.levenshtein("line", "kept_line", 1) >= 0).select("id").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH) -> DataFrame:
    """The lines that stay: doc_id, line_no, line (normalised), blank ones left out."""
    lines = common.stored(first_lines(docs, id_col, text_col), "lines")
    gone = common.staged(near_later(lines, min_length))
    return lines.join(gone, "id", "left_anti").select("doc_id", "line_no", "line")


def per_document(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: n_lines with text, n_kept, kept_digest.

    The digest is the sum over kept lines of the first 32 bits of
    md5("<line number>:<line>"), so it depends on which lines stay and on
    nothing else.
    """
    pieces = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    with_text = F.size(F.filter(pieces, lambda x: normal(x) != ""))
    counts = docs.select(F.col(id_col).alias("doc_id"), with_text.alias("n")).groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_lines"))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("line_no").cast("string"), F.col("line")).cast("binary")), 1, 8), 16, 10).cast("long")
    sums = kept.select(F.col("doc_id").alias("_id"), part.alias("part")).groupBy("_id").agg(F.count("*").alias("n_kept"), F.sum("part").alias("kept_digest"))
    return counts.join(sums, counts["doc_id"].eqNullSafe(sums["_id"]), "left").select(
        "doc_id", "n_lines", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("kept_digest", F.lit(0)).alias("kept_digest")
    )
