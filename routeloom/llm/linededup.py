"""Removal of repeated passages by content-defined chunks of lines.

Every line with a word has a hash, and a rolling hash over the hashes of two neighbouring lines chooses the ends of
chunks: a line ends a chunk where it is divisible by `spread`. So chunks depend on nearby lines only, and inserting a
line moves no other chunk. Chunks of several lines that occur again anywhere are removed, but for the first one.

The edges of a repeated passage lie inside chunks, whose other lines differ. Therefore each line also begins a window
and ends one: the fewest lines with `long_words` words. The sum of the rolling hash over a window is a difference of
two sums of the document, so a window costs the same at any length. Any repeated run of `long_words` words or more is
covered by windows that repeat, so the whole run goes, whatever is around it.

Hashes travel first. Texts of chunks and windows are shuffled only where a hash repeats; they are compared byte by
byte. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once, release, stored

SPREAD, LONG_WORDS, LEAST_WORDS = 3, 50, 20
WORD_LETTERS = 10  # a line counts as a word for each so many code points at least: scripts without spaces
LAST = (1 << 63) - 1  # stands for a null doc_id in row keys; the key's second part tells it from a row of this doc_id
TIES, PLACES, UNKNOWN = 1 << 31, 1 << 31, 1 << 62  # in the order of passages: texts of one doc_id, lines, texts without doc_id
SUMMED = (1 << 36) - 1  # bits of the rolling hash that are added up: no sum over a text overflows
HAS_WORD = r"[^\x20\x09-\x0D]"


def hash_of(line: Column) -> Column:
    """28 bits of md5, which every SQL engine has."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def words_in(line: Column) -> Column:
    """Words of a line, or its code points by `WORD_LETTERS` where that is more; 0 without words."""
    words = F.size(F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), ""))
    odd = [line == "", line.startswith(" "), line.endswith(" "), *[F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")]]
    single = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1  # one space between two words
    words = F.when(reduce(or_, odd), words).otherwise(single)
    return F.when(words > 0, F.greatest(words, F.floor(F.length(line) / WORD_LETTERS).cast("int"))).otherwise(0)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id), tie (the text's 128-bit hash and whether doc_id is null), text, whole (the row itself) of each row of `docs`.

    Rows share a key only where doc_id and text are equal, so no row's lines are taken for another's.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = F.unhex(F.when(F.col("doc_id").isNull(), "01").otherwise("00"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.concat(F.unhex(F.md5("text")), known).alias("tie"), "text", whole.alias("whole"))


def place(a: Column) -> Column:
    """Where line `a` of a keyed row stands among all: by doc_id, null ones last by 62 bits of a hash, then 31 bits of a hash, then the line.

    It only orders. Two texts of one doc_id that collide in it keep both copies of a passage at one line; none loses more.
    """
    big = lambda c: c.cast("decimal(20,0)")
    unknown = F.lit(1 << 62).cast("decimal(20,0)") * 2 + big(F.pmod(F.xxhash64(F.lit("unknown"), "tie"), F.lit(UNKNOWN)))
    doc = F.when(F.substring("tie", 17, 1) == F.unhex(F.lit("01")), unknown).otherwise(big(F.col("doc"))).cast("decimal(20,0)")
    tie = F.pmod(F.xxhash64("tie"), F.lit(TIES)) * PLACES + a
    return (doc * F.lit(TIES * PLACES).cast("decimal(19,0)") + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def lines_of(rows: DataFrame) -> DataFrame:
    """doc, tie, i (line number from 1), x (hash), h (short hash), w (words) of lines with words; line 0 stands before each text."""
    lines = rows.where("text is not null").select("doc", "tie", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), "\n", -1)).alias("i", "line"))
    lines = lines.select("doc", "tie", "i", F.xxhash64("line").alias("x"), F.when(F.col("i") > 0, hash_of(F.col("line"))).alias("h"), words_in(F.col("line")).alias("w"))
    return lines.where("w > 0 or i = 0").repartition("doc", "tie").dropDuplicates(["doc", "tie", "i"])


def spans(rows: DataFrame, least_words: int, long_words: int, spread: int) -> DataFrame:
    """doc, tie, a, b (first and last line), key (hash): the chunks and windows that may go; each (a, b) once."""
    by, n = Window.partitionBy("doc", "tie").orderBy("i"), F.lit(long_words)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = lambda c: F.lag(c).over(by), lambda c: F.lead(c).over(by)
    rolled = F.pmod(before("h") * 31 + F.col("h"), F.lit(spread)) == 0
    ends = (F.col("i") == 0) | after("i").isNull() | (F.col("w") >= n) | (after("w") >= n) | F.coalesce(rolled, F.lit(False))
    r = F.xxhash64(before("x"), "x").bitwiseAND(F.lit(SUMMED))
    lines = lines_of(rows).select("doc", "tie", "i", "x", "w", F.least("w", n).cast("long").alias("m"), r.alias("r"), ends.alias("ends"))
    lines = lines.select("*", F.sum("m").over(so_far).alias("c"), F.sum("r").over(so_far).alias("s"), before("ends").alias("begins"))
    lines = lines.select("*", after("i").alias("i1"), after("x").alias("x1"), after("s").alias("s1"))
    begun = {k: F.last(F.when(F.col("begins"), F.col(c)), ignorenulls=True).over(so_far) for k, c in {"a": "i", "ax": "x", "as": "s", "ac": "c", "am": "m"}.items()}
    lines = lines.select("*", *[c.alias(k) for k, c in begun.items()])

    # c grows from line to line by 1 to long_words, so frames over it hold few lines
    near = Window.partitionBy("doc", "tie").orderBy("c")
    ahead, back = near.rangeBetween(long_words, 2 * long_words - 1), near.rangeBetween(1 - 2 * long_words, -long_words)
    lines = lines.select("*", *[F.first(c).over(ahead).alias(f"to_{c}") for c in ("i", "s")], *[F.last(c).over(back).alias(f"from_{c}") for c in ("i1", "x1", "s1", "c")])
    span = lambda a, b, x, s: F.struct(a.alias("a"), b.alias("b"), F.xxhash64(x, s).alias("key"))
    col, shorter = F.col, F.col("c") - F.col("m")  # words without the last line
    begin = col("ac") - col("am")  # words before the chunk
    long_chunk = (col("c") - begin >= n) & (shorter - begin >= n) & (col("c") - col("ac") >= n)  # else a window is the same
    short_chunk = (col("c") - begin < n) & (col("c") - begin >= least_words) & (col("i") > col("a"))
    each = F.array(
        F.when(col("to_i").isNotNull(), span(col("i1"), col("to_i"), col("x1"), col("to_s") - col("s1"))),
        F.when(col("from_c").isNotNull() & (shorter - col("from_c") >= n), span(col("from_i1"), col("i"), col("from_x1"), col("s") - col("from_s1"))),
        F.when((col("i") > 0) & col("ends") & (long_chunk | short_chunk), span(col("a"), col("i"), col("ax"), col("s") - col("as"))),
    )
    return lines.select("doc", "tie", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("doc", "tie", "e.a", "e.b", "e.key")


def removals(rows: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, spread: int = SPREAD) -> DataFrame:
    """doc, tie, gone (array of lo, hi: lines to remove, in order, apart), runs (of neighbouring ones) of keyed rows that lose any."""
    rows = rows.select("doc", "tie", "text")
    every = stored(spans(rows, least_words, long_words, spread), "spans")
    again = every.groupBy("key").count().where("count > 1").select("key")
    some = every.join(again.hint("merge"), "key").groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b", "key")).alias("found"))
    texts = rows.join(some.hint("merge"), ["doc", "tie"]).select("doc", "tie", once(F.split("text", "\n", -1), "lines"), "found").select("doc", "tie", "lines", F.explode("found").alias("e"))
    texts = stored(texts.select("doc", "tie", "e.a", "e.b", "e.key", place(F.col("e.a")).alias("place"), F.array_join(F.slice("lines", F.col("e.a"), F.col("e.b") - F.col("e.a") + 1), "\n").alias("passage")), "passages")
    firsts = texts.groupBy("key", "passage").agg(F.min("place").alias("first"))  # byte by byte
    later = texts.join(firsts, ["key", "passage"]).where("place > first").select("doc", "tie", "a", "b")
    order = Window.partitionBy("doc", "tie").orderBy("a", F.desc("b"))
    covered = later.withColumn("to", F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    pieces = covered.where("b > to").groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct(F.expr("greatest(a, to + 1)").alias("lo"), F.col("b").alias("hi")))).alias("gone"), F.count_if(F.expr("a > to + 1")).alias("runs"))
    out = stored(pieces, "gone")
    release(every, texts)
    return out


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, spread: int = SPREAD) -> DataFrame:
    """`docs` with the columns n_lines, n_removed_lines, n_removed_runs, and text without the passages that occur before.

    A passage is a chunk of several lines with `least_words` words, or any run of lines with `long_words` words; a
    line counts a word for each ten code points at least, so scripts without spaces count too. Of equal passages the
    first in the order of documents stays: by doc_id, null ones last, equal ones by a hash of the text. Rows that are
    equal in doc_id and text are one occurrence; rows that differ in either never touch each other's lines. Lines without words go where they lie inside a passage. A text of
    which no word is left becomes empty. Null texts stay null and have no lines; empty texts have one. Columns of
    `docs` named like the new ones are replaced; others keep their values, whatever their names.

    No key gathers texts: counts are combined before the shuffle and joins on a hot passage can be split. A text's
    own lines are sorted in one task, on disk where they are many.
    """
    new = ["n_lines", "n_removed_lines", "n_removed_runs"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in new])
    rows = keyed(docs)
    gone = removals(rows, least_words, long_words, spread)
    rows = rows.join(gone.hint("merge"), ["doc", "tie"], "left")  # one plan at any size
    numbers = F.flatten(F.transform("gone", lambda g: F.sequence(g["lo"], g["hi"])))
    lines = F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1))
    rows = rows.select("whole", "text", "runs", once(F.struct(lines.alias("all"), numbers.alias("gone")), "lines"))
    rows = rows.select("whole", "text", "runs", "lines", once(F.array_except(F.sequence(F.lit(1), F.size("lines.all")), F.col("lines.gone")), "kept"))
    rest = F.array_join(F.transform("kept", lambda i: F.get("lines.all", i - 1)), "\n")
    rows = rows.select("whole", "text", "runs", "kept", once(rest, "rest"))
    left = F.when(F.col("rest").isNull(), F.col("text")).when(F.col("rest").rlike(HAS_WORD), F.col("rest")).otherwise("")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1)
    n_gone = F.when(F.col("rest").isNull(), 0).when(F.col("rest").rlike(HAS_WORD), n_lines - F.size("kept")).otherwise(n_lines)
    columns = {"n_lines": n_lines, "n_removed_lines": n_gone, "n_removed_runs": F.coalesce("runs", F.lit(0))}
    return rows.select(*[(left if c == "text" else F.col("whole").getField(c)).alias(c) for c in docs.columns], *[c.cast("long").alias(k) for k, c in columns.items()])
