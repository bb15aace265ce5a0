"""Line dedup by winnowing over line hashes.

A text is a sequence of lines, and every run of ``window`` lines is a window.
Each window selects the position of its smallest line hash (of equal ones the
last), and the hash there is the fingerprint of the position.  Equal windows
select the same position, so two texts that share a run of ``window`` lines are
guaranteed to share a fingerprint; neighbouring windows mostly select the same
position, and a position is one row, with the hashes of the ``window`` - 1 lines
on either side of it.

Positions of one fingerprint are joined with the earliest place (smaller
doc_id, then smaller line number) that has a window of theirs, never with all
the others.  There the match is extended line by line to the left and to the
right, as far as the lines kept with the positions go.  A longer run goes on in
the position that its next window selects, so the union of the matches is the
whole run.  Every line of a match is deleted.

Fewer lines than ``window`` are a window of their own length if they hold
``min_words`` words (of what lies between white space), and so is a whole text
of fewer lines with any word, which meets other whole texts only.  With
``min_words`` None there are windows of ``window`` lines alone.

Defined cases: a null text stays null and has no lines; rows that share a doc_id hold one place, so equal
lines of theirs are not repeats of each other, and what is deleted in one is not deleted in another of a different text; rows
with a null doc_id have no place and stay whole; a run that repeats itself inside a text keeps its first
period; other columns are carried along, and those named n_lines or n_removed
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.llm.mixing import word_count
from panelweave.storage import stage

WINDOW = 3
MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _smallest_last(position: Column, start: Column, n: int) -> Column:
    """Whether the window of n hashes ``h`` from ``start`` selects ``position`` (both from 0)."""
    value = F.get("h", position)
    left = F.array_min(F.slice("h", start + 1, position - start))
    right = F.array_min(F.slice("h", position + 2, start + n - 1 - position))
    return F.coalesce(value <= left, F.lit(True)) & F.coalesce(value < right, F.lit(True))


def selected_positions(docs: DataFrame, text: str, doc_id: str, window: int, min_words: int | None) -> DataFrame:
    """A row for each selected position: doc_id, text_hash, position, fingerprint, around, windows.

    ``around`` has the line hashes from ``window`` - 1 lines before to as many
    after, NULL outside the text; ``windows`` the (back, n, whole) of the
    windows that select the position: lines before it, length, whether it is a
    whole text.
    """
    lines = lines_of(quoted(text))
    words = F.array().cast("array<bigint>") if min_words is None else F.transform(lines, lambda x: word_count(x))
    rows = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"), F.xxhash64(quoted(text)).alias("text_hash"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), words.alias("words"),
    )
    rows = rows.where(F.col("doc_id").isNotNull() & (F.size("h") >= (window if min_words is None else 1)))

    def held(start: Column, n: int) -> Column:
        return F.aggregate(F.slice("words", start + 1, n), F.lit(0).cast("bigint"), lambda x, y: x + y)

    def one(i: Column) -> Column:
        found = []
        for n in range(window if min_words is None else 1, window + 1):
            for back in range(n):
                start = i - back
                fits = (start >= 0) & (start + n <= F.size("h"))
                enough = F.lit(True) if n == window else held(start, n) >= min_words
                for whole, valid in ((False, enough),) if n == window else ((False, enough), (True, (F.size("h") == n) & (held(start, n) > 0))):
                    kind = F.struct(F.lit(back).alias("back"), F.lit(n).alias("n"), F.lit(whole).alias("whole"))
                    # nested: a window that does not fit must not be looked at
                    found.append(F.when(fits, F.when(_smallest_last(i, start, n) & valid, kind)))
        # one array: places outside the text are null
        around = F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda k: F.when(i + k >= 0, F.get("h", i + k)))
        return F.struct(i.alias("position"), F.get("h", i).alias("fingerprint"), around.alias("around"), F.array_compact(F.array(*found)).alias("windows"))

    chosen = F.filter(F.transform(F.sequence(F.lit(0), F.size("h") - 1), one), lambda p: F.size(p["windows"]) > 0)
    return rows.select("doc_id", "text_hash", F.inline(chosen))


def repeated_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, min_words: int | None = MIN_WORDS
) -> DataFrame:
    """(doc_id, text_hash, start, n): runs of n lines from ``start`` that match an earlier place."""
    found = stage(selected_positions(docs, text, doc_id, window, min_words), "positions")
    # a fingerprint of one position cannot match
    common = stage(found.groupBy("fingerprint").agg(F.count("*").alias("m")).where("m > 1").select("fingerprint"), "common")
    place = ["doc_id", "text_hash", "position", "fingerprint", "around"]
    windows = found.join(common, "fingerprint").select(*place, F.inline("windows"))
    lines = F.slice("around", F.lit(window) - F.col("back"), F.col("n"))
    keyed = stage(windows.withColumn("key", F.xxhash64("n", "whole", lines)), "matched")
    firsts = keyed.groupBy("fingerprint", "key").agg(F.min(F.struct("doc_id", "position", "around")).alias("first"), F.count("*").alias("m"))
    firsts = stage(firsts.where("m > 1").select("fingerprint", "key", "first"), "firsts")
    later = F.struct("doc_id", "position") != F.struct("first.doc_id", "first.position")
    matched = keyed.join(firsts, ["fingerprint", "key"]).where(later)

    def reach(step: int) -> Column:
        """Lines that go on being equal on one side, away from the position."""
        at = [window - 1 + step * k for k in range(1, window)]
        equal = F.array(F.lit(True), *[F.coalesce(F.get("around", F.lit(i)) == F.get("first.around", F.lit(i)), F.lit(False)) for i in at], F.lit(False))
        return (F.array_position(equal, F.lit(False)) - 2).cast("int")

    extended = matched.select("doc_id", "text_hash", "position", "back", "n", reach(-1).alias("left"), reach(1).alias("right"))
    # the extension reads the lines themselves: a window must lie inside it
    real = extended.where((F.col("back") <= F.col("left")) & (F.col("n") - F.col("back") - 1 <= F.col("right")))
    return real.select("doc_id", "text_hash", (F.col("position") - F.col("left")).alias("start"), (F.col("left") + F.col("right") + 1).alias("n")).distinct()


def without_repeated_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, min_words: int | None = MIN_WORDS
) -> DataFrame:
    """``docs`` with later repeated runs taken out of the text, and n_lines, n_removed."""
    again = repeated_runs(docs, text, doc_id, window, min_words)
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda w: F.sequence(w.start, w.start + w.n - 1))))
    gone = again.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    gone = stage(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), covered.alias("gone")), "gone")
    packed = docs.select(F.struct("*").alias("row"), quoted(doc_id).cast("long").alias("id"), F.xxhash64(quoted(text)).alias("text_hash"))
    # a sort-merge join at any size: the texts cross the network once, however few repeats there are
    same = (packed["id"] == gone["gone_id"]) & (packed["text_hash"] == gone["gone_hash"])
    joined = packed.join(gone.hint("merge"), same, "left").withColumn("text", F.col("row").getField(text))
    line = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("gone"))  # by hash: linear in the lines
    left = F.when(F.col("gone").isNull(), line).otherwise(F.transform(kept, lambda i: F.get(line, i)))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = joined.select("row", "text", left.alias("left"), F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long").alias("n_removed"))
    kept_text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join("left", "\n"))
    return out.select(
        *[kept_text.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("left") + F.col("n_removed")).cast("long").alias("n_lines"),
        "n_removed",
    )
