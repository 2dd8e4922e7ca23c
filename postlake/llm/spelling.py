"""Grouping spelling variants through permuterm rotations.

A word with a terminator behind it is written in all its rotations.  Skip the character that an
edit touches and rotate it to the end: two words that differ by a replacement there share the
rest of the rotation, and a word that lacks the character has that rest as a whole rotation of
its own.  So sorted rotations bring near words together, in groups that share all but at most
the last character.  A group has at most one word per character of the alphabet (and the word
without one), and a scan over it gives each member its neighbours without listing pairs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.frames import written

RUN = "[A-Za-zÀ-ÿ]"
TERMINATOR = "\0"


def _lower(run: Column) -> Column:
    """A-Z in lower case, nothing else."""
    plain = F.octet_length(run) == F.length(run)
    other = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(run)).otherwise(other)


def runs_of(docs: DataFrame, min_points: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and run: every maximal run of letters of at least ``min_points`` code points."""
    pattern = F.lit(f"{RUN}{{{min_points},}}")
    found = F.explode(F.regexp_extract_all(F.col(text_col), pattern, F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("run"))
    return rows.select("doc_id", _lower(F.col("run")).alias("run"))


def misspelt(runs: DataFrame, every: int) -> Column:
    """The run, without one code point if its hash with the document's id says so."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(F.encode(text, "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(h % every == 0, cut).otherwise(F.col("run"))


def word_counts(
    docs: DataFrame,
    min_points: int = 7,
    min_count: int = 2,
    every: int = 31,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word and n: the words of at least ``min_points`` code points that occur ``min_count``
    times, counted before they are shuffled.

    One run in ``every`` loses a code point first (``misspelt``).  Null texts have no words, a
    null id counts as an empty one; rows that repeat an id or a text all count.
    """
    runs = runs_of(docs, min_points, id_col, text_col)
    words = runs.select(misspelt(runs, every).alias("word")).filter(F.length("word") >= min_points)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def rotations(words: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """word, n, prefix and edited: every rotation of a word with its terminator, whole
    (``edited`` is empty), and again without its last character, which ``edited`` holds."""
    size = F.length("word")
    at = F.abs("turn")
    ahead = F.substring(F.col("word"), at + 1, size)
    behind = F.substring(F.col("word"), F.lit(1), F.when(F.col("turn") < 0, at - 1).otherwise(at))
    turned = words.select("word", "n", F.explode(F.sequence(-size, size)).alias("turn"))
    return turned.select(
        "word",
        "n",
        F.concat(ahead, F.lit(terminator), behind).alias("prefix"),
        F.when(F.col("turn") < 0, F.substring(F.col("word"), at, F.lit(1))).otherwise("").alias("edited"),
        (F.col("turn") == 0).alias("home"),
    )


def neighbours(words: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """word, n, n_near and best of every row of ``words`` (word, n; each word once).

    ``n_near`` counts the words at one inserted, deleted or replaced code point; ``best`` is
    the (n, word) of the most frequent one, the first in code-point order on ties, or null.

    A replacement is met in one group only.  An insertion into a run of equal characters is met
    once for each of them; it counts where the character before it differs.
    """
    rows = rotations(words, terminator)
    rows = rows.withColumns(
        {
            "whole": F.col("edited") == "",
            "rank": F.struct((-F.col("n")).alias("fewest"), F.col("word").alias("form")),
            # of a run of equal characters, the first stands for an insertion or deletion
            "leads": (F.col("edited") != "") & (F.col("edited") != F.substring(F.col("prefix"), -1, 1)),
        }
    )
    group = Window.partitionBy("prefix").orderBy("whole", "rank")
    whole_group = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edit = ~F.col("whole")
    scanned = rows.select(
        "word",
        "n",
        "home",
        "whole",
        "leads",
        F.count(F.when(edit, 1)).over(whole_group).alias("edits"),
        F.count(F.when(F.col("leads"), 1)).over(whole_group).alias("inserted"),
        F.max(F.when(F.col("whole"), F.col("rank"))).over(whole_group).alias("shorter"),
        F.min(F.when(F.col("leads"), F.col("rank"))).over(whole_group).alias("longer"),
        F.min(F.when(edit, F.col("rank"))).over(whole_group).alias("first"),
        F.min(F.when(edit, F.col("rank"))).over(group.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.row_number().over(group).alias("line"),
    )
    lacks = F.col("leads") & F.col("shorter").isNotNull()
    count = F.when(F.col("whole"), F.col("inserted")).otherwise(F.col("edits") - 1 + lacks.cast("int"))
    replaced = F.when(F.col("line") == 1, F.col("next")).otherwise(F.col("first"))
    best = F.when(F.col("whole"), F.col("longer")).otherwise(
        F.least(replaced, F.when(F.col("leads"), F.col("shorter")))
    )
    met = scanned.select("word", "n", "home", count.alias("near"), best.alias("best"))
    met = met.filter(F.col("home") | (F.col("near") > 0))
    total = met.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")
    )
    best = F.struct((-F.col("best.fewest")).alias("n"), F.col("best.form").alias("word"))
    return total.select("word", "n", "n_near", F.when(F.col("best").isNotNull(), best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row of ``forms`` (word, form; no form null), where a form may have
    a form itself.  The steps taken double each round; forms must not lead in a circle."""
    ways = written(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(ways.join(ahead, "root", "left"), "spelling-steps")
        if step.filter(F.col("further").isNotNull()).isEmpty():
            return ways
        ways = step.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = 10, terminator: str = TERMINATOR) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of ``words`` (word, n).

    A word's form is its most frequent near word if that is ``ratio`` times as frequent, else
    null; its root is where forms of forms end, the word itself if it has none.  An empty
    table gives an empty result.  Words must not hold the terminator.
    """
    near = neighbours(written(words.select("word", "n"), "spelling-words"), terminator)
    has = F.col("best.n") >= ratio * F.col("n")
    near = near.select(
        "word",
        "n",
        "n_near",
        F.when(has, F.col("best.word")).alias("form"),
        F.when(has, F.col("best.n")).alias("form_n"),
    )
    near = written(near, "spelling-near")
    ends = roots(near.filter("form IS NOT NULL"))
    found = near.join(ends, "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))
