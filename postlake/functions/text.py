"""Text rules as Column expressions.

Everything runs inside the JVM except NFKC, which Spark has no function for; that one is
a UDF and only non-ASCII values are sent to it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schema as S
from postlake.functions.bind import let

# Unicode-aware whitespace for Java regular expressions.
_WS = r"(?U)\s+"
_FLAT_PARENS = r"\([^()]*\)"


def fold_width(c: Column) -> Column:
    """Store full-width digits and the feed's four punctuation marks as ASCII."""
    wide = F.translate(c, S.WIDE_CHARS, S.NARROW_CHARS)
    return F.when(c.rlike(f"[{S.WIDE_CHARS}]"), wide).otherwise(c)


def _fold_parens(c: Column) -> Column:
    """Walk over the pieces between parentheses, keeping those at depth zero."""
    pieces = F.regexp_extract_all(c, F.lit(r"[()]|[^()]+"), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        depth, out = acc["depth"], acc["out"]
        return F.struct(
            F.when(piece == "(", depth + 1)
            .when(piece == ")", F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
            .alias("depth"),
            F.when(piece.isin("(", ")") | (depth > 0), out)
            .otherwise(F.concat(out, piece))
            .alias("out"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def strip_parens(c: Column) -> Column:
    """Drop parenthesised text at any depth; a stray ``)`` goes, an unclosed ``(`` drops
    the rest.

    Each regex pass removes the innermost pairs in linear time; three passes finish nearly
    all text, and what is left without a pair needs no counting.  Only text nested deeper
    than that is walked piece by piece.
    """
    flat = c
    for _ in range(3):
        flat = F.regexp_replace(flat, _FLAT_PARENS, "")

    def finish(x: Column) -> Column:
        no_pairs = F.regexp_replace(F.regexp_replace(x, r"(?s)\(.*", ""), r"\)", "")
        return F.when(x.rlike(_FLAT_PARENS), _fold_parens(x)).otherwise(no_pairs)

    return F.when(c.rlike("[()]"), let(flat, finish)).otherwise(c)


def blank_unlisted(c: Column) -> Column:
    return F.when(c == S.UNLISTED_TOWN, "").otherwise(c)


# Without Arrow a worker holds a hundred values at a time, with it 10,000, which whole texts
# make large.
@F.udf(T.StringType(), useArrow=False)
def _nfkc(value: str | None) -> str | None:
    return None if value is None else unicodedata.normalize("NFKC", value)


# Not because it is: this keeps the optimizer from running the UDF again for every filter
# and expression that uses its result.
_nfkc = _nfkc.asNondeterministic()


def nfkc(c: Column) -> Column:
    """Unicode NFKC.  ASCII is its own NFKC form and skips the UDF."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip_whitespace(c: Column) -> Column:
    """Remove every Unicode whitespace character."""
    return F.regexp_replace(c, _WS, "")


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_keyword(c: Column) -> Column:
    return strip_whitespace(nfkc(c))


def to_katakana(c: Column) -> Column:
    return F.translate(c, S.HIRAGANA, S.KATAKANA)


def to_hiragana(c: Column) -> Column:
    return F.translate(c, S.KATAKANA, S.HIRAGANA)


def search_candidates(c: Column, fold_search_width: bool = False) -> Column:
    """The keyword, then its katakana and hiragana spelling: unique, non-empty, in order.

    ``fold_search_width`` adds the keyword as :func:`fold_width` would have stored it.
    """
    spellings = [c, to_katakana(c), to_hiragana(c)]
    if fold_search_width:
        spellings.append(fold_width(c))
    return F.filter(F.array_distinct(F.array(*spellings)), lambda x: x != "")


def search_pattern(c: Column, mode: Column | str) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    tail = F.concat(c, F.lit("%"))
    return (
        F.when(mode == "exact", c)
        .when(mode == "prefix", tail)
        .otherwise(F.concat(F.lit("%"), tail))
    )


def clamp_limit(c: Column, default_on_zero: bool = False) -> Column:
    """Result limit 1..200, 50 if absent.  Client helpers also read 0 as absent."""
    wanted = F.when(c != 0, c) if default_on_zero else c
    return F.greatest(
        F.lit(1),
        F.least(
            F.lit(S.SEARCH_LIMIT_MAX),
            F.coalesce(F.floor(wanted), F.lit(S.SEARCH_LIMIT_DEFAULT)),
        ),
    ).cast("int")


def normalize_zip(c: Column, fold_width: bool = False) -> Column:
    """Keep ASCII digits, first seven.  Full-width digits count only with ``fold_width``."""
    text = nfkc(c) if fold_width else c
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 7)


def is_valid_zip(normalized: Column) -> Column:
    return F.coalesce(F.length(normalized) == 7, F.lit(False))


def format_zip(c: Column) -> Column:
    z = normalize_zip(c)
    return F.when(F.length(z) <= 3, z).otherwise(
        F.concat(F.substring(z, 1, 3), F.lit("-"), F.substring(z, 4, 4))
    )


def data_version(ts: Column, prefix: str = "v") -> Column:
    """Version id of a batch time: ``v`` + digits down to the millisecond."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMddHHmmssSSS"))


def batch_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def safe_ratio(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total)
