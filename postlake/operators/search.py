"""Address search for whole tables of requests.

Each request names a keyword and a mode: ``exact`` (a column equals it), ``prefix`` (a
column starts with it) or ``partial`` (a column contains it).  ``%`` and ``_`` are live
wildcards in the last two.  Hits come in a fixed order, at most ``limit`` per request.

How it runs: no mode needs a cross join.  Whole tokens and prefixes of the asked lengths meet
keywords in an equi-join, so the pairs coming out are exactly the matching ones.  For parts
there are grams: every run of one, two, four or eight characters of a token, with its place.
A keyword looks up the one of its longest grams that the fewest tokens have, and the tokens
found are checked in full, so it never meets more tokens than that gram has.  Where the keywords
are too many to be broadcast, a gram travels as two hashes and a place: the tokens themselves
are fetched for the places where a keyword may be.

No request can show more than 200 records, and neither a token nor a keyword contributes more
than its first 200 in order.  So a token keeps 200 records, and a keyword the tokens with the
smallest first records, before the two are joined.  The cuts are exact and are taken on the
map side, so popular tokens stay small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlake import schema as S
from postlake.functions import text
from postlake.operators.skew import BROADCAST_ROWS, HOT_ROWS, fits, key_counts, spread_join
from postlake.session import empty, materialise

# LIKE's escape: a control character instead of the backslash, which stays literal.  Where
# a keyword holds it, it is doubled.
_ESCAPE = "\u0001"
_MATCH = ["mode", "term"]


def _records(addresses: DataFrame) -> DataFrame:
    return addresses.select(
        *[F.coalesce("town", F.lit("")).alias(c) if c == "town" else c for c in S.ADDRESS_COLUMNS]
    ).distinct()


#: Characters of grams; a key is looked up by the longest that fits it.
GRAMS = (1, 2, 4, 8)
#: A gram that more tokens have than this is not shuffled unless a keyword has no rarer one.
POPULAR = 1_000


def _gram_size(key: Column) -> Column:
    return F.greatest(*[F.when(F.length(key) >= n, n).otherwise(GRAMS[0]) for n in GRAMS])


def _gram(text: Column, at: Column, size: Column) -> Column:
    """A hash of the gram: what meets through it is checked in full."""
    return F.xxhash64(F.substring(text, at, size))


@dataclass
class Index:
    """What a search reads; build it once for many batches of requests.

    ``records`` has the first 200 records of each token in result order.  ``columns`` is the
    number of tokens that a record can have.
    """

    records: DataFrame
    columns: int

    @property
    def tokens(self) -> DataFrame:
        """token and ``best``, its first record in result order."""
        return self.records.groupBy("token").agg(F.min(F.struct(*S.ADDRESS_ORDER)).alias("best"))

    @cached_property
    def listed(self) -> DataFrame:
        """``tokens``, written once."""
        # Few bytes of tokens turn into many grams: spread the tokens over all tasks.
        tasks = int(self.records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return materialise(self.tokens.repartition(tasks), "search-tokens")

    def grams_of(self, sizes: list[int]) -> DataFrame:
        """gram, token, best and ``at``: every run of so many characters of a token, hashed, with
        the place (from 1) where it begins."""
        fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("token"))
        rows = self.listed.withColumn("n", F.explode(fitting))
        rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)))
        return rows.select(_gram(F.col("token"), F.col("at"), F.col("n")).alias("gram"), "token", "best", "at")

    @property
    def grams(self) -> DataFrame:
        return self.grams_of(list(GRAMS))


def _index(addresses: DataFrame, tokens: list[Column]) -> Index:
    """(token, record) rows, written once, as matching reads the tokens and the records
    separately."""
    rows = _records(addresses).withColumn("token", F.explode(F.array_distinct(F.array(*tokens))))
    order = Window.partitionBy("token").orderBy(*S.ADDRESS_ORDER)
    cut = (
        rows.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= S.SEARCH_LIMIT_MAX)
        .drop("_n")
    )
    return Index(materialise(cut, "tokens"), len(tokens))


def column_index(addresses: DataFrame) -> Index:
    """What :func:`search_addresses` searches."""
    return _index(addresses, [F.col("prefecture"), F.col("city"), F.col("town")])


def concat_index(addresses: DataFrame) -> Index:
    """What :func:`search_concat` searches."""
    return _index(addresses, [F.concat("prefecture", "city", "town")])


def _with_piece(terms: DataFrame, wildcards: bool) -> DataFrame:
    """Add the piece each (mode, term) is matched on.

    ``kind`` is the sort of piece: ``exact``, ``prefix``, ``part``, or ``length`` for
    patterns made of wildcards only, which ask for a least length.  A wildcard pattern is
    matched on its longest literal part and then checked in full.
    """
    term, mode = F.col("term"), F.col("mode")
    wild = (mode != "exact") & term.rlike("[%_]") if wildcards else F.lit(False)
    literals = F.filter(F.split(term, "[%_]"), lambda x: x != "")
    longest = F.reduce(
        literals,
        F.lit(""),
        lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best),
    )
    least = F.length(F.regexp_replace(term, "[^_]", ""))
    bare = wild & (F.size(literals) == 0)
    kind = (
        F.when(bare, "length")
        .when(wild, "part")
        .when(mode == "exact", "exact")
        .when(mode == "prefix", "prefix")
        .otherwise("part")
    )
    key = F.when(bare, least.cast("string")).when(wild, longest).otherwise(term)
    escaped = F.replace(term, F.lit(_ESCAPE), F.lit(_ESCAPE * 2))
    pattern = F.when(wild & ~bare, text.search_pattern(escaped, mode))
    return terms.select("*", kind.alias("kind"), key.alias("key"), pattern.alias("like"))


@dataclass
class _Asked:
    """The distinct (mode, keyword) pairs of the requests and what they ask for."""

    keys: DataFrame  # _mode, _word, and _n requests asking it
    spelled: DataFrame  # each key once per spelling, with the piece to match
    distinct: int
    most_often: int
    terms: int
    exact: bool
    prefix: list[int]
    part: list[int]  # sizes of grams
    length: list[int]


def _usable() -> Column:
    return (F.col("_word") != "") & F.col("_mode").isin(*S.SEARCH_MODES)


def _asked(prepared: DataFrame, spellings: Column, wildcards: bool) -> _Asked:
    """Reduce requests to distinct keywords, write those, and describe them in one row:
    counts and distinct piece lengths, at most as many as the longest keyword has
    characters."""
    keys = materialise(key_counts(prepared.filter(_usable()), ["_mode", "_word"]), "keywords")
    spelled = _with_piece(
        keys.select(
            F.col("_mode").alias("mode"),
            "_word",
            "_n",
            F.posexplode(spellings).alias("_spelling", "term"),
        ),
        wildcards,
    )

    def lengths(kind: str, value: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, value))).alias(kind)

    size = F.length("key")
    row = spelled.agg(
        F.count_if(F.col("_spelling") == 0).alias("distinct"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("most_often"),
        F.count(F.lit(1)).alias("terms"),
        F.coalesce(F.bool_or(F.col("kind") == "exact"), F.lit(False)).alias("exact"),
        lengths("prefix", size),
        lengths("part", _gram_size(F.col("key"))),
        lengths("length", F.col("key").try_cast("int")),
    ).first()
    return _Asked(keys, spelled, **row.asDict())


def _token_pieces(tokens: DataFrame, want: _Asked) -> DataFrame:
    """(token, best, kind, key) for a token and every prefix or length of it that is asked for."""
    token, n = F.col("token"), F.length("token")

    def ints(values: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def piece(kind: str, keys: Column) -> Column:
        return F.transform(
            F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
        )

    found: list[Column] = []
    if want.exact:
        found.append(piece("exact", F.array(token)))
    if want.prefix:
        fitting = F.filter(ints(want.prefix), lambda size: size <= n)
        found.append(piece("prefix", F.transform(fitting, lambda m: F.substring(token, 1, m))))
    if want.length:
        fitting = F.filter(ints(want.length), lambda size: size <= n)
        found.append(piece("length", F.transform(fitting, lambda m: m.cast("string"))))
    return tokens.select("token", "best", F.explode(F.concat(*found)).alias("p")).select(
        "token", "best", "p.kind", "p.key"
    )


def _held(grams: DataFrame) -> DataFrame:
    """How many places each gram is found at, counted before the shuffle."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))


def _rarest(terms: DataFrame, grams: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``terms`` with the gram of their key that is found at the fewest places, its place in the
    key, from 1, and that number.  A term with a gram that no token has is dropped, as nothing
    can match it.

    ``counts`` is :func:`_held` of the grams if it is known already.
    """
    key, place, size = F.col("key"), F.col("place"), _gram_size(F.col("key"))
    own = terms.withColumn("place", F.explode(F.sequence(F.lit(1), F.length(key) - size + 1)))
    own = own.withColumn("gram", _gram(key, place, size))
    best = F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "place")).alias("g")
    found = own.join(_held(grams) if counts is None else counts, "gram", "left")
    found = found.groupBy(*terms.columns).agg(best).filter("g.held > 0").select(*terms.columns, "g.held", "g.place")
    return found.withColumn("gram", _gram(key, place, size))


def _holding(terms: DataFrame, asked: _Asked, index: Index, broadcast_rows: int, hot_rows: int) -> DataFrame:
    """``terms`` with each token, and its ``best``, that holds their key."""
    grams = index.grams_of(asked.part)
    columns = [*terms.columns, "token", "best"]

    def whole(met: DataFrame) -> DataFrame:
        # the key begins as far before the gram as in the keyword
        start = F.col("at") - F.col("place") + 1
        same = F.substring(F.col("token"), start, F.length("key")) == F.col("key")
        return met.filter((start > 0) & same).select(columns)

    if asked.terms <= broadcast_rows:
        return whole(grams.join(F.broadcast(_rarest(terms, grams)), "gram"))
    counts = materialise(_held(grams), "gram-counts")
    probes = materialise(_rarest(terms, grams, counts), "search-probes")
    # At most one gram in POPULAR places is popular.
    popular = counts.filter(F.col("held") > POPULAR).select("gram")
    popular = F.broadcast(popular) if fits(popular, BROADCAST_ROWS) else popular
    often, seldom = probes.filter(F.col("held") > POPULAR), probes.filter(F.col("held") <= POPULAR)
    asked_often = often.select("gram").distinct()
    asked_often = F.broadcast(asked_often) if fits(asked_often, BROADCAST_ROWS) else asked_often
    met = spread_join(grams.join(asked_often, "gram", "left_semi"), often, ["gram"], hot_rows=hot_rows)
    token = F.xxhash64("token").alias("token_hash")
    places = grams.select("gram", token, "at").join(popular, "gram", "left_anti")
    found = places.join(seldom, "gram").join(index.listed.select("*", token), "token_hash")
    return whole(met).unionByName(whole(found))


def _match(asked: _Asked, index: Index, broadcast_rows: int, hot_rows: int) -> DataFrame:
    """The first 200 distinct records of each (mode, term), in result order."""
    if not asked.terms:
        found = asked.spelled.select(*_MATCH).schema.fields
        found += index.records.drop("token").schema.fields
        return empty(asked.keys.sparkSession, T.StructType(found))
    terms = asked.spelled.select(*_MATCH, "kind", "key", "like").distinct()

    def meet(pieces: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
        if asked.terms <= broadcast_rows:
            return pieces.join(F.broadcast(wanted), on)
        return spread_join(pieces, wanted, on, hot_rows=hot_rows)

    parts = []
    if asked.exact or asked.prefix or asked.length:
        # Few bytes of tokens turn into many pieces: keep the tokens spread over all tasks.
        tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = _token_pieces(index.tokens.repartition(tasks), asked)
        parts.append(meet(pieces, terms.filter("kind <> 'part'"), ["kind", "key"]))
    if asked.part:
        parts.append(_holding(terms.filter("kind = 'part'"), asked, index, broadcast_rows, hot_rows))
    matches = F.expr("like IS NULL OR token LIKE like ESCAPE '\\u0001'")
    met = reduce(DataFrame.unionByName, [p.select(*_MATCH, "like", "token", "best") for p in parts])
    matched = met.filter(matches).select(*_MATCH, "token", "best")
    # Each of these tokens has a record no later than its rank allows, and as many tokens as a
    # record has columns may share one; a key that a token holds twice repeats it that often.
    first = Window.partitionBy(*_MATCH).orderBy("best", "token")
    matched = matched.distinct().withColumn("_t", F.row_number().over(first))
    matched = matched.filter(F.col("_t") <= index.columns * S.SEARCH_LIMIT_MAX).drop("_t", "best")
    # A record can match through several of its columns; equal rows share a rank.
    order = Window.partitionBy(*_MATCH).orderBy(*S.ADDRESS_ORDER)
    return (
        matched.join(index.records, "token")
        .drop("token")
        .withColumn("_n", F.dense_rank().over(order))
        .filter(F.col("_n") <= S.SEARCH_LIMIT_MAX)
        .drop("_n")
        .distinct()
    )


def _prepared(requests: DataFrame, keyword: Column) -> DataFrame:
    """Requests with their normalised keyword, mode and limit under internal names."""
    mode = F.coalesce("mode", F.lit("partial")) if "mode" in requests.columns else F.lit("partial")
    limit = F.col("limit") if "limit" in requests.columns else F.lit(None).cast("int")
    return requests.select(
        "*",
        keyword.alias("_word"),
        mode.alias("_mode"),
        text.clamp_limit(limit).alias("_limit"),
    )


def _answer(
    prepared: DataFrame,
    asked: _Asked,
    ranked: DataFrame,
    columns: list[str],
    keep_all: bool,
    broadcast_rows: int,
    hot_rows: int,
) -> DataFrame:
    """Attach the ranked hits of each distinct (mode, keyword) to its requests.

    A keyword has at most 200 hits, so the number of keywords bounds the hit list and
    tells whether it may be broadcast.  Otherwise both sides are shuffled, and keywords
    asked very often are spread.
    """
    on, how = ["_mode", "_word"], "left" if keep_all else "inner"
    if not keep_all:
        prepared = prepared.filter(_usable())
    if asked.distinct * S.SEARCH_LIMIT_MAX <= broadcast_rows:
        out = prepared.join(F.broadcast(ranked), on, how)
    elif keep_all or asked.most_often >= hot_rows:
        # Requests that cannot hit get a null keyword, which is never sent to one task.
        out = spread_join(
            prepared.withColumn("_word", F.when(_usable(), F.col("_word"))),
            ranked,
            on,
            how,
            spread_by=F.col(columns[0]),
            hot_rows=hot_rows,
            counts=asked.keys,
        )
    else:
        out = prepared.join(ranked, on, how)
    out = out.filter(F.col("position").isNull() | (F.col("position") <= F.col("_limit")))
    if not keep_all:
        return out.select(*columns, "position", *S.ADDRESS_COLUMNS)
    status = (
        F.when(~F.col("_mode").isin(*S.SEARCH_MODES), "invalid_mode")
        .when(F.coalesce("_word", F.lit("")) == "", "empty")
        .when(F.col("position").isNull(), "not_found")
        .otherwise("ok")
    )
    return out.select(*columns, status.alias("status"), "position", *S.ADDRESS_COLUMNS)


def search_addresses(
    requests: DataFrame,
    addresses: DataFrame,
    fold_search_width: bool = False,
    keep_all: bool = False,
    index: Index | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Search prefecture, city and town for each request's ``address``.

    Keywords are NFKC-folded, freed of whitespace and tried as written, in katakana and in
    hiragana; hits of an earlier spelling come first, then by the fixed order.  Work is
    done once per distinct (mode, keyword), and only the short result lists meet the
    requests again.  ``keep_all`` also returns requests without a hit, with a ``status``.
    ``index`` is a :func:`column_index` of the addresses built before.
    """
    prepared = _prepared(requests, text.normalize_keyword(F.col("address")))
    spellings = text.search_candidates(F.col("_word"), fold_search_width)
    asked = _asked(prepared, spellings, wildcards=True)
    hits = _match(asked, index or column_index(addresses), broadcast_rows, hot_rows)
    key = ["mode", "_word"]
    order = Window.partitionBy(*key).orderBy("_spelling", *S.ADDRESS_ORDER)
    ranked = (
        asked.spelled.select(*key, "_spelling", "term")
        .join(hits, _MATCH)
        .groupBy(*key, *S.ADDRESS_COLUMNS)
        .agg(F.min("_spelling").alias("_spelling"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= S.SEARCH_LIMIT_MAX)
        .select(F.col("mode").alias("_mode"), "_word", "position", *S.ADDRESS_COLUMNS)
    )
    return _answer(prepared, asked, ranked, requests.columns, keep_all, broadcast_rows, hot_rows)


def search_concat(
    requests: DataFrame,
    addresses: DataFrame,
    keep_all: bool = False,
    index: Index | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Records whose prefecture, city and town written together contain the keyword.

    A keyword may span columns.  It is only freed of whitespace: no folding, no wildcards.
    """
    prepared = _prepared(requests, text.strip_whitespace(F.col("address"))).withColumn(
        "_mode", F.lit("partial")
    )
    asked = _asked(prepared, F.array("_word"), wildcards=False)
    hits = _match(asked, index or concat_index(addresses), broadcast_rows, hot_rows)
    order = Window.partitionBy(*_MATCH).orderBy(*S.ADDRESS_ORDER)
    ranked = hits.withColumn("position", F.row_number().over(order)).select(
        F.col("mode").alias("_mode"), F.col("term").alias("_word"), "position", *S.ADDRESS_COLUMNS
    )
    return _answer(prepared, asked, ranked, requests.columns, keep_all, broadcast_rows, hot_rows)
