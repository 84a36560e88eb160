"""Fingerprints that follow edit distance: Order MinHash over word pieces, with SQL functions only.

A text is cut into pieces: its words, if they have at most ``PIECE`` characters. Longer runs without white
space are cut by what they hold, after each of the signs in ``CUTS`` and each sign of a script without spaces (and
after ``PIECE`` characters without any), so an insertion changes the pieces around it only. Three pieces in a row
are a k-mer. The n-th occurrence of a k-mer has its own identity, so repeats count. One hash orders
all identities; the ``SURVIVORS`` smallest go on. For each of ``SKETCHES`` further hashes the two
smallest survivors are selected and put back into text order, and the pair is hashed: an element
of the fingerprint agrees if the same two k-mers were selected and stand in the same order. A text with
fewer than three pieces is one k-mer, the empty one included.

To compare a text with its successor in descending id, texts are dealt to ranges of the id. The row
at the upper end of a range goes to the range above as well, as its successor, so the texts are
shuffled once and no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE, KMER = 12, 3
CUTS = r"aeiouAEIOU0-9/+=._\-\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff"
"""Vowels, digits and signs, and the scripts of South-East and East Asia, as in a character class."""
SURVIVORS, SKETCHES = 64, 32
RANGE_BYTES = 8_000_000
MOST_RANGES = 10_000
_PLACE_BITS = 26
_LOWEST = -(1 << 63)


def _hashes(pieces: str) -> Column:
    """The k-mers of the column ``pieces``: 38 bits of a hash, and below them the place."""
    place = (1 << _PLACE_BITS) - 1
    return F.expr(f"""
        CASE WHEN size({pieces}) < {KMER} THEN array((xxhash64(get({pieces}, 0), get({pieces}, 1)) & {~place}L))
        ELSE transform(slice({pieces}, 1, size({pieces}) - {KMER - 1}),
                       (x, i) -> (xxhash64(x, get({pieces}, i + 1), get({pieces}, i + 2)) & {~place}L) | (i & {place})) END""")


def _pieces(text: str) -> Column:
    """A word of few characters is a piece; of a longer one a piece ends at a cut."""
    space = r"\x20\x09-\x0D"
    word = rf"(?<![^{space}])[^{space}]{{1,{PIECE}}}(?![^{space}])"
    part = rf"[^{space}{CUTS}]{{0,{PIECE - 1}}}[{CUTS}]|[^{space}{CUTS}]{{1,{PIECE}}}"
    return F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({word}|{part})"), F.lit(1))


def fingerprinted(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` and the column ``name``, an array of numbers: the Order MinHash of the column ``text``."""
    bits, place = _PLACE_BITS, (1 << _PLACE_BITS) - 1
    ids = (1 << (64 - bits)) - 1
    # Each step is a column of its own, so that no lambda computes another array again.
    rows = rows.withColumn("__pieces", _pieces(text))
    rows = rows.withColumn("__sorted", F.sort_array(_hashes("__pieces"))).drop("__pieces")
    rows = rows.withColumn("__firsts", F.expr(f"slice(filter(__sorted, (x, i) -> i = 0 OR (x >> {bits}) != (get(__sorted, i - 1) >> {bits})), 1, {SURVIVORS})"))
    rows = rows.withColumn("__again", F.expr(f"filter(__sorted, (x, i) -> i > 0 AND (x >> {bits}) = (get(__sorted, i - 1) >> {bits}))")).drop("__sorted")
    # Where the runs of equal k-mers begin among the second and later occurrences.
    rows = rows.withColumn("__runs", F.expr(
        f"filter(transform(__again, (x, i) -> if(i = 0 OR (x >> {bits}) != (get(__again, i - 1) >> {bits}), i, -1)), i -> i >= 0)"))
    rows = rows.withColumn("__again", F.expr(f"""
        flatten(transform(__runs, (s, r) -> transform(
            slice(__again, s + 1, coalesce(get(__runs, r + 1), size(__again)) - s),
            (x, o) -> (xxhash64(x >> {bits}, o + 2) & {~place}L) | (x & {place}))))""")).drop("__runs")
    rows = rows.withColumn("__least", F.expr(f"slice(sort_array(concat(__firsts, slice(sort_array(__again), 1, {SURVIVORS}))), 1, {SURVIVORS})")).drop("__firsts", "__again")
    rows = rows.withColumn("__least", F.expr(f"transform(sort_array(transform(__least, x -> ((x & {place}L) << {64 - bits}) | ((x >> {bits}) & {ids}L))), x -> x & {ids}L)"))
    low = SURVIVORS - 1
    rows = rows.withColumn("__ranks", F.expr(f"transform(sequence(1, {SKETCHES}), s -> transform(__least, (x, i) -> (xxhash64(x, s) & {~low}L) | i))"))
    rows = rows.withColumn("__ranks", F.expr("transform(__ranks, r -> struct(r AS all, array_min(r) AS least))"))
    rows = rows.withColumn("__two", F.expr(
        f"transform(__ranks, r -> struct(r.least & {low}L AS a, coalesce(array_min(filter(r.all, y -> y > r.least)), r.least) & {low}L AS b))")).drop("__ranks")
    return rows.withColumn(name, F.expr(
        "transform(__two, p -> xxhash64(get(__least, cast(least(p.a, p.b) AS int)), get(__least, cast(greatest(p.a, p.b) AS int))) & 4294967295L)")).drop("__two", "__least")


def as_string(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The share of elements that agree."""
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e)) / cast({SKETCHES} AS double)")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key: first among every so-manieth, then within one stretch."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    stretches = [bounds[n:n + step] for n in range(0, len(bounds), step)]
    last = F.array(*[F.lit(s[-1]) for s in stretches])
    fine = F.array(*[F.array(*[F.lit(b) for b in s]) for s in stretches])
    coarse = F.size(F.filter(last, lambda b: b < key))
    return coarse * step + F.coalesce(F.size(F.filter(F.get(fine, coarse), lambda b: b < key)), F.lit(0))


def with_next(rows: DataFrame, columns: list[str], size: Column) -> DataFrame:
    """``rows`` (doc_id, text, …) and ``next_…`` of each of ``columns`` in descending order of id and text; after the last comes the first.

    A null id is the last. Rows that repeat an id are ordered by text.
    """
    count, top = rows.agg(F.sum(size), F.max("doc_id")).first()
    ranges = min(MOST_RANGES, max(1, -(-(count or 0) // RANGE_BYTES)))
    bounds: list[int] = []
    if ranges > 1:
        shares = [n / ranges for n in range(1, ranges)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges))).first()[0] or []))
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    # The upper bound of a range is an id that occurs; its row is also what follows the range above.
    first = _LOWEST if top is None else top
    rows = rows.withColumn("__key", key).withColumn("__range", _range_of(F.col("__key"), bounds))
    above = F.when(F.col("__key").isin(bounds), F.col("__range") + 1) if bounds else F.lit(None).cast("int")
    around = F.when(F.col("__key") == first, F.lit(0))
    copies = F.filter(F.array(
        F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest")), F.struct(above.alias("range"), F.lit(1).alias("guest")),
        F.struct(around.alias("range"), F.lit(1).alias("guest"))), lambda c: c["range"].isNotNull())
    dealt = rows.withColumn("__at", F.explode(copies)).drop("__range")
    order = Window.partitionBy("__at.range").orderBy("__at.guest", F.desc("__key"), "text")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return dealt.where("__at.guest = 0").drop("__at", "__key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` for each row of ``docs``.

    The edited text has its last floor(n_chars / 2) characters replaced by as many first ones of the
    next text (all, if it is shorter). ``near_edited`` and ``near_next`` are the shares of elements in which the fingerprint
    agrees with the edited text's and with the next text's. A null text counts as empty. Texts are read whole, up to
    2**26 k-mers each. Rows that repeat an id follow each other in the order of their texts; a single row is its own
    successor. Other columns of ``docs``, whatever their names, are left out; an empty table has no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text") + 1
    rows = with_next(fingerprinted(rows, "text", "sketch"), ["text", "sketch"], size)
    half = "cast(length(text) div 2 AS int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch")
    rows = fingerprinted(rows, "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string("sketch").alias("fingerprint"), as_string("edited_sketch").alias("edited_fingerprint"),
                       likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
