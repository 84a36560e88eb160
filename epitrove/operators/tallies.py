"""Window tallies: how often each substring occurs in a ``(start, len)`` window of the alignment.

As in ``frequencies``, identical sequences are grouped first, so all and distinct counts come
from one pass. A window's rows are never gathered in one task: totals come along from the
sequences, and ranks come from top-k limits or from counting.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitrove.functions.text import peptide_key, protein_key, ungapped
from epitrove.operators.filters import is_aligned
from epitrove.operators.frequencies import distinct_sequences
from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin
from epitrove.sources.tables import valid_windows

# Candidates per window, alternates per peptide, the bound of a conserved peptide.
TOP_CANDIDATES = 5
TOP_ALTERNATES = 4
CONSERVED_SHARE = 0.95

WINDOW = ["start", "len"]


def distinct_windows(aligned: DataFrame, protein: str | None = None) -> DataFrame:
    """Distinct aligned windows of the uploaded peptides, of one protein or with the protein kept."""
    usable = aligned.where((F.col("start") > 0) & (F.col("length") > 0))
    window = [F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("len")]
    if protein is None:
        return usable.select("protein", *window).distinct()
    wanted = protein.strip().upper()
    return usable.where(F.upper("protein") == wanted).select(*window).distinct()


def cross_windows(
    sequences: DataFrame,
    windows: Iterable[tuple[int, int]] | DataFrame,
    carried: Sequence[str],
    by: Sequence[str] = (),
    at_most: int | None = None,
) -> DataFrame:
    """The substring of every sequence in every window; windows past the end give short or empty ones.

    Windows given as values are attached row by row; windows in a table are joined on ``by``.
    ``at_most`` is a known bound of that table.
    """
    if isinstance(windows, DataFrame):
        if not by:
            raise ValueError("a table of windows needs the columns it is joined on")
        paired = lookup_join(
            sequences, windows.select(*by, *WINDOW).where("start > 0 and len > 0"), by, "inner", at_most
        )
    else:
        literal = [
            F.struct(F.lit(s).cast("int").alias("start"), F.lit(n).cast("int").alias("len"))
            for s, n in valid_windows(windows)
        ]
        none = F.array().cast("array<struct<start:int,len:int>>")
        paired = sequences.withColumn("window", F.explode(F.array(*literal) if literal else none))
        paired = paired.withColumns({"start": F.col("window.start"), "len": F.col("window.len")})
    return paired.select(*carried, *WINDOW, F.substring(F.col("sequence"), F.col("start"), F.col("len")).alias("peptide"))


def full_outer_all_unique(copies_all: DataFrame, copies_unique: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over all and over distinct sequences side by side, for counts made in two places.

    ``window_tallies`` has both from one pass and does not need this join.
    """
    keys = [*by, *WINDOW, "peptide"]
    both = copies_all.join(copies_unique, keys, "full")
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frequency_all", "frequency_unique")])


def _window_place() -> Column:
    """The order of windows, by start and length, as one number: a hash aggregate can hold its extremes."""
    return F.shiftleft(F.col("start").cast("long"), 32) + F.col("len")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))


def _starts(windows: Iterable[tuple[int, int]]) -> Column:
    """A list of windows as an array of (start, lens): the lengths asked for at each start."""
    found: dict[int, list[int]] = {}
    for start, length in valid_windows(windows):
        found.setdefault(int(start), []).append(int(length))
    literal = [F.struct(F.lit(start).alias("start"), F.array(*[F.lit(n) for n in sorted(lens)]).alias("lens")) for start, lens in found.items()]
    return F.array(*literal) if literal else F.array().cast("array<struct<start:int,lens:array<int>>>")


def window_tallies(
    isolates: DataFrame, windows: Iterable[tuple[int, int]] | DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Count, total and share of every observed substring in every window, per group of ``by``.

    Windows that share a start are prefixes of the longest one: each distinct sequence is cut once per
    start, the longest substrings are counted, and shorter ones are counted from these counts. Every
    sequence has one substring in each window, so a window's totals are those of its group. They are known
    before, come along from the start and need no join by window; a window that holds most rows is split like any other.
    """
    weighted = distinct_sequences(isolates, by)
    sums = [F.sum("copies").alias("total_all"), F.count(F.lit(1)).alias("total_unique")]
    if isinstance(windows, DataFrame):
        if not by:
            raise ValueError("a table of windows needs the columns it is joined on")
        asked = windows.select(*by, F.col("start").cast("int").alias("start"), F.col("len").cast("int").alias("len")).where("start > 0 and len > 0")
        # The lengths at one start: a short list. Windows and totals are small next to the sequences.
        asked = asked.groupBy(*by, "start").agg(F.array_sort(F.collect_set("len")).alias("lens"))
        paired = lookup_join(weighted, lookup_join(asked, weighted.groupBy(*by).agg(*sums), by, "inner"), by, "inner")
    else:
        starts = F.explode(_starts(windows)).alias("window")
        if by:
            paired = lookup_join(weighted, weighted.groupBy(*by).agg(*sums), by, "inner").select("*", starts)
        else:
            paired = weighted.select("*", weighted.agg(F.struct(*sums)).scalar().alias("totals"), starts).select("*", "totals.*")
        paired = paired.select("*", "window.*")
    totals = ["total_all", "total_unique"]
    longest = F.substring(F.col("sequence"), F.col("start"), F.element_at("lens", -1)).alias("peptide")
    counts = paired.select(*by, "start", "lens", *totals, "copies", longest).groupBy(*by, "start", "lens", *totals, "peptide").agg(
        F.sum("copies").alias("frequency_all"), F.count(F.lit(1)).alias("frequency_unique")
    ).select("*", F.explode("lens").alias("len")).withColumn("peptide", F.substring(F.col("peptide"), F.lit(1), F.col("len")))
    if isinstance(windows, DataFrame) or len({start for start, _ in valid_windows(windows)}) < len(valid_windows(windows)):
        counts = counts.groupBy(*by, *WINDOW, *totals, "peptide").agg(
            F.sum("frequency_all").alias("frequency_all"), F.sum("frequency_unique").alias("frequency_unique"))
    return counts.select(
        *by, *WINDOW, "peptide",
        "frequency_all", "total_all", _share("frequency_all", "total_all").alias("proportion_all"),
        "frequency_unique", "total_unique", _share("frequency_unique", "total_unique").alias("proportion_unique"),
    )


def window_tallies_selected(tallies: DataFrame, selected: str) -> DataFrame:
    """Tallies of one window, with a zero row for the selected peptide when it was never seen."""
    measures = [c for c in tallies.columns if c not in WINDOW]
    seen = F.count_if(F.upper("peptide") == selected.upper())
    summary = tallies.agg(
        seen.alias("seen"),
        F.coalesce(F.max("total_all"), F.lit(0)).alias("total_all"),
        F.coalesce(F.max("total_unique"), F.lit(0)).alias("total_unique"),
    )
    zero = summary.where("seen = 0").select(
        F.lit(selected).alias("peptide"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("frequency_all", "frequency_unique")],
        *[F.lit(0.0).alias(c) for c in ("proportion_all", "proportion_unique")],
        "total_all", "total_unique",
    )
    return tallies.select(*measures).unionByName(zero.select(*measures))


def _name(text: Column) -> Column:
    """How proteins are compared here."""
    return F.upper(F.trim(text))


def _of(rows: DataFrame, protein: str | None) -> DataFrame:
    """The rows of one protein; without a name all rows, with their proteins' names as they are compared."""
    if protein is None:
        return rows.withColumn("protein", _name(F.col("protein")))
    return rows.where(_name(F.col("protein")) == protein.strip().upper())


def _by(protein: str | None) -> list[str]:
    """What tallies of one protein lack and those of all proteins are grouped by."""
    return ["protein"] if protein is None else []


def _tallied(tallies: DataFrame, protein: str | None) -> DataFrame:
    return _of(tallies, None) if protein is None else tallies


def _shown(protein: str | None) -> Column:
    return F.col("protein") if protein is None else F.lit(protein).alias("protein")


def peptide_tallies(aligned: DataFrame, tallies: DataFrame, protein: str | None = None) -> DataFrame:
    """Frequencies of each uploaded peptide summed over the windows it was seen in.

    Totals are those of its first window, and the shares are formed anew. With a protein the tallies
    are that protein's; without, they have a column ``protein`` and all proteins are done at once.
    """
    by = _by(protein)
    placed = aligned.where((F.length("peptide_aligned") > 0) & (F.col("start") > 0))
    uploads = _of(placed, protein).select(*by, F.upper("peptide_aligned").alias("key")).distinct()
    wanted = lookup_join(_tallied(tallies, protein).withColumn("key", F.upper("peptide")), uploads, [*by, "key"], "left_semi")
    summed = wanted.groupBy(*by, "peptide").agg(
        F.sum("frequency_all").alias("frequency_all"),
        F.min_by("total_all", _window_place()).alias("total_all"),
        F.sum("frequency_unique").alias("frequency_unique"),
        F.min_by("total_unique", _window_place()).alias("total_unique"),
    )
    return summed.select(
        _shown(protein), "peptide",
        "frequency_all", "total_all", _share("frequency_all", "total_all").alias("proportion_all"),
        "frequency_unique", "total_unique", _share("frequency_unique", "total_unique").alias("proportion_unique"),
    ).orderBy("protein", F.desc("proportion_all"), "peptide")


def _leading(tallies: DataFrame, group: Sequence[str], metric: str, most: int) -> DataFrame:
    """The first ``most`` peptides of each group. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(metric), F.asc("peptide"))
    return tallies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _slot(board: str, row: Column, most: int) -> Column:
    """How many entries of a sorted ``board`` of at most ``most`` are not after ``row``, by binary search."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        # A board that ends before ``middle`` has null there, which is after every row.
        return F.when(F.get(board, F.lit(middle)) <= row, within(middle + 1, high)).otherwise(within(low, middle))

    return within(0, most)


def top_candidates_by_window(tallies: DataFrame, most: int = TOP_CANDIDATES, by: Sequence[str] = ()) -> DataFrame:
    """Peptides among the first ``most`` of their window by either share, with both exact ranks.

    The tallies are read twice: store them first. The candidates of a window, sorted by either share, are its
    two boards. Each tally row finds its slot on both boards; a candidate's rank is one more than the rows in
    the slots before it. So no row is multiplied and no window is sorted in one task. Boards are stored: a
    window that holds most rows can be split against them, and they are broadcast only if their size allows.
    """
    group = [*by, *WINDOW]
    kept = ["peptide", "proportion_all", "proportion_unique", "frequency_all", "total_all", "frequency_unique", "total_unique"]
    # Both sets are partitioned by window already; a full join on all columns is their union.
    chosen = _leading(tallies, group, "proportion_all", most).join(
        _leading(tallies, group, "proportion_unique", most), tallies.columns, "full"
    )

    def place(metric: str) -> Column:
        return F.struct((-F.col(metric)).alias("metric"), F.col("peptide").alias("peptide"))

    # At most twice ``most`` entries per window.
    entries = chosen.groupBy(*group).agg(F.collect_list(F.struct(*kept)).alias("entries"))
    board = lambda metric: F.array_sort(F.transform("entries", lambda e: F.struct((-e[metric]).alias("metric"), e["peptide"].alias("peptide"))))
    boards = pin(entries.select(*group, "entries", board("proportion_all").alias("board_all"), board("proportion_unique").alias("board_unique")))
    slots = lookup_join(tallies.select(*group, "peptide", "proportion_all", "proportion_unique"), boards.select(*group, "board_all", "board_unique"), group, "inner")
    slots = slots.select(*group, _slot("board_all", place("proportion_all"), 2 * most).alias("slot_all"),
                         _slot("board_unique", place("proportion_unique"), 2 * most).alias("slot_unique"))
    filled = slots.groupBy(*group, "slot_all", "slot_unique").agg(F.count(F.lit(1)).alias("rows"))
    # Rows up to each slot: a few numbers per window.
    before = [F.array(*[F.sum(F.when(F.col(slot) <= n, F.col("rows")).otherwise(0)) for n in range(2 * most)]).alias(f"before_{slot}")
              for slot in ("slot_all", "slot_unique")]
    ranked = boards.join(filled.groupBy(*group).agg(*before), group).select("*", F.inline("entries"))

    def rank(metric: str, board: str, slot: str) -> Column:
        return F.get(f"before_{slot}", (F.array_position(F.col(board), place(metric)) - 1).cast("int")) + 1

    return ranked.select(
        *group, "peptide", rank("proportion_all", "board_all", "slot_all").alias("r_all"), rank("proportion_unique", "board_unique", "slot_unique").alias("r_u"),
        *kept[1:],
    ).orderBy(*group, "r_all", "r_u", "peptide")


def top_alternates(
    window_rows: DataFrame, selected: str, unique: bool = False, most: int = TOP_ALTERNATES
) -> DataFrame:
    """The clicked peptide (rank 0) and its most frequent alternates in the same window."""
    proportion, frequency, total = (
        f"{m}_{'unique' if unique else 'all'}" for m in ("proportion", "frequency", "total")
    )
    bare = selected.replace("-", "").strip().upper()
    rows = window_rows.select(
        "peptide", F.col(proportion).alias("proportion"), F.col(frequency).alias("frequency"),
        F.col(total).alias("total"), peptide_key(F.col("peptide")).alias("ungapped_key"),
    )
    # An aggregate without groups has one row even when the peptide was never seen.
    own = F.struct("proportion", "frequency", "total", "peptide")
    head = rows.where(F.col("ungapped_key") == bare).agg(F.max(own).alias("own")).select(
        F.lit(0).alias("rank"),
        F.coalesce("own.peptide", F.lit(selected.replace("-", ""))).alias("peptide"),
        F.coalesce("own.proportion", F.lit(0.0)).alias("proportion"),
        F.coalesce("own.frequency", F.lit(0)).alias("frequency"),
        F.coalesce("own.total", F.lit(0)).alias("total"),
        F.lit(bare).alias("ungapped_key"),
    )
    alternates = rows.where(F.col("ungapped_key") != bare).orderBy(F.desc("proportion"), "peptide").limit(most)
    ranked = alternates.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("proportion"), "peptide"))
    )
    return head.unionByName(ranked.select(*head.columns))


def mismatch_template(rows: DataFrame, selected: str, key: str = "ungapped_key") -> DataFrame:
    """Write each peptide into the clicked one's gap pattern and mark the columns that differ.

    The pattern is a constant: each of its columns is a gap or the next letter, or nothing when
    the peptide is shorter. ``mismatches`` has ``x`` where the letters differ and ``.`` elsewhere.
    """
    columns, letter = [], 0
    for sign in selected:
        letter += sign != "-"
        columns.append(F.lit("-") if sign == "-" else F.substring(key, letter, 1))
    shown = F.concat(*columns) if columns else F.lit("")
    compared = [
        F.when(F.substring("display_peptide", i, 1) == "", "").when(
            F.substring("display_peptide", i, 1) != F.lit(sign), "x"
        ).otherwise(".")
        for i, sign in enumerate(selected, start=1)
    ]
    return rows.withColumn("display_peptide", shown).withColumn(
        "mismatches", F.concat(*compared) if compared else F.lit("")
    )


def peptide_proportion_lookup(aligned: DataFrame, tallies: DataFrame, unique: bool = False) -> DataFrame:
    """Share of each aligned peptide in its own window; 0 when it was not seen there.

    Peptides are compared without gaps; of several gap patterns the largest share counts. Tallies
    with a column ``protein`` are looked up by protein.
    """
    metric = "proportion_unique" if unique else "proportion_all"
    named = ["__protein"] if "protein" in tallies.columns else []
    shares = tallies.withColumn("key", F.upper(ungapped(F.col("peptide"))))
    text = F.when(F.length("peptide_aligned") > 0, F.col("peptide_aligned")).otherwise(F.col("peptide"))
    keyed = aligned.withColumn("key", F.upper(ungapped(text)))
    if named:
        shares, keyed = (rows.withColumn("__protein", _name(F.col("protein"))) for rows in (shares, keyed))
    shares = shares.groupBy(*named, "start", F.col("len").alias("length"), "key").agg(F.max(metric).alias("proportion"))
    joined = lookup_join(keyed, shares, [*named, "start", "length", "key"], "left")
    return joined.select(*aligned.columns, F.coalesce("proportion", F.lit(0.0)).alias("proportion"))


def aligned_summary(aligned: DataFrame) -> DataFrame:
    """Aligned and other peptides of each protein."""
    marked = aligned.select(protein_key(F.col("protein")).alias("protein"), is_aligned(aligned).alias("hit"))
    return marked.groupBy("protein").agg(
        F.count_if("hit").alias("aligned"), F.count_if(~F.col("hit")).alias("not_aligned")
    )


def conserved_summary(aligned: DataFrame, tallies: DataFrame, protein: str | None = None) -> DataFrame:
    """Uploaded peptides whose largest share is above and below the conserved bound, of one protein or of each.

    A peptide that was not seen counts as below; one exactly at the bound counts in neither.
    """
    by = _by(protein)
    if protein is None:
        aligned, tallies = (rows.withColumn("protein", protein_key(F.col("protein"))) for rows in (aligned, tallies))
    else:
        aligned = aligned.where(protein_key(F.col("protein")) == protein_key(F.lit(protein)))
    uploads = aligned.select(*by, peptide_key(F.col("peptide")).alias("key")).where("key <> ''").distinct()
    shares = tallies.select(
        *by, peptide_key(F.col("peptide")).alias("key"), F.coalesce("proportion_all", "proportion_unique").alias("share")
    ).groupBy(*by, "key").agg(F.max("share").alias("share"))
    share = F.coalesce("share", F.lit(0.0))
    return uploads.join(shares, [*by, "key"], "left").groupBy(*by).agg(
        F.count_if(share > CONSERVED_SHARE).alias("conserved"), F.count_if(share < CONSERVED_SHARE).alias("not_conserved")
    )


def _root_windows(aligned: DataFrame, protein: str | None) -> DataFrame:
    """Distinct (root, window) of the uploads of one protein, or of each."""
    return _of(aligned.where((F.col("start") > 0) & (F.col("length") > 0)), protein).select(
        *_by(protein), F.upper(ungapped(F.col("peptide"))).alias("root"),
        F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("len"),
    ).where("root <> ''").distinct()


def window_roots(aligned: DataFrame, candidates: DataFrame, protein: str | None = None) -> DataFrame:
    """Root peptides of every candidate: those uploaded in its windows, and itself if uploaded.

    Of one protein, or with the column ``protein`` of each.
    """
    by = _by(protein)
    by_window = _root_windows(aligned, protein)
    keyed = _tallied(candidates, protein).select(*by, F.upper(ungapped(F.col("peptide"))).alias("peptide"), *WINDOW).distinct()
    found = lookup_join(keyed, by_window, [*by, *WINDOW], "inner").select(*by, "peptide", "root")
    own = _of(aligned, protein).select(*by, F.upper(ungapped(F.col("peptide"))).alias("peptide")).withColumn("root", F.col("peptide"))
    return found.unionByName(own).where("peptide <> ''").distinct()


_COUNTS = ("frequency_all", "total_all", "frequency_unique", "total_unique")


def annotations_by_prediction(predictions: DataFrame, tallies: DataFrame, roots: DataFrame, protein: str | None = None) -> DataFrame:
    """Each prediction once, with ``found``: the proteins whose tallies or roots hold its peptide, and what they say.

    Frequencies are summed over windows; the totals are those of the last window; roots are joined by ``;``.
    ``found`` is null where no protein has the peptide. Of one protein, or with their column ``protein`` of all.
    """
    by = _by(protein)
    predicted = predictions.select(F.upper(ungapped(F.col("peptide"))).alias("peptide")).distinct()
    bare = _tallied(tallies, protein).withColumn("peptide", F.upper(ungapped(F.col("peptide"))))
    summed = lookup_join(bare, predicted, "peptide", "left_semi").groupBy(*by, "peptide").agg(
        F.sum("frequency_all").alias("frequency_all"), F.max_by("total_all", _window_place()).alias("total_all"),
        F.sum("frequency_unique").alias("frequency_unique"), F.max_by("total_unique", _window_place()).alias("total_unique"),
    )
    # The list of roots is part of the result row.
    joined_roots = _tallied(roots, protein).groupBy(*by, "peptide").agg(F.array_join(F.array_sort(F.collect_set("root")), ";").alias("root"))
    both = summed.join(joined_roots, [*by, "peptide"], "full").select(
        _shown(protein), "peptide", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], F.coalesce("root", F.lit("")).alias("root"))
    # At most one entry per protein.
    found = both.groupBy("peptide").agg(F.collect_list(F.struct("protein", *_COUNTS, "root")).alias("found"))
    base = predictions.select(
        F.upper("allele").alias("allele"), F.upper(ungapped(F.col("peptide"))).alias("peptide"),
        "netmhcpan_el_percentile", "netmhcpan_ba_percentile",
    )
    return lookup_join(base, found, "peptide", "left")


def unfold_annotations(annotated: DataFrame, proteins: Column | None = None) -> DataFrame:
    """One row per prediction and protein that has its peptide, or per prediction and each of an array ``proteins``.

    A protein without the peptide has zeros and no root.
    """
    if proteins is None:
        shown = F.col("found")
    else:
        annotated = annotated.withColumn("wanted", proteins)
        zeros = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
        shown = F.transform("wanted", lambda p: F.coalesce(
            F.get(F.filter("found", lambda f: f["protein"] == p), 0), F.struct(p.alias("protein"), *zeros, F.lit("").alias("root"))))
    rows = annotated.select("allele", "peptide", "netmhcpan_el_percentile", "netmhcpan_ba_percentile", F.inline(shown))
    return rows.select(
        "protein", "allele", "peptide", "netmhcpan_el_percentile", "netmhcpan_ba_percentile",
        "frequency_all", "total_all", _share("frequency_all", "total_all").alias("proportion_all"),
        "frequency_unique", "total_unique", _share("frequency_unique", "total_unique").alias("proportion_unique"), "root",
    )


def annotate_predictions(predictions: DataFrame, tallies: DataFrame, roots: DataFrame, protein: str | None = None) -> DataFrame:
    """Predictions with the tallies of their peptide and its roots, joined by ``;``.

    Without a protein every prediction comes once for each protein that has tallies or roots; for the rows of
    proteins that have its peptide alone, unfold ``annotations_by_prediction``.
    """
    annotated = annotations_by_prediction(predictions, tallies, roots, protein)
    if protein is None:
        # The proteins' names: one short list, as a subquery.
        names = tallies.select("protein").unionByName(roots.select("protein")).agg(F.collect_set(_name(F.col("protein")))).scalar()
    else:
        names = F.array(F.lit(protein))
    return unfold_annotations(annotated, names)


def frequency_summary(
    aligned: DataFrame, tallies: DataFrame, protein: str | None = None, most: int = TOP_ALTERNATES
) -> DataFrame:
    """Every root seen in its windows with its tallies, and up to four alternates from there.

    Alternates are the most frequent over all sequences. The fill from the ranking over distinct
    sequences only applies when there are fewer, and then the first ranking already has them all.
    Of one protein, or of each that the tallies' column ``protein`` names.

    Each window's peptides are read from the most frequent one downwards. What stands deeper than the last one read
    has at most the sum of these in a root's windows; once a root's alternates have more, it is done. The few
    roots that aren't go on deeper. So a root meets some peptides of its windows, not all.
    """
    by = _by(protein)
    rows = _tallied(tallies, protein).select(
        *by, *WINDOW, F.upper(ungapped(F.col("peptide"))).alias("peptide"),
        "frequency_all", "total_all", "frequency_unique", "total_unique",
    ).where("peptide <> ''")
    # Gapped forms of a peptide are one.
    rows = pin(rows.groupBy(*by, *WINDOW, "peptide").agg(
        F.sum("frequency_all").alias("frequency_all"), F.max("total_all").alias("total_all"),
        F.sum("frequency_unique").alias("frequency_unique"), F.max("total_unique").alias("total_unique"),
    ))
    roots = pin(_root_windows(aligned, protein))

    def summed(pairs: DataFrame) -> DataFrame:
        """(root, peptide) pairs with their sums over the root's windows."""
        met = pairs.join(roots, [*by, "root"]).join(rows, [*by, *WINDOW, "peptide"])
        return met.groupBy(*by, "root", "peptide").agg(
            F.sum("frequency_all").alias("frequency_all"), F.max_by("total_all", _window_place()).alias("total_all"),
            F.sum("frequency_unique").alias("frequency_unique"), F.max_by("total_unique", _window_place()).alias("total_unique"))

    own = pin(summed(roots.select(*by, "root", F.col("root").alias("peptide")).distinct()))
    order = [F.desc("frequency_all"), F.desc("frequency_unique"), F.asc("peptide")]
    left, depth, found = own.select(*by, "root"), most + 1, [own]
    while True:
        listed = pin(_alternates_read(rows, roots, left, by, order, depth))
        pairs = listed.where(F.col("peptide") != F.col("root")).select(*by, "root", "peptide").distinct()
        place = F.row_number().over(Window.partitionBy(*by, "root").orderBy(*order))
        best = pin(summed(pairs).withColumn("place", place).where(F.col("place") <= most))
        # Of a root with one window, the peptides read are the first ones.
        bounds = listed.groupBy(*by, "root").agg(
            F.sum(F.when(F.col("read") == depth, F.col("frequency_all")).otherwise(0)).alias("bound"), F.max("windows").alias("windows"))
        weakest = best.groupBy(*by, "root").agg(F.min("frequency_all").alias("least"), F.count(F.lit(1)).alias("held"))
        done = (F.col("bound") == 0) | (F.col("windows") == 1) | ((F.col("held") == most) & (F.col("least") > F.col("bound")))
        judged = pin(bounds.join(weakest, [*by, "root"], "left").withColumn("done", F.coalesce(done, F.lit(False))).select(*by, "root", "done"))
        found.append(best.join(judged.where("done"), [*by, "root"], "left_semi").drop("place"))
        left = judged.where(~F.col("done")).select(*by, "root")
        if left.isEmpty():
            break
        depth *= 4
    paired = found[0]
    for more in found[1:]:
        paired = paired.unionByName(more)
    return paired.select(
        "peptide", _shown(protein),
        "frequency_all", "total_all", _share("frequency_all", "total_all").alias("proportion_all"),
        "frequency_unique", "total_unique", _share("frequency_unique", "total_unique").alias("proportion_unique"),
        F.col("root").alias("root_peptide"),
    )


def _alternates_read(rows: DataFrame, roots: DataFrame, left: DataFrame, by: list[str], order: list[Column], depth: int) -> DataFrame:
    """The first ``depth`` peptides of each window of the roots in ``left``: their place in the window is ``read``."""
    windows = roots.join(left, [*by, "root"], "left_semi")
    counted = windows.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("windows"))
    wanted = windows.select(*by, *WINDOW).distinct()
    first = lookup_join(rows, wanted, [*by, *WINDOW], "left_semi").select(*by, *WINDOW, "peptide", "frequency_all", "frequency_unique")
    first = first.withColumn("read", F.row_number().over(Window.partitionBy(*by, *WINDOW).orderBy(*order))).where(F.col("read") <= depth)
    return windows.join(counted, [*by, "root"]).join(first, [*by, *WINDOW]).select(*by, "root", "windows", "peptide", "read", "frequency_all")
