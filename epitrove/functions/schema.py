"""Find columns by the several names under which prediction tables carry them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Column names of prediction tables.
METHOD_PERCENTILES = {
    "netmhcpan_el": "netmhcpan_el percentile",
    "netmhcpan_ba": "netmhcpan_ba percentile",
    "netmhciipan_el": "netmhciipan_el percentile",
    "netmhciipan_ba": "netmhciipan_ba percentile",
}
LENGTH_NAMES = ("peptide length", "length", "peptide_length", "Length")
SEQUENCE_NAMES = ("seq #", "sequence_number")
LABEL_SEQUENCE_NAMES = ("seq #", "sequence_number", "sequence_index")
CLASS_PREFIX = {"I": "netmhcpan", "II": "netmhciipan"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError("missing expected columns: " + ", ".join(missing))


def percentile_column(columns: Sequence[str], method: str) -> str | None:
    """Exact name, then any percentile column naming the method, then any percentile column."""
    exact = METHOD_PERCENTILES.get(method)
    if exact in columns:
        return exact
    percentiles = [c for c in columns if "percentile" in c.lower()]
    for_method = [c for c in percentiles if method.lower() in c.lower()]
    return next(iter(for_method + percentiles), exact)


def class_percentile_column(columns: Sequence[str], mhc_class: str = "I", mode: str = "EL") -> str | None:
    """Percentile column of a class and mode, ignoring case and separators in its name."""
    kind = "ba" if "BA" in mode.upper() else "el"
    prefix = CLASS_PREFIX["II" if mhc_class == "II" else "I"]
    squeezed = {}
    for column in columns:
        squeezed[re.sub(r"[\s_-]+", "", column.lower())] = column
    for candidate in (f"{prefix}{kind}percentile", f"{kind}percentile"):
        if candidate in squeezed:
            return squeezed[candidate]
    return next((c for c in columns if re.search(f"{kind}.*percent", c, re.IGNORECASE)), None)


def percentile_value(columns: Sequence[str], mode: str = "EL", explicit: str | None = None) -> Column:
    """Each row's own percentile: that of an explicit column if the table has it, else of the first that is filled.

    Class I comes before class II, and a name with an underscore before the same with a space. So a table may
    mix rows of both classes.
    """
    if explicit in columns:
        return quoted(explicit).cast("double")
    kind = "ba" if "BA" in mode.upper() else "el"
    names = [f"{prefix}_{kind}{sign}percentile" for prefix in CLASS_PREFIX.values() for sign in ("_", " ")]
    return F.coalesce(*[quoted(name).cast("double") for name in names if name in columns], F.lit(None).cast("double"))


def allele_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First column equal to one of the names without regard to case, else containing one."""
    wanted = [name.lower() for name in names]
    equal = [c for c in columns if c.lower() in wanted]
    holding = [c for c in columns if any(w in c.lower() for w in wanted)]
    return next(iter(equal + holding), None)


def first_present(df: DataFrame, names: Sequence[str]) -> Column | None:
    found = [quoted(name) for name in names if name in df.columns]
    if not found:
        return None
    return F.coalesce(*found)


def peptide_length(df: DataFrame) -> Column:
    found = first_present(df, LENGTH_NAMES)
    return (F.lit(None) if found is None else found).cast("int")


def sequence_number(df: DataFrame, names: Sequence[str] = SEQUENCE_NAMES) -> Column:
    """1-based sequence number; rows without one belong to sequence 1."""
    found = first_present(df, names)
    return F.lit(1) if found is None else F.coalesce(found.cast("int"), F.lit(1))
