"""Option lists behind the filter controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epitrove.functions.schema import quoted
from epitrove.operators.filters import filter_nonblank, search_values

FIRST_PAGE = 20
SEARCH_PAGE = 50
SEARCH_LETTERS = 2


def distinct_values(rows: DataFrame, name: str) -> DataFrame:
    """Trimmed values with their row counts."""
    filled = filter_nonblank(rows, name)
    return filled.groupBy(F.trim(quoted(name)).alias("val")).agg(F.count(F.lit(1)).alias("n"))


def page_values(rows: DataFrame, name: str, query: str = "", offset: int = 0, limit: int = SEARCH_PAGE) -> DataFrame:
    """One page of values: the most frequent first, or the matches of a search in order."""
    if len(query.strip()) < SEARCH_LETTERS:
        counted = distinct_values(rows, name)
        return counted.orderBy(F.desc("n"), "val").offset(offset).limit(FIRST_PAGE).select("val")
    found = distinct_values(search_values(rows, name, query), name)
    return found.select("val").orderBy("val").offset(offset).limit(limit)


def allele_classes(alleles: DataFrame) -> DataFrame:
    """Long form of the wide allele list: distinct ``(class, allele)``."""
    long = alleles.select(F.explode(F.array(
        F.struct(F.lit("I").alias("class"), F.trim(quoted("Class I")).alias("allele")),
        F.struct(F.lit("II").alias("class"), F.trim(quoted("Class II")).alias("allele")),
    )).alias("entry")).select("entry.*")
    return filter_nonblank(long, "allele").distinct()


def allele_options(
    alleles: DataFrame, mhc_class: str, query: str = "", offset: int = 0, limit: int = SEARCH_PAGE
) -> DataFrame:
    """One page of a class's alleles."""
    wanted = "II" if mhc_class == "II" else "I"
    listed = allele_classes(alleles).where(F.col("class") == wanted).select("allele")
    size = FIRST_PAGE
    if len(query.strip()) >= SEARCH_LETTERS:
        listed, size = search_values(listed, "allele", query), limit
    return listed.orderBy("allele").offset(offset).limit(size)
