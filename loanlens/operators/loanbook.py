"""Alignment of loan books: company alignment weighted by exposure."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.missing import field, known, known_total, ratio
from loanlens.functions.relations import looked_up, match, with_group_totals
from loanlens.operators.checks import one_of, validate_data_has_expected_cols
from loanlens.operators.company_alignment import LEVELS, arranged_as
from loanlens.sources import schemas

GROUP = ["scenario", "region", "sector", "year", "direction"]
COMPANY_YEAR = ["scenario", "region", "sector", "year", "name_abcd"]
ALIGNMENT_COLUMNS = [*GROUP, "name_abcd", "activity_unit", "scenario_source", "alignment_metric"]
CURRENCY = "loan_size_outstanding_currency"
SIZE = "loan_size_outstanding"

# Sectors in which a company is expected to have both directions.
TWO_WAY_SECTORS = ["automotive", "hdv", "power"]

COUNTS = ["n_companies", "n_companies_aligned", "share_companies_aligned"]
EXPOSURES = [
    "sum_loan_size_outstanding",
    "sum_exposure_companies_aligned",
    "share_exposure_aligned",
]


class LoanbookAlignment(NamedTuple):
    """Results per company and per group; each is computed only when it is used."""

    company: DataFrame
    aggregate: DataFrame


def loan_exposure(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outstanding loans per group, currency, company and sector."""
    keys = [*by, CURRENCY, "name_abcd", "sector"]
    return matched.groupBy(*[field(k) for k in keys]).agg(known_total(field(SIZE)).alias(SIZE))


def add_exposure_weight(exposure: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each exposure's share of its book in its currency, over all sectors.

    A book in one currency can be the whole table, so its total is aggregated and
    joined back: by broadcast if the totals turn out few, so that no exposure is shuffled
    by its currency, else by a join that hot books are split in.  Nothing runs before
    the plan does, and the loans are read once.
    """
    keys = [*by, CURRENCY]
    totals = exposure.groupBy(*[field(k) for k in keys]).agg(
        known_total(field(SIZE)).alias("_book")
    )
    beside = looked_up(exposure, totals, keys)
    weight = ratio(field(SIZE), F.col("_book"))
    return beside.withColumn("exposure_weight", weight).drop("_book")


def in_both_directions(data: DataFrame, zeros: dict[str, Column]) -> DataFrame:
    """Rows of `data`, and an opposite for each that is alone in its direction.

    `_first` and `_last` are the first and last direction a company has in a place,
    year and unit.  `zeros` gives the columns of the opposite that differ.
    """
    direction = F.col("direction")
    alone = (
        (F.col("_first") == F.col("_last"))
        & direction.isin("buildout", "phaseout")
        & F.col("sector").isin(TWO_WAY_SECTORS)
    )
    other = F.when(direction == "buildout", "phaseout").otherwise("buildout")
    changed = {"direction": other, **zeros}
    columns = [c for c in data.columns if c not in ("_first", "_last")]
    # The other columns pass as they are, so that a partitioning by them stays known.
    here = F.struct(*[field(c) for c in changed])
    opposite = F.struct(*[value.alias(c) for c, value in changed.items()])
    rows = F.inline(F.when(alone, F.array(here, opposite)).otherwise(F.array(here)))
    same = [field(c) for c in columns if c not in changed]
    return data.select(*same, rows).select(*[field(c) for c in columns])


def add_opposite_directions(data: DataFrame) -> DataFrame:
    """A zero row in the other direction where a company has only one.

    Only for sectors that go both ways.  Loans multiply the rows of a company alike,
    so this is done before they are joined.
    """
    zeros = {"total_deviation": F.lit(0.0), "alignment_metric": F.lit(0.0)}
    data = data.withColumns(
        {
            c: field(c).cast("double") if c in data.columns else F.lit(None).cast("double")
            for c in zeros
        }
    )
    ranged = with_group_totals(
        data,
        [*COMPANY_YEAR, "activity_unit"],
        F.min("direction").alias("_first"),
        F.max("direction").alias("_last"),
    )
    return in_both_directions(ranged, zeros)


def join_exposure(
    data: DataFrame, exposure: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Company alignment beside every exposure to the company's sector."""
    company = match(data, exposure, ["name_abcd", "sector"], split_hot_keys=True)
    leading = [field(c) for c in by]
    return company.select(
        *leading,
        *[field(c) for c in data.columns],
        CURRENCY,
        SIZE,
        "exposure_weight",
    )


def summarise_exposure(exposure: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exposure to a company's sector over its currencies, one row per group."""
    weight = F.col("exposure_weight")
    return exposure.groupBy(*[field(k) for k in [*by, "name_abcd", "sector"]]).agg(
        F.count("*").alias("n_currencies"),
        F.sum(SIZE).alias("size"),
        F.sum(weight).alias("weight"),
        F.count_if(weight != 0).alias("n_weighted"),
        F.count_if(weight.isNull()).alias("n_unweighted"),
    )


def summarise_alignment(data: DataFrame, level: str) -> DataFrame:
    """Alignment of a company's sector over its units and sources, per year and direction.

    For `bo_po` opposite directions are added on the way, to one row per unit and
    direction: few enough for a window.  One shuffle, by keys that both sums and the
    window share, serves all three; a scenario may be a literal, so it is not one of them.
    """
    metric = known(F.col("alignment_metric"))
    sums = [
        F.count("*").alias("n_rows"),
        F.count_if(metric >= 0).alias("n_aligned"),
        F.count(metric).alias("n_known"),
        F.sum(metric).alias("metric"),
    ]
    if level == "net":
        return data.groupBy("name_abcd", *GROUP).agg(*sums)
    unit = Window.partitionBy(*COMPANY_YEAR, "activity_unit")
    shared = [field(k) for k in COMPANY_YEAR if k not in ("scenario", "scenario_source")]
    per_unit = (
        data.repartition(*shared)
        .groupBy("name_abcd", *GROUP, "activity_unit")
        .agg(*sums)
        .withColumn("_first", F.min("direction").over(unit))
        .withColumn("_last", F.max("direction").over(unit))
    )
    n_rows = F.col("n_rows")
    both = in_both_directions(
        per_unit, {"n_aligned": n_rows, "n_known": n_rows, "metric": F.lit(0.0)}
    )
    return both.groupBy("name_abcd", *GROUP).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_aligned", "n_known", "metric")]
    )


def aggregate_alignment(
    data: DataFrame, exposure: DataFrame, level: str, by: Sequence[str] = ()
) -> DataFrame:
    """Counts, exposure-weighted alignment and, for `net`, aligned exposure per group.

    Sums over a company's rows beside its exposures are products of sums over either,
    so both are summed first.  A group then meets each company once: companies are
    counted without a distinct aggregation, and rows are combined into groups before
    they are shuffled again.
    """
    group = [field(c) for c in [*by, *GROUP]]
    n_aligned, n_known, weight = F.col("n_aligned"), F.col("n_known"), F.col("weight")
    # Zero times an infinity would not be a number; zero weights leave a metric out.
    aligned_size = F.when(n_aligned == 0, 0.0).otherwise(n_aligned * F.col("size"))
    weighted = F.when((n_known == 0) | (F.col("n_weighted") == 0), 0.0)
    companies = match(
        summarise_alignment(data, level),
        summarise_exposure(exposure, by),
        ["name_abcd", "sector"],
        split_hot_keys=True,
    )
    per_group = companies.groupBy(*group).agg(
        F.count("*").alias("n_companies"),
        F.sum(n_aligned * F.col("n_currencies")).alias("n_companies_aligned"),
        F.sum(F.col("n_rows") * F.col("size")).alias("sum_loan_size_outstanding"),
        F.sum(aligned_size).alias("sum_exposure_companies_aligned"),
        F.sum(weighted.otherwise(F.col("metric") * weight)).alias("metrics"),
        F.sum(F.when(n_known == 0, 0.0).otherwise(n_known * weight)).alias("weights"),
        F.sum(n_known * F.col("n_unweighted")).alias("n_unweighted"),
    )
    columns = {
        "share_companies_aligned": ratio(
            F.col("n_companies_aligned").cast("double"), F.col("n_companies")
        ),
        "exposure_weighted_net_alignment": F.when(
            F.col("n_unweighted") == 0, ratio(F.col("metrics"), F.col("weights"))
        ),
    }
    kept = [*COUNTS, "exposure_weighted_net_alignment"]
    if level == "net":
        columns["share_exposure_aligned"] = ratio(
            F.col("sum_exposure_companies_aligned"), F.col("sum_loan_size_outstanding")
        )
        kept += EXPOSURES
    return per_group.withColumns(columns).select(*group, *kept)


def check_by(data: DataFrame, by: Sequence[str]) -> None:
    critical = {*ALIGNMENT_COLUMNS, *schemas.column_names(schemas.MATCHED_LOANS)}
    if critical & set(by):
        raise ValueError(
            "It is not possible to group by the critical columns of the `data` and "
            "`matched` inputs. Please check your `by` argument!"
        )
    ambiguous = sorted(set(data.columns) & {*by, CURRENCY, SIZE, "exposure_weight"})
    if ambiguous:
        raise ValueError(f"`data` must not have the column(s) {', '.join(ambiguous)}.")


def aggregate_alignment_loanbook_exposure(
    data: DataFrame,
    matched: DataFrame,
    level: str = "net",
    by: str | Sequence[str] | None = None,
    *,
    arranged: bool = False,
    position: str | None = None,
) -> LoanbookAlignment:
    """Alignment of the loan book(s) in `matched` from company alignment in `data`.

    `by` names columns of `matched` to tell loan books apart, none for one book.
    `level` says whether `data` is net or split into build-out and phase-out.
    `arranged` sorts the aggregate; `position` instead names a column for each row's place
    in that order.
    """
    one_of("level", level, LEVELS)
    by = [by] if isinstance(by, str) else list(dict.fromkeys(by or []))
    validate_data_has_expected_cols(data, ALIGNMENT_COLUMNS)
    validate_data_has_expected_cols(
        matched, [*schemas.column_names(schemas.MATCHED_LOANS), *by]
    )
    check_by(data, by)

    exposure = add_exposure_weight(loan_exposure(matched, by), by)
    rows = add_opposite_directions(data) if level == "bo_po" else data
    company = join_exposure(rows, exposure, by)
    aggregate = aggregate_alignment(data, exposure, level, by)
    return LoanbookAlignment(
        company, arranged_as(aggregate, [*by, *GROUP], arranged, position)
    )
