"""One query per operator and analysis, over the benchmark tables.

Counts come out as bigint and ratios rounded to six places, here only, so that
results can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions.missing import field
from loanlens.operators import benchmark, company_alignment, loanbook, report
from loanlens.operators import tech_deviation as deviation
from loanlens.operators.activity_units import build_activity_units
from loanlens.plans.proxies import (
    REGION,
    SCENARIO,
    SOURCE,
    START_YEAR,
    TIME_FRAME,
    Proxies,
)

TARGET = deviation.target_column(SCENARIO)
BY = ["group_id"]

RATIOS = [
    "alignment_metric",
    "exposure_weight",
    "share_companies_aligned",
    "exposure_weighted_net_alignment",
    "share_exposure_aligned",
]

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Round ratios and rename the target column, whose dot not every engine likes."""
    rounded = {c: F.round(field(c), 6) for c in df.columns if c in RATIOS or c in also}
    return df.withColumns(rounded).withColumnRenamed(TARGET, "target")


# Sectors with technology pathways


def long_rows(px: Proxies) -> DataFrame:
    data = px.tms_results
    return deviation.restrict_to_scenario(
        data, SOURCE, "metric", TARGET, deviation.first_year(data), TIME_FRAME
    ).drop(*deviation.NOT_IDENTIFYING)


def tms_filter_years(px: Proxies) -> DataFrame:
    return long_rows(px)


def tms_pivot(px: Proxies) -> DataFrame:
    return comparable(
        deviation.spread_metrics(
            long_rows(px), "metric", "production", ["projected", TARGET]
        )
    )


def wide_rows(px: Proxies) -> DataFrame:
    return deviation.output_beside_target(
        px.tms_results, px.technology_direction, SOURCE, SCENARIO, TIME_FRAME
    )


def tms_direction_join(px: Proxies) -> DataFrame:
    return comparable(wide_rows(px))


def tms_drop_empty_tech(px: Proxies) -> DataFrame:
    return comparable(deviation.without_idle_technologies(wide_rows(px), TARGET, True))


def tms_drop_zero_sector(px: Proxies) -> DataFrame:
    active = deviation.without_idle_technologies(wide_rows(px), TARGET, True)
    return comparable(deviation.without_untargeted_sectors(active, TARGET, True))


def deviations(px: Proxies, bridge_tech: str = "none") -> DataFrame:
    return deviation.calculate_company_tech_deviation(
        px.tms_results,
        px.technology_direction,
        SOURCE,
        SCENARIO,
        bridge_tech,
        TIME_FRAME,
        validate=False,
    )


def tech_deviation(px: Proxies) -> DataFrame:
    return comparable(deviations(px))


def tech_deviation_gascap(px: Proxies) -> DataFrame:
    return comparable(deviations(px, "gascap"))


def net_scenario_value(px: Proxies) -> DataFrame:
    return comparable(company_alignment.beside_scenario_total(deviations(px), TARGET))


def total_deviation(px: Proxies) -> DataFrame:
    return company_alignment.total_deviation_by_direction(deviations(px), TARGET)


def alignment(px: Proxies, level: str) -> DataFrame:
    return company_alignment.calculate_company_aggregate_alignment_tms(
        deviations(px), SOURCE, SCENARIO, level, validate=False
    )


def company_alignment_net(px: Proxies) -> DataFrame:
    return comparable(alignment(px, "net"))


def directed(px: Proxies) -> DataFrame:
    """Build-out and phase-out alignment before missing directions are filled in."""
    return company_alignment.relative_to_scenario(total_deviation(px), SCENARIO)


def company_alignment_bo_po(px: Proxies) -> DataFrame:
    return comparable(directed(px))


def complete_directions(px: Proxies) -> DataFrame:
    return comparable(alignment(px, "bo_po"))


# Sectors measured by emission intensity


def sda_pivot(px: Proxies) -> DataFrame:
    data = px.sda_results
    wide = company_alignment.intensity_beside_target(
        data, SOURCE, TARGET, deviation.first_year(data), TIME_FRAME
    )
    return comparable(wide, also=("projected", TARGET))


def alignment_sda(px: Proxies) -> DataFrame:
    return company_alignment.calculate_company_aggregate_alignment_sda(
        px.sda_results, SOURCE, SCENARIO, TIME_FRAME, validate=False
    )


def company_alignment_sda(px: Proxies) -> DataFrame:
    return comparable(alignment_sda(px), also=("total_deviation",))


# Loan books


def loan_exposure(px: Proxies) -> DataFrame:
    return loanbook.loan_exposure(px.matched)


def loan_exposure_weight(px: Proxies) -> DataFrame:
    weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(px.matched))
    return comparable(weighed)


def loan_exposure_weight_by(px: Proxies) -> DataFrame:
    weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(px.matched, BY), BY)
    return comparable(weighed)


def portfolio(px: Proxies, level: str, by: list[str] | None = None):
    return loanbook.aggregate_alignment_loanbook_exposure(
        alignment(px, level), px.matched, level, by
    )


def portfolio_company_net(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net").company)


def portfolio_company_net_by_group(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net", BY).company)


def portfolio_company_bo_po(px: Proxies) -> DataFrame:
    """From alignment without filled directions, which the loan book then fills."""
    return comparable(
        loanbook.aggregate_alignment_loanbook_exposure(directed(px), px.matched, "bo_po").company
    )


GROUP = loanbook.GROUP


def portfolio_counts(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net").aggregate.select(*GROUP, *loanbook.COUNTS))


def portfolio_exposure_aligned(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net").aggregate.select(*GROUP, *loanbook.EXPOSURES))


def portfolio_weighted_alignment(px: Proxies) -> DataFrame:
    return comparable(
        portfolio(px, "net").aggregate.select(*GROUP, "exposure_weighted_net_alignment")
    )


def portfolio_aggregate_net(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net").aggregate)


def portfolio_aggregate_bo_po(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "bo_po").aggregate)


def portfolio_aggregate_net_by_group(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "net", BY).aggregate)


def portfolio_aggregate_bo_po_by_group(px: Proxies) -> DataFrame:
    return comparable(portfolio(px, "bo_po", BY).aggregate)


def portfolio_tms_sda(px: Proxies) -> DataFrame:
    both = alignment(px, "net").unionByName(alignment_sda(px))
    return comparable(
        loanbook.aggregate_alignment_loanbook_exposure(both, px.matched, "net").aggregate
    )


# Results with their place in the arranged order


def arranged_tms(px: Proxies) -> DataFrame:
    return comparable(
        company_alignment.calculate_company_aggregate_alignment_tms(
            deviations(px), SOURCE, SCENARIO, "bo_po", validate=False, position="position"
        )
    )


def arranged_sda(px: Proxies) -> DataFrame:
    return comparable(
        company_alignment.calculate_company_aggregate_alignment_sda(
            px.sda_results, SOURCE, SCENARIO, TIME_FRAME, validate=False, position="position"
        ),
        also=("total_deviation",),
    )


def arranged_portfolio(px: Proxies) -> DataFrame:
    return comparable(
        loanbook.aggregate_alignment_loanbook_exposure(
            alignment(px, "bo_po"), px.matched, "bo_po", BY, position="position"
        ).aggregate
    )


# Reference tables and the benchmark loan book


def activity_units(px: Proxies) -> DataFrame:
    return build_activity_units(px.abcd)


def sector_code_pick(px: Proxies) -> DataFrame:
    """The code lent to every company-sector of the asset data."""
    sectors = px.abcd.groupBy("sector").agg(F.count_distinct("company_id").alias("n_companies"))
    return sectors.join(benchmark.pick_sector_codes(px.sector_codes), "sector")


def sector_code_listed(px: Proxies) -> DataFrame:
    """Codes of a stored table, of which the file's order decides between equally long ones."""
    return benchmark.pick_sector_codes(px.listed_codes)


def benchmark_book(px: Proxies) -> DataFrame:
    return benchmark.create_benchmark_loanbook(
        px.abcd,
        SOURCE,
        START_YEAR,
        px.region_isos,
        REGION,
        sector_codes=px.sector_codes,
        validate=False,
    )


def benchmark_loanbook(px: Proxies) -> DataFrame:
    return benchmark_book(px)


def benchmark_portfolio(px: Proxies) -> DataFrame:
    return comparable(
        loanbook.aggregate_alignment_loanbook_exposure(
            alignment(px, "net"), benchmark_book(px), "net", BY
        ).aggregate
    )


# Inputs with gaps and further columns


def deviations_by_plant(px: Proxies) -> DataFrame:
    return deviation.calculate_company_tech_deviation(
        px.tms_results_by_plant,
        px.technology_direction_by_plant,
        SOURCE,
        SCENARIO,
        time_frame=TIME_FRAME,
        validate=False,
    )


def tech_deviation_by_plant(px: Proxies) -> DataFrame:
    """Rows told apart by plant; missing regions; production that is not a number."""
    return comparable(deviations_by_plant(px))


def alignment_by_plant(px: Proxies) -> DataFrame:
    return company_alignment.calculate_company_aggregate_alignment_tms(
        deviations_by_plant(px), SOURCE, SCENARIO, "bo_po", validate=False
    )


def company_alignment_by_plant(px: Proxies) -> DataFrame:
    return comparable(alignment_by_plant(px))


def loan_exposure_weight_gaps(px: Proxies) -> DataFrame:
    weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(px.matched_with_gaps, BY), BY)
    return comparable(weighed)


def portfolio_gaps(px: Proxies) -> DataFrame:
    """Loans to nobody, in no currency or book, of no size, beside plants in no region."""
    return comparable(
        loanbook.aggregate_alignment_loanbook_exposure(
            alignment_by_plant(px), px.matched_with_gaps, "bo_po", BY
        ).aggregate
    )


def activity_units_mixed(px: Proxies) -> DataFrame:
    return build_activity_units(px.abcd_with_gaps)


def benchmark_loanbook_gaps(px: Proxies) -> DataFrame:
    return benchmark.create_benchmark_loanbook(
        px.abcd_with_gaps,
        SOURCE,
        START_YEAR,
        px.region_isos,
        REGION,
        sector_codes=px.sector_codes,
        validate=False,
    )


def contract_report(px: Proxies) -> DataFrame:
    """All value checks, two of them failing on purpose."""
    return report.contract_report(
        tms_results=px.tms_results,
        technology_direction=px.technology_direction,
        sda_results=px.sda_results,
        abcd=px.abcd,
        region_isos=px.region_isos,
        scenario_source=SOURCE,
        scenario="2c",
        start_year=1900,
        benchmark_region=REGION,
    )


def contract_values(px: Proxies) -> DataFrame:
    """Every value on offer to every check; some checks fail on purpose."""
    return report.contract_values(
        tms_results=px.tms_results,
        technology_direction=px.technology_direction,
        deviations=deviations(px),
        sda_results=px.sda_results,
        alignment=alignment(px, "net"),
        matched=px.matched,
        abcd=px.abcd,
        region_isos=px.region_isos,
        scenario_source="weo_2021",
        scenario=SCENARIO,
        start_year=1900,
        benchmark_region=REGION,
        by=["group_id", "sector", "bank"],
    )


ALL = [
    tms_filter_years,
    tms_pivot,
    tms_direction_join,
    tms_drop_empty_tech,
    tms_drop_zero_sector,
    tech_deviation,
    tech_deviation_gascap,
    net_scenario_value,
    total_deviation,
    company_alignment_net,
    company_alignment_bo_po,
    complete_directions,
    sda_pivot,
    company_alignment_sda,
    loan_exposure,
    loan_exposure_weight,
    loan_exposure_weight_by,
    portfolio_company_net,
    portfolio_company_net_by_group,
    portfolio_company_bo_po,
    portfolio_counts,
    portfolio_exposure_aligned,
    portfolio_weighted_alignment,
    portfolio_aggregate_net,
    portfolio_aggregate_bo_po,
    portfolio_aggregate_net_by_group,
    portfolio_aggregate_bo_po_by_group,
    portfolio_tms_sda,
    arranged_tms,
    arranged_sda,
    arranged_portfolio,
    activity_units,
    sector_code_pick,
    sector_code_listed,
    tech_deviation_by_plant,
    company_alignment_by_plant,
    loan_exposure_weight_gaps,
    portfolio_gaps,
    activity_units_mixed,
    benchmark_loanbook_gaps,
    benchmark_loanbook,
    benchmark_portfolio,
    contract_report,
    contract_values,
]


def registered() -> dict[str, Query]:
    def over_tables(plan: Callable[[Proxies], DataFrame]) -> Query:
        return lambda spark, sf_dir: plan(Proxies(spark, sf_dir))

    return {plan.__name__: over_tables(plan) for plan in ALL}
