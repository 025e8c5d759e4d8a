"""Loan book of the whole corporate economy of a region, as a benchmark.

Every ultimate owner with production in the region is lent its production, so that
exposure weights become production weights.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.missing import known_total, text_or_na
from loanlens.functions.relations import dimension, match, with_position
from loanlens.operators.checks import (
    not_found,
    occurs,
    one_integer,
    one_text,
    validate_data_has_expected_cols,
)
from loanlens.sources import schemas

COMPANY_SECTOR = ["company_id", "sector", "code", "name_company", "lei"]


def listed_position(table: DataFrame) -> Column:
    """Where a row stands in its table: `ordinal`, or else its place in the file it is read from.

    Only Parquet files tell places; for other tables it is the code, so that the smallest
    comes first.
    """
    if "ordinal" in table.columns:
        return F.col("ordinal")
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        table.select(place)
    except AnalysisException:
        return F.col("code")
    return place


def pick_sector_codes(sector_codes: DataFrame) -> DataFrame:
    """The longest unambiguous code of each sector, the first listed of several."""
    shortness = -F.coalesce(F.length("code"), F.lit(-1))
    first = F.struct(shortness, listed_position(sector_codes))
    return (
        sector_codes.where(~F.col("borderline"))
        .groupBy("sector")
        .agg(F.min_by("code", first).alias("code"))
    )


def countries_of_region(
    region_isos: DataFrame, scenario_source: str, benchmark_region: str
) -> DataFrame:
    in_region = (F.col("source") == scenario_source) & (F.col("region") == benchmark_region)
    return region_isos.where(in_region).select(F.upper("isos").alias("plant_location")).distinct()


def regional_production(
    data: DataFrame, start_year: int, countries: DataFrame, codes: DataFrame
) -> DataFrame:
    """Production of ultimate owners in the countries and year, per company and sector."""
    owners = data.where(F.col("is_ultimate_owner") & (F.col("year") == start_year))
    local = match(owners, dimension(countries), ["plant_location"], "left_semi")
    return (
        match(local, dimension(codes), ["sector"])
        .groupBy(*COMPANY_SECTOR)
        .agg(known_total(F.col("production")).alias("production_sector"))
    )


def as_matched_loanbook(companies: DataFrame, benchmark_region: str) -> DataFrame:
    """The companies in the layout of a matched loan book, without `id_loan`."""

    def numbered(prefix: str) -> Column:
        return F.concat(F.lit(prefix), text_or_na(F.col("company_id")))

    nothing = F.lit(None).cast("string")
    name, production = F.col("name_company"), F.col("production_sector")
    columns = {
        "id_direct_loantaker": numbered("C"),
        "name_direct_loantaker": name,
        "id_intermediate_parent_1": nothing,
        "name_intermediate_parent_1": nothing,
        "id_ultimate_parent": numbered("UP"),
        "name_ultimate_parent": name,
        "loan_size_outstanding": production,
        "loan_size_outstanding_currency": F.lit("USD"),
        "loan_size_credit_limit": production,
        "loan_size_credit_limit_currency": F.lit("USD"),
        "sector_classification_system": F.lit("NACE"),
        "sector_classification_input_type": F.lit("Code"),
        "sector_classification_direct_loantaker": F.col("code"),
        "fi_type": F.lit("Loan"),
        "flag_project_finance_loan": F.lit("No"),
        "name_project": nothing,
        "lei_direct_loantaker": F.col("lei"),
        "isin_direct_loantaker": nothing,
        "id_2dii": numbered("DL"),
        "level": F.lit("direct_loantaker"),
        "sector": F.col("sector"),
        "sector_abcd": F.col("sector"),
        "name": name,
        "name_abcd": name,
        "score": F.lit(1.0),
        "source": F.lit("loanbook"),
        "borderline": F.lit(False),
        "group_id": F.lit(f"benchmark_corporate_economy_{benchmark_region}"),
    }
    positions = [c for c in companies.columns if c == "position"]
    return companies.select(*[c.alias(n) for n, c in columns.items()], *positions)


def check_benchmark_input(
    data: DataFrame,
    scenario_source: str,
    start_year: int,
    region_isos: DataFrame,
    benchmark_region: str,
) -> None:
    in_source = F.col("source") == scenario_source
    if not occurs(region_isos, in_source):
        raise not_found(
            "scenario_source", "region_isos$source", scenario_source, region_isos.select("source")
        )
    if not occurs(region_isos, in_source & (F.col("region") == benchmark_region)):
        raise not_found(
            "benchmark_region",
            "region_isos$region` for the given `scenario_source",
            benchmark_region,
            region_isos.where(in_source).select("region"),
        )
    if not occurs(data, F.col("year") == start_year):
        raise not_found("start_year", "data$year", start_year, data.select("year"))


def create_benchmark_loanbook(
    data: DataFrame,
    scenario_source: str,
    start_year: int,
    region_isos: DataFrame,
    benchmark_region: str,
    *,
    sector_codes: DataFrame,
    validate: bool = True,
) -> DataFrame:
    """Benchmark loan book of `benchmark_region`, in matched form.

    `sector_codes` lists the industry classification's codes per sector.  Loans are
    numbered in the order of company, sector, code, name and legal entity.
    """
    one_text("scenario_source", scenario_source)
    one_integer("start_year", start_year)
    one_text("benchmark_region", benchmark_region)
    validate_data_has_expected_cols(data, schemas.column_names(schemas.ASSET_DATA))
    validate_data_has_expected_cols(region_isos, schemas.column_names(schemas.REGION_ISOS))
    validate_data_has_expected_cols(sector_codes, ["sector", "code", "borderline"])
    if validate:
        check_benchmark_input(data, scenario_source, start_year, region_isos, benchmark_region)

    countries = countries_of_region(region_isos, scenario_source, benchmark_region)
    companies = regional_production(data, start_year, countries, pick_sector_codes(sector_codes))
    loans = as_matched_loanbook(
        with_position(companies, COMPANY_SECTOR, "position"), benchmark_region
    )
    id_loan = F.concat(F.lit("L"), F.col("position").cast("string"))
    return loans.withColumn("id_loan", id_loan).drop("position")
