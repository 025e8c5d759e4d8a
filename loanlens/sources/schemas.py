"""Schemas of the input relations.

Any DataFrame with these columns will do, from `spark.read` of any format or from a
table.  Extra columns are allowed; in the long relations they become part of what
identifies a row.
"""

from __future__ import annotations

TECHNOLOGY_RESULTS = """
    sector string, technology string, year int, region string, scenario_source string,
    name_abcd string, metric string, production double, technology_share double,
    scope string, percentage_of_initial_production_by_scope double
"""

TECHNOLOGY_DIRECTION = """
    scenario_source string, scenario string, sector string, technology string,
    region string, directional_dummy double
"""

ACTIVITY_UNITS = "sector string, technology string, activity_unit string"

INTENSITY_RESULTS = """
    sector string, year int, region string, scenario_source string, name_abcd string,
    emission_factor_metric string, emission_factor_value double
"""

COMPANY_ALIGNMENT = """
    name_abcd string, sector string, activity_unit string, region string,
    scenario_source string, scenario string, year int, direction string,
    total_deviation double, alignment_metric double
"""

MATCHED_LOANS = """
    id_loan string, loan_size_outstanding double, loan_size_outstanding_currency string,
    name_abcd string, sector string
"""

RAW_LOANS = """
    id_loan string, id_direct_loantaker string, name_direct_loantaker string,
    id_intermediate_parent_1 string, name_intermediate_parent_1 string,
    id_ultimate_parent string, name_ultimate_parent string,
    loan_size_outstanding double, loan_size_outstanding_currency string,
    loan_size_credit_limit double, loan_size_credit_limit_currency string,
    sector_classification_system string, sector_classification_input_type string,
    sector_classification_direct_loantaker string, fi_type string,
    flag_project_finance_loan string, name_project string, lei_direct_loantaker string,
    isin_direct_loantaker string
"""

ASSET_DATA = """
    company_id int, name_company string, lei string, is_ultimate_owner boolean,
    sector string, technology string, plant_location string, year int,
    production double, production_unit string, emission_factor double,
    emission_factor_unit string, ald_timestamp string
"""

REGION_ISOS = "region string, isos string, source string"

# `ordinal` is the position in the published list; it breaks ties between codes.
SECTOR_CODES = "sector string, code string, borderline boolean, ordinal int"


def column_names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]
