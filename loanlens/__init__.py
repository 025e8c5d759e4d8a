"""Climate alignment of companies and loan books on Spark DataFrames."""

from loanlens.operators.activity_units import build_activity_units
from loanlens.operators.benchmark import create_benchmark_loanbook
from loanlens.operators.checks import validate_data_has_expected_cols
from loanlens.operators.company_alignment import (
    calculate_company_aggregate_alignment_sda,
    calculate_company_aggregate_alignment_tms,
)
from loanlens.operators.loanbook import (
    LoanbookAlignment,
    aggregate_alignment_loanbook_exposure,
)
from loanlens.operators.tech_deviation import calculate_company_tech_deviation

__all__ = [
    "LoanbookAlignment",
    "aggregate_alignment_loanbook_exposure",
    "build_activity_units",
    "calculate_company_aggregate_alignment_sda",
    "calculate_company_aggregate_alignment_tms",
    "calculate_company_tech_deviation",
    "create_benchmark_loanbook",
    "validate_data_has_expected_cols",
]
