"""Loan book aggregation: worked examples, invariants, missing values, contracts."""

import pytest

from loanlens import aggregate_alignment_loanbook_exposure
from loanlens.operators import loanbook
from loanlens.sources import schemas
from tests.conftest import records

INF, NAN = float("inf"), float("nan")


def alignment(company, direction, metric, deviation=0.0, sector="power", **changes):
    row = {
        "name_abcd": company,
        "sector": sector,
        "activity_unit": "MW",
        "region": "global",
        "scenario_source": "source",
        "scenario": "scenario",
        "year": 2027,
        "direction": direction,
        "total_deviation": deviation,
        "alignment_metric": metric,
    }
    row.update(changes)
    return tuple(row.values())


NET = [
    alignment("north", "net", 0.5, 5.0),
    alignment("south", "net", -0.25, -8.0),
    alignment("east", "net", -1.0, -2.0),
]
# The first company has no phase-out row; the second is ahead in one and behind in the other.
SPLIT = [
    alignment("north", "buildout", 0.5, 5.0),
    alignment("south", "buildout", -0.5, -16.0),
    alignment("south", "phaseout", 0.25, 8.0),
    alignment("east", "buildout", 0.0, 0.0),
    alignment("east", "phaseout", -1.0, -2.0),
]
# Two loans go to the same company.
LOANS = [
    ("A1", 15.0, "EUR", "north", "power"),
    ("A2", 5.0, "EUR", "north", "power"),
    ("A3", 50.0, "EUR", "south", "power"),
    ("A4", 30.0, "EUR", "east", "power"),
]
GROUPED = schemas.MATCHED_LOANS + ", bank string, country string"
# Bank q lends in two countries, bank r in one.
BOOKS = [
    (*LOANS[0], "q", "x"),
    (*LOANS[2], "q", "x"),
    (*LOANS[3], "q", "y"),
    (*LOANS[1], "r", "y"),
    ("B1", 15.0, "EUR", "east", "power", "r", "y"),
]


@pytest.fixture
def aggregate(table):
    def run(data, level, loans=LOANS, by=None, schema=None, **arguments):
        schema = schema or (schemas.MATCHED_LOANS if len(loans[0]) == 5 else GROUPED)
        return aggregate_alignment_loanbook_exposure(
            table(data, schemas.COMPANY_ALIGNMENT), table(loans, schema), level, by, **arguments
        )

    return run


def approx_rows(df, *columns):
    return [pytest.approx(dict(zip(columns, r, strict=True))) for r in records(df, *columns)]


def as_dicts(df, *columns):
    return [dict(zip(columns, r, strict=True)) for r in records(df, *columns)]


def test_net(aggregate):
    row = aggregate(NET, "net").aggregate.first()
    assert row.asDict() == {
        "scenario": "scenario",
        "region": "global",
        "sector": "power",
        "year": 2027,
        "direction": "net",
        "n_companies": 3,
        "n_companies_aligned": 1,
        "share_companies_aligned": pytest.approx(1 / 3),
        # 0.2 * 0.5 - 0.5 * 0.25 - 0.3
        "exposure_weighted_net_alignment": pytest.approx(-0.325),
        "sum_loan_size_outstanding": 100.0,
        "sum_exposure_companies_aligned": 20.0,
        "share_exposure_aligned": 0.2,
    }


def test_split(aggregate):
    result = aggregate(SPLIT, "bo_po", arranged=True).aggregate
    rows = result.select("direction", *loanbook.COUNTS, "exposure_weighted_net_alignment").collect()
    # A direction that a company lacks counts as aligned, with zero.
    assert [tuple(r) for r in rows] == [
        ("buildout", 3, 2, pytest.approx(2 / 3), pytest.approx(0.2 * 0.5 - 0.5 * 0.5)),
        ("phaseout", 3, 2, pytest.approx(2 / 3), pytest.approx(0.5 * 0.25 - 0.3)),
    ]


def test_columns(aggregate):
    net, split = aggregate(NET, "net", BOOKS, ["bank", "country"]), aggregate(SPLIT, "bo_po")
    assert net.aggregate.columns == ["bank", "country", *split.aggregate.columns, *loanbook.EXPOSURES]
    assert net.company.columns == [
        "bank",
        "country",
        *schemas.column_names(schemas.COMPANY_ALIGNMENT),
        "loan_size_outstanding_currency",
        "loan_size_outstanding",
        "exposure_weight",
    ]


def test_company_rows(aggregate):
    rows = records(aggregate(SPLIT, "bo_po").company, "name_abcd", "direction", "total_deviation", "alignment_metric", "loan_size_outstanding", "exposure_weight")
    assert len(rows) == 6
    assert rows[2] == ("north", "buildout", 5.0, 0.5, 20.0, 0.2)
    assert rows[3] == ("north", "phaseout", 0.0, 0.0, 20.0, 0.2)


@pytest.mark.parametrize(
    "by, expected",
    [
        ("bank", [("q", 3, 1, -35 / 95, 95.0), ("r", 2, 1, -12.5 / 20, 20.0)]),
        (
            ["bank", "country"],
            [("q", 2, 1, -5 / 65, 65.0), ("q", 1, 0, -1.0, 30.0), ("r", 2, 1, -12.5 / 20, 20.0)],
        ),
    ],
)
def test_net_by(aggregate, by, expected):
    result = aggregate(NET, "net", BOOKS, by).aggregate
    rows = result.orderBy(by).select("bank", "n_companies", "n_companies_aligned", "exposure_weighted_net_alignment", "sum_loan_size_outstanding").collect()
    assert [tuple(r) for r in rows] == [(*e[:3], pytest.approx(e[3]), e[4]) for e in expected]


def test_split_by(aggregate):
    rows = records(aggregate(SPLIT, "bo_po", BOOKS, "bank").aggregate, "bank", "direction", "exposure_weighted_net_alignment")
    assert [r[:2] for r in rows] == [("q", "buildout"), ("q", "phaseout"), ("r", "buildout"), ("r", "phaseout")]
    assert [r[2] for r in rows] == pytest.approx([-17.5 / 95, -17.5 / 95, 0.125, -0.75])


@pytest.mark.parametrize("by", [None, "bank", "country", ["bank", "country"]])
def test_net_is_the_sum_of_buildout_and_phaseout(aggregate, by):
    keys = [by] if isinstance(by, str) else by or ["sector"]
    column = "exposure_weighted_net_alignment"
    net = {r[:-1]: r[-1] for r in records(aggregate(NET, "net", BOOKS, by).aggregate, *keys, column)}
    split: dict = {}
    for *key, value in records(aggregate(SPLIT, "bo_po", BOOKS, by).aggregate, *keys, column):
        split[tuple(key)] = split.get(tuple(key), 0) + value
    # A missing direction counts as zero, so the parts differ from net by rounding only.
    assert split == pytest.approx(net)


def test_loans_are_preserved(aggregate):
    result = aggregate(NET, "net", BOOKS, "bank").aggregate
    assert sum(r["sum_loan_size_outstanding"] for r in result.collect()) == sum(b[1] for b in BOOKS)


def test_weights_span_all_sectors_of_a_currency(table):
    loans = table(
        [
            ("L1", 1.0, "USD", "c1", "power"),
            ("L2", 2.0, "USD", "c1", "power"),
            ("L3", 9.0, "USD", "c1", "coal"),
            ("L4", None, "USD", "c2", "coal"),
            ("L5", NAN, "USD", "c2", "coal"),
            ("L6", 5.0, "EUR", "c1", "power"),
            ("L7", 5.0, None, "c1", "power"),
            ("L8", 15.0, None, "c2", "power"),
            ("L9", 0.0, "CHF", "c2", "power"),
        ],
        schemas.MATCHED_LOANS,
    )
    result = loanbook.add_exposure_weight(loanbook.loan_exposure(loans))
    assert records(result) == [
        (None, "c1", "power", 5.0, 0.25),
        (None, "c2", "power", 15.0, 0.75),
        ("CHF", "c2", "power", 0.0, None),
        ("EUR", "c1", "power", 5.0, 1.0),
        ("USD", "c1", "coal", 9.0, 0.75),
        ("USD", "c1", "power", 3.0, 0.25),
        ("USD", "c2", "coal", 0.0, 0.0),
    ]


def test_two_currencies_count_a_company_once_but_its_rows_twice(aggregate):
    loans = [("A1", 1.0, "USD", "north", "power"), ("A2", 3.0, "EUR", "north", "power")]
    row = aggregate(NET, "net", loans).aggregate.first()
    assert (row["n_companies"], row["n_companies_aligned"], row["share_companies_aligned"]) == (1, 2, 2.0)


def test_missing_company_name_matches_and_counts(aggregate):
    loans = [*LOANS, ("A5", 10.0, "EUR", None, "power")]
    row = aggregate([*NET, alignment(None, "net", 0.2)], "net", loans).aggregate.first()
    assert (row["n_companies"], row["n_companies_aligned"]) == (4, 2)


def test_missing_metrics(aggregate):
    data = [alignment("north", "net", None), alignment("south", "net", NAN), alignment("east", "net", None, sector="coal")]
    loans = [*LOANS, ("A5", 1.0, "EUR", "east", "coal"), ("A6", 1.0, "EUR", "west", "coal")]
    rows = records(aggregate([*data, alignment("west", "net", 0.5, sector="coal")], "net", loans).aggregate, "sector", "n_companies", "n_companies_aligned", "exposure_weighted_net_alignment", "sum_exposure_companies_aligned")
    assert rows == [("coal", 2, 1, 0.5, 1.0), ("power", 2, 0, None, 0.0)]


def test_infinite_metrics(aggregate):
    data = [alignment("north", "net", -INF), alignment("south", "net", 1.0)]
    assert aggregate(data, "net").aggregate.first()["exposure_weighted_net_alignment"] == -INF
    # Without exposure an infinite metric has no say.
    loans = [("A1", 0.0, "EUR", "north", "power"), LOANS[2]]
    assert aggregate(data, "net", loans).aggregate.first()["exposure_weighted_net_alignment"] == 1.0


def test_book_without_exposure_has_no_alignment(aggregate):
    loans = [("A1", 0.0, "EUR", "north", "power")]
    row = aggregate(NET, "net", loans).aggregate.first()
    assert row["exposure_weighted_net_alignment"] is None
    assert row["share_exposure_aligned"] is None


def test_opposite_directions(table):
    rows = [
        alignment("both", "buildout", 0.1, 1.0),
        alignment("both", "phaseout", 0.2, 2.0),
        alignment("one", "buildout", 0.3, 3.0),
        alignment("coal", "phaseout", 0.4, 4.0, sector="coal"),
        alignment("net", "net", 0.5, 5.0),
        alignment("unknown", None, 0.6, 6.0),
        alignment("partly", None, 0.7, 7.0),
        alignment("partly", "phaseout", 0.8, 8.0),
        # Another source's row in the other direction makes the company two-way.
        alignment("mixed", "buildout", 0.9, 9.0),
        alignment("mixed", "phaseout", 1.0, 9.0, scenario_source="other"),
    ]
    result = loanbook.add_opposite_directions(table(rows, schemas.COMPANY_ALIGNMENT))
    added = set(records(result, "name_abcd", "direction", "total_deviation", "alignment_metric")) - {(r[0], r[7], r[8], r[9]) for r in rows}
    assert added == {("one", "phaseout", 0.0, 0.0), ("partly", "buildout", 0.0, 0.0)}
    assert result.count() == len(rows) + 2


def test_extra_columns_travel_along(table):
    data = table([(*r, "note") for r in SPLIT], schemas.COMPANY_ALIGNMENT + ", `my.note` string")
    result = aggregate_alignment_loanbook_exposure(data, table(LOANS, schemas.MATCHED_LOANS), "bo_po")
    assert {r["my.note"] for r in result.company.collect()} == {"note"}
    assert result.aggregate.count() == 2


def test_total_deviation_is_optional(table):
    data = table(SPLIT, schemas.COMPANY_ALIGNMENT).drop("total_deviation")
    result = aggregate_alignment_loanbook_exposure(data, table(LOANS, schemas.MATCHED_LOANS), "bo_po")
    assert records(result.company, "total_deviation").count((None,)) == len(SPLIT)
    assert result.aggregate.count() == 2


@pytest.mark.parametrize(
    "by, message",
    [
        ("bad", "Must include expected columns in input data set."),
        ("loan_size_outstanding", "It is not possible to group by the critical columns"),
        ("year", "Must include expected columns"),
        (["bank", "sector"], "It is not possible to group by the critical columns"),
    ],
)
def test_bad_by(aggregate, by, message):
    with pytest.raises(ValueError, match=message):
        aggregate(NET, "net", BOOKS, by)


def test_bad_input(aggregate, table):
    with pytest.raises(ValueError, match="`level` must be one of"):
        aggregate(NET, "gross")
    data = table(NET, schemas.COMPANY_ALIGNMENT)
    loans = table(LOANS, schemas.MATCHED_LOANS)
    with pytest.raises(ValueError, match="alignment_metric"):
        aggregate_alignment_loanbook_exposure(data.drop("alignment_metric"), loans)
    with pytest.raises(ValueError, match="id_loan"):
        aggregate_alignment_loanbook_exposure(data, loans.drop("id_loan"))
    with pytest.raises(ValueError, match="must not have the column.*exposure_weight"):
        aggregate_alignment_loanbook_exposure(
            data.withColumnRenamed("total_deviation", "exposure_weight"), loans
        )
