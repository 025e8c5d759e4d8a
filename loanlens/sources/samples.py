"""Sample inputs for trying the package out.

Technologies are listed; companies, borrowers and production follow rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.sources import schemas

# Companies of each sector, and the countries that they are spread over.
PER_SECTOR = 3
COUNTRIES = ["DE", "JP", "BR", "IN"]

# Sector, technologies, production unit, emission unit, emission factor.
SECTORS = [
    ("power", ["coalcap", "gascap", "hydrocap", "nuclearcap", "oilcap", "renewablescap"],
     "MW", None, None),
    ("automotive", ["electric", "hybrid", "ice"], "cars produced", None, None),
    ("steel", ["ac-electric arc furnace", "blast furnace"],
     "tonnes per year", "tonnes of CO2 per tonne of steel", 1.2),
    ("cement", ["integrated facility", "grinding"],
     "tonnes per year", "tonnes of CO2 per tonne of cement", 0.6),
    ("aviation", ["passenger", "freight"],
     "active planes", "tonnes of CO2 per passenger per km travelled", 0.1),
    ("coal", ["coal"], "tonnes per year", None, None),
    ("oil and gas", ["gas", "oil"], "GJ", None, None),
]

# Industry code of the sample loans by the borrower's first sector.
LOAN_CODES = {
    "power": "3511",
    "automotive": "2920",
    "steel": "2410",
    "cement": "2351",
    "aviation": "5110",
    "oil and gas": "6100",
    "coal": "5100",
}
FIRST_YEAR, LAST_YEAR = 2022, 2027


def companies() -> list[tuple[int, str, str, list[str]]]:
    """Id, name, country and sectors; every third company of a sector is in the next one too."""
    names = [sector for sector, *_ in SECTORS]
    return [
        (
            i * PER_SECTOR + k + 1,
            f"{sector.title()} Works {k + 1}",
            COUNTRIES[(i + k) % len(COUNTRIES)],
            [sector, names[(i + 1) % len(names)]] if k == 2 else [sector],
        )
        for i, sector in enumerate(names)
        for k in range(PER_SECTOR)
    ]


def sample_asset_data(spark: SparkSession) -> DataFrame:
    """Yearly production of the companies in all technologies of their sectors."""
    owners = spark.createDataFrame(
        companies(),
        "company_id int, name_company string, plant_location string, sectors array<string>",
    ).withColumn("sector", F.explode("sectors"))
    sectors = spark.createDataFrame(
        SECTORS,
        "sector string, technologies array<string>, production_unit string, "
        "emission_factor_unit string, base_factor double",
    )
    series = owners.join(sectors, "sector").select(
        "*", F.posexplode("technologies").alias("place", "technology")
    )
    years = F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR)))
    # The first technology shrinks and the following ones grow, by company.
    growth = (F.col("place") - 0.5) * (F.col("company_id") % 5 + 1) / 50
    production = F.round(1000 * (1 + growth * (F.col("year") - FIRST_YEAR)) / (F.col("place") + 1))
    return series.select("*", years.alias("year")).select(
        "company_id",
        "name_company",
        F.lit(None).cast("string").alias("lei"),
        F.lit(True).alias("is_ultimate_owner"),
        "sector",
        "technology",
        "plant_location",
        "year",
        production.alias("production"),
        "production_unit",
        (F.col("base_factor") / (F.col("year") - FIRST_YEAR + 1)).alias("emission_factor"),
        "emission_factor_unit",
        F.lit(f"{FIRST_YEAR} Q4").alias("ald_timestamp"),
    )


def sample_loanbook(spark: SparkSession) -> DataFrame:
    """A loan to every second company, before matching; sizes grow with the company's id."""
    borrowers = [
        (i, name, LOAN_CODES[sectors[0]]) for i, name, _, sectors in companies() if i % 2
    ]
    rows = [
        (f"L{n}", f"C{i}", name, None, None, f"UP{i}", name, 2e5 * i, "EUR", 3e5 * i, "EUR",
         "NACE", "Code", code, "Loan", "No", None, None, None)
        for n, (i, name, code) in enumerate(borrowers, 1)
    ]
    return spark.createDataFrame(rows, schemas.RAW_LOANS)
