"""The package's input relations, derived from the benchmark's order tables.

Parts play technologies, suppliers companies, ship years plan years, line items both
production figures and loans.  Amounts are whole numbers held as doubles, so sums do
not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.activity_units import constant
from loanlens.sources import schemas

SOURCE = "geco_2021"
SCENARIO = "1.5c"
TIME_FRAME = 5
START_YEAR = 1996
REGION = "ASIA"

# Part types by the sector they stand for; other types are cement.
TYPE_OF_SECTOR = {
    "power": "ECONOMY",
    "automotive": "SMALL",
    "hdv": "MEDIUM",
    "coal": "LARGE",
    "steel": "STANDARD",
}
SECTOR = """
    case p_type when 'ECONOMY' then 'power' when 'SMALL' then 'automotive'
        when 'MEDIUM' then 'hdv' when 'LARGE' then 'coal' when 'STANDARD' then 'steel'
        else 'cement' end as sector
"""
TECHNOLOGY = """
    case sector
        when 'power' then element_at(array('coalcap', 'gascap', 'oilcap', 'nuclearcap',
            'hydrocap', 'renewablescap'), p_size % 6 + 1)
        when 'automotive' then element_at(array('electric', 'hybrid', 'ice'), p_size % 3 + 1)
        when 'hdv' then element_at(array('electric', 'hybrid', 'ice'), p_size % 3 + 1)
        when 'coal' then 'coal'
        when 'steel' then if(p_size % 2 = 0, 'blast furnace', 'ac-electric arc furnace')
        else if(p_size % 2 = 0, 'integrated facility', 'grinding') end as technology
"""
BUILDOUT = "technology in ('electric', 'hybrid', 'nuclearcap', 'hydrocap', 'renewablescap')"

PATHWAY_SECTORS = ["power", "automotive", "hdv", "coal"]
INTENSITY_SECTORS = ["steel", "cement"]

# Stand-in classification: two codes of equal length where the listed order decides,
# shorter and borderline codes that must not be picked.
SECTOR_CODES = [
    ("power", "35", False, 1),
    ("power", "3512", False, 2),
    ("power", "3511", False, 3),
    ("power", "35111", True, 4),
    ("automotive", "2910", False, 5),
    ("automotive", "29", False, 6),
    ("hdv", "2920", False, 7),
    ("coal", "0510", False, 8),
    ("coal", "0520", False, 9),
    ("steel", "2410", False, 10),
    ("cement", "2351", False, 11),
    ("cement", "23510", True, 12),
]


CENTS = "cast(round(l_extendedprice * 100) as bigint)"


class Proxies:
    """Input relations over the parquet tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.opened[name]

    def parts(self, sectors: list[str]) -> DataFrame:
        """Sector and technology of the parts in some sectors.

        The sectors are selected by part type, which the parquet reader can use.
        """
        types = [t for s, t in TYPE_OF_SECTOR.items() if s in sectors]
        parts = self.table("part")
        if "cement" not in sectors:
            parts = parts.where(F.col("p_type").isin(types))
        elif len(types) < len(TYPE_OF_SECTOR):
            others = [t for s, t in TYPE_OF_SECTOR.items() if s not in sectors]
            parts = parts.where(F.col("p_type").isNull() | ~F.col("p_type").isin(others))
        return parts.selectExpr("p_partkey", "p_size", SECTOR).selectExpr(
            "p_partkey", "sector", TECHNOLOGY
        )

    def lines(self, sectors: list[str]) -> DataFrame:
        """Line items with company, place, technology, year, source and metric.

        Each dimension is joined by itself, so that its own size decides how.
        """
        return (
            self.table("lineitem")
            .join(self.parts(sectors), F.expr("l_partkey = p_partkey"))
            .join(self.table("supplier"), F.expr("l_suppkey = s_suppkey"))
            .join(self.table("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "*",
                "year(l_shipdate) as year",
                "r_name as region",
                "if(l_linestatus = 'O', 'geco_2021', 'weo_2021') as scenario_source",
                "s_name as name_abcd",
                "case l_returnflag when 'A' then 'projected' when 'N' then 'target_1.5c'"
                " else 'target_ndc' end as metric",
            )
        )

    @cached_property
    def tms_results(self) -> DataFrame:
        return (
            self.lines(PATHWAY_SECTORS)
            .groupBy(
                "sector", "technology", "year", "region", "scenario_source", "name_abcd", "metric"
            )
            .agg(F.expr("sum(if(l_quantity <= 10, 0D, l_quantity)) as production"))
            .selectExpr(
                "*",
                "0D as technology_share",
                "'sector' as scope",
                "0D as percentage_of_initial_production_by_scope",
            )
        )

    @cached_property
    def technology_direction(self) -> DataFrame:
        # The region table has a row per continent.
        regions = self.table("region").agg(F.collect_list("r_name")).scalar()
        return (
            self.parts(PATHWAY_SECTORS)
            .select("sector", "technology")
            .distinct()
            .select("*", F.explode(regions).alias("region"))
            .selectExpr("*", "explode(array('geco_2021', 'weo_2021')) as scenario_source")
            .selectExpr("*", "explode(array('1.5c', 'ndc')) as scenario")
            .selectExpr("*", f"if({BUILDOUT}, 1D, -1D) as directional_dummy")
        )

    @cached_property
    def sda_results(self) -> DataFrame:
        """Intensity per company, and of all companies together as `market`.

        The market's figures add up the companies' sums.
        """
        place = ["sector", "year", "region", "scenario_source", "metric"]
        sums = (
            self.lines(INTENSITY_SECTORS)
            .groupBy(*place, "name_abcd")
            .agg(
                F.expr(f"sum({CENTS}) as emitted"),
                F.expr("sum(l_quantity) as output"),
            )
        )
        market = (
            sums.groupBy(*place)
            .agg(F.sum("emitted").alias("emitted"), F.sum("output").alias("output"))
            .selectExpr("*", "'market' as name_abcd")
        )
        return sums.unionByName(market).selectExpr(
            "sector",
            "year",
            "region",
            "scenario_source",
            "name_abcd",
            "metric as emission_factor_metric",
            "cast(emitted as double) / output as emission_factor_value",
        )

    @cached_property
    def matched(self) -> DataFrame:
        """Loans matched to companies; `group_id` tells loan books apart."""
        return (
            self.lines(PATHWAY_SECTORS + INTENSITY_SECTORS)
            .join(self.table("orders"), F.expr("l_orderkey = o_orderkey"))
            .selectExpr(
                "o_orderpriority as group_id",
                "concat(l_orderkey, '-', l_linenumber) as id_loan",
                f"cast({CENTS} as double) as loan_size_outstanding",
                "if(o_orderstatus = 'F', 'EUR', 'USD') as loan_size_outstanding_currency",
                "name_abcd",
                "sector",
            )
        )

    @cached_property
    def abcd(self) -> DataFrame:
        return (
            self.lines(PATHWAY_SECTORS + INTENSITY_SECTORS)
            .groupBy("l_suppkey", "s_name", "sector", "technology", "n_name", "year")
            .agg(F.sum("l_quantity").alias("production"))
            .selectExpr(
                "l_suppkey as company_id",
                "s_name as name_company",
                "cast(null as string) as lei",
                "l_suppkey % 10 <> 0 as is_ultimate_owner",
                "sector",
                "technology",
                "n_name as plant_location",
                "year",
                "production",
                "'units' as production_unit",
                "cast(null as double) as emission_factor",
                "cast(null as string) as emission_factor_unit",
                "'n/a' as ald_timestamp",
            )
        )

    # The same relations with what real ones also have: further identifying columns, missing
    # keys, numbers that are not numbers, nothing lent, units of both kinds.

    @cached_property
    def tms_results_by_plant(self) -> DataFrame:
        return (
            self.lines(PATHWAY_SECTORS)
            .selectExpr(
                "sector",
                "technology",
                "year",
                "if(s_suppkey % 5 = 0, null, region) as region",
                "scenario_source",
                "name_abcd",
                "metric",
                "l_linenumber % 2 as plant",
                "l_quantity",
            )
            .groupBy(
                "sector",
                "technology",
                "year",
                "region",
                "scenario_source",
                "name_abcd",
                "metric",
                "plant",
            )
            .agg(F.expr("sum(if(l_quantity <= 10, 0D, l_quantity)) as total"))
            .selectExpr(
                "* except(total)",
                "if(total % 7 = 3, double('nan'), total) as production",
                "0D as technology_share",
                "'sector' as scope",
                "0D as percentage_of_initial_production_by_scope",
            )
        )

    @cached_property
    def technology_direction_by_plant(self) -> DataFrame:
        """Directions for a missing region too, each of them listed twice."""
        known = self.technology_direction
        nowhere = known.withColumn("region", F.lit(None).cast("string")).distinct()
        return known.unionByName(nowhere).unionByName(nowhere)

    @cached_property
    def matched_with_gaps(self) -> DataFrame:
        lent = f"cast({CENTS} as double)"
        return (
            self.lines(PATHWAY_SECTORS + INTENSITY_SECTORS)
            .join(self.table("orders"), F.expr("l_orderkey = o_orderkey"))
            .selectExpr(
                "if(o_orderpriority like '1%', null, o_orderpriority) as group_id",
                "concat(l_orderkey, '-', l_linenumber) as id_loan",
                f"case l_linenumber when 1 then double('nan') when 2 then 0D else {lent} end"
                " as loan_size_outstanding",
                "case o_orderstatus when 'F' then 'EUR' when 'O' then 'USD' end"
                " as loan_size_outstanding_currency",
                "if(s_suppkey % 4 = 0, null, name_abcd) as name_abcd",
                "sector",
            )
        )

    @cached_property
    def abcd_with_gaps(self) -> DataFrame:
        return self.abcd.withColumns(
            {
                "company_id": F.expr("if(company_id % 7 = 0, null, company_id)"),
                "lei": F.expr("if(company_id % 3 = 0, null, concat('LEI', company_id))"),
                "production": F.expr("if(production % 10 = 0, double('nan'), production)"),
                "production_unit": F.expr(
                    "case sector when 'power' then if(technology = 'gascap', null, 'MW')"
                    " when 'coal' then 't' else 'vehicles' end"
                ),
                "emission_factor_unit": F.expr("concat('tCO2 per t of ', sector)"),
            }
        )

    @cached_property
    def listed_codes(self) -> DataFrame:
        """Part names as codes of the sectors, many of equal length, in the order of the file."""
        return self.table("part").selectExpr(
            "p_type", "p_name as code", "p_size % 7 = 0 as borderline", SECTOR
        )

    @cached_property
    def region_isos(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "r_name as region",
                "lower(n_name) as isos",
                "explode(array('geco_2021', 'weo_2021')) as source",
            )
        )

    @cached_property
    def sector_codes(self) -> DataFrame:
        return constant(self.spark, SECTOR_CODES, schemas.column_names(schemas.SECTOR_CODES))
