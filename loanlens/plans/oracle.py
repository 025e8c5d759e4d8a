"""The queries in SQL, written against the raw tables.

Each text is a chain of common table expressions, of which only those a query needs
are included.  NaN never arises: x/0 is spelled out as an infinity, 0/0 as NULL.
"""

from __future__ import annotations

import re

INF = "cast('inf' as double)"


def ratio(n: str, d: str) -> str:
    return (
        f"case when {d} = 0 then case when {n} > 0 then {INF} when {n} < 0 then -{INF} end "
        f"else {n} / {d} end"
    )


def six(expression: str) -> str:
    return f"round({expression}, 6)"


RELATIONS = {
    "px_part": """
        select p_partkey,
          case p_type when 'ECONOMY' then 'power' when 'SMALL' then 'automotive'
            when 'MEDIUM' then 'hdv' when 'LARGE' then 'coal' when 'STANDARD' then 'steel'
            else 'cement' end as sector,
          case p_type
            when 'ECONOMY' then case p_size % 6 when 0 then 'coalcap' when 1 then 'gascap'
              when 2 then 'oilcap' when 3 then 'nuclearcap' when 4 then 'hydrocap'
              else 'renewablescap' end
            when 'SMALL' then
              case p_size % 3 when 0 then 'electric' when 1 then 'hybrid' else 'ice' end
            when 'MEDIUM' then
              case p_size % 3 when 0 then 'electric' when 1 then 'hybrid' else 'ice' end
            when 'LARGE' then 'coal'
            when 'STANDARD' then
              case p_size % 2 when 0 then 'blast furnace' else 'ac-electric arc furnace' end
            else case p_size % 2 when 0 then 'integrated facility' else 'grinding' end
          end as technology
        from part""",
    "px_line": """
        select l.*, x.sector, x.technology, s.s_suppkey, s.s_name, n.n_name, r.r_name,
          cast(year(l_shipdate) as int) as yr,
          case l_linestatus when 'O' then 'geco_2021' else 'weo_2021' end as src,
          case l_returnflag when 'A' then 'projected' when 'N' then 'target_1.5c'
            else 'target_ndc' end as met
        from lineitem l join px_part x on l_partkey = p_partkey
          join supplier s on l_suppkey = s_suppkey
          join nation n on s_nationkey = n_nationkey
          join region r on n_regionkey = r_regionkey""",
    "px_tms": """
        select sector, technology, yr as year, r_name as region, src as scenario_source,
          s_name as name_abcd, met as metric,
          sum(case when l_quantity <= 10 then cast(0 as double) else l_quantity end)
            as production
        from px_line where sector in ('power', 'automotive', 'hdv', 'coal')
        group by 1, 2, 3, 4, 5, 6, 7""",
    "px_dir": """
        select src as scenario_source, scn as scenario, sector, technology,
          r_name as region,
          cast(case when technology in ('electric', 'hybrid', 'nuclearcap', 'hydrocap',
            'renewablescap') then 1.0 else -1.0 end as double) as directional_dummy
        from (select distinct sector, technology from px_part
              where sector in ('power', 'automotive', 'hdv', 'coal')) a
          cross join region
          cross join (values ('geco_2021'), ('weo_2021')) v(src)
          cross join (values ('1.5c'), ('ndc')) w(scn)""",
    "px_sda": """
        select sector, yr as year, r_name as region, src as scenario_source,
          s_name as name_abcd, met as emission_factor_metric,
          cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
            / sum(l_quantity) as emission_factor_value
        from px_line where sector in ('steel', 'cement') group by 1, 2, 3, 4, 5, 6
        union all
        select sector, yr, r_name, src, 'market', met,
          cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
            / sum(l_quantity)
        from px_line where sector in ('steel', 'cement') group by 1, 2, 3, 4, 6""",
    "px_matched": """
        select o_orderpriority as group_id, concat(l_orderkey, '-', l_linenumber) as id_loan,
          cast(cast(round(l_extendedprice * 100) as bigint) as double)
            as loan_size_outstanding,
          case o_orderstatus when 'F' then 'EUR' else 'USD' end
            as loan_size_outstanding_currency,
          s_name as name_abcd, sector
        from px_line join orders on l_orderkey = o_orderkey""",
    "px_abcd": """
        select s_suppkey as company_id, s_name as name_company,
          cast(null as varchar) as lei, s_suppkey % 10 <> 0 as is_ultimate_owner, sector,
          technology, n_name as plant_location, yr as year, sum(l_quantity) as production,
          'units' as production_unit, cast(null as varchar) as emission_factor_unit
        from px_line group by s_suppkey, s_name, sector, technology, n_name, yr""",
    "px_isos": """
        select r_name as region, lower(n_name) as isos, src as source
        from nation join region on n_regionkey = r_regionkey
          cross join (values ('geco_2021'), ('weo_2021')) v(src)""",
    "px_codes": """
        select * from (values
          ('power', '35', false, 1), ('power', '3512', false, 2),
          ('power', '3511', false, 3), ('power', '35111', true, 4),
          ('automotive', '2910', false, 5), ('automotive', '29', false, 6),
          ('hdv', '2920', false, 7), ('coal', '0510', false, 8),
          ('coal', '0520', false, 9), ('steel', '2410', false, 10),
          ('cement', '2351', false, 11), ('cement', '23510', true, 12)
        ) c(sector, code, borderline, ordinal)""",
    "units": """
        select * from (values
          ('automotive', 'electric', 'cars produced'),
          ('automotive', 'hybrid', 'cars produced'),
          ('automotive', 'ice', 'cars produced'),
          ('cement', 'grinding', 'tonnes of CO2 per tonne of cement'),
          ('cement', 'integrated facility', 'tonnes of CO2 per tonne of cement'),
          ('coal', 'coal', 'tonnes per year'),
          ('hdv', 'electric', 'vehicles produced'),
          ('hdv', 'hybrid', 'vehicles produced'),
          ('hdv', 'ice', 'vehicles produced'),
          ('power', 'coalcap', 'MW'), ('power', 'gascap', 'MW'), ('power', 'hydrocap', 'MW'),
          ('power', 'nuclearcap', 'MW'), ('power', 'oilcap', 'MW'),
          ('power', 'renewablescap', 'MW'),
          ('steel', 'ac-electric arc furnace', 'tonnes of CO2 per tonne of steel'),
          ('steel', 'blast furnace', 'tonnes of CO2 per tonne of steel')
        ) u(sector, technology, activity_unit)""",
    # Sectors with technology pathways
    "long_rows": """
        select sector, technology, year, region, scenario_source, name_abcd, metric, production
        from px_tms
        where scenario_source = 'geco_2021' and metric in ('projected', 'target_1.5c')
          and year between (select min(year) from px_tms)
            and (select min(year) + 5 from px_tms)""",
    "pivoted": """
        select sector, technology, year, region, scenario_source, name_abcd,
          max(case when metric = 'projected' then production end) as projected,
          max(case when metric = 'target_1.5c' then production end) as target
        from long_rows group by 1, 2, 3, 4, 5, 6""",
    "signed": """
        select p.*, d.directional_dummy
        from pivoted p join px_dir d
          on p.sector = d.sector and p.technology = d.technology and p.region = d.region
        where d.scenario_source = 'geco_2021' and regexp_matches(d.scenario, '1.5c')""",
    "not_idle": """
        select * from signed w where not exists (
          select 1 from (
            select name_abcd, region, scenario_source, sector, technology, year
            from signed group by 1, 2, 3, 4, 5, 6
            having coalesce(sum(projected), 0) = 0 and coalesce(sum(target), 0) = 0
          ) z
          where z.name_abcd = w.name_abcd and z.region = w.region
            and z.scenario_source = w.scenario_source and z.sector = w.sector
            and z.technology = w.technology and z.year = w.year)""",
    "deviated": """
        select w.sector, w.technology, w.year, w.region, w.scenario_source, w.name_abcd,
          w.projected, w.target,
          (w.projected - w.target) * w.directional_dummy as total_tech_deviation,
          case when w.directional_dummy is null then null
            when w.directional_dummy = 1 then 'buildout' else 'phaseout' end as direction,
          u.activity_unit
        from not_idle w
          join units u on w.sector = u.sector and w.technology = u.technology
          join (
            select name_abcd, region, scenario_source, sector, year from not_idle
            group by 1, 2, 3, 4, 5 having coalesce(sum(target), 0) <> 0
          ) k on k.name_abcd = w.name_abcd and k.region = w.region
            and k.scenario_source = w.scenario_source and k.sector = w.sector
            and k.year = w.year""",
    "with_total": """
        select d.*, coalesce(sum(target) over (
            partition by name_abcd, scenario_source, region, sector, activity_unit, year
          ), 0) as net_absolute_scenario_value
        from deviated d""",
    "summed_bo_po": """
        select name_abcd, scenario_source, region, sector, activity_unit, year, direction,
          coalesce(sum(total_tech_deviation), 0) as total_deviation,
          net_absolute_scenario_value
        from with_total
        group by name_abcd, scenario_source, region, sector, activity_unit, year,
          net_absolute_scenario_value, direction""",
    "directed": f"""
        select name_abcd, sector, activity_unit, region, scenario_source,
          '1.5c' as scenario, year, direction, total_deviation,
          {ratio("total_deviation", "net_absolute_scenario_value")} as alignment_metric
        from summed_bo_po""",
    "net": f"""
        select name_abcd, sector, activity_unit, region, scenario_source,
          '1.5c' as scenario, year, 'net' as direction, total_deviation,
          {ratio("total_deviation", "net_absolute_scenario_value")} as alignment_metric
        from (
          select name_abcd, scenario_source, region, sector, activity_unit, year,
            coalesce(sum(total_tech_deviation), 0) as total_deviation,
            net_absolute_scenario_value
          from with_total
          group by name_abcd, scenario_source, region, sector, activity_unit, year,
            net_absolute_scenario_value) s""",
    "completed": """
        select g.name_abcd, g.sector, g.activity_unit, g.region, g.scenario_source,
          g.scenario, g.year, a.direction, coalesce(d.total_deviation, 0) as total_deviation,
          coalesce(d.alignment_metric, 0) as alignment_metric
        from (select distinct name_abcd, sector, activity_unit, region, scenario_source,
                scenario, year from directed) g
          cross join (select distinct direction from directed) a
          left join directed d on d.name_abcd = g.name_abcd and d.sector = g.sector
            and d.activity_unit = g.activity_unit and d.region = g.region
            and d.scenario_source = g.scenario_source and d.scenario = g.scenario
            and d.year = g.year and d.direction = a.direction""",
    # Sectors measured by emission intensity
    "sda_wide": """
        select sector, year, region, scenario_source, name_abcd,
          max(case when emission_factor_metric = 'projected'
            then emission_factor_value end) as projected,
          max(case when emission_factor_metric = 'target_1.5c'
            then emission_factor_value end) as target,
          'net' as direction
        from px_sda
        where scenario_source = 'geco_2021' and name_abcd <> 'market'
          and emission_factor_metric in ('projected', 'target_1.5c')
          and year between (select min(year) from px_sda)
            and (select min(year) + 5 from px_sda)
        group by 1, 2, 3, 4, 5""",
    "sda": f"""
        select name_abcd, sector, activity_unit, region, scenario_source,
          '1.5c' as scenario, year, direction, total_deviation,
          {ratio("total_deviation", "net_value")} as alignment_metric
        from (
          select w.*, u.activity_unit,
            coalesce(sum(target) over p, 0) as net_value,
            (projected - coalesce(sum(target) over p, 0)) * -1 as total_deviation
          from sda_wide w
            join (select distinct sector, activity_unit from units) u on u.sector = w.sector
          window p as (partition by name_abcd, scenario_source, region, w.sector,
            activity_unit, year)
        ) t""",
    # Loan books
    "exposure": """
        select loan_size_outstanding_currency, name_abcd, sector,
          coalesce(sum(loan_size_outstanding), 0) as loan_size_outstanding
        from px_matched group by 1, 2, 3""",
    "exposure_by": """
        select group_id, loan_size_outstanding_currency, name_abcd, sector,
          coalesce(sum(loan_size_outstanding), 0) as loan_size_outstanding
        from px_matched group by 1, 2, 3, 4""",
    "weighed": """
        select e.*, loan_size_outstanding / sum(loan_size_outstanding)
          over (partition by loan_size_outstanding_currency) as exposure_weight
        from exposure e""",
    "weighed_by": """
        select e.*, loan_size_outstanding / sum(loan_size_outstanding)
          over (partition by group_id, loan_size_outstanding_currency) as exposure_weight
        from exposure_by e""",
    # Reference tables and the benchmark loan book
    "picked_codes": """
        select sector, code from (
          select sector, code, row_number() over (
            partition by sector order by length(code) desc, ordinal) as n
          from px_codes where not borderline) c
        where n = 1""",
    "book": """
        select 'C' || company_id as id_direct_loantaker,
          name_company as name_direct_loantaker,
          cast(null as varchar) as id_intermediate_parent_1,
          cast(null as varchar) as name_intermediate_parent_1,
          'UP' || company_id as id_ultimate_parent, name_company as name_ultimate_parent,
          production_sector as loan_size_outstanding,
          'USD' as loan_size_outstanding_currency,
          production_sector as loan_size_credit_limit,
          'USD' as loan_size_credit_limit_currency,
          'NACE' as sector_classification_system,
          'Code' as sector_classification_input_type,
          code as sector_classification_direct_loantaker, 'Loan' as fi_type,
          'No' as flag_project_finance_loan, cast(null as varchar) as name_project,
          lei as lei_direct_loantaker, cast(null as varchar) as isin_direct_loantaker,
          'DL' || company_id as id_2dii, 'direct_loantaker' as level, sector,
          sector as sector_abcd, name_company as name, name_company as name_abcd,
          cast(1 as double) as score, 'loanbook' as source, false as borderline,
          'benchmark_corporate_economy_ASIA' as group_id,
          'L' || row_number() over (order by company_id, sector, code, name_company, lei)
            as id_loan
        from (
          select a.company_id, a.name_company, a.lei, c.code, a.sector,
            coalesce(sum(a.production), 0) as production_sector
          from px_abcd a join picked_codes c on a.sector = c.sector
          where a.is_ultimate_owner and a.year = 1996
            and a.plant_location in (select upper(isos) from px_isos
              where source = 'geco_2021' and region = 'ASIA')
          group by 1, 2, 3, 4, 5) b""",
    "book_weighed": """
        select e.*, loan_size_outstanding / sum(loan_size_outstanding)
          over (partition by group_id, loan_size_outstanding_currency) as exposure_weight
        from (select group_id, loan_size_outstanding_currency, name_abcd, sector,
                sum(loan_size_outstanding) as loan_size_outstanding
              from book group by 1, 2, 3, 4) e""",
    # Inputs with gaps and further columns
    "gap_tms": """
        select sector, technology, year, region, scenario_source, name_abcd, metric, plant,
          case when total % 7 = 3 then null else total end as production
        from (
          select sector, technology, yr as year,
            case when s_suppkey % 5 = 0 then null else r_name end as region,
            src as scenario_source, s_name as name_abcd, met as metric,
            l_linenumber % 2 as plant,
            sum(case when l_quantity <= 10 then cast(0 as double) else l_quantity end) as total
          from px_line where sector in ('power', 'automotive', 'hdv', 'coal')
          group by 1, 2, 3, 4, 5, 6, 7, 8) t""",
    "gap_signed": """
        select p.*, d.directional_dummy
        from (
          select sector, technology, year, region, scenario_source, name_abcd, plant,
            max(case when metric = 'projected' then production end) as projected,
            max(case when metric = 'target_1.5c' then production end) as target
          from gap_tms
          where scenario_source = 'geco_2021' and metric in ('projected', 'target_1.5c')
            and year between (select min(year) from gap_tms)
              and (select min(year) + 5 from gap_tms)
          group by 1, 2, 3, 4, 5, 6, 7) p
          join (select distinct sector, technology, directional_dummy, region from px_dir
                union select distinct sector, technology, directional_dummy, null from px_dir) d
            on p.sector = d.sector and p.technology = d.technology
              and p.region is not distinct from d.region""",
    "gap_active": """
        select * exclude (planned, aimed) from (
          select s.*, coalesce(sum(projected) over w, 0) as planned,
            coalesce(sum(target) over w, 0) as aimed
          from gap_signed s
          window w as (partition by name_abcd, region, scenario_source, sector, technology, year)
        ) t where planned <> 0 or aimed <> 0""",
    "gap_deviated": """
        select k.* exclude (directional_dummy, aimed), u.activity_unit,
          (projected - target) * directional_dummy as total_tech_deviation,
          case when directional_dummy = 1 then 'buildout' else 'phaseout' end as direction
        from (
          select s.*, coalesce(sum(target) over (
            partition by name_abcd, region, scenario_source, sector, year), 0) as aimed
          from gap_active s) k
          join units u on k.sector = u.sector and k.technology = u.technology
        where aimed <> 0""",
    "gap_directed": f"""
        select name_abcd, sector, activity_unit, region, scenario_source, '1.5c' as scenario,
          year, direction, deviation as total_deviation,
          {ratio("deviation", "total")} as alignment_metric
        from (
          select name_abcd, sector, activity_unit, region, scenario_source, year, direction,
            coalesce(sum(total_tech_deviation), 0) as deviation, any_value(aimed) as total
          from (
            select d.*, coalesce(sum(target) over (partition by name_abcd, scenario_source,
              region, sector, activity_unit, year), 0) as aimed
            from gap_deviated d) t
          group by all) s""",
    "gap_completed": """
        select * exclude (alignment_metric), coalesce(alignment_metric, 0) as alignment_metric
        from gap_directed
        union all by name
        select * exclude (direction, total_deviation, alignment_metric, n),
          case direction when 'buildout' then 'phaseout' else 'buildout' end as direction,
          0 as total_deviation, 0 as alignment_metric
        from (
          select d.*, count(*) over (partition by name_abcd, sector, activity_unit, region,
            scenario_source, year) as n from gap_directed d) t
        where n = 1""",
    "gap_weighed": f"""
        select * exclude (total),
          {ratio("loan_size_outstanding", "total")} as exposure_weight
        from (
          select e.*, sum(loan_size_outstanding)
            over (partition by group_id, loan_size_outstanding_currency) as total
          from (
            select case when o_orderpriority like '1%' then null else o_orderpriority end
                as group_id,
              case o_orderstatus when 'F' then 'EUR' when 'O' then 'USD' end
                as loan_size_outstanding_currency,
              case when s_suppkey % 4 = 0 then null else s_name end as name_abcd, sector,
              cast(sum(case when l_linenumber in (1, 2) then 0
                else cast(round(l_extendedprice * 100) as bigint) end) as double)
                as loan_size_outstanding
            from px_line join orders on l_orderkey = o_orderkey
            group by 1, 2, 3, 4) e) t""",
    "gap_abcd": """
        select case when company_id % 7 = 0 then null else company_id end as company_id,
          name_company, is_ultimate_owner, sector, technology, plant_location, year,
          case when company_id % 3 = 0 then null else 'LEI' || company_id end as lei,
          case when production % 10 = 0 then null else production end as production,
          case sector when 'power' then case when technology = 'gascap' then null else 'MW' end
            when 'coal' then 't' else 'vehicles' end as production_unit,
          'tCO2 per t of ' || sector as emission_factor_unit
        from px_abcd""",
}

DEVIATION = """sector, technology, year, region, scenario_source, name_abcd, projected,
    target, total_tech_deviation, direction, activity_unit"""
ALIGNMENT = f"""name_abcd, sector, activity_unit, region, scenario_source, scenario, year,
    direction, total_deviation, {six("alignment_metric")} as alignment_metric"""


def company(alignment: str, exposure: str) -> str:
    """Company alignment in one relation joined with the exposures in another."""
    return f"""select e.* exclude (name_abcd, sector), a.*
        from {alignment} a join {exposure} e
          on a.name_abcd = e.name_abcd and a.sector = e.sector"""


def with_opposite(joined: str) -> str:
    """Joined rows plus zero rows for companies with one direction."""
    return f"""with j as ({joined}), c as (
          select j.*, count(distinct direction) over (
              partition by scenario, region, sector, year, name_abcd, activity_unit,
                loan_size_outstanding_currency) as n_directions
          from j)
        select * exclude (n_directions) from c
        union all by name
        select * exclude (n_directions) replace (
            case direction when 'buildout' then 'phaseout' else 'buildout' end as direction,
            0 as total_deviation, 0 as alignment_metric)
        from c where n_directions = 1 and direction in ('buildout', 'phaseout')
          and sector in ('automotive', 'hdv', 'power')"""


COUNTS = f"""
    cast(n_companies as bigint) as n_companies,
    cast(n_companies_aligned as bigint) as n_companies_aligned,
    {six("n_companies_aligned / n_companies")} as share_companies_aligned"""
WEIGHTED = f"""
    {six(ratio("terms", "weights"))} as exposure_weighted_net_alignment"""
EXPOSURES = f"""
    sum_loan_size_outstanding, sum_exposure_companies_aligned,
    {six(ratio("sum_exposure_companies_aligned", "sum_loan_size_outstanding"))}
      as share_exposure_aligned"""


def aggregate(joined: str, *columns: str, by: str = "") -> str:
    return f"""select {by} scenario, region, sector, year, direction, {", ".join(columns)}
        from (
          select {by} scenario, region, sector, year, direction,
            count(distinct name_abcd) as n_companies,
            sum(case when alignment_metric >= 0 then 1 else 0 end) as n_companies_aligned,
            sum(case when alignment_metric is not null and exposure_weight <> 0
              then alignment_metric * exposure_weight else 0 end) as terms,
            sum(case when alignment_metric is not null then exposure_weight else 0 end)
              as weights,
            sum(loan_size_outstanding) as sum_loan_size_outstanding,
            sum(case when alignment_metric >= 0 then loan_size_outstanding else 0 end)
              as sum_exposure_companies_aligned
          from ({joined}) j group by all) g"""


COMPANY = f"""name_abcd, sector, activity_unit, region, scenario_source, scenario, year,
    direction, total_deviation, {six("alignment_metric")} as alignment_metric,
    loan_size_outstanding_currency, loan_size_outstanding,
    {six("exposure_weight")} as exposure_weight"""

NET = company("net", "weighed")
NET_BY = company("net", "weighed_by")

CHECK = """select '{relation}' as input, '{argument}' as argument,
    '{requested}' as requested, count(distinct {offered}) as n_available,
    coalesce(bool_or({matches}), false) as ok from {relation_view}"""


def check(view: str, relation: str, argument: str, requested, offered: str, matches: str) -> str:
    return CHECK.format(
        relation=relation,
        argument=argument,
        requested=requested,
        offered=offered,
        matches=matches,
        relation_view=view,
    )


def scenario_of(metric: str) -> str:
    return f"case when contains({metric}, 'target_') then replace({metric}, 'target_', '') end"


CONTRACTS = " union all ".join(
    [
        check("px_tms", "tms_results", "scenario_source", "geco_2021", "scenario_source",
              "scenario_source = 'geco_2021'"),
        check("px_tms", "tms_results", "scenario", "2c", scenario_of("metric"),
              "regexp_matches(metric, '2c')"),
        check("px_dir", "technology_direction", "scenario_source", "geco_2021",
              "scenario_source", "scenario_source = 'geco_2021'"),
        check("px_dir", "technology_direction", "scenario", "2c", "scenario",
              "scenario = '2c'"),
        check("px_sda", "sda_results", "scenario_source", "geco_2021", "scenario_source",
              "scenario_source = 'geco_2021'"),
        check("px_sda", "sda_results", "scenario", "2c",
              scenario_of("emission_factor_metric"),
              "emission_factor_metric = 'target_2c'"),
        check("px_isos", "region_isos", "scenario_source", "geco_2021", "source",
              "source = 'geco_2021'"),
        check("px_isos", "region_isos", "benchmark_region", "ASIA",
              "case when source = 'geco_2021' then region end",
              "source = 'geco_2021' and region = 'ASIA'"),
        check("px_abcd", "abcd", "start_year", 1900, "year", "year = 1900"),
    ]
)

def offered(view: str, name: str, key: str, argument: str, wanted, value: str, met: str) -> str:
    """A row for each value on offer, beside whether any row meets the check."""
    return f"""select '{name}' as input, '{key}' as "check", '{argument}' as argument,
        '{wanted}' as requested, v.available, c.ok
        from (select coalesce(bool_or({met}), false) as ok from {view}) c
        left join (select distinct cast({value} as varchar) as available from {view}
          where {value} is not null) v on true"""


def columns_asked(name: str, key: str, present: str, absent: str = "") -> str:
    rows = [f"('{c}', '{c}', true)" for c in present.split()]
    rows += [f"('{c}', null, false)" for c in absent.split()]
    return f"""select '{name}' as input, '{key}' as "check", 'columns' as argument, *
        from (values {", ".join(rows)}) t(requested, available, ok)"""


VALUES = " union all ".join(
    [
        columns_asked("tms_results", "V2", """sector technology year region scenario_source
            name_abcd metric production technology_share scope
            percentage_of_initial_production_by_scope"""),
        columns_asked("technology_direction", "V2", """scenario_source scenario sector
            technology region directional_dummy"""),
        columns_asked("deviations", "V7", """sector technology year region scenario_source
            name_abcd projected direction total_tech_deviation activity_unit target_1.5c"""),
        columns_asked("sda_results", "V9", """sector year region scenario_source name_abcd
            emission_factor_metric emission_factor_value"""),
        columns_asked("alignment", "V12", """scenario region sector year direction name_abcd
            activity_unit scenario_source alignment_metric"""),
        columns_asked("matched", "V12", """id_loan loan_size_outstanding
            loan_size_outstanding_currency name_abcd sector group_id""", "bank"),
        """select 'matched', 'V13', 'by', c, c, ok
           from (values ('group_id', true), ('sector', false), ('bank', true)) t(c, ok)""",
        columns_asked("abcd", "V14", """company_id name_company lei is_ultimate_owner sector
            technology plant_location year production production_unit emission_factor
            emission_factor_unit ald_timestamp"""),
        columns_asked("region_isos", "V14", "region isos source"),
        offered("px_tms", "tms_results", "V3", "scenario_source", "weo_2021",
                "scenario_source", "scenario_source = 'weo_2021'"),
        offered("px_tms", "tms_results", "V4", "scenario", "1.5c", scenario_of("metric"),
                "regexp_matches(metric, '1.5c')"),
        offered("px_dir", "technology_direction", "V5", "scenario_source", "weo_2021",
                "scenario_source", "scenario_source = 'weo_2021'"),
        offered("px_dir", "technology_direction", "V6", "scenario", "1.5c", "scenario",
                "scenario = '1.5c'"),
        offered("deviated", "deviations", "V8", "scenario_source", "weo_2021",
                "scenario_source", "scenario_source = 'weo_2021'"),
        offered("px_sda", "sda_results", "V10", "scenario_source", "weo_2021",
                "scenario_source", "scenario_source = 'weo_2021'"),
        offered("px_sda", "sda_results", "V11", "scenario", "1.5c",
                scenario_of("emission_factor_metric"),
                "emission_factor_metric = 'target_1.5c'"),
        offered("px_isos", "region_isos", "V15", "scenario_source", "weo_2021", "source",
                "source = 'weo_2021'"),
        offered("px_isos", "region_isos", "V16", "benchmark_region", "ASIA",
                "case when source = 'weo_2021' then region end",
                "source = 'weo_2021' and region = 'ASIA'"),
        offered("px_abcd", "abcd", "V17", "start_year", 1900, "year", "year = 1900"),
    ]
)

# The benchmark's book with missing ids, which are written NA and come first.
GAP_BOOK = (
    RELATIONS["book"]
    .replace("'C' || company_id", "'C' || coalesce(cast(company_id as varchar), 'NA')")
    .replace("'UP' || company_id", "'UP' || coalesce(cast(company_id as varchar), 'NA')")
    .replace("'DL' || company_id", "'DL' || coalesce(cast(company_id as varchar), 'NA')")
    .replace("px_abcd", "gap_abcd")
    .replace(
        "order by company_id, sector, code, name_company, lei",
        "order by company_id nulls first, sector, code, name_company, lei nulls first",
    )
)

QUERIES = {
    "tms_filter_years": "select * from long_rows",
    "tms_pivot": "select * from pivoted",
    "tms_direction_join": "select * from signed",
    "tms_drop_empty_tech": "select * from not_idle",
    "tms_drop_zero_sector": """
        select w.* from not_idle w where exists (
          select 1 from not_idle k
          where k.name_abcd = w.name_abcd and k.region = w.region
            and k.scenario_source = w.scenario_source and k.sector = w.sector
            and k.year = w.year
          having coalesce(sum(k.target), 0) <> 0)""",
    "tech_deviation": f"select {DEVIATION} from deviated",
    "tech_deviation_gascap": """
        select * replace (case when technology = 'gascap' then -abs(total_tech_deviation) + 0
          else total_tech_deviation end as total_tech_deviation)
        from deviated where technology is not null""",
    "net_scenario_value": "select * from with_total",
    "total_deviation": "select * from summed_bo_po",
    "company_alignment_net": f"select {ALIGNMENT} from net",
    "company_alignment_bo_po": f"select {ALIGNMENT} from directed",
    "complete_directions": f"select {ALIGNMENT} from completed",
    "sda_pivot": f"""
        select * replace ({six("projected")} as projected, {six("target")} as target)
        from sda_wide""",
    "company_alignment_sda": f"""
        select * replace ({six("total_deviation")} as total_deviation,
          {six("alignment_metric")} as alignment_metric)
        from sda""",
    "loan_exposure": "select * from exposure",
    "loan_exposure_weight": f"""
        select * replace ({six("exposure_weight")} as exposure_weight) from weighed""",
    "loan_exposure_weight_by": f"""
        select * replace ({six("exposure_weight")} as exposure_weight) from weighed_by""",
    "portfolio_company_net": f"select {COMPANY} from ({NET})",
    "portfolio_company_net_by_group": f"select group_id, {COMPANY} from ({NET_BY})",
    "portfolio_company_bo_po": f"""
        select {COMPANY} from ({with_opposite(company("directed", "weighed"))})""",
    "portfolio_counts": aggregate(NET, COUNTS),
    "portfolio_exposure_aligned": aggregate(NET, EXPOSURES),
    "portfolio_weighted_alignment": aggregate(NET, WEIGHTED),
    "portfolio_aggregate_net": aggregate(NET, COUNTS, WEIGHTED, EXPOSURES),
    "portfolio_aggregate_bo_po": aggregate(
        with_opposite(company("completed", "weighed")), COUNTS, WEIGHTED
    ),
    "portfolio_aggregate_net_by_group": aggregate(
        NET_BY, COUNTS, WEIGHTED, EXPOSURES, by="group_id,"
    ),
    # All directions are there already, so none have to be added.
    "portfolio_aggregate_bo_po_by_group": aggregate(
        company("completed", "weighed_by"), COUNTS, WEIGHTED, by="group_id,"
    ),
    "portfolio_tms_sda": aggregate(
        company("(select * from net union all by name select * from sda)", "weighed"),
        COUNTS, WEIGHTED, EXPOSURES,
    ),
    "arranged_tms": f"""
        select {ALIGNMENT}, row_number() over (order by sector nulls last,
          name_abcd nulls last, region nulls last, year nulls last, direction nulls last,
          activity_unit nulls last, scenario_source nulls last) as position
        from completed""",
    "arranged_sda": f"""
        select * replace ({six("total_deviation")} as total_deviation,
          {six("alignment_metric")} as alignment_metric),
          row_number() over (order by sector nulls last, name_abcd nulls last,
            region nulls last, year nulls last, activity_unit nulls last) as position
        from sda""",
    "arranged_portfolio": f"""
        select *, row_number() over (order by group_id nulls last, scenario nulls last,
          region nulls last, sector nulls last, year nulls last, direction nulls last)
          as position
        from ({aggregate(company("completed", "weighed_by"), COUNTS, WEIGHTED, by="group_id,")})
        a""",
    "activity_units": """
        select distinct sector, technology,
          case when sector in ('aviation', 'cement', 'steel') then emission_factor_unit
            else production_unit end as activity_unit
        from px_abcd""",
    "sector_code_pick": """
        select sector, n_companies, code
        from (select sector, count(distinct company_id) as n_companies
              from px_abcd group by 1) a
          join picked_codes using (sector)""",
    "sector_code_listed": """
        select sector, code from (
          select x.sector, p_name as code, row_number() over (
            partition by x.sector order by length(p_name) desc, p.p_partkey) as n
          from part p join px_part x on p.p_partkey = x.p_partkey
          where not p_size % 7 = 0) c
        where n = 1""",
    "tech_deviation_by_plant": f"select {DEVIATION}, plant from gap_deviated",
    "company_alignment_by_plant": f"select {ALIGNMENT} from gap_completed",
    "loan_exposure_weight_gaps": f"""
        select * replace ({six("exposure_weight")} as exposure_weight) from gap_weighed""",
    "portfolio_gaps": aggregate(
        """select e.* exclude (name_abcd, sector), a.*
        from gap_completed a join gap_weighed e
          on a.name_abcd is not distinct from e.name_abcd and a.sector = e.sector""",
        COUNTS, WEIGHTED, by="group_id,",
    ),
    "activity_units_mixed": """
        select distinct sector, technology,
          case when sector in ('aviation', 'cement', 'steel') then emission_factor_unit
            else production_unit end as activity_unit
        from gap_abcd""",
    "benchmark_loanbook_gaps": GAP_BOOK,
    "benchmark_loanbook": "select * from book",
    "benchmark_portfolio": aggregate(
        company("net", "book_weighed"), COUNTS, WEIGHTED, EXPOSURES, by="group_id,"
    ),
    "contract_report": CONTRACTS,
    "contract_values": VALUES,
}


def needed(text: str) -> list[str]:
    """Relations a text refers to, directly or not, in order of definition."""
    names: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\w+", sql)) & set(RELATIONS) - names:
            names.add(name)
            visit(RELATIONS[name])

    visit(text)
    return [name for name in RELATIONS if name in names]


def registered() -> dict[str, str]:
    return {
        name: "with "
        + ",\n".join(f"{r} as ({RELATIONS[r]})" for r in needed(text))
        + f"\nselect * from ({text}) answer"
        for name, text in QUERIES.items()
    }
