"""Whole analyses on random tables, against a row by row calculation.

The tables have missing keys and values, zeros, several sources, units and currencies,
and in some runs a column of their own that tells rows apart.
"""

import math
import random
from collections import defaultdict

import pytest

from loanlens import (
    aggregate_alignment_loanbook_exposure,
    calculate_company_aggregate_alignment_sda,
    calculate_company_aggregate_alignment_tms,
    calculate_company_tech_deviation,
)
from loanlens.operators.company_alignment import OUTPUT
from loanlens.sources import schemas

SOURCE, SCENARIO, TARGET = "s1", "x", "target_x"
TECHNOLOGIES = {"power": ["gascap", "coalcap", "hydrocap"], "coal": ["coal"], None: ["odd"]}
UNITS = [
    ("power", "gascap", "MW"),
    ("power", "coalcap", "MW"),
    ("power", "hydrocap", "GW"),
    ("coal", "coal", "t"),
    ("coal", "coal", "kt"),
    (None, "odd", None),
]


def missing(value):
    return value is None or math.isnan(value)


def total(values):
    return math.fsum(v for v in values if not missing(v))


def divide(n, d):
    if n is None or d is None:
        return None
    if d == 0:
        return None if n == 0 else math.copysign(math.inf, n)
    return n / d


def technology_rows(rng, extra):
    rows = {}
    for _ in range(500):
        sector = rng.choice(["power", "power", "coal", None])
        key = (
            sector,
            rng.choice(TECHNOLOGIES[sector] + [None]),
            rng.choice([2020, 2021, 2023, 2026]),
            rng.choice(["r1", "r2", None]),
            rng.choice([SOURCE, SOURCE, SOURCE, "s2", None]),
            rng.choice(["c1", "c2", "c3", None]),
            rng.choice(["projected", TARGET, "target_y", None]),
            *([rng.choice(["p1", "p2", None])] if extra else []),
        )
        rows[key] = rng.choice([0.0, 0.0, None, float("nan"), 2.0, 5.0, 16.0])
    return rows


def deviations(rows, signs, bridge):
    """(ids without metric, projected, target, deviation, direction, unit) per result row."""
    start = min(k[2] for k in rows)
    wide = defaultdict(dict)
    for k, production in rows.items():
        if k[4] == SOURCE and k[6] in ("projected", TARGET) and start <= k[2] <= start + 5:
            cell = None if missing(production) else production
            wide[(*k[:6], *k[7:])][k[6]] = cell
    wide = {k: v for k, v in wide.items() if (k[0], k[1], k[3]) in signs}
    technology, sector = defaultdict(list), defaultdict(list)
    for k, v in wide.items():
        technology[k[:6]].append((v.get("projected"), v.get(TARGET)))
    idle = {
        k for k, v in technology.items() if total(p for p, _ in v) == total(t for _, t in v) == 0
    }
    wide = {k: v for k, v in wide.items() if k[:6] not in idle}
    for k, v in wide.items():
        sector[(k[0], *k[2:6])].append(v.get(TARGET))
    result = []
    for k, v in wide.items():
        if total(sector[(k[0], *k[2:6])]) == 0:
            continue
        sign, p, t = signs[(k[0], k[1], k[3])], v.get("projected"), v.get(TARGET)
        deviation = None if None in (p, t, sign) else (p - t) * sign
        if bridge != "none":
            if k[1] is None:
                continue
            if k[1] == bridge and deviation is not None:
                deviation = -abs(deviation)
        direction = None if sign is None else "buildout" if sign == 1 else "phaseout"
        for s, tech, unit in UNITS:
            if (s, tech) == k[:2]:
                result.append((k, p, t, deviation, direction, unit))
    return result


def company_alignment(rows, level):
    net, parts = defaultdict(list), defaultdict(list)
    for k, _, t, deviation, direction, unit in rows:
        key = (k[5], k[0], unit, k[3], k[4], SCENARIO, k[2])
        net[key].append(t)
        parts[(key, "net" if level == "net" else direction)].append(deviation)
    result = {
        (*key, d): (total(v), divide(total(v), total(net[key]))) for (key, d), v in parts.items()
    }
    if level == "bo_po":
        directions = {d for _, d in parts}
        for key in net:
            for d in directions:
                deviation, metric = result.get((*key, d), (0.0, 0.0))
                result[(*key, d)] = (deviation, 0.0 if metric is None else metric)
    return result


def loanbook(alignment, loans, level, by):
    """Group to (companies, aligned, share, weighted metric, exposure, aligned exposure)."""
    exposure, book = defaultdict(list), defaultdict(list)
    for loan in loans:
        exposure[(*(loan[c] for c in by), loan["currency"], loan["name"], loan["sector"])].append(
            loan["size"]
        )
    sizes = {k: total(v) for k, v in exposure.items()}
    for k, size in sizes.items():
        book[k[:-2]].append(size)
    rows = [(*k, *v) for k, v in alignment.items()]
    if level == "bo_po":
        unit_directions = defaultdict(set)
        for r in rows:
            unit_directions[(*r[:4], *r[5:7])].add(r[7])
        for r in list(rows):
            known = unit_directions[(*r[:4], *r[5:7])] - {None}
            if r[1] in ("automotive", "hdv", "power") and r[7] in ("buildout", "phaseout"):
                if len(known) == 1:
                    other = "phaseout" if r[7] == "buildout" else "buildout"
                    rows.append((*r[:7], other, 0.0, 0.0))
    groups = defaultdict(list)
    for r in rows:
        for k, size in sizes.items():
            if k[-2:] == r[:2]:
                group = (*k[: len(by)], r[5], r[3], r[1], r[6], r[7])
                groups[group].append((r[0], r[9], size, divide(size, total(book[k[:-2]]))))
    result = {}
    for group, members in groups.items():
        aligned = [m for m in members if m[1] is not None and m[1] >= 0]
        kept = [m for m in members if m[1] is not None]
        weighted = None
        if all(m[3] is not None for m in kept):
            terms = [m[1] * m[3] for m in kept if m[3] != 0]
            if not (math.inf in terms and -math.inf in terms):
                weighted = divide(math.fsum(terms), math.fsum(m[3] for m in kept))
        names = {m[0] for m in members}
        size, aligned_size = total(m[2] for m in members), total(m[2] for m in aligned)
        result[group] = (len(names), len(aligned), divide(len(aligned), len(names)), weighted)
        if level == "net":
            result[group] += (size, aligned_size, divide(aligned_size, size))
    return result


def close(a, b):
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def same(found, expected):
    assert expected
    assert set(found) == set(expected)
    for key, values in expected.items():
        assert all(close(a, b) for a, b in zip(found[key], values, strict=True)), (
            key,
            found[key],
            values,
        )


def as_mapping(df, n_keys):
    rows = [tuple(r) for r in df.collect()]
    mapping = {r[:n_keys]: r[n_keys:] for r in rows}
    assert len(mapping) == len(rows)
    return mapping


@pytest.mark.parametrize(
    "seed, extra, bridge, by",
    [
        (1, False, "none", []),
        (2, False, "gascap", ["bank"]),
        (3, True, "none", ["bank", "kind"]),
        (4, True, "gascap", []),
    ],
)
def test_pathways_to_loanbook(spark, table, seed, extra, bridge, by):
    rng = random.Random(seed)
    rows = technology_rows(rng, extra)
    signs = {
        (s, t, r): rng.choice([1.0, -1.0, -1.0, None])
        for s, ts in TECHNOLOGIES.items()
        for t in ts
        for r in ["r1", "r2", None]
        if rng.random() < 0.9
    }
    results = table(
        [(*k[:7], v, 0.0, "sector", rng.random(), *k[7:]) for k, v in rows.items()],
        schemas.TECHNOLOGY_RESULTS + (", plant string" if extra else ""),
    )
    directions = table(
        [(SOURCE, SCENARIO, s, t, r, d) for (s, t, r), d in signs.items()],
        schemas.TECHNOLOGY_DIRECTION,
    )
    found = calculate_company_tech_deviation(
        results,
        directions,
        SOURCE,
        SCENARIO,
        bridge,
        activity_units=table(UNITS, schemas.ACTIVITY_UNITS),
    )
    expected = deviations(rows, signs, bridge)
    ids = ["sector", "technology", "year", "region", "scenario_source", "name_abcd"]
    ids += ["plant"] if extra else []
    shown = found.select(
        *ids, "activity_unit", "projected", f"`{TARGET}`", "total_tech_deviation", "direction"
    )
    same(
        as_mapping(shown, len(ids) + 1),
        {(*k, unit): (p, t, dev, d) for k, p, t, dev, d, unit in expected},
    )

    loans = [
        {
            "id": f"L{i}",
            "size": rng.choice([0.0, None, float("nan"), 1.0, 3.0, 10.0]),
            "currency": rng.choice(["USD", "EUR", None]),
            "name": rng.choice(["c1", "c2", "c3", "c9", None]),
            "sector": rng.choice(["power", "coal", None]),
            "bank": rng.choice(["b1", "b2", None]),
            "kind": rng.choice(["k1", "k2"]),
        }
        for i in range(60)
    ]
    matched = table(
        [tuple(loan.values()) for loan in loans],
        schemas.MATCHED_LOANS + ", bank string, kind string",
    )
    for level in ("net", "bo_po"):
        aligned = calculate_company_aggregate_alignment_tms(found, SOURCE, SCENARIO, level)
        expected_alignment = company_alignment(expected, level)
        same(as_mapping(aligned.select(*OUTPUT), 8), expected_alignment)
        book = aggregate_alignment_loanbook_exposure(aligned, matched, level, by)
        same(
            as_mapping(book.aggregate, len(by) + 5),
            loanbook(expected_alignment, loans, level, by),
        )


@pytest.mark.parametrize("seed, extra", [(5, False), (6, True)])
def test_intensities(table, seed, extra):
    rng = random.Random(seed)
    rows = {}
    for _ in range(300):
        key = (
            rng.choice(["steel", "coal", None]),
            rng.choice([2020, 2021, 2025, 2026]),
            rng.choice(["r1", None]),
            rng.choice([SOURCE, SOURCE, "s2", None]),
            rng.choice(["c1", "c2", "c3", "market", None]),
            rng.choice(["projected", TARGET, "target_y"]),
            *([rng.choice(["p1", "p2", None])] if extra else []),
        )
        rows[key] = rng.choice([0.0, None, float("nan"), 0.5, 0.8])
    schema = schemas.INTENSITY_RESULTS + (", plant string" if extra else "")
    found = calculate_company_aggregate_alignment_sda(
        table([(*k[:6], v, *k[6:]) for k, v in rows.items()], schema),
        SOURCE,
        SCENARIO,
        activity_units=table(UNITS + [("steel", "a", "t")], schemas.ACTIVITY_UNITS),
    )
    start = min(k[1] for k in rows)
    wide, totals = defaultdict(dict), defaultdict(list)
    for k, value in rows.items():
        company = k[4] is not None and k[4] != "market"
        if company and k[3] == SOURCE and k[5] != "target_y" and k[1] <= start + 5:
            wide[(*k[:5], *k[6:])][k[5]] = None if missing(value) else value
    for k, v in wide.items():
        totals[k[:5]].append(v.get(TARGET))
    expected = []
    for k, v in wide.items():
        net, p = total(totals[k[:5]]), v.get("projected")
        deviation = None if p is None else -(p - net)
        for unit in sorted({u for s, _, u in UNITS + [("steel", "a", "t")] if s == k[0]}, key=str):
            expected.append(
                (k[4], k[0], unit, k[2], k[3], SCENARIO, k[1], "net", deviation, divide(deviation, net))
            )

    def order(row):
        return [
            (v is not None, round(v, 9) if isinstance(v, float) else v) for v in row
        ]

    actual = sorted((tuple(r) for r in found.collect()), key=order)
    expected.sort(key=order)
    assert len(actual) == len(expected) > 0
    for a, b in zip(actual, expected, strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)
