"""Evidence codes: normal form, experimental test, weights."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public ECO to GO evidence code map, experimental codes, default weights.
ECO_TO_CODE = {
    "ECO:0000269": "EXP", "ECO:0007005": "HDA", "ECO:0007007": "HEP", "ECO:0007003": "HGI", "ECO:0007001": "HMP",
    "ECO:0006056": "HTP", "ECO:0000318": "IBA", "ECO:0000319": "IBD", "ECO:0000305": "IC", "ECO:0000314": "IDA",
    "ECO:0000501": "IEA", "ECO:0000270": "IEP", "ECO:0000317": "IGC", "ECO:0000316": "IGI", "ECO:0000320": "IKR",
    "ECO:0000315": "IMP", "ECO:0000353": "IPI", "ECO:0000321": "IRD", "ECO:0000247": "ISA", "ECO:0000255": "ISM",
    "ECO:0000266": "ISO", "ECO:0000250": "ISS", "ECO:0000303": "NAS", "ECO:0000307": "ND", "ECO:0000245": "RCA",
    "ECO:0000304": "TAS", "ECO:0000256": "IEA", "ECO:0000366": "IEA", "ECO:0007322": "IEA", "ECO:0007826": "IEA",
}
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "HTP", "HDA", "HMP", "HGI", "HEP", "IC", "TAS")
COMPUTATIONAL = ("ISS", "ISO", "ISA", "ISM", "IGC", "IBA", "IBD", "IKR", "IRD", "RCA")
WEIGHTS = {**dict.fromkeys(EXPERIMENTAL, 1.0), **dict.fromkeys(COMPUTATIONAL, 0.7), "NAS": 0.5, "IEA": 0.3, "ND": 0.1}
OTHER_WEIGHT = 0.5


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*values.items())))


def normalize(code: Column) -> Column:
    """The GO form of an ECO id; other codes as they are."""
    return F.coalesce(F.try_element_at(_map(ECO_TO_CODE), code), code)


def is_experimental(code: Column) -> Column:
    """Whether a GO or ECO code is experimental; null is not."""
    return F.coalesce(normalize(code).isin(*EXPERIMENTAL), F.lit(False))


def not_negated(qualifier: Column) -> Column:
    """Null qualifiers stay; any that contains NOT goes."""
    return qualifier.isNull() | ~qualifier.contains("NOT")


def weight(code: Column, overrides: dict[str, float] | Column | None = None) -> Column:
    """Override, else default weight of the normal form, else 0.5 (also for null and blank)."""
    own = normalize(code)
    default = F.coalesce(F.try_element_at(_map(WEIGHTS), own), F.lit(OTHER_WEIGHT))
    if overrides is None or (isinstance(overrides, dict) and not overrides):
        return default
    table = _map(overrides) if isinstance(overrides, dict) else overrides
    return F.coalesce(F.try_element_at(table, own), default)


def in_sql(code: str) -> str:
    """normalize() as a CASE any engine reads."""
    return f"(CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ECO_TO_CODE.items()) + f" ELSE {code} END)"


def weight_in_sql(code: str) -> str:
    return f"(CASE {in_sql(code)} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items()) + f" ELSE CAST({OTHER_WEIGHT} AS DOUBLE) END)"


def experimental_in_sql(code: str) -> str:
    return f"coalesce({in_sql(code)} IN ({', '.join(repr(c) for c in EXPERIMENTAL)}), FALSE)"
