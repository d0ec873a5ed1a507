"""Ordered rule labelling of budget rows and code consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LABEL = "rest"

# Document types and fund codes dropped before labelling.
DROPPED_DOC_TYPES = ["RE", "ZY", "ZF", "ZH"]
DROPPED_FUND_CODES = [1410]
DROPPED_FUND_CODES_COIN_1 = [1407, 1405, 1400, 1406]

# Label rules in order; a later matching rule replaces an earlier one.
COIN_1_RULES = [
    ("affilated_other", {"doc_type": ["ZC"]}),
    ("vehicles", {"doc_type": ["KR", "KG"], "law": [300]}),
    ("career_salary", {"fund_code": [1411], "doc_type": ["ZC"]}),
    ("drafted_salary", {"fund_code": [1409], "doc_type": ["ZC"]}),
    ("pensions", {"fund_code": [1401, 1402], "doc_type": ["ZC", "ZW"]}),
    ("idf_workers_salary", {"fund_code": [1408], "doc_type": ["ZC"]}),
    ("dd_workers_salary", {"fund_code": [1413, 1414, 1415], "doc_type": ["ZC", "ZW"]}),
    ("pre_draft_salary", {"fund_code": [1412], "doc_type": ["ZC"]}),
    ("additional_drafted_service_salary", {"fund_code": [1416], "doc_type": ["ZC"]}),
    ("overseas_transportation", {"doc_type": ["KR", "KG"], "law": [302]}),
    ("tariffs", {"doc_type": ["KR", "KG"], "law": [706]}),
    ("insurance", {"doc_type": ["KR", "KG"], "law": [2900]}),
    ("special_compensation", {"doc_type": ["KR", "KG"], "law": [1316]}),
    ("special_research", {"law": [9800]}),
    ("hostages", {"fund_code": [1423]}),
    ("fiancees", {"fund_code": [1425]}),
    ("commemoration", {"fund_code": [1403]}),
    ("disabled", {"fund_code": [1407]}),
    ("arnona", {"doc_type": ["ZD"]}),
    ("electricity", {"expenditure_type": [1020]}),
    ("water", {"expenditure_type": [1030]}),
    ("KM", {"doc_type": ["KM"]}),
    ("KT", {"doc_type": ["KT"]}),
    ("SA", {"doc_type": ["SA"]}),
    ("ZJ", {"doc_type": ["ZJ"]}),
]
COIN_5_RULES = [
    ("ZW", {"doc_type": ["ZW"]}),
    ("ZC", {"doc_type": ["ZC"]}),
    ("travel-KRKG", {"doc_type": ["KR", "KG"], "expenditure_type": [2010, 2030, 2050, 2015, 2035, 2045]}),
    ("14-KRKG", {"doc_type": ["KR", "KG"], "fund_code": list(range(1400, 1479))}),
    ("SA", {"doc_type": ["SA"]}),
]

# Codes whose series belong together.
FUND_DOC_CODES = [50, 51, 60, 61, 78, 79]
FUND_DOC_MERGES = {51: 50, 61: 60}
INVOICE_DOC_MERGES = {"ZY": "RE", "ZF": "RE", "KG": "KR"}


def matches(condition: dict[str, list]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isin(values) for c, values in condition.items()])


def label_column(rules, default: str = DEFAULT_LABEL) -> Column:
    """``when`` chain in reverse rule order, so that the last matching rule wins."""
    (last_label, last_condition), *earlier = list(reversed(rules))
    chain = F.when(matches(last_condition), F.lit(last_label))
    for label, condition in earlier:
        chain = chain.when(matches(condition), F.lit(label))
    return chain.otherwise(F.lit(default))


def rules_for(coin: int):
    return COIN_1_RULES if coin == 1 else COIN_5_RULES


def keep_for_labelling(coin: int) -> Column:
    """Not one of the dropped codes; a null code is none of them, so its row stays."""
    def outside(c: str, codes) -> Column:
        return F.coalesce(~F.col(c).isin(codes), F.lit(True))

    keep = outside("doc_type", DROPPED_DOC_TYPES) & outside("fund_code", DROPPED_FUND_CODES)
    return keep & outside("fund_code", DROPPED_FUND_CODES_COIN_1) if coin == 1 else keep


def merge_codes(c: str | Column, merges: dict) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    chain = None
    for old, new in merges.items():
        chain = F.when(value == old, F.lit(new)) if chain is None else chain.when(value == old, F.lit(new))
    return chain.otherwise(value)
