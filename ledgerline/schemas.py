"""Declared schemas of the input tables."""

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


ORDERS = _struct(
    doc_id=_S, fund_year=_S, item=_S, po_type=_S, huka=_S, porcurment_organization=_S,
    expanditure_type=_S, fingroup=_S, po_net_value=_D,
)
ORDER_DATES = _struct(doc_id=_S, fund_year=_S, item=_S, order_date=_S)
ORDER_EDITS = _struct(doc_id=_S, fund_year=_S, item=_S, order_date=_S, volume=_D)
INVOICES = _struct(
    doc_id=_S, fund_year=_S, item=_S, invoice_year=_I, invoice_month=_I, mof_class=_S,
    RE=_D, ZY=_D, ZF=_D,
)
PAYMENTS = _struct(
    budget_year=_L, order_id=_S, order_line=_S, fingroup=_S, po_2=_L, coin=_L, huka=_L,
    expediture_type=_L, fc4=_L, fund_code=_L, zroa=_L, doc_type=_S, fc3=_L, paymant_date=_S,
    mimun=_D,
)
SALES_ORDERS = _struct(
    order_id=_S, order_line=_S, po_2=_S, fund_code=_S, sales_office=_S, sales_organistion=_S,
    sales_document_type=_S, sales_group=_S, inviting_partner=_S, order_starting_date=_L, fc=_S,
    sales_order_sum=_D, order_line_balance=_D,
)
MONTH_COLUMNS = [str(m) for m in range(1, 13)]
BUDGET_WIDE = _struct(
    financial_year=_I, economy=_S, expenditure_type=_I, doc_type=_S, fund_code=_I, fingroup=_S,
    law=_I, **{m: _S for m in MONTH_COLUMNS},
)
CHANGE_LINES = _struct(
    doc_id=_S, doc_item=_I, fund_code=_I, **{"0": _S, "110": _S}, MOF_class=_S, year=_I, month=_I,
    law=_I,
)
DOCUMENTS = _struct(doc=_S, group=_S, year=_I, month=_I, volume=_D, fund_year=_I)
