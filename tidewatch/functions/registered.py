"""The functions of this package under names of SQL, and the links of a page as a table function.

Each function is a temporary SQL function whose body is the text of its Column expression, so a query in SQL is planned as the
same query in Columns is: inlined, pushed down, compiled, without a Python worker. ``listing_links`` is the one table
function that runs Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.functions import udtf

from ..sources import pages
from . import dates, money, text, urls

#: Of each name: the arguments with their types, and the expression.
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "tw_strip_accents": ("s string", text.strip_accents),
    "tw_squeeze": ("s string", text.squeeze),
    "tw_comparable": ("s string", text.comparable),
    "tw_blank_to_null": ("s string", text.blank_to_null),
    "tw_title_key": ("s string, y long", text.title_key),
    "tw_legal_reference": ("s string", text.legal_reference),
    "tw_notice_codes": ("s string", text.notice_codes),
    "tw_lost_prefix": ("r string, s string", text.lost_prefix),
    "tw_similarity": ("a string, b string", text.similarity),
    "tw_escape_html": ("s string", text.escape_html),
    "tw_split_list": ("s string", text.split_list),
    "tw_json_of_reply": ("s string", text.json_of_reply),
    "tw_lisbon_to_utc": ("t string", dates.lisbon_to_utc),
    "tw_opening": ("s string", lambda s: dates.parse_date(s, False)),
    "tw_closing": ("s string", lambda s: dates.parse_date(s, True)),
    "tw_days_until": ("t timestamp, n timestamp", dates.days_until),
    "tw_excel_date": ("n double", dates.excel_date),
    "tw_next_send": ("f string, u boolean, n timestamp", dates.next_send),
    "tw_retry_delay_minutes": ("n int, k string", dates.retry_delay_minutes),
    "tw_deadline_label": ("t timestamp, p string", dates.deadline_label),
    "tw_amount": ("s string", money.amount),
    "tw_percentage": ("s string", money.percentage),
    "tw_euros": ("v double", money.euros),
    "tw_call_cost": ("i long, o long, w long, r long", money.call_cost),
    "tw_canonical_url": ("u string", urls.canonical_url),
    "tw_host_name": ("u string", urls.host_name),
}
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|<|>|=|\+|-|\*|/|%|!|&|\||and|or|not)\(")
_DOUBLE = re.compile(r"(?<![\w.`])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")  # else a decimal


def sql_text(column: Column) -> str:
    """A Column expression as SQL. Operators, which are printed as functions of their names, get the quotes such names need."""
    said = column._jc.node().sql()
    parts = re.split(r"('(?:[^'\\]|\\.)*')", said, flags=re.S)  # literals stand at odd places
    return "".join(x if i % 2 else _DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", x)) for i, x in enumerate(parts))


@udtf(returnType="posicao int, href string, texto string", useArrow=True)
class ListingLinks:
    """Every anchor of a page in order."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        for i, (href, words) in enumerate(pages.page_links(html)):
            yield i, href, words


def registered(spark: SparkSession) -> SparkSession:
    """The session with all functions by name; those of before with such names are replaced."""
    for name, (arguments, build) in FUNCTIONS.items():
        columns = [F.col(a.split()[0]) for a in arguments.split(", ")]
        spark.sql(f"create or replace temporary function {name}({arguments}) return {sql_text(build(*columns))}")
    spark.udtf.register("listing_links", ListingLinks)
    return spark
