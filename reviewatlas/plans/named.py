"""Registered queries: the named tools, for one child id, against the set-wise SQL."""

from __future__ import annotations

from reviewatlas.plans import comparing, evidence, tools  # noqa: F401
from reviewatlas.plans.registry import QUERIES, Query, query

CHILD, PARENT, OTHER = "A000000012", "A000000010", "A000000017"


def _of(name: str, column: str = "parent_asin") -> str:
    return f"SELECT * FROM ({QUERIES[name].oracle}) WHERE {column} = '{PARENT}'"


def _tool(name: str, oracle: str, shape=lambda df: df, **arguments: str) -> None:
    QUERIES[f"tool_{name}"] = Query(lambda t: shape(tools.call(name, t, **arguments)), oracle)


_tool("get_product_swot", _of("swot"), asin=CHILD)
_tool("analyze_customer_context", _of("customer_context"), asin=CHILD)
_tool("generate_listing_content", _of("listing_brief", "asin"), asin=CHILD)
_tool("find_better_alternatives", _of("better_alternatives", "for_asin").replace(comparing._VAGUE, "product_parents"), asin=CHILD)
_tool("analyze_competitors", _of("competitor_gaps", "for_asin").replace(comparing._VAGUE, "product_parents"), asin=CHILD)


@query("tool_compare_head_to_head", f"""SELECT * FROM (WITH s AS ({comparing._SIDES})
    SELECT '{PARENT}' AS a, 'A000000015' AS b, x.aspect, x.pos_ratio AS score_a, y.pos_ratio AS score_b, x.mentions AS mentions_a, y.mentions AS mentions_b
    FROM s x JOIN s y ON x.parent_asin = '{PARENT}' AND y.parent_asin = 'A000000015' AND y.aspect = x.aspect
    QUALIFY row_number() OVER (ORDER BY x.mentions + y.mentions DESC, x.aspect) <= 10)""", ["tags_norm"])
def _(t):
    return tools.call("compare_head_to_head", t, asin_a=CHILD, asin_b=OTHER)


@query("tool_search_review_evidence", evidence._EV.format(where=f"q.parent_asin = '{PARENT}' AND q.sentiment = 'Negative' AND (contains(lower(quote), 'the') OR contains(lower(text), 'the'))"), ["quoted_norm", "reviews_text"])
def _(t):
    return tools.call("search_review_evidence", t, asin=CHILD, sentiment="Negative", keyword="the")
