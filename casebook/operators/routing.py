"""Whether a message needs retrieval, and the dispatch of tool calls.

A chat model makes the routing choice in an interactive service. Over a table of
messages an ordered list of keyword rules stands in for it: a proxy, to be judged
by its own rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.fixed_values import NO_CONTEXT_MESSAGE, RETRIEVAL_TOOL

DIRECT, RETRIEVE = "direct", "retrieve"

# Ordered rules: route, pattern on the lower-cased text.
DEFAULT_RULES = [
    (DIRECT, r"^\s*(xin chào|chào|hello|hi\s|hi$)"),
    (DIRECT, r"(cảm ơn|cám ơn|thank)"),
    (DIRECT, r"(bạn là ai|bạn khỏe không)"),
    (DIRECT, r"(tóm tắt|nhắc lại).*(câu trả lời|ở trên|vừa rồi)"),
    (RETRIEVE, r"(luật|điều \d|nghị định|thông tư|quy định|xử phạt|mức phạt|phạt)"),
    (RETRIEVE, r"(hợp đồng|quyền|nghĩa vụ|tội|tòa|thủ tục|bồi thường)"),
]


def route(text: Column, rules=DEFAULT_RULES, otherwise: str = DIRECT) -> Column:
    """Route of the first rule that matches."""
    lowered = F.lower(text)
    chain = F
    for label, pattern in rules:
        chain = chain.when(F.rlike(lowered, F.lit(pattern)), F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def dispatch_tool_calls(
    messages: DataFrame, results: DataFrame, tool: str = RETRIEVAL_TOOL
) -> DataFrame:
    """Tool messages for each known call, in call order.

    ``messages(conv_id, turn, tool_calls)`` and ``results(query, result)`` with one
    row per query. A known call without a result, or without a query, is answered
    with the fixed message. A call of any other tool yields no row. An absent call
    id becomes the empty string.
    """
    calls = (
        messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("call_no", "call"))
        .filter(F.col("call.name") == tool)
        .select(
            "conv_id",
            "turn",
            F.col("call_no").cast("bigint").alias("call_no"),
            F.coalesce("call.id", F.lit("")).alias("tool_call_id"),
            F.col("call.name").alias("name"),
            F.col("call.args")["query"].alias("query"),
        )
    )
    content = F.coalesce("result", F.lit(NO_CONTEXT_MESSAGE)).alias("content")
    return calls.join(results, "query", "left").select(
        "conv_id", "turn", "call_no", "tool_call_id", "name", content
    )
