"""The library's functions for SQL users: SQL functions that the optimizer inlines, and a table function.

``register(spark)`` makes url_host, url_platform, round_status, text_bigrams and keyword_overlap known to
the session, and ``date_tokens(text)`` for use with LATERAL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from roundtide import dims
from roundtide.functions import grams
from roundtide.functions.urls import HOST_PART


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _platform() -> str:
    arms = (f"WHEN {' OR '.join(f'contains(host, {text(f)})' for f in fragments)} THEN {text(name)}" for name, fragments in dims.TICKET_PLATFORMS.items())
    return f"CASE {' '.join(arms)} WHEN host = '' THEN 'unknown' ELSE host END"


def functions() -> dict[str, str]:
    """Signature and body of each function, in the order in which they build on each other."""
    return {
        "url_host(url STRING)": f"regexp_replace(lower(regexp_extract(coalesce(url, ''), {text(HOST_PART)}, 1)), '^www[.]', '')",
        "platform_of_host(host STRING)": _platform(),
        "url_platform(url STRING)": "platform_of_host(url_host(url))",
        "round_status(starts DATE, ends DATE, results DATE, sale DATE, pay DATE, as_of DATE)": """CASE
            WHEN results = as_of THEN 'results_today'
            WHEN datediff(pay, as_of) BETWEEN 0 AND 1 THEN 'payment_due'
            WHEN datediff(sale, as_of) BETWEEN 0 AND 2 THEN 'general_sale_soon'
            WHEN sale < as_of THEN 'closed'
            WHEN as_of BETWEEN starts AND ends THEN CASE WHEN datediff(ends, as_of) <= 2 THEN 'closing_soon' ELSE 'open' END
            WHEN as_of < starts THEN 'upcoming'
            WHEN as_of > ends THEN 'closed' ELSE 'unknown' END""",
        "text_bigrams(body STRING)": f"array_distinct(regexp_extract_all(regexp_replace(lower(body), {text(grams.IGNORED)}, ''), '(?s)(?=(..)).', 1))",
        "shared_share(wanted ARRAY<STRING>, given ARRAY<STRING>)": "CASE WHEN size(wanted) = 0 THEN 0D ELSE CAST(size(array_intersect(wanted, given)) AS DOUBLE) / size(wanted) END",
        "keyword_overlap(keyword STRING, body STRING)": "shared_share(text_bigrams(keyword), text_bigrams(body))",
    }


RETURNS = {"text_bigrams": "ARRAY<STRING>", "shared_share": "DOUBLE", "keyword_overlap": "DOUBLE"}


@udtf(returnType="place int, token string", useArrow=True)
class DateTokens:
    """Rows (place, token): the date tokens of a text in order, from 1."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for k, token in enumerate(re.findall(dims.DATE_TOKEN, text or ""), 1):
            yield k, token


def register(spark: SparkSession) -> None:
    for signature, body in functions().items():
        returns = RETURNS.get(signature.split("(")[0], "STRING")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    spark.udtf.register("date_tokens", DateTokens)
