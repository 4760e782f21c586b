"""One relational text for an operator, for Spark and - as its check - for DuckDB.

Operators are written in the part of SQL that both engines share; the few words
in which they differ are written in capitals and rendered here:
``PCT(x, p)`` exact interpolated percentile, ``KURT(x)`` population excess
kurtosis, ``MEDIAN(x)``, ``LASTV(x)``/``FIRSTV(x)`` last and first value that
isn't null (before ``OVER``), ``SEQ(a, b, t, x)`` a lateral row for every integer
from a to b, ``HALFEVEN(x, d)`` rounding half to even, ``VALUES_OF(x)`` the sorted
list of different values, ``EACH(list, t, x)`` a lateral row for each of a list.
Inputs stand in braces: ``{s}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

ARG = r"((?:[^(),]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))+)"
RULES = {
    "spark": [
        (rf"\bPCT\({ARG},{ARG}\)", r"percentile(\1,\2)"),
        (rf"\bMEDIAN\({ARG}\)", r"percentile(\1, 0.5)"),
        (rf"\bKURT\({ARG}\)", r"kurtosis(\1)"),
        (rf"\bLASTV\({ARG}\)", r"last_value(\1) IGNORE NULLS"),
        (rf"\bFIRSTV\({ARG}\)", r"first_value(\1) IGNORE NULLS"),
        (rf"\bSEQ\({ARG},{ARG},{ARG},{ARG}\)", r"LATERAL explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT))) AS \3(\4)"),
        (rf"\bHALFEVEN\({ARG},{ARG}\)", r"bround(\1,\2)"),
        (rf"\bVALUES_OF\({ARG}\)", r"array_sort(collect_set(\1))"),
        (rf"\bEACH\({ARG},{ARG},{ARG}\)", r"LATERAL explode(\1) AS \2(\3)"),
    ],
    "duckdb": [
        (rf"\bPCT\({ARG},{ARG}\)", r"quantile_cont(\1,\2)"),
        (rf"\bMEDIAN\({ARG}\)", r"quantile_cont(\1, 0.5)"),
        (rf"\bKURT\({ARG}\)", r"kurtosis_pop(\1)"),
        (rf"\bLASTV\({ARG}\)", r"last_value(\1 IGNORE NULLS)"),
        (rf"\bFIRSTV\({ARG}\)", r"first_value(\1 IGNORE NULLS)"),
        (rf"\bSEQ\({ARG},{ARG},{ARG},{ARG}\)", r"LATERAL (SELECT unnest(generate_series(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))) AS \3(\4)"),
        (rf"\bHALFEVEN\({ARG},{ARG}\)", r"round_even(\1,\2)"),
        (rf"\bVALUES_OF\({ARG}\)", r"list_sort(list(DISTINCT \1))"),
        (rf"\bEACH\({ARG},{ARG},{ARG}\)", r"LATERAL (SELECT unnest(\1)) AS \2(\3)"),
    ],
}


def render(text: str, dialect: str) -> str:
    before = None
    while before != text:  # words may stand inside each other
        before = text
        for pattern, to in RULES[dialect]:
            text = re.sub(pattern, to, text)
    if dialect == "spark":  # decimal literals are doubles here
        text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", text)
    return text


def run(text: str, **inputs: DataFrame) -> DataFrame:
    """The operator's DataFrame over its inputs; Catalyst plans it as one query."""
    spark = next(iter(inputs.values())).sparkSession
    return spark.sql(render(text, "spark"), **inputs)


def oracle(text: str, **inputs: str) -> str:
    """The same for DuckDB, inputs being SQL texts."""
    text = render(text, "duckdb")
    for name, sql in inputs.items():
        text = text.replace("{" + name + "}", f"({sql})")
    return text
