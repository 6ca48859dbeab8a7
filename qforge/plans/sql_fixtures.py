"""DuckDB-dialect SQL text for the oracle side of each registered query.

The oracle registers only the base tables, so the sensor views are
inlined as CTEs. Each query's SQL states the operator's semantics in
plain ANSI SQL (window functions and exact quantiles are fine there: the
oracle is a single-node reference, not the engine).
"""

from __future__ import annotations

FEATURES = ["temp", "humid", "press"]

K = "CAST(json_extract_string(props, '$.k') AS INT)"

SENSOR = f"""sensor AS (
  SELECT event_id, value AS temp, CAST({K} AS DOUBLE) AS humid, CAST(user_id AS DOUBLE) AS press,
         CASE WHEN value > 60 AND {K} > 40 THEN 1 ELSE 0 END AS error
  FROM events)"""

SENSOR_RAW = """sensor_raw AS (
  SELECT event_id,
         CASE WHEN event_id % 37 = 0 THEN NULL ELSE temp END AS temp,
         CASE WHEN event_id % 53 = 0 THEN NULL ELSE humid END AS humid,
         press, error
  FROM sensor)"""

SCORE_EXPR = ("(least(temp / CAST(120.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) * CAST(0.6 AS DOUBLE)"
              " + humid / CAST(99.0 AS DOUBLE) * CAST(0.4 AS DOUBLE))")

SCORED = f"""scored AS (
  SELECT event_id, error AS label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT event_id, error,
               floor({SCORE_EXPR} * CAST(200.0 AS DOUBLE)) / CAST(200.0 AS DOUBLE) AS score
        FROM sensor) t)"""


def ci(cond: str) -> str:
    """count_if with a BIGINT result (DuckDB's count_if is HUGEINT)."""
    return f"CAST(count_if({cond}) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def spark_round(sql: str) -> str:
    """Rewrite ``round(x, d)`` to round half-up on the shortest decimal text of x.

    That is how Spark (and Python's decimal view of a double) rounds;
    DuckDB's double ``round`` scales by 10^d first and so rounds values
    such as 90.91499999999999 up. Only this file's own SQL is rewritten.
    """
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = spark_round(sql[j + len(key):comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(CAST(({inner}) AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)")
        i = k
