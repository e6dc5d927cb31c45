"""What a query's physical plan does, as rows: scans, the predicates that reach them, and how tables meet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

STEP_SCHEMA = "step string, detail string"
_JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def steps(df: DataFrame) -> list[tuple[str, str]]:
    """(step, detail) in the order of the plan: scan with its columns, pushed with each predicate, filter, shuffle, join and python."""
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, 1 << 20)  # or else long lists of predicates are cut
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)
    # a plan that adapts also prints what it started from
    text = text.split("== Initial Plan ==")[0]
    out: list[tuple[str, str]] = []
    for line in text.splitlines():
        node = re.sub(r"^[\s:+|*\-()\d]*", "", line)
        name = re.match(r"\w+", node)
        if not name:
            continue
        if name[0] == "FileScan":
            columns = re.search(r"ReadSchema: struct<(.*?)>\s*$", line)
            out.append(("scan", ", ".join(re.findall(r"(?:^|,)(\w+):", columns[1])) if columns else ""))
            pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)
            if pushed and pushed[1]:
                out += [("pushed", x) for x in re.findall(r"\w+\((?:[^()]|\([^()]*\))*\)", pushed[1])]
        elif name[0] == "Filter":
            out.append(("filter", node[len("Filter ") :].strip()))
        elif name[0] == "Exchange":
            out.append(("shuffle", node[len("Exchange ") :].split(",")[0].strip()))
        elif name[0] in _JOINS:
            out.append(("join", name[0]))
        elif "InArrow" in name[0] or "InPandas" in name[0] or name[0].endswith("EvalPython"):
            out.append(("python", name[0]))
    return out


def describe(df: DataFrame) -> DataFrame:
    """steps() as a DataFrame."""
    return df.sparkSession.createDataFrame(steps(df), STEP_SCHEMA)
