"""Record assembly: physical lines to records of at most `max_group` lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a continuation line begins with once blanks are stripped.
STARTS = ("at ", "Caused by:", "Exception in thread", "...", "Traceback (")


def continues(value: Column) -> Column:
    """Whether a line looks like the continuation of the one before."""
    stripped = F.btrim(value)
    test = value.rlike("^[ \\t]")
    for s in STARTS:
        test = test | stripped.startswith(s)
    return test


def balance(text: str, depth: int = 0, quoted: bool = False, escaped: bool = False) -> tuple[int, bool, bool]:
    """Brace depth after a text; 0 as soon as it first comes back to 0, whatever follows."""
    for c in text:
        if escaped:
            escaped = False
        elif quoted:
            if c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return 0, False, False
    return depth, quoted, escaped


def fold(values: list[str], max_group: int) -> list[int]:
    """Number of the record of each line, by the sequential rule with open braces."""
    out, record, size, depth, quoted, escaped = [], -1, 0, 0, False, False
    for v in values:
        whole = v.lstrip().startswith("{") and balance(v.strip())[0] == 0
        blank = v[:1] in (" ", "\t") or v.strip().startswith(STARTS)
        joins = record >= 0 and size < max_group and (depth > 0 or blank) and not (depth == 0 and whole)
        if not joins:
            record, size, depth, quoted, escaped = record + 1, 0, 0, False, False
        size += 1
        depth, quoted, escaped = balance(v, depth, quoted, escaped)
        out.append(record)
    return out


def assemble(lines: DataFrame, max_group: int = 50) -> DataFrame:
    """(file, line_no of the first line, raw, n_lines). Files in which a line leaves a brace open are folded in order,
    each in one task; all others are grouped by window functions alone."""
    opens = F.coalesce(F.length(F.regexp_replace("value", "[^{]", "")) > F.length(F.regexp_replace("value", "[^}]", "")), F.lit(False))
    files = lines.groupBy("file").agg(F.max(opens | F.col("value").rlike('\\{[^{}]*"[^"]*[{}]')).alias("folded"))
    marked = lines.join(files, "file")
    order = Window.partitionBy("file").orderBy("line_no")
    runs = marked.where(~F.col("folded")).withColumn("start", (~continues(F.col("value"))).cast("int")).withColumn("run", F.sum("start").over(order))
    within = Window.partitionBy("file", "run").orderBy("line_no")
    fast = runs.withColumn("part", F.floor((F.row_number().over(within) - 1) / max_group)).select("file", "line_no", "value", F.concat_ws(":", "run", "part").alias("record"))

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        pdf["record"] = [str(r) for r in fold(pdf["value"].tolist(), max_group)]
        return pdf[["file", "line_no", "value", "record"]]

    slow = marked.where("folded").select("file", "line_no", "value").groupBy("file").applyInPandas(folded, "file string, line_no long, value string, record string")
    rows = fast.unionByName(slow)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("file", "record").agg(F.min("line_no").alias("line_no"), joined.alias("raw"), F.count("*").cast("int").alias("n_lines")).drop("record")
