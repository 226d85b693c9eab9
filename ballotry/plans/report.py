"""Report tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities as null, as strict JSON wants."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls kept, no NaN."""
    cols = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A CSV table in fixed column order; missing values are empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report_lines(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Formatted lines, one a row."""
    return df.select(F.format_string(pattern, *columns).alias("line"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line, text) of a Markdown table: head, rule, then rows in order. For report tables, a row or so a cell."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line long, text string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    line = (F.row_number().over(Window.orderBy(*order)) + 1).cast("long")
    return head.unionByName(df.select(line.alias("line"), text.alias("text")))


def canonical_order(cells: DataFrame, domains: dict[str, str], order: list[str]) -> DataFrame:
    """Report rows with the domain of their task and their position in the given order."""
    names = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    rows = cells.withColumn("domain", names[F.col("task")])
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("line").write.mode("overwrite").text(path)


def roll_up(cells: DataFrame, value: str, by: tuple[str, ...] = ("task", "model")) -> DataFrame:
    """By each of the columns and overall: count, mean, least, most, sample deviation, cells below zero and not."""
    x = F.col(value)
    return cells.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.stddev_samp(x).alias("std"),
        F.count_if(x < 0).alias("below"), F.count_if(x >= 0).alias("exceptions"),
    )


def task_table(cells: DataFrame) -> DataFrame:
    """One row a task: its domain, number of models and means. cells: model, task, domain, drho_pct, dkeff, rho_sc,
    rho_pt, diversity; a row a cell that counts."""
    means = [F.avg(c).alias(f"mean_{n}") for c, n in (("drho_pct", "drho"), ("dkeff", "dkeff"), ("rho_sc", "rho_sc"), ("rho_pt", "rho_pt"), ("diversity", "diversity"))]
    return cells.groupBy("task").agg(F.max("domain").alias("domain"), F.count("*").alias("n_models"), *means)


def domain_table(cells: DataFrame) -> DataFrame:
    """One row a domain: cells, mean, least and most change of rho, mean majority of both arms in percent, mean and
    sample deviation of their difference in points. cells: domain, drho_pct, mv_sc, mv_pt."""
    x, points = F.col("drho_pct"), 100 * (F.col("mv_pt") - F.col("mv_sc"))
    return cells.groupBy("domain").agg(
        F.count("*").alias("n_cells"), F.avg(x).alias("mean_drho"), F.min(x).alias("least_drho"), F.max(x).alias("most_drho"),
        (100 * F.avg("mv_sc")).alias("mv_sc"), (100 * F.avg("mv_pt")).alias("mv_pt"), F.avg(points).alias("mean_gain"), F.stddev_samp(points).alias("std_gain"),
    )


def exceptions(cells: DataFrame, value: str, accuracy: DataFrame) -> DataFrame:
    """Cells whose value isn't below zero, with the accuracy of both arms. accuracy: model, task, arm, p_bar."""
    p = lambda a: F.max(F.when(F.col("arm") == a, F.col("p_bar"))).alias(f"p_{a.lower()}")
    both = accuracy.groupBy("model", "task").agg(p("SC"), p("PT"))
    return cells.where(F.col(value) >= 0).select("model", "task", value).join(both, ["model", "task"])
