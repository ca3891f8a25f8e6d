"""Closed-world shapes: each constraint gives violation rows
(shape, focus, path, value, constraint, severity, message)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths

COLUMNS = ["shape", "focus", "path", "value", "constraint", "severity", "message"]


@dataclass
class Constraint:
    """kind: minCount, maxCount, datatype, class, minExclusive, maxInclusive, pattern, in,
    lessThanOrEquals or required; param is its value."""

    path: str
    kind: str
    param: object
    severity: str = "Violation"
    message: str = ""


@dataclass
class Shape:
    name: str
    target: str
    constraints: list[Constraint]


def instances(quads: DataFrame, target: str) -> DataFrame:
    """focus: individuals of the class or of any class below it.  The closure starts from the
    class, so classes elsewhere in the tree aren't visited."""
    down = quads.where("p = 'subClassOf'").select(F.col("o_key").alias("src"), F.col("s").alias("dst"))
    me = quads.sparkSession.createDataFrame([(target,)], "src string")
    wanted = paths.zero_or_more(down, me).select(F.col("dst").alias("cls"))
    types = quads.where("p = 'type'").select(F.col("s").alias("focus"), F.col("o_key").alias("cls"))
    return types.join(wanted, "cls", "left_semi").select("focus").distinct()


def validate(quads: DataFrame, shapes: list[Shape]) -> DataFrame:
    """All violations of all shapes; an empty result means none was found.  Constraints on the
    values of one path are tested in one pass over them, and so are those on their number."""
    out, members = None, {}

    def of(target: str) -> DataFrame:
        if target not in members:
            members[target] = instances(quads, target)
        return members[target]

    for shape in shapes:
        focus = of(shape.target)
        parts: list[DataFrame] = []
        for path in dict.fromkeys(c.path for c in shape.constraints):
            mine = [c for c in shape.constraints if c.path == path]
            by_value, by_number = [c for c in mine if c.kind in VALUE], [c for c in mine if c.kind in ("minCount", "maxCount")]
            values = values_of(quads, focus, path)
            if by_value:
                parts.append(told(values.withColumn("value", F.col("o_lex")), [(c, VALUE[c.kind](c.param)) for c in by_value]))
            if by_number:
                counts = values.groupBy("focus").agg(F.count_distinct("o_key").alias("n"))
                n = F.coalesce("n", F.lit(0))
                parts.append(told(focus.join(counts, "focus", "left").withColumn("value", n), [(c, F.col("value") < c.param if c.kind == "minCount" else F.col("value") > c.param) for c in by_number]))
            parts += [told(check(quads, focus, values, c, of), [(c, F.lit(True))]) for c in mine if c not in by_value and c not in by_number]
        for rows in parts:
            rows = rows.select(F.lit(shape.name).alias("shape"), *COLUMNS[1:])
            out = rows if out is None else out.unionByName(rows)
    return out


def values_of(quads: DataFrame, focus: DataFrame, path: str) -> DataFrame:
    return quads.where(F.col("p") == path).select(F.col("s").alias("focus"), "o_key", "o_lex", "o_kind", "o_dt", "o_num", "o_ts").join(focus, "focus", "left_semi")


def told(rows: DataFrame, tests: list[tuple[Constraint, Column]]) -> DataFrame:
    """A violation for every row (focus, value) and constraint whose test is true."""
    tell = lambda c: F.struct(F.lit(c.path).alias("path"), F.lit(c.kind).alias("constraint"), F.lit(c.severity).alias("severity"), F.lit(c.message).alias("message"))
    broken = F.filter(F.array(*(F.when(test, tell(c)) for c, test in tests)), lambda x: x.isNotNull())
    return rows.select("focus", F.col("value").cast("string").alias("value"), F.inline(broken))


#: What breaks a constraint on single values, by kind.
VALUE: dict[str, Callable[[object], Column]] = {
    "datatype": lambda x: ~((F.col("o_kind") == 1) & (F.coalesce("o_dt", F.lit("")) == x)),
    "minExclusive": lambda x: ~F.coalesce(F.col("o_num") > x, F.lit(False)),
    "maxInclusive": lambda x: ~F.coalesce(F.col("o_num") <= x, F.lit(False)),
    "pattern": lambda x: ~F.col("o_lex").rlike(str(x)),
    "in": lambda x: ~F.col("o_lex").isin(list(x)),
}


def check(quads: DataFrame, focus: DataFrame, values: DataFrame, c: Constraint, of: Callable[[str], DataFrame]) -> DataFrame:
    """focus and value of the rows that break a constraint that looks at other nodes too."""
    if c.kind == "class":
        return values.join(of(str(c.param)).withColumnRenamed("focus", "o_key"), "o_key", "left_anti").select("focus", F.col("o_lex").alias("value"))
    if c.kind == "lessThanOrEquals":
        other = quads.where(F.col("p") == c.param).select(F.col("s").alias("focus"), F.col("o_num").alias("n2"), F.col("o_ts").alias("t2"))
        both = values.join(other, "focus")
        return both.where(~F.coalesce(F.col("o_num") <= F.col("n2"), F.col("o_ts") <= F.col("t2"), F.lit(False))).select("focus", F.col("o_lex").alias("value"))
    if c.kind == "required":  # several slots, each of which must be filled
        slots = focus.withColumn("slot", F.explode(F.array(*map(F.lit, c.param))))
        filled = quads.where(F.col("p").isin(list(c.param))).select(F.col("s").alias("focus"), F.col("p").alias("slot")).distinct()
        return slots.join(filled, ["focus", "slot"], "left_anti").select("focus", F.col("slot").alias("value"))
    raise ValueError(f"constraint {c.kind} is not supported")


def route(violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Focus nodes to quarantine (a violation), and tickets (warnings)."""
    return violations.where("severity = 'Violation'").select("focus").distinct(), violations.where("severity = 'Warning'")
