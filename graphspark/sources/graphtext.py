"""Line-based graph text (N-Triples, N-Quads) as a source and a sink, and CDC patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mapping import IRI, LITERAL, NUMBER

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$'
XSD = "http://www.w3.org/2001/XMLSchema#"


def parse_lines(lines: DataFrame, column: str = "value", graph: str = "default") -> DataFrame:
    """Quads of the lines that are statements; blank and comment lines are skipped, any other
    line raises.  Blank nodes are named after their label."""
    line = F.col(column)
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    rows = rows.withColumn("_ok", F.when(line.rlike(_LINE), True).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), line)).cast("boolean"))).where("_ok")
    part = lambda k: F.regexp_extract(line, _LINE, k)
    bare = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    o = part(3)
    literal = o.startswith('"')
    lex = F.when(literal, F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")).otherwise(bare(o))
    dt = F.nullif(F.replace(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(XSD), F.lit("xsd:")), F.lit(""))
    lang = F.nullif(F.regexp_extract(o, r'"@([A-Za-z-]+)$', 1), F.lit(""))
    dt = F.when(literal & lang.isNull(), F.coalesce(dt, F.lit("xsd:string")))
    key = F.when(~literal, bare(o)).when(lang.isNotNull(), F.concat(F.lit('"'), lex, F.lit('"@'), lang)).otherwise(F.concat(F.lit('"'), lex, F.lit('"^^'), dt))
    return rows.select(
        F.when(part(4) == "", graph).otherwise(bare(part(4))).alias("g"), bare(part(1)).alias("s"), part(2).alias("p"), key.alias("o_key"),
        F.when(literal, LITERAL).otherwise(IRI).cast("tinyint").alias("o_kind"), lex.alias("o_lex"), dt.alias("o_dt"), lang.alias("o_lang"),
        F.when(dt.isin("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float"), lex.try_cast(NUMBER)).cast(NUMBER).alias("o_num"),
        F.when(dt.isin("xsd:date", "xsd:dateTime"), lex.try_cast("timestamp_ntz")).cast("timestamp_ntz").alias("o_ts"),
    )


def read_lines(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    return parse_lines(spark.read.text(path), graph=graph)


def to_lines(quads: DataFrame) -> DataFrame:
    """One statement per quad, in the column value."""
    literal = F.concat(F.lit('"'), F.regexp_replace("o_lex", r'(["\\])', r"\\$1"), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") == "xsd:string", "").otherwise(F.concat(F.lit("^^<"), F.replace("o_dt", F.lit("xsd:"), F.lit(XSD)), F.lit(">"))))
    o = F.when(F.col("o_kind") == LITERAL, literal).otherwise(F.concat(F.lit("<"), "o_lex", F.lit(">")))
    g = F.when(F.col("g") == "default", "").otherwise(F.concat(F.lit(" <"), "g", F.lit(">")))
    return quads.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, g, F.lit(" .")).alias("value"))


def patch(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """A new version: changes (op insert or delete, and the quad's columns) are applied to a
    copy, deletions first; nothing is changed in place."""
    keys = ["g", "s", "p", "o_key"]
    gone = changes.where("op = 'delete'").select(*keys).distinct()
    new = changes.where("op = 'insert'").drop("op")
    return quads.join(gone, keys, "left_anti").unionByName(new).dropDuplicates(keys)


def forms(quads: DataFrame) -> DataFrame:
    """Each subject's quads as a list of triples, as a sentence and as JSON."""
    t = quads.select("s", F.concat_ws(" ", "s", "p", "o_lex").alias("t"), F.struct("p", F.col("o_lex").alias("o")).alias("j"))
    return t.groupBy("s").agg(F.sort_array(F.collect_list("t")).alias("triples"), F.to_json(F.sort_array(F.collect_list("j"))).alias("json")).withColumn("sentence", F.concat(F.array_join("triples", "; "), F.lit(".")))
