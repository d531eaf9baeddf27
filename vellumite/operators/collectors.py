"""Collectors over the ordered lines of texts: windows over one text's lines, after which every line knows whether it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: The heading of a dossier of a target, its attributes, and the word of an entry that ends it.
DOSSIER, ATTRIBUTES, ENDS_AT = "目标档案", "年龄|职业|外貌特征|军衔|直系亲属|注记|犯罪记录|其他关系", "岛屿"
#: Fixed value: white space at the ends of lines and cells, as Python's str.strip takes it.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS)


def _line() -> Column:
    return F.btrim(T.some(F.col("line")), F.lit(BLANKS))


def _inner(line: Column) -> Column:
    """What stands between the outer bars of a line (trimmed), behind marks of quotes."""
    return F.btrim(F.regexp_replace(line, f"^>[>{_BLANK}]*", ""), F.lit("|"))


def is_row(line: Column) -> Column:
    """Two cells or more, one of them not blank."""
    s = _inner(line)
    return s.contains("|") & s.rlike(f"[^|{_BLANK}]")


def is_rule(line: Column) -> Column:
    """Cells of three dashes and more, with colons at their ends, and no others."""
    cells = F.split(_inner(line), "\\|", -1)
    return line.contains("|") & line.contains("---") & F.forall(cells, lambda c: c.rlike(f"^[{_BLANK}]*:?-{{3,}}:?[{_BLANK}]*\\z"))


def _ordered(lines: DataFrame) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """id, line_no and line (trimmed), and a text's lines in order and up to each of them."""
    down = W.partitionBy("id").orderBy("line_no")
    df = lines.select("id", F.col("line_no").cast("bigint").alias("line_no"), _line().alias("line"))
    return df, down, down.rowsBetween(W.unboundedPreceding, W.currentRow)


def strict_tables(lines: DataFrame) -> DataFrame:
    """id, table, line_no, line: the lines (id, line_no, line) of strict tables, numbered from 1 in each text.

    A table is a row with a rule of dashes below it and all rows up to the first line that is none. A rule with one cell
    is no row. It opens a table behind rows that are in none, so of such rules with rows alone between them, every second
    one ends a table: whether a line opens one follows from its place among them.
    """
    df, down, so_far = _ordered(lines)
    df = df.withColumn("row", is_row(F.col("line"))).withColumn("rule", is_rule(F.col("line"))).withColumn("at", F.row_number().over(down))
    df = df.withColumn("after_row", F.coalesce(F.lag("row").over(down), F.lit(False)))
    df = df.withColumn("second", F.col("row") & F.col("rule") & F.col("after_row"))  # opens, unless its rows are in a table already
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("at"))).over(so_far), F.lit(0))
    df = df.withColumn("seen", last(F.col("second"))).withColumn("ended", last(~F.col("row")))
    df = df.withColumn("within", F.col("seen") > F.coalesce(F.lag("ended").over(down), F.lit(0)))  # such a rule in the rows up to here, or in those before a line that is none
    df = df.withColumn("may", ~F.col("row") & F.col("rule") & F.col("after_row") & ~F.col("within"))
    df = df.withColumn("others", F.sum((~F.col("row")).cast("int")).over(so_far))
    df = df.withColumn("place", F.col("others") - F.coalesce(F.max(F.when(~F.col("row") & ~F.col("may"), F.col("others"))).over(so_far), F.lit(0)))
    df = df.withColumn("begun", F.last(F.when(~F.col("row"), F.col("may") & (F.col("place") % 2 == 1)), ignorenulls=True).over(so_far))
    df = df.withColumn("open", F.coalesce("begun", F.lit(False)) | (F.col("row") & F.col("within")))
    df = df.withColumn("opens", F.col("open") & F.col("rule") & ((~F.col("row")) | ~F.coalesce(F.lag("open").over(down), F.lit(False))))
    df = df.withColumn("head", F.coalesce(F.lead("opens").over(down), F.lit(False)))
    df = df.withColumn("table", F.sum(F.col("opens").cast("int")).over(so_far) + F.when(F.col("head"), 1).otherwise(0))
    return df.where(F.col("open") | F.col("head")).select("id", F.col("table").cast("int").alias("table"), "line_no", "line")


def dossiers(lines: DataFrame) -> DataFrame:
    """id, dossier, line_no, line of dossiers. A line with its heading opens one; entries and attributes go on, blank lines are passed over, anything else ends it."""
    df, _, so_far = _ordered(lines)
    line = F.col("line")
    named = line.rlike("^\\*\\*[^*]+\\*\\*[。.:：]")
    entry = (named & ~line.contains(ENDS_AT)) | (~named & line.rlike(f"^(?:{ATTRIBUTES})[：:]"))
    head = F.regexp_replace(line, f"^#{{1,6}}[{_BLANK}]*", "") == DOSSIER
    goes_on = (line == "") | (entry & ~line.rlike(f"^#{{1,6}}[{_BLANK}]"))  # none of these is a heading of a dossier
    df = df.withColumn("head", head).withColumn("goes_on", goes_on)
    df = df.withColumn("open", F.last(F.when(~F.col("goes_on"), F.col("head")), ignorenulls=True).over(so_far)).withColumn("dossier", F.sum(F.col("head").cast("int")).over(so_far))
    return df.where(F.col("open") & (line != "")).select("id", F.col("dossier").cast("int").alias("dossier"), "line_no", F.when(F.col("head"), DOSSIER).otherwise(line).alias("line"))
