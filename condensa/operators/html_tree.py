"""Text of pages with skipped elements nested to any depth, as a plan over a table of page tokens.

Skipped elements open and close with weights of +1 and -1; the depth at a token is the running sum of weights, kept from
falling below 0 by what its running minimum lacks: two window sums, no parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions.fixed import BLOCKS, ENTITIES, SKIPPED
from condensa.functions.text import strip

#: Comments, raw elements with their content, tags, declarations and text; a tag that is never closed takes the rest of the page.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|[^<]+|<"
)
_REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&"


def plain_characters(text: Column) -> Column:
    """Numeric and the common named character references as the characters that they stand for."""
    def character(part: Column) -> Column:
        digits = F.regexp_replace(part, "[&#;]", "")
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    parts = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), lambda p: F.when(p.startswith("&#") & p.endswith(";"), character(p)).otherwise(p))
    out = F.when(text.contains("&#"), F.array_join(parts, "")).otherwise(text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def exact_text(df: DataFrame, *, payload: str = "payload", out: str = "text") -> DataFrame:
    """Adds the text of each page: blocks apart by a blank line, nothing from skipped elements, however they nest.

    A stray end tag of a skipped element changes nothing; one that is never closed hides the rest. Null pages give null, pages without text an
    empty one. Other columns stay; the order of rows doesn't.
    """
    columns = df.columns
    rows = df.select(F.struct(*columns).alias("_rest"), F.regexp_extract_all(F.col(payload), F.lit(TOKEN), F.lit(0)).alias("toks")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_row", "_rest", F.posexplode_outer("toks").alias("pos", "tok"))
    rows = rows.withColumn("_rest", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_rest"))).repartition("_row")
    name = F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][^\s/>]*)", 1))
    raw = name.isin("script", "style") & ~F.col("tok").startswith("</")
    skipped = name.isin(*SKIPPED) & ~raw
    weight = F.when(~skipped | F.col("tok").endswith("/>"), 0).when(F.col("tok").startswith("</"), -1).otherwise(1)
    before = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"name": name, "sum": F.sum(weight).over(before)}).withColumn("least", F.min("sum").over(before))
    depth = F.col("sum") - F.least(F.lit(0), F.col("least"))
    said = (F.length("tok") > 0) & (~F.col("tok").rlike(r"^<[a-zA-Z/!?]"))
    piece = F.when(F.col("name").isin(*BLOCKS), "\n").when(said & (depth == 0), plain_characters(F.col("tok"))).otherwise("")
    whole = rows.groupBy("_row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", piece.alias("piece"))))), lambda x: x["piece"]), " ").alias("said"), F.first("_rest", ignorenulls=True).alias("_rest")
    )
    lines = F.transform(F.split("said", "\n"), lambda s: strip(F.regexp_replace(s, r"(?U)\s+", " ")))
    text = F.when(F.col("_rest")[payload].isNotNull(), F.array_join(F.filter(lines, lambda s: s != ""), "\n\n"))
    return whole.withColumn("_text", text).select("_rest.*", F.col("_text").alias(out))
