"""Views that the queries run on, built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.sources.tables import spread, table

CASES_SQL = """
select o_orderkey as source_row_id, 'PMC' || o_orderkey as PMCID, o_custkey as PMID, o_orderkey % 3 + 1 as case_no,
  case o_orderkey % 3 when 0 then 'Lassa fever' when 1 then 'Hantavirus infection' else 'Puumala virus infection' end as disease,
  'Case report of a ' || (o_custkey % 95 + 1) || '-year-old ' || case when o_custkey % 2 = 0 then 'woman' else 'man' end || ' from ' || n_name || '. MRN: ' || lpad(o_orderkey::varchar, 8, '0') || '. '
  || case when o_custkey % 2 = 0 then 'She' else 'He' end || ' was admitted on ' || strftime(o_orderdate, '%Y-%m-%d') || ' after ' || (o_orderkey % 12 + 1) || ' days of fever and was also reviewed on '
  || strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') || '. ' || c_name || ' was reportedly stable.' as case_text
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""".strip()


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """One synthetic case per order; nations and customers take part through joins on their keys."""
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.col("o_custkey") % 2 == 0
    disease = F.when(F.col("o_orderkey") % 3 == 0, "Lassa fever").when(F.col("o_orderkey") % 3 == 1, "Hantavirus infection").otherwise("Puumala virus infection")
    text = F.concat(
        F.lit("Case report of a "), (F.col("o_custkey") % 95 + 1).cast("string"), F.lit("-year-old "), F.when(even, "woman").otherwise("man"), F.lit(" from "), F.col("n_name"),
        F.lit(". MRN: "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(". "), F.when(even, "She").otherwise("He"), F.lit(" was admitted on "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" after "), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(" days of fever and was also reviewed on "),
        F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(". "), F.col("c_name"), F.lit(" was reportedly stable."),
    )
    return joined.select(F.col("o_orderkey").alias("source_row_id"), F.concat(F.lit("PMC"), F.col("o_orderkey").cast("string")).alias("PMCID"), F.col("o_custkey").alias("PMID"), (F.col("o_orderkey") % 3 + 1).alias("case_no"), disease.alias("disease"), text.alias("case_text"))


DATE_VALUES_SQL = """
select o_orderkey as row_id, o_orderkey % 11 + 1 as variant_id, case o_orderkey % 14
  when 0 then strftime(o_orderdate, '%Y-%m-%d')
  when 1 then year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
  when 2 then month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
  when 3 then strftime(o_orderdate, '%m/%d/%y')
  when 4 then strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y')
  when 5 then strftime(o_orderdate, '%b %d, %Y')
  when 6 then upper(strftime(o_orderdate, '%B ')) || day(o_orderdate) || strftime(o_orderdate, ' %Y')
  when 7 then strftime(o_orderdate, '%b ') || day(o_orderdate)
  when 8 then strftime(o_orderdate, '%B ') || day(o_orderdate) || 'th'
  when 9 then (day(o_orderdate) % 12) || '-' || (day(o_orderdate) % 12 + month(o_orderdate)) || ' weeks'
  when 10 then 'gestational age ' || (day(o_orderdate) + 10) || ' weeks'
  when 11 then day(o_orderdate) || ' days'
  when 12 then strftime(o_orderdate, '%B ') || day(o_orderdate) || 'th, ' || year(o_orderdate)
  else 'day ' || day(o_orderdate) || ' of ' || year(o_orderdate) end as value
from orders
""".strip()


def date_values(spark: SparkSession, folder: str) -> DataFrame:
    """One date-like value per order, in all styles and kinds."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 14
    text = lambda c: c.cast("string")
    year, month, day = text(F.year(d)), text(F.month(d)), text(F.dayofmonth(d))
    number = F.dayofmonth(d) % 12
    value = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.concat_ws("/", year, month, day))
        .when(k == 2, F.concat_ws("/", month, day, year))
        .when(k == 3, F.date_format(d, "MM/dd/yy"))
        .when(k == 4, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 5, F.date_format(d, "MMM dd, yyyy"))
        .when(k == 6, F.upper(F.date_format(d, "MMMM d yyyy")))
        .when(k == 7, F.date_format(d, "MMM d"))
        .when(k == 8, F.concat(F.date_format(d, "MMMM d"), F.lit("th")))
        .when(k == 9, F.concat(text(number), F.lit("-"), text(number + F.month(d)), F.lit(" weeks")))
        .when(k == 10, F.concat(F.lit("gestational age "), text(F.dayofmonth(d) + 10), F.lit(" weeks")))
        .when(k == 11, F.concat(day, F.lit(" days")))
        .when(k == 12, F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), year))
        .otherwise(F.concat(F.lit("day "), day, F.lit(" of "), year))
    )
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 11 + 1).alias("variant_id"), value.alias("value"))
