"""Synthetic wide cohort derived from the TPC-H-like tables, by fixed rules.

One wide text row per customer, shaped like the raw study file, so every
operator downstream runs on data whose volume grows with the input tables:

* subject = customer; demographics follow deterministic rules on the key;
* admissions = all of the customer's orders, ranked by (order date, order
  key). The file holds nine admission slots per row; a customer with more
  continues on further rows, which repeat the subject's own cells (sex, birth,
  diabetes, hypertension, death) and leave the period cells empty, so that a
  presence row still occurs once per subject and period.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortflow.spec import CAUSE_VOCABULARY, SLOT_MEASURES, wide_columns

VA_CODES = ("Autologous AV Fistula", "AV Graft", "Tunneled catheter", "Loop graft")
UNLISTED_CAUSE = "Unlisted cause"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dmy(d: Column) -> Column:
    return F.date_format(d, "d/M/yyyy")


def _dmy_dash(d: Column) -> Column:
    return F.date_format(d, "dd-MM-yyyy")


def _decimal_comma(x: Column, key: Column) -> Column:
    """Text of a number; odd keys carry a ``,0`` decimal part."""
    s = x.cast("long").cast("string")
    return F.when(key % 2 == 1, F.concat(s, F.lit(",0"))).otherwise(s)


def admission_slots(spark: SparkSession, sf_dir: str, n_slots: int = 9) -> DataFrame:
    """Every order of a customer in slot columns, ``n_slots`` to a file row (``file_row`` from 0)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    place = F.row_number().over(w) - 1
    ranked = (o.withColumn("place", place).withColumn("slot", F.col("place") % n_slots + 1)
              .withColumn("file_row", F.floor(F.col("place") / n_slots)))

    start = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 97 != 0, F.date_add(start, (F.col("o_orderkey") % 15).cast("int")))
    readm = (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
             .when(F.col("o_orderpriority") == "1-URGENT", F.lit("Yes")).otherwise(F.lit("No")))
    codes = F.array(*[F.lit(v[0]) for v in CAUSE_VOCABULARY] + [F.lit(UNLISTED_CAUSE)])
    code_no = (F.col("o_orderkey") % 40).cast("int")
    cause = F.when(code_no < len(CAUSE_VOCABULARY) + 1, F.get(codes, code_no))
    slots = ranked.select(
        "o_custkey", "file_row", "slot",
        _dmy(start).alias("hosp_start"), _dmy_dash(end).alias("hosp_end"),
        readm.alias("hosp_re"), cause.alias("hosp_cause"))
    # One row per (customer, file row, slot): a conditional max per slot is the pivot.
    aggs = [F.max(F.when(F.col("slot") == k, F.col(m))).alias(f"{m}_{k}")
            for k in range(1, n_slots + 1) for m in SLOT_MEASURES]
    return slots.groupBy("o_custkey", "file_row").agg(*aggs)


def cohort_wide_text(spark: SparkSession, sf_dir: str, n_slots: int = 9) -> DataFrame:
    """The wide raw-text cohort: 22 scalar columns + ``n_slots`` x 4 slot columns."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    birth = F.date_add(F.lit(dt.date(1920, 1, 1)), ((k * 7919) % 25000).cast("int"))
    dtype = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Type 1"))
             .when(F.col("c_mktsegment") == "MACHINERY", F.lit("Type 2"))
             .when(F.col("c_mktsegment") == "FURNITURE", F.lit("Other")))
    va = F.when(k % 31 != 0, F.get(F.array(*[F.lit(v) for v in VA_CODES]), (k % 4).cast("int")))
    charlson1 = (k * 13) % 12
    charlson2 = charlson1 + k % 3
    karnofsky = F.lit(10) * ((k * 17) % 9 + 2)
    status = F.get(F.array(F.lit("active"), F.lit("transferred"), F.lit("inactive")), (k % 3).cast("int"))
    dead = k % 13 == 0
    scalar = {
        "id": k.cast("string"),
        "status_date_p1": _dmy(F.date_add(F.lit(dt.date(1996, 1, 1)), (k % 300).cast("int"))),
        "clinic_p1": F.when(k % 7 == 0, F.lit("NA")).otherwise(F.col("n_name")),
        "status_p1": status,
        "substatus_p1": F.col("c_mktsegment"),
        "status_date_p2": _dmy(F.date_add(F.lit(dt.date(1997, 1, 1)), (k % 300).cast("int"))),
        "clinic_p2": F.when(k % 11 != 0, F.col("n_name")),
        "status_p2": status,
        "substatus_p2": F.col("c_mktsegment"),
        "birth_date": _dmy(birth),
        "gender": F.when(k % 50 == 0, F.lit(None).cast("string"))
                   .when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")),
        "charlson_p1": _decimal_comma(charlson1, k),
        "charlson_p2": _decimal_comma(charlson2, k),
        "karnofsky_p1": karnofsky.cast("string"),
        "karnofsky_p2": karnofsky.cast("string"),
        "diabetes_type": dtype,
        "diabetes_date": F.when(dtype.isNotNull(), _dmy(F.date_add(birth, 15000))),
        "va_p1": va,
        "va_p2": va,
        "htn": F.when(F.col("c_acctbal") < -900, F.lit(None).cast("string"))
                .when(F.col("c_acctbal") >= 3000, F.lit("Y")).otherwise(F.lit("N")),
        "death_date": F.when(dead, _dmy(F.date_add(F.lit(dt.date(1998, 6, 1)), (k % 100).cast("int")))),
        "death_cause": F.when(dead, F.when(k % 2 == 0, F.lit("cardiac")).otherwise(F.lit("infection"))),
    }
    base = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
    slots = admission_slots(spark, sf_dir, n_slots)
    joined = base.join(slots, base.c_custkey == slots.o_custkey, "left")
    lead = F.coalesce(F.col("file_row"), F.lit(0)) == 0
    scalar = {c: F.when(lead, e) if c.endswith(("_p1", "_p2")) else e for c, e in scalar.items()}
    cols = [scalar[c].cast("string").alias(c) if c in scalar else F.col(c) for c in wide_columns(n_slots)]
    return joined.select(*cols)
