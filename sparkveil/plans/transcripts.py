"""Transcripts made from the star-schema tables, for operators whose input is speech.

Each builder returns a DataFrame and has a SQL twin with the same rows, so a query over it can be
compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.session import spread, table

#: A mobile number from a customer key, in Spark and in DuckDB.
PHONE = "lpad(cast(6000000000 + (c_custkey * 7919) % 3999999999 as varchar(10)), 10, '0')"
OTHER = "lpad(cast(6000000000 + (c_custkey * 104729) % 3999999999 as varchar(10)), 10, '0')"

#: What a call says, by key modulo 8, and what must be found in it: (type, value) or nothing.
UTTERANCES = [
    (f"concat('My phone number is ', {PHONE}, '.')", "PHONE", PHONE),
    (f"concat('The order number is ', {PHONE}, '.')", None, None),
    (f"concat('For example the phone number ', {PHONE}, ' is a sample.')", None, None),
    (f"concat('My phone number is ', {PHONE}, ' uh ', {OTHER}, '.')", "PHONE", OTHER),
    ("concat('My account number is ', cast(300000000000 + c_custkey as varchar(12)), '.')", "ACCOUNT_NUMBER", "cast(300000000000 + c_custkey as varchar(12))"),
    ("concat('The OTP is ', cast(100000 + c_custkey % 900000 as varchar(6)), '.')", "OTP", "cast(100000 + c_custkey % 900000 as varchar(6))"),
    ("concat('Please tell me your CVV. Mine is ', cast(100 + c_custkey % 900 as varchar(3)), '.')", "CVV", "cast(100 + c_custkey % 900 as varchar(3))"),
    ("concat('My CVV was asked. There were ', cast(100 + c_custkey % 900 as varchar(3)), ' transactions.')", None, None),
]

UTTERANCE_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {text}" for i, (text, _, _) in enumerate(UTTERANCES)) + " END"
TYPE_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(UTTERANCES) if kind) + " END"
VALUE_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {value}" for i, (_, kind, value) in enumerate(UTTERANCES) if kind) + " END"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_id, text``, one sentence for each customer."""
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("call_id"), F.expr(UTTERANCE_SQL).alias("text"))


#: A collection call about an order, by key modulo 5.
COLLECTION_SQL = """CASE o_orderkey % 5
 WHEN 0 THEN concat('The EMI of Rs ', cast(1000 + o_orderkey % 5000 as varchar(10)), ' is overdue and the rate is ', cast(5 + o_orderkey % 20 as varchar(10)), '% APR.')
 WHEN 1 THEN concat('I will pay Rs ', cast(500 + o_orderkey % 700 as varchar(10)), ' tomorrow by upi.')
 WHEN 2 THEN 'I cannot pay, I lost my job. I refuse to pay.'
 WHEN 3 THEN concat('This call is being recorded. Your loan tenure is ', cast(6 + o_orderkey % 30 as varchar(10)), ' months.')
 ELSE 'You will be arrested. We will shame you, idiot.' END"""


def collection_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_id, call_date, text``, one call for each order."""
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("call_id"), F.to_date("o_orderdate").alias("call_date"), F.expr(COLLECTION_SQL).alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments of 5 seconds with plain spaces."""
    text = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_id"), (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 4.0).alias("end"), text.alias("text"), F.col("role").alias("speaker"))


SEGMENTS_SQL = r"""SELECT conv_id AS call_id, turn AS seg_id, turn * 5.0::DOUBLE AS start, turn * 5.0::DOUBLE + 4.0 AS stop,
  trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS text, role AS speaker FROM conversations"""


def words(segs: DataFrame) -> DataFrame:
    """The words of segments, each 0.25 seconds after the one before."""
    rows = segs.select("call_id", "seg_id", "start", F.posexplode(F.split("text", " ")).alias("word_idx", "word")).where("word != ''")
    begin = F.col("start") + F.col("word_idx") * 0.25
    return rows.select("call_id", "seg_id", "word_idx", "word", begin.alias("start"), (begin + 0.2).alias("end"), (0.5 + (F.col("word_idx") % 5) * 0.1).alias("confidence"))
