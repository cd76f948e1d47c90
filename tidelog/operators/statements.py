"""Answers to statements that ask for variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import select_items, statement_kind

#: The variables there are, and the error numbers of an unknown one and of anything else.
SYSTEM_VARIABLES = ("server_id", "server_uuid", "gtid_mode", "gtid_executed", "gtid_purged", "binlog_checksum", "version", "version_comment")
UNKNOWN_VARIABLE, UNSUPPORTED = 1193, 1235
#: Characters of a value that goes with every statement.
LONG_VALUE = 256
#: Bytes of a column's different values that a Parquet writer keeps by default before it writes out every copy; of these one for
#: each statement, as a time with its length, and some for uneven parts. Statements that a part holds at least.
DICTIONARY_BYTES, ANSWER_BYTES, SPARE_BYTES, LEAST_STATEMENTS = 1 << 20, 16, 4096, 256

NAME = "[A-Za-z0-9_$]+"


def checksum_variable(algorithm: Column) -> Column:
    """K6: the name of a log's checksum as a variable: NONE for OFF, CRC32 if nothing is known."""
    return F.when(algorithm == "OFF", "NONE").when(F.coalesce(algorithm, F.lit("")) == "", "CRC32").otherwise(algorithm)


def answer_parts(asking: int, long_bytes: int) -> int:
    """Parts to deal statements into by a key, so that a Parquet file of their answers holds the long values once.

    A file repeats a value by number while its column's different values are below DICTIONARY_BYTES; past that each of the `asking`
    statements brings the whole long_bytes. 0 if the long values leave no room for LEAST_STATEMENTS: then only a writer
    with a parquet.dictionary.page.size above them holds them once.
    """
    most = (DICTIONARY_BYTES - long_bytes - SPARE_BYTES) // ANSWER_BYTES
    return -(-asking // most) if most >= LEAST_STATEMENTS else 0


def select_answers(statements: DataFrame, variables: DataFrame, now: Column) -> DataFrame:
    """K2, K3: statements (sql, session: a map of user variables by lower-case name) with `names`, `values` and `error`.

    A list may ask for UNIX_TIMESTAMP(), VERSION(), @@[global. | session. | local.]variable and @user_variable, null if it isn't
    set. The first item that can't be answered makes the error, 1193 for an unknown variable and 1235 for all else,
    and leaves names and values null. variables (name, value), at most SYSTEM_VARIABLES, go to every task as one map; values
    above LONG_VALUE characters only meet the statements that ask for one, as each of those gets the whole of it anyway.
    """
    right, long = F.col("name").isin(*SYSTEM_VARIABLES), F.coalesce(F.length("value"), F.lit(0)) > LONG_VALUE
    entries = lambda value: F.map_from_entries(F.collect_list(F.struct("name", value.alias("value"))))
    known = variables.where(right).agg(entries(F.when(~long, F.col("value"))).alias("_known"), F.collect_set(F.when(long, F.col("name"))).alias("_long_names"))
    longs = variables.where(right & long).agg(entries(F.col("value")).alias("_longs")).select(F.lit(True).alias("_asks_long"), "_longs")
    system = rf"^@@\s*(?:(?i:global|session|local)\s*\.\s*)?({NAME}(?:\s*\.\s*{NAME})?)\s*$"

    def answer(item: Column) -> Column:
        name = F.when(F.upper(item) == "VERSION()", "version").when(item.rlike(system), F.lower(F.regexp_extract(item, system, 1)))
        value = F.when(F.upper(item) == "UNIX_TIMESTAMP()", now.cast("string")).when(name.isNotNull(), F.try_element_at("_known", name))
        value = value.when(item.rlike(rf"^@{NAME}$"), F.try_element_at("session", F.lower(F.substring(item, 2, 1 << 20))))
        right = F.upper(item).isin("UNIX_TIMESTAMP()", "VERSION()") | item.rlike(rf"^@{NAME}$")
        error = F.when(right, None).when(item.rlike(system), F.when(~F.array_contains(F.map_keys("_known"), name), UNKNOWN_VARIABLE)).otherwise(UNSUPPORTED)
        return F.struct(item.alias("name"), value.alias("value"), error.cast("int").alias("error"), F.when(F.array_contains("_long_names", name), name).alias("long"))

    text = F.regexp_replace("sql", r"[\s;]+$", "")
    items = F.when(statement_kind(text) == "select", F.transform(select_items(text), answer))
    asked = statements.join(F.broadcast(known), how="cross").withColumn("_items", items).drop("_known", "_long_names")
    error = F.when(F.col("_items").isNull(), UNSUPPORTED).otherwise(F.get(F.filter("_items", lambda x: x["error"].isNotNull()), F.lit(0))["error"])
    out = asked.withColumn("error", error.cast("int"))
    right = F.col("error").isNull()
    out = out.withColumn("_asks_long", right & F.exists("_items", lambda x: x["long"].isNotNull())).join(F.broadcast(longs), "_asks_long", "left")
    values = F.when(F.col("_asks_long"), F.transform("_items", lambda x: F.when(x["long"].isNotNull(), F.try_element_at("_longs", x["long"])).otherwise(x["value"]))).otherwise(F.col("_items.value"))
    return out.withColumns({"names": F.when(right, F.col("_items.name")), "values": F.when(right, values)}).drop("_items", "_asks_long", "_longs")
