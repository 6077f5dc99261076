"""Signups and contact messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted e-mail form and the messages a rejected contact gets.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CONTACT_ERRORS = {
    "name": "Name is required",
    "email": "Email is required",
    "message": "Message is required",
    "format": "Please enter a valid email address",
}
BLANKS = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def valid_signups(signups: DataFrame) -> DataFrame:
    """Trimmed, well-formed addresses only."""
    return signups.withColumn("email", stripped(F.col("email"))).where(F.col("email").rlike(EMAIL_PATTERN))


def first_signups(signups: DataFrame) -> DataFrame:
    """One row per address whatever its case: the earliest one.

    An aggregation rather than a window, so an address repeated without end is reduced
    to one row per task before the exchange.
    """
    others = [c for c in signups.columns if c not in ("ts", "email")]
    order = F.struct("ts", "email", *others)
    firsts = signups.groupBy(F.lower("email").alias("email_lc")).agg(F.min(order).alias("_first"))
    return firsts.select("email_lc", *[F.col(f"_first.{c}").alias(c) for c in ("email", "ts", *others)])


def new_signups(signups: DataFrame, registered: DataFrame) -> DataFrame:
    """Valid first signups whose address is not registered yet."""
    known = registered.select(F.lower("email").alias("email_lc")).distinct()
    return first_signups(valid_signups(signups)).join(known, "email_lc", "left_anti")


def check_contacts(contacts: DataFrame) -> DataFrame:
    """Trim the fields, add an id and `error`: the first rule a message breaks, or null."""
    trimmed = contacts.withColumns({c: stripped(F.col(c)) for c in ("name", "email", "message")})
    error = F.when(F.col("name") == "", CONTACT_ERRORS["name"])
    error = error.when(F.col("email") == "", CONTACT_ERRORS["email"])
    error = error.when(F.col("message") == "", CONTACT_ERRORS["message"])
    address = F.col("email").contains("@") & F.col("email").contains(".")
    error = error.when(~address, CONTACT_ERRORS["format"])
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return trimmed.withColumns({"id": F.concat(F.lit("contact_"), stamp), "error": error})


def accepted_contacts(contacts: DataFrame) -> DataFrame:
    return check_contacts(contacts).where(F.col("error").isNull()).drop("error")


def newest_first(contacts: DataFrame) -> DataFrame:
    """By time, newest first; more columns keep messages of one second from being one key."""
    return contacts.orderBy(F.desc("ts"), "id", "email", "name")
