"""Policy: what a token may do, its limits, and where and from where it may ask; small dimension tables and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import addresses

# Fixed values of the service's tiers: connections, messages a second, square degrees (0 unlimited), vessels followed.
TIERS = {"anonymous": (2, 20, 100.0, 10), "personal": (2, 50, 400.0, 50), "feeder": (5, 200, 0.0, 200)}
EARNED_EVENTS = 1000
ACTIONS = {"admin": ("publish", "subscribe"), "feeder": ("publish",), "peer": ("publish", "subscribe"), "personal": ("publish", "subscribe"), "partner": ("subscribe",), "anonymous": ("subscribe",)}
RAW_ROLES = ("feeder", "peer", "partner", "admin")
SUBJECT = r"^[A-Za-z0-9_.:=/+-]{1,128}$"


def actions(spark: SparkSession) -> DataFrame:
    """(role, action), one row for each action that a role allows."""
    return spark.createDataFrame([(r, a) for r, own in ACTIONS.items() for a in own], "role string, action string")


def may(asked: DataFrame) -> DataFrame:
    """``asked`` (role, action, ...) with ``allowed``."""
    known = actions(asked.sparkSession).withColumn("allowed", F.lit(True))
    return asked.join(F.broadcast(known), ["role", "action"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def may_raw(role: Column, earned: Column) -> Column:
    return role.isin(*RAW_ROLES) | F.coalesce(earned, F.lit(False))


def limits(claims: DataFrame) -> DataFrame:
    """``claims`` (role, contributed, ...) with earned, conns, rate, area and mmsis of their tier; one that contributes enough has a feeder's."""
    tiers = claims.sparkSession.createDataFrame([(t, *v) for t, v in TIERS.items()], "tier string, conns int, rate int, area double, mmsis int")
    earned = (F.col("role") == "personal") & (F.col("contributed") >= EARNED_EVENTS)
    judged = claims.withColumns({"earned": earned, "tier": F.when(earned, "feeder").otherwise(F.col("role"))})
    return judged.join(F.broadcast(tiers), "tier", "left")


def allows_mmsis(most: Column, n: Column) -> Column:
    return (most <= 0) | (n <= most)


def allows_area(most: Column, boxes: Column, total: Column) -> Column:
    """0 is unlimited, less than 0 allows no boxes at all."""
    return F.when(most == 0, True).when(most < 0, boxes == 0).otherwise(total <= most)


def expired(exp: Column, now: Column) -> Column:
    return (exp != 0) & (now > exp)


def valid_tokens(tokens: DataFrame, keys: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    """Tokens (sub, kid, exp) of a known key, with a subject of the allowed form, not expired and not revoked."""
    fine = tokens.where(F.col("sub").rlike(SUBJECT) & ~expired(F.col("exp"), F.lit(now)))
    return fine.join(keys.select("kid"), "kid").join(revoked.select("sub"), "sub", "left_anti")


def allowed_address(cidrs: Column, ip: Column) -> Column:
    """No blocks allow every address; for many blocks, or as a table, see ``addresses.longest_match``."""
    return (F.size(cidrs) <= 0) | F.exists(cidrs, lambda c: addresses.in_block(ip, c))
