"""Data operations of the account tables: domains, single-use tokens, users, entities.

Rewrites return the table's new contents; with one writer a token is used once at most.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import merge

TOKEN_LIFE = timedelta(minutes=15)
#: A token that lives longer than this was asked for a moment ago.
RECENT_LIFE = timedelta(minutes=13)


def domain_allowed(emails: DataFrame, domains: DataFrame) -> DataFrame:
    """emails with `allowed`: whether the domain is listed under any entity."""
    listed = domains.select(F.col("domain").alias("_d")).distinct()
    return emails.join(listed, N.email_domain(F.col("email")) == F.col("_d"), "left").withColumn("allowed", F.col("_d").isNotNull()).drop("_d")


def is_allowed(domains: DataFrame, email: str) -> bool:
    pieces = email.lower().split("@")
    return len(pieces) > 1 and bool(pieces[1]) and not domains.where(F.col("domain") == pieces[1]).limit(1).isEmpty()


def live(now) -> Column:
    return (F.col("expires_at") > F.lit(now)) & F.col("used_at").isNull()


def live_tokens(tokens: DataFrame, now) -> DataFrame:
    return tokens.where(live(now))


def recent_tokens(tokens: DataFrame, now: datetime) -> DataFrame:
    """(email, recent): unused tokens of each address that were asked for a moment ago."""
    return tokens.where((F.col("expires_at") > F.lit(now + RECENT_LIFE)) & F.col("used_at").isNull()).groupBy("email").agg(F.count("*").alias("recent"))


def recent_token_exists(tokens: DataFrame, email: str, now: datetime) -> bool:
    return not tokens.where((F.col("email") == email.lower()) & (F.col("expires_at") > F.lit(now + RECENT_LIFE)) & F.col("used_at").isNull()).limit(1).isEmpty()


def add_token(tokens: DataFrame, token: str, email: str, now: datetime) -> DataFrame:
    row = tokens.sparkSession.createDataFrame([(token, email.lower(), now + TOKEN_LIFE, None)], "token string, email string, expires_at timestamp, used_at timestamp")
    return merge.insert_new(tokens, row, "token")


def consume(tokens: DataFrame, wanted: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The table with the wanted live tokens marked as used, and the (token, email) that were live."""
    asked = wanted.select(F.col("token").alias("_t")).distinct()
    both = tokens.join(asked, F.col("token") == F.col("_t"), "left")
    hit = F.col("_t").isNotNull() & live(now)
    used = both.withColumn("used_at", F.when(hit, F.lit(now)).otherwise(F.col("used_at"))).drop("_t")
    return used, both.where(hit).select("token", "email")


def token_entities(tokens: DataFrame, users: DataFrame, now) -> DataFrame:
    """(token, email, entity) of live tokens; the entity is null where the user has none or isn't there."""
    known = users.select(F.lower("email").alias("_e"), F.nullif(F.col("entity"), F.lit("")).alias("entity"))
    return live_tokens(tokens, now).select("token", "email").join(known, F.lower("email") == F.col("_e"), "left").select("token", "email", "entity")


def record_logins(users: DataFrame, emails: DataFrame, now) -> DataFrame:
    """Users after logins: known ones get last_login_at, new ones a row of their own."""
    asked = emails.select(F.lower("email").alias("_e")).distinct()
    both = users.join(asked, F.col("email") == F.col("_e"), "full_outer")
    now = F.lit(now)
    came, had = F.col("_e").isNotNull(), F.col("email").isNotNull()
    value = {
        "id": F.coalesce(F.col("id"), F.uuid()),
        "email": F.coalesce("email", "_e"),
        "created_at": F.when(had, F.col("created_at") if "created_at" in users.columns else now).otherwise(now),
        "updated_at": F.when(had, F.col("updated_at") if "updated_at" in users.columns else now).otherwise(now),
        "last_login_at": F.when(came, now).otherwise(F.col("last_login_at") if "last_login_at" in users.columns else F.lit(None)),
    }
    return both.select(*[value.get(c, F.col(c)).cast(t).alias(c) for c, t in users.dtypes])


def user_by_id(users: DataFrame, user_id) -> DataFrame:
    return users.where(F.col("id") == F.lit(user_id)).select("id", "email", "entity").limit(1)


def update_entity(users: DataFrame, user_id, entity: str) -> DataFrame:
    entity = entity.strip()
    if not entity:
        raise ValueError("an entity is needed")
    return users.withColumn("entity", F.when(F.col("id") == F.lit(user_id), entity).otherwise(F.col("entity")))


def entities_sorted(entities: DataFrame) -> DataFrame:
    return entities.select("entity", F.nullif(F.col("entity_long"), F.lit("")).alias("entity_long")).orderBy("entity")


def entity_filter(entities: DataFrame, q: str) -> DataFrame:
    """Entities whose short or long name contains the text, whatever its case; % and _ are plain characters."""
    q = q.lower()
    return entities.where(F.contains(F.lower("entity"), F.lit(q)) | F.coalesce(F.contains(F.lower("entity_long"), F.lit(q)), F.lit(False)))


def offers_custom(entities: DataFrame, q: str) -> DataFrame:
    """One row, `offered`: whether the text is no entity's name, so that it may be added."""
    q = q.strip().lower()
    return entities.agg(((F.count_if(F.lower("entity") == q) == 0) & F.lit(bool(q))).alias("offered"))


@dataclass(frozen=True)
class Result:
    """What an account action gives: data if it succeeded, else the reason."""

    success: bool
    data: dict | None = None
    error: str | None = None


class Actions:
    """The account actions as compositions of the operations above, each on the versioned tables it needs.

    Mail and sessions are the caller's: a requested token is returned, and so is a verified user's id.
    """

    def __init__(self, users: merge.VersionedTable, tokens: merge.VersionedTable, domains: merge.VersionedTable):
        self.users, self.tokens, self.domains = users, tokens, domains

    def request_link(self, email: str | None, now: datetime) -> Result:
        """A new token for an allowed address (trimmed) that has none from a moment ago."""
        email = email.strip() if isinstance(email, str) else ""
        if not email:
            return Result(False, error="an address is needed")
        if not is_allowed(self.domains.read(), email):
            return Result(False, error="the address's domain isn't allowed")
        if recent_token_exists(self.tokens.read(), email, now):
            return Result(False, error="a link was sent a moment ago")
        token = secrets.token_hex(32)
        row = self.tokens.spark.createDataFrame([(token, email.lower(), now + TOKEN_LIFE, None)], self.tokens.schema)
        self.tokens.merge(row, lambda old, new: merge.insert_new(old, new, "token"))
        return Result(True, {"email": email, "token": token})

    def check_entity(self, token: str | None, now: datetime) -> Result:
        """A live token's address, and the entity of its user if there is one."""
        if not token or not isinstance(token, str):
            return Result(False, error="a token is needed")
        found = token_entities(self.tokens.lookup(token), self.users.read(), now).head()
        if found is None:
            return Result(False, error="the token is unknown, used or too old")
        return Result(True, {"email": found.email, "hasEntity": found.entity is not None, "entity": found.entity})

    def verify(self, token: str | None, now: datetime, entity: str | None = None) -> Result:
        """Uses a live token, records its user's login and, if given, the entity; gives the user's id."""
        if not token or not isinstance(token, str):
            return Result(False, error="a token is needed")
        wanted = self.tokens.spark.createDataFrame([(token,)], "token string")
        found = live_tokens(self.tokens.lookup(token), now).head()
        if found is None:
            return Result(False, error="the link is unknown, used or too old")
        self.tokens.merge(wanted, lambda old, new: consume(old, new, now)[0])
        address = self.users.spark.createDataFrame([(found.email.lower(),)], "email string")
        self.users.merge(address, lambda old, new: record_logins(old, new, now))
        user = self.users.lookup(found.email.lower()).head()
        if isinstance(entity, str) and entity.strip():
            self.users.merge(address, lambda old, _: update_entity(old, user.id, entity))
        return Result(True, {"userId": user.id})

    def set_entity(self, user_id: str | None, entity: str | None) -> Result:
        """The entity of a signed-in user."""
        user = user_by_id(self.users.read(), user_id).head() if user_id else None
        if user is None:
            return Result(False, error="nobody is signed in")
        if not isinstance(entity, str) or not entity.strip():
            return Result(False, error="an entity is needed")
        address = self.users.spark.createDataFrame([(user.email,)], "email string")
        self.users.merge(address, lambda old, _: update_entity(old, user.id, entity))
        return Result(True)
