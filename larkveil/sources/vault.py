"""The vault: sessions, mappings and surface forms as tables with encrypted values.

Values are sealed with AES-256-GCM by Spark's own function: a fresh nonce for each, and the place
(session|token, for forms session|token|ordinal) as additional data, so that a sealed value can't
be moved elsewhere. Nonce, text and tag are one binary. The key is an argument of the plan, so
sealing and opening first see to it that ``spark.sql.redaction.string.regex`` takes numbers of 64
hexadecimal digits out of plans as they are shown in ``explain``, the UI and event logs; it is never
stored with the tables. Changes give new tables (Parquet has no update in place); ``save`` writes a
version in ``BUCKETS`` folders by a hash of the session.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SESSIONS = "id string, created_at timestamp, doc_sha256 string, config_hash string, external_key string"
MAPPINGS = "session_id string, token string, data_class string, sealed binary, attributes map<string,string>"
FORMS = "session_id string, token string, ordinal int, sealed binary"


class VaultError(RuntimeError):
    """A key file that can't be used, or a value that doesn't open."""


def load_or_create_key(path: str) -> bytes:
    """32 bytes, readable by the owner alone; never through a link."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600)
        with os.fdopen(handle, "wb") as f:
            key = os.urandom(32)
            f.write(key)
        return key
    except OSError as e:
        raise VaultError(f"can't open the key file: {e.strerror}") from e
    with os.fdopen(handle, "rb") as f:
        if stat.S_IMODE(os.fstat(f.fileno()).st_mode) & 0o077:
            raise VaultError("others can read the key file")
        key = f.read()
    if len(key) != 32:
        raise VaultError("the key file doesn't have 32 bytes")
    return key


#: Folders of a saved table; a session is in one of them.
BUCKETS = 256
#: What a key looks like in a plan, as text or as binary.
KEY_IN_PLANS = r"(?:0x|X')?[0-9a-fA-F]{64}'?"
REDACTION = "spark.sql.redaction.string.regex"


def _hide_keys() -> None:
    """Plans of the session are shown without keys from here on."""
    conf = SparkSession.active().conf
    own = conf.get(REDACTION, None)
    if not own or KEY_IN_PLANS not in own:
        conf.set(REDACTION, f"(?:{own})|{KEY_IN_PLANS}" if own else KEY_IN_PLANS)


def _place(*columns) -> Column:
    return F.concat_ws("|", *columns)


def seal(value: Column, key: bytes, place: Column) -> Column:
    _hide_keys()
    return F.aes_encrypt(value, F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), place)


def unseal(sealed: Column, key: bytes, place: Column) -> Column:
    """The value; null where key or place don't fit."""
    _hide_keys()
    return F.try_aes_decrypt(sealed, F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), place).cast("string")


def store(entries: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(mappings, forms) of entries: session_id, token, data_class, value, forms, attributes."""
    mappings = entries.select("session_id", "token", "data_class", seal(F.col("value"), key, _place("session_id", "token")).alias("sealed"), "attributes")
    forms = entries.select("session_id", "token", F.posexplode("forms").alias("ordinal", "form"))
    return mappings, forms.select("session_id", "token", "ordinal", seal(F.col("form"), key, _place("session_id", "token", F.col("ordinal").cast("string"))).alias("sealed"))


def load(mappings: DataFrame, forms: DataFrame, key: bytes) -> DataFrame:
    """session_id, token, data_class, value, forms (in order, [] if none), attributes. A value that doesn't open raises."""
    fail = F.raise_error(F.lit("a sealed value doesn't open"))
    opened = forms.select("session_id", "token", "ordinal", F.coalesce(unseal(F.col("sealed"), key, _place("session_id", "token", F.col("ordinal").cast("string"))), fail).alias("form"))
    lists = opened.groupBy("session_id", "token").agg(F.array_sort(F.collect_list(F.struct("ordinal", "form"))).alias("f")).select("session_id", "token", F.col("f.form").alias("forms"))
    value = F.coalesce(unseal(F.col("sealed"), key, _place("session_id", "token")), fail)
    return mappings.join(lists, ["session_id", "token"], "left").select("session_id", "token", "data_class", value.alias("value"), F.coalesce("forms", F.array().cast("array<string>")).alias("forms"), "attributes")


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, token) whose stored value differs from the new one. Both as ``load`` gives them."""
    return old.alias("o").join(new.alias("n"), ["session_id", "token"]).where("o.value <> n.value").select("session_id", "token")


def append_forms(forms: DataFrame, new: DataFrame, key: bytes) -> DataFrame:
    """forms with those of new (session_id, token, forms) after the greatest ordinal."""
    last = forms.groupBy("session_id", "token").agg(F.max("ordinal").alias("last"))
    rows = new.select("session_id", "token", F.posexplode("forms").alias("i", "form")).join(last, ["session_id", "token"], "left")
    rows = rows.withColumn("ordinal", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("i"))
    return forms.unionByName(rows.select("session_id", "token", "ordinal", seal(F.col("form"), key, _place("session_id", "token", F.col("ordinal").cast("string"))).alias("sealed")))


def get_or_create(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """sessions with one for each external_key of keys (external_key, id, created_at, config_hash) that has none."""
    new = keys.dropDuplicates(["external_key"]).join(sessions.select("external_key"), "external_key", "left_anti")
    return sessions.unionByName(new.withColumn("doc_sha256", F.lit("")).select(*sessions.columns))


def max_counters(mappings: DataFrame) -> DataFrame:
    """session_id, label, last: the greatest token number of each label without gender."""
    label = F.regexp_replace(F.regexp_extract("token", r"^<(.+)_(\d+)>$", 1), "_(FEMALE|MALE)$", "")
    numbered = mappings.where(F.col("token").rlike(r"^<[A-Z][A-Z0-9_]*_\d+>$"))
    return numbered.groupBy("session_id", label.alias("label")).agg(F.max(F.regexp_extract("token", r"_(\d+)>$", 1).cast("int")).alias("last"))


def delete_tokens(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("session_id", "token"), ["session_id", "token"], "left_anti")


def purge(sessions: DataFrame, mappings: DataFrame, forms: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sessions of ``gone`` (id) and what belongs to them."""
    ids = gone.select("id")
    own = ids.withColumnRenamed("id", "session_id")
    return sessions.join(ids, "id", "left_anti"), mappings.join(own, "session_id", "left_anti"), forms.join(own, "session_id", "left_anti")


def older_than(sessions: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    return sessions.where(F.col("created_at") < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days))).select("id")


def list_sessions(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """id, created_at, token_count in the order of creation."""
    n = mappings.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("token_count"))
    return sessions.join(n, "id", "left").select("id", "created_at", F.coalesce("token_count", F.lit(0)).alias("token_count")).orderBy("created_at", "id")


def known_forms(entries: DataFrame) -> DataFrame:
    """session_id, form, data_class, token: each form of a session once, for the first token that has it."""
    rows = entries.select("session_id", "token", "data_class", F.posexplode(F.concat(F.array("value"), "forms")).alias("i", "form")).where("form <> ''")
    first = Window.partitionBy("session_id", "form").orderBy("token", "i")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("session_id", "form", "data_class", "token")


def save(table: DataFrame, path: str, by: str = "session_id") -> None:
    """A version of a table in BUCKETS folders by session, so that purging one rewrites its folder only and files stay few."""
    table.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, session: str | None = None, by: str = "session_id") -> DataFrame:
    """A saved table, or one session's rows of it from its folder alone."""
    table = spark.read.parquet(path)
    if session is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(session)), F.lit(BUCKETS)).cast("int")).first()[0]
        table = table.where((F.col("bucket") == bucket) & (F.col(by) == session))
    return table.drop("bucket")


def exists(sessions: DataFrame, key: str) -> bool:
    """Whether there is a session of this external key."""
    return not sessions.where(F.col("external_key") == key).limit(1).isEmpty()


def changed_settings(sessions: DataFrame, fingerprint: str) -> DataFrame:
    """id, external_key of sessions that were made with other settings than these; a caller warns of them."""
    return sessions.where(F.col("config_hash") != fingerprint).select("id", "external_key")
