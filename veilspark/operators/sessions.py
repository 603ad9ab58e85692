"""Sessions: their store, listing, lookup, expiry and encrypted hand-off."""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
import struct
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID = r"^[A-Za-z0-9_-]{4,128}$"
MAGIC, VERSION = b"PII1", 1


def new_session_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y-%m-%d_%H%M%S_") + secrets.token_hex(2)


def valid_id(column: Column) -> Column:
    return column.rlike(ID)


# ---------------------------------------------------------------- hashes


def sha256_of(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def parsed_hash(column: Column) -> Column:
    """The digest of a sha256: value, null if it isn't one."""
    return F.when(column.rlike(r"^sha256:[0-9a-fA-F]{64}$"), F.lower(F.substring(column, 8, 64)))


# ---------------------------------------------------------------- store


def save(df: DataFrame, path: str) -> None:
    """Replaces the stored rows of the sessions in df, and theirs only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def load(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Stored rows; a session's alone are found by its folder."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("session_id", F.col("session_id").cast("string"))
    return rows if session_id is None else rows.where(F.col("session_id") == session_id)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


# ---------------------------------------------------------------- queries


def listing(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """session_id, documents, entities, approved and last change, newest first."""
    docs = documents.groupBy("session_id").agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.col("approved"), F.lit(False))).alias("approved"), F.max("added_at").alias("changed"))
    found = spans.groupBy("session_id").agg(F.count("*").alias("entities"))
    out = docs.join(found, "session_id", "left")
    return out.select("session_id", "documents", F.coalesce("entities", F.lit(0)).alias("entities"), "approved", "changed").orderBy(F.desc("changed"), "session_id")


def find_by_document(documents: DataFrame, source_hash: str | None = None, source_path: str | None = None) -> DataFrame:
    """Sessions that hold a document with this content or path, the newest of each session."""
    hit = F.lit(False)
    if source_hash is not None:
        hit = hit | (F.col("source_hash") == source_hash)
    if source_path is not None:
        hit = hit | (F.col("source_path") == source_path)
    newest = Window.partitionBy("session_id").orderBy(F.desc("added_at"), "doc_id")
    return documents.where(hit).withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")


def resolve_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """One row: status (found, none, ambiguous), the session if it is one, and how many fit."""
    fit = sessions.select("session_id").distinct().where(F.col("session_id").startswith(prefix))
    counted = fit.agg(F.count("*").alias("n"), F.min("session_id").alias("first"), F.max((F.col("session_id") == prefix).cast("int")).alias("exact"))
    one = (F.col("n") == 1) | (F.coalesce("exact", F.lit(0)) == 1)
    return counted.select(
        F.lit(prefix).alias("prefix"),
        F.when(one, "found").when(F.col("n") == 0, "none").otherwise("ambiguous").alias("status"),
        F.when(F.coalesce("exact", F.lit(0)) == 1, F.lit(prefix)).when(F.col("n") == 1, F.col("first")).alias("session_id"),
        "n",
    )


def latest(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max_by("session_id", F.struct("changed", "session_id")).alias("session_id"), F.max("changed").alias("changed"))


def alive(sessions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Sessions that haven't expired."""
    return sessions.where(F.col("changed") >= now - F.make_dt_interval(F.lit(days)))


def planned_outputs(files: DataFrame) -> DataFrame:
    """files(path) with names for their rewritten forms; equal names are numbered from the second on."""
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    k = F.row_number().over(Window.partitionBy("base", "ext").orderBy("path"))
    named = files.withColumns({"base": base, "ext": ext}).withColumn("k", k)
    return named.select("path", F.concat("base", F.lit("_anonymized"), F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k"))).otherwise(""), "ext").alias("output"))


# ---------------------------------------------------------------- archive


class ArchiveError(ValueError):
    """Why an archive can't be written or read; code names the case."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def derive(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=16384, r=8, p=1, dklen=32, maxmem=64 << 20)


def gcm(spark: SparkSession, way: str, data: bytes, key: bytes, nonce: bytes) -> bytes:
    """AES-256-GCM by Spark's own functions, on one row; ciphertext and tag stand together."""
    row = spark.createDataFrame([(bytearray(data), bytearray(key), bytearray(nonce))], "data binary, key binary, nonce binary")
    if way == "encrypt":
        return bytes(row.select(F.aes_encrypt("data", "key", F.lit("GCM"), F.lit("DEFAULT"), "nonce").alias("x")).first().x)[12:]
    found = row.select(F.try_aes_decrypt(F.concat("nonce", "data"), "key", F.lit("GCM")).alias("x")).first().x
    if found is None:
        raise ArchiveError("wrong_passphrase", "wrong passphrase or damaged content")
    return bytes(found)


def export_session(pool_rows: list[dict], session_id: str, passphrase: str, spark: SparkSession, review: list[dict] | None = None) -> bytes:
    """magic | version | salt | nonce | length | ciphertext and tag; within, JSON with its own digest."""
    if len(passphrase) < 4:
        raise ArchiveError("short_passphrase", "a passphrase has at least four characters")
    if not pool_rows:
        raise ArchiveError("unknown_session", f"session {session_id} has no entities")
    body = json.dumps({"session_id": session_id, "pool": pool_rows, "review": review}, ensure_ascii=False, sort_keys=True, default=str)
    inner = json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body}).encode()
    salt, nonce = os.urandom(16), os.urandom(12)
    sealed = gcm(spark, "encrypt", inner, derive(passphrase, salt), nonce)
    return MAGIC + bytes([VERSION]) + salt + nonce + struct.pack(">I", len(sealed)) + sealed


def import_session(data: bytes, passphrase: str, spark: SparkSession, existing: set[str] = frozenset(), overwrite: bool = False) -> dict:
    """session_id, pool and review of an archive, after every check."""
    if len(data) < 37:
        raise ArchiveError("truncated", "the archive is cut short")
    if data[:4] != MAGIC:
        raise ArchiveError("bad_magic", "not a session archive")
    if data[4] != VERSION:
        raise ArchiveError("bad_version", f"version {data[4]} is unknown")
    if len(passphrase) < 4:
        raise ArchiveError("short_passphrase", "a passphrase has at least four characters")
    (size,) = struct.unpack_from(">I", data, 33)
    if len(data) - 37 < size:
        raise ArchiveError("truncated", "the archive is cut short")
    if len(data) - 37 > size or size < 16:
        raise ArchiveError("bad_length", "the stated length doesn't fit")
    inner = gcm(spark, "decrypt", data[37:], derive(passphrase, data[5:21]), data[21:33])
    try:
        outer = json.loads(inner)
        if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
            raise ArchiveError("bad_digest", "the content's digest differs")
        found = json.loads(outer["body"])
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ArchiveError("bad_content", "the content is no session") from e
    if not re.fullmatch(ID, found.get("session_id") or ""):
        raise ArchiveError("bad_session_id", "the session's id is not allowed")
    if found["session_id"] in existing and not overwrite:
        raise ArchiveError("exists", f"session {found['session_id']} exists already")
    return found
