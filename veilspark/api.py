"""A store of sessions with the operations of daily use: scan, anonymize, restore, verify, review, hand-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import detect as detection
from veilspark.operators import pool as pools
from veilspark.operators import redact, review, sessions

DOCUMENTS = "doc_id string, ord long, source_path string, source_hash string, text string, anonymized_text string, spans " + detection.SPANS + ", approved boolean, added_at timestamp, session_id string"


class Store:
    """Sessions below one folder: their pools and their documents, partitioned by session.

    One writer a session at a time; sessions don't disturb one another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, schema: str, session_id: str | None = None) -> DataFrame:
        folder = f"{self.path}/{name}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(folder)
        return rows if session_id is None else rows.where(F.col("session_id") == session_id)

    def pool(self, session_id: str | None = None) -> DataFrame:
        return self.read("pool", pools.POOL, session_id)

    def documents(self, session_id: str | None = None) -> DataFrame:
        return self.read("documents", DOCUMENTS, session_id)

    # ------------------------------------------------------------ rewriting

    def scan(self, docs: DataFrame, **options) -> DataFrame:
        """Spans of docs(doc_id, text), one a row; nothing is stored."""
        return detection.spans_table(detection.detect(docs, **options), "doc_id")

    def anonymize(self, docs: DataFrame, session_id: str | None = None, prefix: str = "", **options) -> tuple[str, DataFrame]:
        """The session and its rewritten docs(doc_id, ord, text[, source_path]). A session that exists is extended:
        what it knows keeps its placeholders, and a doc_id it has is replaced."""
        session_id = session_id or sessions.new_session_id()
        named = docs if "source_path" in docs.columns else docs.withColumn("source_path", F.lit(None).cast("string"))
        found = detection.detect(named.select(F.lit(session_id).alias("session_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "source_path", "text"), **options)
        return session_id, self._store(found, session_id, prefix)

    def _store(self, found: DataFrame, session_id: str, prefix: str = "", approved: bool = False) -> DataFrame:
        spans = detection.spans_table(found.drop("text"), "session_id", "doc_id", "ord")
        staged = f"{self.path}/.staged-{session_id}"
        # What replaces stored rows is written beside them first, since it is read from them.
        pools.build_pool(spans, self.pool(session_id), prefix).write.mode("overwrite").parquet(f"{staged}-pool")
        sessions.save(self.spark.read.schema(pools.POOL).parquet(f"{staged}-pool"), f"{self.path}/pool")
        rewritten, _, _ = redact.anonymize(found, self.pool(session_id), prefix, spans=spans)
        rows = rewritten.withColumns({"source_hash": sessions.sha256_of(F.col("text").cast("binary")), "approved": F.lit(approved), "added_at": F.current_timestamp()})
        columns = [f.name for f in self.documents().schema]
        kept = self.documents(session_id).join(found.select("doc_id"), "doc_id", "left_anti")
        merged = kept.select(columns).unionByName(rows.select(columns))
        merged.write.mode("overwrite").parquet(staged)
        sessions.save(self.spark.read.parquet(staged), f"{self.path}/documents")
        return self.documents(session_id)

    def deanonymize(self, docs: DataFrame, session_id: str | None = None, text: str = "anonymized_text") -> DataFrame:
        """docs(doc_id, anonymized_text) with restored_text, by the given or the latest session."""
        session_id = session_id or self.latest()
        return redact.restore(docs.drop("session_id").withColumn("session_id", F.lit(session_id)), pools.mapping(self.pool(session_id)), text)

    def verify(self, session_id: str, **options) -> DataFrame:
        """Leaks in a session's rewritten documents."""
        return redact.verify(self.documents(session_id).select("session_id", "doc_id", "anonymized_text"), pools.mapping(self.pool(session_id)), **options)

    def mapping(self, session_id: str, values: bool = False) -> DataFrame:
        """Placeholders with their types, and with values only if asked for."""
        known = pools.mapping(self.pool(session_id))
        return known if values else pools.safe_mapping(known)

    # ------------------------------------------------------------ review

    def apply_review(self, session_id: str, overrides: DataFrame) -> DataFrame:
        """The session after overrides(doc_id, overrides): corrected documents are rewritten and approved, all by one pool."""
        corrected = review.apply_overrides(self.documents(session_id).drop("anonymized_text").join(overrides, "doc_id"))
        return self._store(corrected.select("session_id", "doc_id", "ord", "source_path", "text", "spans"), session_id, approved=True)

    # ------------------------------------------------------------ sessions

    def sessions(self) -> DataFrame:
        docs = self.documents()
        return sessions.listing(docs, docs.select("session_id", F.explode("spans")))

    def latest(self) -> str | None:
        return sessions.latest(self.documents().groupBy("session_id").agg(F.max("added_at").alias("changed"))).first().session_id

    def show(self, session_id: str) -> DataFrame:
        return self.documents(session_id).select("doc_id", "source_path", "source_hash", "approved", "added_at", F.size("spans").alias("entities"))

    def find(self, source_hash: str | None = None, source_path: str | None = None) -> DataFrame:
        return sessions.find_by_document(self.documents(), source_hash, source_path)

    def resolve(self, prefix: str) -> tuple[str, str | None]:
        row = sessions.resolve_prefix(self.documents(), prefix).first()
        return row.status, row.session_id

    def expired(self, days: int = 7) -> DataFrame:
        """Sessions that haven't changed for so many days."""
        held = self.documents().groupBy("session_id").agg(F.max("added_at").alias("changed"))
        return held.join(sessions.alive(held, F.current_timestamp(), days), "session_id", "left_anti")

    def export(self, session_id: str, passphrase: str) -> bytes:
        return sessions.export_session([r.asDict() for r in self.pool(session_id).collect()], session_id, passphrase, self.spark)

    def import_(self, data: bytes, passphrase: str, overwrite: bool = False) -> str:
        found = sessions.import_session(data, passphrase, self.spark)
        if not overwrite and not self.pool().where(F.col("session_id") == found["session_id"]).isEmpty():
            raise sessions.ArchiveError("exists", f"session {found['session_id']} exists already")
        sessions.save(self.spark.createDataFrame([tuple(r[k] for k in self.pool().columns) for r in found["pool"]], pools.POOL), f"{self.path}/pool")
        return found["session_id"]
