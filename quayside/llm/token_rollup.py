"""Token counts as delta-maintained rollups.

A batch of changes is a table of events: insert (a document's count under a tokenizer version), revise (a new count for
what is there) and delete. Each becomes signed entries: +1 document and +n tokens for what comes, and the negative of
what was there for what goes. The entries of a batch are summed by source, language and tokenizer version before they
are stored, and totals are the sum of all batches' sums.

A batch is committed once: its folder is written under a name of its own and gets into effect by one small marker
written last, so a repeated or interrupted commit changes nothing. Entries are kept as well, for the counts that later
batches take back. They are dealt by document into shards, and a commit opens those of the shards it touches alone;
``compact`` puts all batches' entries and totals into one folder each, so that history doesn't grow with the commits.

A row of a document is named by ``doc_id``, which may be null, and ``part`` (0 by default): rows that repeat a doc_id and
differ in ``part`` count each. Within a batch the last event of a (row, tokenizer version) counts, by ``seq``; equal ones
count once, and of events tied in everything but their count the larger count wins. Revising or deleting what isn't
there has no effect but that a revision inserts. Null sources and languages are groups of their own; events with a null
tokenizer, op or (but for deletes) count are refused: they are left out. Empty batches can be committed. Other columns
don't take part.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import WORD_CLASS
from quayside.session import remove

EVENT = (
    "doc_id bigint, part bigint, tokenizer string, seq bigint, op string, source string, lang string, n_tokens bigint"
)
GROUP = ["source", "lang", "tokenizer"]
ENTRY = "doc_id bigint, part bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint, shard int"
TOTAL = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
MARK = "batch string, folder string, generation int"
SHARDS = 256

# Tokenizer versions that a regular expression defines.
COUNTERS = {
    "words/1": WORD_CLASS,
    "words/2": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]",
}


def counted(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a version of COUNTERS; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def _shard() -> Column:
    return F.pmod(F.xxhash64("doc_id", "part"), F.lit(SHARDS)).cast("int")


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    same = F.lit(True)
    for name in key:
        same = same & a[name].eqNullSafe(b[name])
    return same


class Rollup:
    """Totals kept in a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> dict[str, tuple[int, str]]:
        """The batches in effect, each with its newest generation and the folder that holds it then: one small row per
        commit and compaction."""
        try:
            marks = self.spark.read.schema(MARK).parquet(f"{self.path}/marks/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        newest: dict[str, tuple[int, str]] = {}
        for row in marks:
            newest[row.batch] = max(newest.get(row.batch, (-1, "")), (row.generation, row.folder))
        return newest

    def _mark(self, name: str, rows: list[tuple[str, str, int]]) -> None:
        marks = self.spark.createDataFrame(rows, MARK)
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/{name}")

    def _folder(self, part: str, folder: str) -> str:
        return f"{self.path}/{part}/folder={folder}"

    def _stored(self, part: str, schema: str, committed: dict[str, tuple[int, str]]) -> DataFrame:
        paths = [self._folder(part, folder) for folder in sorted({folder for _, folder in committed.values()})]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, folder string").option("basePath", f"{self.path}/{part}")
        return reader.parquet(*paths).drop("folder")

    def entries(self, shards: list[int] | None = None, committed: dict | None = None) -> DataFrame:
        """What is in effect of each row and tokenizer version, in some shards or all."""
        stored = self._stored("entries", ENTRY, self._committed() if committed is None else committed)
        if shards is not None:
            stored = stored.where(F.col("shard").isin(shards))
        return _summed(stored, "doc_id", "part", *GROUP).where("docs > 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens of all batches in effect; groups without documents are left out."""
        return _summed(self._stored("totals", TOTAL, self._committed()), *GROUP).where("docs > 0")

    def _write(self, folder: str, entries: DataFrame) -> None:
        """Entries by shard, and their sums."""
        path = self._folder("entries", folder)
        dealt = entries.withColumn("shard", _shard()).repartition("shard")
        dealt.write.partitionBy("shard").mode("overwrite").parquet(path)
        held = self.spark.read.schema(ENTRY).parquet(path)
        _summed(held, *GROUP).write.mode("overwrite").parquet(self._folder("totals", folder))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Puts a batch into effect; False if it is already."""
        committed = self._committed()
        if batch in committed:
            return False
        key = ["doc_id", "part", "tokenizer"]
        if "part" not in events.columns:
            events = events.withColumn("part", F.lit(0).cast("long"))
        last = (
            events.select(*[f.split()[0] for f in EVENT.split(", ")])
            .where("tokenizer is not null and op in ('insert', 'revise', 'delete')")
            .where("op = 'delete' or n_tokens is not null")
            .groupBy(*key)
            .agg(F.max(F.struct("seq", "op", "n_tokens", "source", "lang")).alias("e"))
            .select(*key, "e.*")
        )
        come = last.where("op <> 'delete'").select(
            "doc_id", "part", *GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")
        )
        if committed:
            touched = [row.shard for row in events.select(_shard().alias("shard")).distinct().collect()]
            old = self.entries(touched, committed)
            gone = old.join(last, _same(old, last, key), "left_semi").select(
                "doc_id", "part", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
            )
            come = come.unionByName(gone)
        folder = hashlib.sha256(batch.encode()).hexdigest()[:32]
        self._write(folder, come)
        self._mark(folder, [(batch, folder, 0)])
        return True

    def compact(self) -> int:
        """Puts the entries in effect into one folder; returns how many folders that replaces. The old ones stay until
        their marks are outdated, which one written file does, so an interrupted compaction has no effect."""
        committed = self._committed()
        folders = {folder for _, folder in committed.values()}
        if len(folders) < 2:
            return 0
        generation = 1 + max(number for number, _ in committed.values())
        name = f"compacted-{generation}"
        self._write(name, self.entries(committed=committed))
        self._mark(name, [(batch, name, generation) for batch in sorted(committed)])
        for folder in sorted(folders):
            for part in ("entries", "totals"):
                remove(self.spark, self._folder(part, folder))
        return len(folders)


def part_of(docs: DataFrame) -> Column:
    """Tells rows apart that repeat a doc_id; rows equal in text, source and language too are one."""
    return F.xxhash64("text", "source", "lang")


def events_of(docs: DataFrame, tokenizer: str, op: str, seq: int) -> DataFrame:
    """One event per document, with the count of ``tokenizer``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        part_of(docs).alias("part"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(seq).cast("long").alias("seq"),
        F.lit(op).alias("op"),
        "source",
        "lang",
        counted(F.col("text"), tokenizer).alias("n_tokens"),
    )
