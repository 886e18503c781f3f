"""Stored analyses: documents, facts, relations and analyses as Parquet tables with a log of commits.

An analysis is written into folders of its own and published by one file of the log, whose number is the
next version. The file appears whole or not at all and never over another one, so of two writers that
want the same version one wins; the other looks at what has been published since it began, and commits
after it. A save that fails leaves what was stored before as it was.

A document belongs to the last version that has it. Facts of earlier analyses of the document, and
relations that point to such facts, are no longer part of the store; nothing is rewritten for that until
``compact`` puts what still holds into one folder. A reader takes a version's list of folders and sees no
later one; it reads the last compacted folder and the runs after it, and not every run.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import remove, sound
from .search import candidates, search, write_index

TABLES = ("documents", "facts", "relationships")
#: Trigrams of what is searched, by fact_id and relationship_id.
INDEXES = ("fact_grams", "relation_grams")
SUMMARY = "analysis_id string, version long, published_at long, n_documents long, n_facts long, n_relationships long"


def latest_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows with one key the last in the given order; of equal ones there the same one in every run."""
    tie = F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order), tie))
    return rows.withColumn("__n", rank).filter("__n = 1").drop("__n")


def overwrite_documents(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """What is stored after ``arrived``: rows of documents that arrive anew are replaced as a whole."""
    return stored.join(arrived.select("document_id").distinct(), "document_id", "left_anti").unionByName(arrived)


class Conflict(Exception):
    """Another analysis of the same documents was published first."""


@dataclass(frozen=True)
class Snapshot:
    """What a version of the store consists of: a compacted folder, and the runs published after it."""

    version: int = 0
    base: str | None = None
    base_version: int = 0
    runs: list[dict] = field(default_factory=list)


class Log:
    """Numbered files of one folder, each written once.

    A file is written under a hidden name and renamed without overwriting, which is one step where the
    file system makes it one (HDFS and its like).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def names(self) -> list[str]:
        where = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        files = where.getFileSystem(self.conf)
        return sorted(n for f in files.listStatus(where) if not (n := f.getPath().getName()).startswith(".")) if files.exists(where) else []

    def read(self, names: list[str]) -> dict[str, dict]:
        """Contents by name; there are as many as commits since the last compaction."""
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.folder}/{n}" for n in names], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("n"), "value")
        return {r["n"]: json.loads(r["value"]) for r in rows.collect()}

    def put(self, name: str, content: dict) -> bool:
        """Whether the file was written; False if one of that name is there."""
        hidden, final = self._path(f".{name}-{uuid.uuid4().hex}"), self._path(name)
        files = final.getFileSystem(self.conf)
        out = files.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(hidden), files.makeQualified(final), never)
            return True
        except Py4JJavaError as e:
            files.delete(hidden, False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise

    def delete(self, name: str) -> None:
        remove(self.spark, f"{self.folder}/{name}")


class Store:
    """Tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        sound(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _run(self, name: str, analysis_id: str) -> str:
        return f"{self.path(name)}/run=r-{analysis_id}"

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The store at a version, or the last one."""
        named = [(int(n[2:-5]), n) for n in self.log.names() if n[:2] in ("v-", "c-")]
        able = lambda kind: [(v, n) for v, n in named if n.startswith(kind) and (version is None or v <= version)]
        commits, compacted = able("v-"), max(able("c-"), default=(0, None))
        later = [n for v, n in commits if v > compacted[0]]
        read = self.log.read([*later, *([compacted[1]] if compacted[1] else [])])
        runs = [read[n] for n in later]
        base = read[compacted[1]]["folder"] if compacted[1] else None
        return Snapshot(max([v for v, _ in commits] + [compacted[0]]), base, compacted[0], runs)

    def _read(self, name: str, at: Snapshot, only: list[str] | None = None) -> DataFrame | None:
        """A table of a snapshot, or of some of its runs; ``documents`` with their versions."""
        runs = [r for r in at.runs if only is None or r["analysis_id"] in only]
        parts = []
        if runs:
            part = self.spark.read.option("mergeSchema", "true").parquet(*(self._run(name, r["analysis_id"]) for r in runs))
            if name == "documents":
                versions = self.spark.createDataFrame([(r["analysis_id"], r["version"]) for r in runs], "analysis_id string, version long")
                part = part.join(F.broadcast(versions), "analysis_id")  # one row for a run since the last compaction
            parts.append(part)
        if at.base and only is None:
            parts.append(self.spark.read.parquet(f"{at.base}/{name}"))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def _shares_documents(self, documents: DataFrame, at: Snapshot, since: int) -> bool:
        """Whether a run published after a version has one of the documents."""
        later = [r["analysis_id"] for r in at.runs if r["version"] > since]
        if at.base_version > since:  # compacted meanwhile: what it holds of later versions
            other = self._read("documents", at).filter(F.col("version") > since)
        elif later:
            other = self._read("documents", at, later)
        else:
            return False
        return not documents.select("document_id").join(other.select("document_id"), "document_id", "left_semi").isEmpty()

    def begin(self) -> int:
        """The version that a writer starts from."""
        return self.snapshot().version

    def save(self, analysis_id: str, documents: DataFrame, facts: DataFrame, relations: DataFrame, since: int | None = None, retry: bool = True) -> DataFrame:
        """Stores and publishes an analysis; of facts with one id the last one. Returns the summary's row.

        The analysis must not be stored yet. If one of its documents has been published by another analysis
        after the version ``since`` (by default the one at the call), it is committed after that one, or raises
        ``Conflict`` if it must not ``retry``; its folders are then removed.
        """
        since = self.begin() if since is None else since
        counts = {}
        for name, rows in zip(TABLES, (documents, latest_per_key(facts, ["fact_id"], "pos"), relations)):
            rows.withColumn("analysis_id", F.lit(analysis_id)).write.parquet(self._run(name, analysis_id))
            counts[f"n_{name}"] = self.spark.read.parquet(self._run(name, analysis_id)).count()
        self._write_indexes(lambda name: self._run(name, analysis_id))
        own = self.spark.read.parquet(self._run("documents", analysis_id))
        while True:
            at = self.snapshot()
            if not retry and at.version > since and self._shares_documents(own, at, since):
                for name in TABLES + INDEXES:
                    remove(self.spark, self._run(name, analysis_id))
                raise Conflict(f"a document of {analysis_id} was published after version {since}")
            entry = {"analysis_id": analysis_id, "version": at.version + 1, "published_at": time.time_ns(), **counts}
            if self.log.put(f"v-{entry['version']:020}.json", entry):
                return self.spark.createDataFrame([entry], SUMMARY)

    def _write_indexes(self, path) -> None:
        """The trigrams of facts and relations that are written; tables without what is searched have no index."""
        facts, relations = (self.spark.read.parquet(path(name)) for name in ("facts", "relationships"))
        if {"fact_id", "entity", "metric", "value_raw", "supporting_text"} <= set(facts.columns):
            write_index(facts.withColumn("text", fact_text()), ["fact_id"], "text", path("fact_grams"))
            if {"a_fact_id", "b_fact_id", "explanation"} <= set(relations.columns):
                write_index(relation_texts(relations, facts), ["relationship_id"], "text", path("relation_grams"))

    def _index(self, name: str, at: Snapshot) -> DataFrame:
        paths = [self._run(name, r["analysis_id"]) for r in at.runs] + ([f"{at.base}/{name}"] if at.base else [])
        parts = [self.spark.read.parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts)

    def search_facts(self, query: str = "", status: str | None = None, version: int | None = None) -> DataFrame:
        """Facts that the store holds at a version, by a text in them; only postings of the query's trigrams are read."""
        at = self.snapshot(version)
        live = self._read("facts", at).join(self._owners(self._read("documents", at)), ["document_id", "analysis_id"], "left_semi")
        return search_facts(live, query, status, self._index("fact_grams", at))

    def search_relations(self, query: str = "", kind: str | None = None, version: int | None = None) -> DataFrame:
        at = self.snapshot(version)
        owners, held = self._owners(self._read("documents", at)), self._read("relationships", at)
        for side in ("a_document_id", "b_document_id"):
            held = held.join(owners.withColumnRenamed("document_id", side), [side, "analysis_id"], "left_semi")
        facts = self._read("facts", at).join(owners, ["document_id", "analysis_id"], "left_semi")
        return search_relations(held, facts, query, kind, self._index("relation_grams", at))

    def analyses(self, version: int | None = None) -> DataFrame:
        """The summary of every published analysis."""
        at = self.snapshot(version)
        rows = self.spark.createDataFrame(at.runs, SUMMARY)
        return rows.unionByName(self.spark.read.parquet(f"{at.base}/analyses")) if at.base else rows

    @staticmethod
    def _owners(documents: DataFrame) -> DataFrame:
        last = documents.groupBy("document_id").agg(F.max(F.struct("version", "analysis_id")).alias("o"))
        return last.select("document_id", F.col("o.analysis_id").alias("analysis_id"))

    def owners(self, version: int | None = None) -> DataFrame | None:
        """document_id and the analysis_id that it belongs to; None if nothing is stored."""
        documents = self._read("documents", self.snapshot(version))
        return None if documents is None else self._owners(documents)

    def load(self, analysis_id: str, version: int | None = None) -> dict[str, DataFrame] | None:
        """The tables of a stored analysis, or None: its documents with their current facts, and relations that still hold.

        ``version``: as the store was then.
        """
        at = self.snapshot(version)
        found = self.analyses(version).filter(F.col("analysis_id") == analysis_id)
        documents = self._read("documents", at)
        if documents is None or found.isEmpty():
            return None
        ids = documents.filter(F.col("analysis_id") == analysis_id).select("document_id")
        live = self._owners(documents.join(ids, "document_id", "left_semi"))
        held = live.filter(F.col("analysis_id") == analysis_id).select("document_id")
        relations = _between(self._read("relationships", at).filter(F.col("analysis_id") == analysis_id), held)
        read = lambda df: df.join(live, ["document_id", "analysis_id"], "left_semi")
        return {"analyses": found, "documents": read(documents).drop("version"), "facts": read(self._read("facts", at)), "relationships": relations}

    def compact(self) -> int:
        """Puts what holds at the last version into one folder, from which later readers start. Returns the version.

        Runs stay where they are for readers of earlier versions, until ``vacuum``.
        """
        at = self.snapshot()
        documents = self._read("documents", at)
        if documents is None or not at.runs:
            return at.version
        folder = f"{self.path('compacted')}/{at.version}-{uuid.uuid4().hex}"
        owners = self._owners(documents)
        # Which documents an analysis had stays known; of facts and relations only what holds is kept.
        documents.write.parquet(f"{folder}/documents")
        self._read("facts", at).join(owners, ["document_id", "analysis_id"], "left_semi").write.parquet(f"{folder}/facts")
        relations = self._read("relationships", at)
        for side in ("a_document_id", "b_document_id"):
            relations = relations.join(owners.withColumnRenamed("document_id", side), [side, "analysis_id"], "left_semi")
        relations.write.parquet(f"{folder}/relationships")
        self._write_indexes(lambda name: f"{folder}/{name}")
        self.analyses(at.version).write.parquet(f"{folder}/analyses")
        if not self.log.put(f"c-{at.version:020}.json", {"version": at.version, "folder": folder}):
            remove(self.spark, folder)  # another compaction was first
        return at.version

    def vacuum(self) -> int:
        """Removes runs, log files and folders that only versions before the last compaction need; returns how many runs."""
        names = self.log.names()
        compacted = max((n for n in names if n.startswith("c-")), default=None)
        if compacted is None:
            return 0
        old = [n for n in names if n[2:] <= compacted[2:] and n != compacted]
        gone = self.log.read(old)
        for name, entry in gone.items():
            for path in [entry["folder"]] if "folder" in entry else [self._run(t, entry["analysis_id"]) for t in TABLES + INDEXES]:
                remove(self.spark, path)
            self.log.delete(name)
        return sum("folder" not in e for e in gone.values())


def _between(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations of which both sides lie in the documents."""
    for side in ("a_document_id", "b_document_id"):
        relations = relations.join(documents.withColumnRenamed("document_id", side), side, "left_semi")
    return relations


def summarize(documents: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids of the documents and counts of everything, as one row."""
    d = documents.agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"), F.count("*").alias("n_documents"))
    f = facts.agg(F.count("*").alias("n_facts"))
    r = relations.agg(F.count("*").alias("n_relationships"))
    return d.crossJoin(f).crossJoin(r)  # one row each


def read_back(facts: DataFrame, relations: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Relations between the facts of a list, with both facts' text: two semi-joins and two lookups."""
    known = facts.join(fact_ids, "fact_id", "left_semi")
    side = lambda p: known.select(F.col("fact_id").alias(f"fact_{p}_id"), F.col("entity").alias(f"entity_{p}"), F.col("value_raw").alias(f"value_{p}"))
    return relations.select("relationship_id", "relationship_type", F.col("a_fact_id").alias("fact_a_id"), F.col("b_fact_id").alias("fact_b_id")).join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")


#: Between the fields of a text that is searched; no query holds it.
FIELD = "\x00"


def fact_text() -> Column:
    """All of a fact that is searched: a query is held by one of the fields."""
    return F.concat_ws(FIELD, *(F.coalesce(c, F.lit("")) for c in ("entity", "metric", "value_raw", "supporting_text")))


def search_facts(facts: DataFrame, query: str = "", status: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Facts of an epistemic status that hold a text in entity, metric, value or evidence, without regard to case.

    ``index``: postings of ``fact_text`` by fact_id; without it all facts are read.
    """
    able = facts if status is None else facts.filter(F.col("epistemic_status") == status)
    if index is not None:
        return search(able, index, query, ["fact_id"], fact_text())
    return able.filter(F.contains(F.lower(fact_text()), F.lit(query.lower())))


def relation_texts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with all that is searched of them as ``text``: explanation and both facts."""
    side = lambda p: facts.select(F.col("fact_id").alias(f"{p}_fact_id"), F.concat_ws("\n", "entity", "metric", "value_raw").alias(f"text_{p}"))
    rows = relations.join(side("a"), "a_fact_id", "left").join(side("b"), "b_fact_id", "left")
    return rows.withColumn("text", F.concat_ws("\n", "explanation", "text_a", "text_b")).drop("text_a", "text_b")


def search_relations(relations: DataFrame, facts: DataFrame, query: str = "", kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Relations of a type that hold a text in the explanation or in either fact, without regard to case.

    ``index``: postings of ``relation_texts`` by relationship_id; with it only relations that can hold the text meet their facts.
    """
    able = relations if kind is None else relations.filter(F.col("relationship_type") == kind)
    found = None if index is None else candidates(index, query, ["relationship_id"])
    if found is not None:
        able = able.join(found, "relationship_id", "left_semi")
    return relation_texts(able, facts).filter(F.contains(F.lower("text"), F.lit(query.lower()))).drop("text")
