"""The engine as one object: parse, extract, analyze, compare, load."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, extract, facts, pages, planner, relations
from .operators.journal import Journal
from .shared import durable, sound
from .sources import documents
from .sources.files import FormFeeds, Paged, list_files
from .sources.store import Store, summarize


@dataclass(frozen=True)
class Config:
    """Settings; each may come from an environment variable ``CONCORDAT_<NAME>``."""

    batch_size: int = 5
    budget: int | None = None
    workers: int = 2
    threshold: float = pages.EXTRACTION_THRESHOLD
    by_relevance: bool = True
    radius: int = context.RADIUS
    page_numbers: tuple[int, ...] = field(default=())
    journal: str | None = None
    """A folder in which a model's answers are kept as they come, so that none is asked for twice."""
    stop_at_quota: bool = True

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")
        if self.budget is not None and self.budget < 1:
            raise ValueError("budget must be positive")
        if self.radius < 0:
            raise ValueError("radius must not be negative")
        object.__setattr__(self, "workers", max(1, min(2, self.workers)))

    @classmethod
    def from_env(cls, **given) -> Config:
        """Arguments first, then the environment, then the defaults; a value that cannot be read is an error."""
        kinds = {"batch_size": int, "budget": int, "workers": int, "threshold": float, "radius": int}
        out = cls()
        for name, kind in kinds.items():
            variable = f"CONCORDAT_{name.upper()}"
            told = os.environ.get(variable, "").strip()
            if told and given.get(name) is None:
                try:
                    value = kind(told)
                except ValueError:
                    raise ValueError(f"{variable} must be {'an integer' if kind is int else 'a number'}, got {told!r}") from None
                out = replace(out, **{name: value})
        return replace(out, **{k: v for k, v in given.items() if v is not None})


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, caller: Callable[[str], str] | None = None, store: Store | None = None, parser: documents.Parser | FormFeeds | Paged = documents.split_form_feeds, kinds: tuple[str, ...] = ()):
        sound(spark)
        self.kinds = kinds  # endings of file names; none: any
        self.spark, self.config, self.caller, self.store, self.parser = spark, config or Config(), caller, store, parser

    def about(self) -> dict[str, str]:
        return {"status": "healthy", "service": "concordat"}

    def parse(self, path: str) -> DataFrame:
        """Pages of the files at ``path``; raises ValueError if there are none, or one is of no kind in ``kinds``."""
        files = list_files(self.spark, path)
        if files.isEmpty():
            raise ValueError(f"no files at {path}")
        kind = F.lit(not self.kinds)
        for ending in self.kinds:
            kind = kind | F.endswith(F.lower("name"), F.lit(ending))
        other = files.filter(~kind).select(F.min("path")).first()[0]
        if other is not None:
            raise ValueError(f"{other} is of no kind that is read ({', '.join(self.kinds)})")
        return documents.parse_files(self.spark, path, self.parser, files)

    def plan(self, page_rows: DataFrame) -> DataFrame:
        c = self.config
        full = page_rows.filter("has_text")
        scored = pages.score_pages(full, c.threshold)
        if c.page_numbers:
            chosen = pages.limit_pages(full, list(c.page_numbers)).withColumn("score", F.lit(None).cast("double"))
        else:
            chosen = scored.filter("selected") if c.by_relevance else scored
        return planner.plan_pages(chosen, c.budget, c.batch_size)

    def extraction(self, page_rows: DataFrame) -> dict[str, DataFrame]:
        """claims (each with its reject_reason, null if accepted), plan, batches (with their outcomes) and statuses.

        Claims are grounded on their pages: by the caller's model if there is one, else by rule. What a model has
        said is written once and read from there, so that no batch is asked twice.
        """
        plan = durable(self.plan(page_rows))
        planned = plan.filter("planned").select("document_id", "page_number", "batch_id")
        if self.caller is None:
            chosen = page_rows.join(planned.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
            claims = extract.rule_claims(chosen)
            order = F.struct("document_id", "page_number", "segment", "value_no")
            batches = planned.select("document_id", "batch_id", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error")).distinct()
        else:
            texts = context.prompt_text(context.page_context(page_rows, self.config.radius))
            kept = Journal(self.config.journal) if self.config.journal else None
            said = durable(extract.call_model(planner.batch_prompts(plan, texts), self.caller, self.config.workers, journal=kept, stop_at_quota=self.config.stop_at_quota))
            claims = extract.read_candidates(said.filter("output IS NOT NULL"))
            order = F.struct("document_id", "batch_id", "candidate_no")
            batches = said.drop("output")
        key = F.conv(F.substring(F.sha2(F.to_json(order), 256), 1, 15), 16, 10).cast("long")
        checked = extract.with_grounding(claims.withColumn("pos", key), page_rows)
        claims = durable(extract.reject_reason(checked, planned))
        return {"claims": claims, "plan": plan, "batches": batches, "statuses": extract.extraction_status(batches, plan)}

    def extract(self, page_rows: DataFrame) -> DataFrame:
        """The accepted claims."""
        return self.extraction(page_rows)["claims"].filter("reject_reason IS NULL")

    def normalize(self, claims: DataFrame, calendar: str | None = None) -> DataFrame:
        return facts.normalize_facts(claims, calendar)

    def relate(self, normalized: DataFrame) -> DataFrame:
        return relations.relate(normalized)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Relations of given pairs (columns with a_ and b_), whether or not they would surface."""
        return relations.classify(relations.compare(pairs))

    def analyze(self, page_rows: DataFrame, claims: DataFrame | None = None) -> dict[str, DataFrame]:
        """From pages to relations; stored if the engine has a store.

        Facts and relations are computed once, and all tables and counts are derived from these. Beside them
        come, where claims are not given, the documents' extraction statuses and their sum (``statuses``,
        ``status``) and the counts of rejected claims; and the errors of documents that were not read.
        """
        out: dict[str, DataFrame] = {}
        if claims is None:
            done = self.extraction(page_rows)
            claims = done["claims"].filter("reject_reason IS NULL")
            rejected = done["claims"].filter("reject_reason IS NOT NULL").groupBy("document_id", "reject_reason").agg(F.count("*").alias("n"))
            statuses = extract.document_summaries(done["statuses"], done["claims"], done["batches"], self.config.budget)
            out = {"statuses": statuses, "status": self._status(page_rows, done["statuses"]), "rejected": rejected, "batches": done["batches"]}
        if "error" in page_rows.columns:
            out["errors"] = page_rows.filter("error IS NOT NULL").select("document_id", "error")
            page_rows = page_rows.filter("error IS NULL")
        normalized = durable(self.normalize(claims))
        related = durable(self.relate(normalized))
        docs = page_rows.groupBy("document_id").agg(F.count("*").alias("total_pages"))
        analysis_id = str(uuid.uuid4())
        if self.store is not None:
            summary = self.store.save(analysis_id, docs, normalized, related)
        else:
            summary = summarize(docs, normalized, related).select(F.lit(analysis_id).alias("analysis_id"), "*")
        return out | {"documents": docs, "facts": normalized, "relationships": related, "summary": summary}

    @staticmethod
    def _status(page_rows: DataFrame, statuses: DataFrame) -> DataFrame:
        """The status of all documents, in the order of their files' names where these are known."""
        if "document_name" not in page_rows.columns:
            return extract.overall_status(statuses)
        names = page_rows.groupBy("document_id").agg(F.min("document_name").alias("document_name"))
        return extract.overall_status(statuses.join(names, "document_id", "left"), F.struct("document_name", "document_id"))

    def load(self, analysis_id: str) -> dict[str, DataFrame] | None:
        return self.store.load(analysis_id) if self.store is not None else None
