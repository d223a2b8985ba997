"""Rendering jobs as streams: files arrive, pages are processed, jobs end and expire."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import tables

#: Limits of a job.
MOST_BYTES, MOST_PAGES, QUEUE, DPI_RANGE, TTL_MS = 50 << 20, 500, 100, (8, 1200), 3_600_000
FILES = "path string, modificationTime timestamp, length long, content binary"
STATUS = "job_id string, status string, done int, failed int, created timestamp, expires timestamp"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files in a landing folder: (doc_id, content, created, refused); one larger than a job may be has no content and a reason."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").load(folder)
    fits = F.col("length") <= MOST_BYTES
    return files.select(F.col("path").alias("doc_id"), F.when(fits, F.col("content")).alias("content"), F.col("modificationTime").alias("created"), F.when(~fits, f"413: a file may have {MOST_BYTES} bytes").alias("refused"))


def page_results(files: DataFrame, dpi: float = 150.0) -> DataFrame:
    """One row per page: (doc_id, page_no, status, reason, png); a file that cannot be opened is one failed row."""
    images = tables.page_images(files.select("doc_id", "content"), dpi)
    why = F.coalesce("error", "failed", F.when(F.col("page_no") >= MOST_PAGES, "more pages than a job may have"))
    return images.select("doc_id", "page_no", F.when(why.isNull(), "done").otherwise("failed").alias("status"), why.alias("reason"), F.when(why.isNull(), F.col("png")).alias("png"))


def job_status(results: DataFrame) -> DataFrame:
    """(doc_id, status, done, failed): failed without a done page, partial with a failed one, else done."""
    g = results.groupBy("doc_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.select("doc_id", F.when(F.col("done") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("done").alias("status"), "done", "failed")


def job_view(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Each job as JSON: its state, pages in order, and where its document is once it may be fetched."""
    pages = F.sort_array(F.collect_list(F.struct("page_no", "status", "reason")))
    p = results.groupBy("doc_id").agg(pages.alias("pages"))
    ready = F.when(F.col("status").isin("done", "partial"), F.concat(F.lit("/v1/jobs/"), "doc_id", F.lit("/document.html")))
    return jobs.join(p, "doc_id", "left").select("doc_id", F.to_json(F.struct("status", "done", "failed", "pages", ready.alias("document_url"))).alias("view"))


def answers(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """HTTP codes of requests (doc_id, what): 404 for unknown jobs, 409 while a job has not ended, else 200 (204 for delete)."""
    j = requests.join(jobs.select("doc_id", "status"), "doc_id", "left")
    ended = F.col("status").isin("done", "partial", "failed")
    code = F.when(F.col("status").isNull(), 404).when(F.col("what") == "status", 200).when(~ended, 409).when(F.col("what") == "delete", 204).when((F.col("what").isin("document", "archive")) & (F.col("status") == "failed"), 409).otherwise(200)
    return j.select("doc_id", "what", code.alias("code"))


def admitted(waiting: DataFrame, live: int, queue: int = QUEUE) -> DataFrame:
    """Waiting files (doc_id, created) with whether the queue takes them, oldest first: at most twice its depth may live."""
    head = waiting.orderBy("created", "doc_id").limit(max(0, 2 * queue - live)).select("doc_id").withColumn("accepted", F.lit(True))
    return waiting.join(head, "doc_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def swept(jobs: DataFrame, now: Any) -> DataFrame:
    """Jobs that have ended and whose time is over."""
    return jobs.where(F.col("status").isin("done", "partial", "failed") & (F.col("expires") < F.lit(now)))


def follow(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of page events (job_id, status, pages, ts) to job states: each change is a row; an ended job is forgotten at its expiry.

    `pages` is the number of pages of the job. Time is that of the events, with their watermark; time to live
    counts from the job's first event.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done, failed, created = state.get
            state.remove()
            when = pd.Timestamp(created, unit="ms")
            yield pd.DataFrame([(key[0], "expired", done, failed, when, when + pd.Timedelta(ttl_ms, "ms"))], columns=["job_id", "status", "done", "failed", "created", "expires"])
            return
        done, failed, created = state.get if state.exists else (0, 0, None)
        pages = 0
        for b in batches:
            done += int((b["status"] == "done").sum())
            failed += int((b["status"] == "failed").sum())
            pages = max(pages, int(b["pages"].max()))
            first = int(b["ts"].min().timestamp() * 1000)
            created = first if created is None else min(created, first)
        state.update((done, failed, created))
        state.setTimeoutTimestamp(max(created + ttl_ms, state.getCurrentWatermarkMs() + 1))
        ended = done + failed >= pages
        status = "processing" if not ended else "failed" if not done else "partial" if failed else "done"
        when = pd.Timestamp(created, unit="ms")
        yield pd.DataFrame([(key[0], status, done, failed, when, when + pd.Timedelta(ttl_ms, "ms"))], columns=["job_id", "status", "done", "failed", "created", "expires"])

    return events.groupBy("job_id").applyInPandasWithState(step, STATUS, "done int, failed int, created long", "append", GroupStateTimeout.EventTimeTimeout)
