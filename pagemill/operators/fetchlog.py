"""Fetch-log operators over ``captures(page_id, url, attempt, status, content_type, failure,
final_url, chars, elapsed_ms[, renderer])`` (F1-F6, W2, W3, P10, A9).

The fetch loop becomes table work: the outcome of an attempt is a CASE (F1), the retry rule a
boolean (F2), the last attempt per URL a ``max_by`` aggregate (W3), diagnostics and errors are
projections of it (F5, F6), and the browser / http choice a conditional aggregate (F4).
Everything groups by URL, a bounded group (at most three attempts per renderer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses retried while attempts remain (0-based attempt < 2).
RETRY_STATUSES = (408, 425, 429, 500, 502, 503, 504)
BLOCKED_STATUSES = (401, 403, 429)
MAX_RETRIES = 2


def is_html(ct) -> Column:
    """P10: content type names HTML or XHTML."""
    low = F.lower(F.coalesce(F.col(ct) if isinstance(ct, str) else ct, F.lit("")))
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def outcome() -> Column:
    """F1 for one http attempt."""
    st = F.col("status")
    return (
        F.when(F.col("failure") == "timeout", "timeout")
        .when(F.col("failure") != "", "http-error")
        .when(st >= 400, F.when(st.isin(*BLOCKED_STATUSES), "blocked").otherwise("http-error"))
        .when(~is_html("content_type"), "non-html")
        .otherwise("ok")
    )


def retryable() -> Column:
    """retried status, time-out or transport failure, while attempts remain."""
    return (F.col("status").isin(*RETRY_STATUSES) | (F.col("failure") != "")) & (F.col("attempt") < MAX_RETRIES)


def classify(captures: DataFrame) -> DataFrame:
    """F1 + F2 on every attempt."""
    return captures.withColumns({"reason": outcome(), "retryable": F.coalesce(retryable(), F.lit(False))})


def backoff_plan(captures: DataFrame) -> DataFrame:
    """one row per planned re-fetch: (url, next_attempt, delay_s = 0.5 * 2^attempt); jitter left out."""
    c = classify(captures).where("retryable")
    return c.select(
        "page_id",
        "url",
        (F.col("attempt") + 1).alias("next_attempt"),
        (F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempt"))).alias("delay_s"),
    )


def last_attempts(captures: DataFrame, key: str = "page_id", columns: list[str] | None = None) -> DataFrame:
    """The last attempt of each fetch, plus the number of attempts seen and whether each
    earlier attempt was one the retry rule allows (planned vs. observed)."""
    c = classify(captures)
    columns = [x for x in columns or c.columns if x != key]
    g = c.groupBy(key).agg(
        F.max_by(F.struct(*columns), "attempt").alias("last"),
        F.count(F.lit(1)).alias("attempts"),
    )
    return g.select(key, "last.*", "attempts")


def retries_consistent(captures: DataFrame, key: str = "page_id") -> DataFrame:
    """W3 check: every attempt before the last one must be retryable."""
    c = classify(captures)
    w = Window.partitionBy(key)
    c = c.withColumn("_last", F.max("attempt").over(w))
    return c.groupBy(key).agg(
        F.bool_and(F.when(F.col("attempt") < F.col("_last"), F.col("retryable")).otherwise(F.lit(True))).alias("consistent"),
        F.max("attempt").alias("last_attempt"),
    )


def diagnostics(captures: DataFrame, key: str = "page_id") -> DataFrame:
    """one diagnostic row per fetch from its last attempt (time-outs keep the requested URL)."""
    last = last_attempts(captures, key)
    timeout = F.col("reason") == "timeout"
    renderer = F.col("renderer") if "renderer" in captures.columns else F.lit("http")
    return last.select(
        key,
        "url",
        F.when(timeout, F.col("url")).otherwise(F.col("final_url")).alias("final_url"),
        F.coalesce(F.col("status").cast("string"), F.lit("")).alias("status"),
        F.when(timeout, F.lit("")).otherwise(F.col("content_type")).alias("content_type"),
        F.when(timeout, F.lit(0)).otherwise(F.col("chars")).cast("bigint").alias("bytes"),
        F.lit(0).cast("bigint").alias("extracted_chars"),
        F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"),
        "reason",
        renderer.alias("renderer"),
        F.lit("").alias("error"),
    )


def errors(diag: DataFrame, key: str = "page_id") -> DataFrame:
    """an error row for every fetch whose outcome is not ok (time-outs carry no status)."""
    status = F.when(F.col("reason") == "timeout", F.lit("")).otherwise(F.col("status"))
    return diag.where(F.col("reason") != "ok").select(key, "url", "reason", status.alias("status"))


def best_variant(captures: DataFrame, mode: str, min_text_chars: int, key: str = "page_id", chars_col: str = "chars") -> DataFrame:
    """the capture a fetch ends with for ``render_mode``.

    http -> the http capture; browser -> the browser capture only; auto -> http when it is ok and long enough, else browser, else http. Fetches with no
    usable capture are dropped. One ``max_by`` on a priority column per fetch."""
    c = classify(captures)
    if "renderer" not in c.columns:
        c = c.withColumn("renderer", F.lit("http"))
    ok = F.col("reason") == "ok"
    http, browser = F.col("renderer") == "http", F.col("renderer") == "browser"
    if mode == "browser":
        prio = F.when(browser & ok, 2)
    elif mode == "auto":
        prio = F.when(http & ok & (F.col(chars_col) >= min_text_chars), 3).when(browser & ok, 2).when(http & ok, 1)
    else:
        prio = F.when(http & ok, 1)
    c = c.withColumn("_prio", prio).where(F.col("_prio").isNotNull())
    g = c.groupBy(key).agg(F.max_by(F.struct(*[x for x in c.columns if x not in (key, "_prio")]), F.struct("_prio", "attempt")).alias("v"))
    return g.select(key, "v.*")


def latest_diagnostic(diag: DataFrame, seq_col: str = "seq") -> DataFrame:
    """The newest diagnostic of each URL, be it the one asked for or the one arrived at. One partial
    aggregate, so a URL that most fetches end at is no hot window."""
    urls = F.array_distinct(F.array("url", "final_url"))
    each = diag.select(F.explode(urls).alias("any_url"), "*")
    g = each.groupBy("any_url").agg(F.max_by(F.struct(*diag.columns), seq_col).alias("v"))
    return g.select("any_url", "v.*")


def with_extracted_chars(diag: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write each page's extracted length onto its fetch's diagnostic (equi join on the fetch id,
    so two URLs redirected to one target are not mixed)."""
    p = pages.select(F.col(key), F.col("clean_text_chars").cast("bigint").alias("_x"))
    return diag.join(p, key, "left").withColumn("extracted_chars", F.coalesce("_x", "extracted_chars")).drop("_x")


def outcomes(captures: DataFrame, key: str = "page_id") -> DataFrame:
    """What A9 and F6 need of the last attempt, without its length (so the body is never read)."""
    renderer = ["renderer"] if "renderer" in captures.columns else []
    last = last_attempts(captures, key, ["url", "status", "reason", "elapsed_ms", *renderer])
    status = F.coalesce(F.col("status").cast("string"), F.lit(""))
    return last.select(key, "url", status.alias("status"), "reason", F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"), (F.col("renderer") if renderer else F.lit("http")).alias("renderer"))


def by_reason(diag: DataFrame) -> DataFrame:
    """Diagnostics counted by (reason, renderer) with total and largest elapsed time."""
    return diag.groupBy("reason", "renderer").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsed_ms").alias("total_elapsed_ms"),
        F.max("elapsed_ms").alias("max_elapsed_ms"),
    )


def run_snapshots(diag: DataFrame, run_col: str) -> DataFrame:
    """one summary row per run of the diagnostics."""
    ok = F.col("reason") == "ok"
    return diag.groupBy(run_col).agg(
        F.count_if(ok).alias("pages_count"),
        F.count_if(~ok).alias("errors_count"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("bigint").alias("total_chars"),
        F.max("elapsed_ms").alias("max_elapsed_ms"),
    )


def last_run(snapshots: DataFrame, started_col: str) -> DataFrame:
    """the snapshot of the run that started last."""
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), started_col).alias("v")).where(F.col("v").isNotNull()).select("v.*")


def visit_errors(decided: DataFrame, fetch_errors: DataFrame, key: str = "page_id") -> DataFrame:
    """F6 for a whole visit: a row for every URL that was not fetched because of its host or robots rules
    (``decided`` has error_reason, '' for the others), and the fetch errors of those that were."""
    barred = decided.where(F.col("error_reason") != "").select(key, "url", F.col("error_reason").alias("reason"), F.lit("").alias("status"))
    fetched = decided.where(F.col("error_reason") == "").select(key)
    return barred.unionByName(fetch_errors.join(fetched, key, "left_semi"))
