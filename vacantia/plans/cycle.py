"""One poll cycle over landed responses, from payloads to alerts and run log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import is_new_grad, normalize_company
from vacantia.operators import alerts, load, runlog
from vacantia.operators.keystore import KeyStore
from vacantia.session import stash
from vacantia.sources import payloads

ORDER = ["fetched_at", "ats", "token", "page", "position"]
# what a posting is told by; all else of it is its payload and stays where it was saved
_TOLD = [*load.JOB_KEY, *ORDER, "row", "company", "posted_at", "is_new_grad", "loose_id"]
_PAYLOAD = ["title", "location", "url", "description", "raw"]


class Cycle(NamedTuple):
    companies: DataFrame  # new company state
    new_jobs: DataFrame   # rows to append
    alerts: DataFrame
    run_log: DataFrame


def poll(landing: DataFrame, companies: DataFrame, job_keys: DataFrame | KeyStore, as_of: Column,
         notified: DataFrame | None = None, details: DataFrame | None = None,
         watchlist: DataFrame | None = None) -> Cycle:
    """Parse, name, upsert, look up, classify, insert, add details, select alerts, count.

    ``job_keys(source, external_id)`` are the stored postings, as a table or as a
    ``KeyStore``, to which the caller adds the new rows when they are written. The
    landing table is parsed once and its typed rows are saved, each under a row
    number. All steps move narrow columns and these numbers; the payload is
    written once and meets the new rows where they are used, by number, with the
    columns that are asked for. Ids that follow from a key or a name are made
    when they are read and not saved. ``details`` (see ``load.apply_details``) are
    taken for the new rows that ``detail_selection`` chooses, before the alerts
    look at the flag. Boards of ``watchlist`` that did not answer count as failed.
    """
    rows = stash(_numbered(payloads.typed(landing, whole=True)), "cycle-rows")
    boards = stash(payloads.board_companies(rows).withColumn("name_normalized", normalize_company(F.col("name"))), "cycle-boards")
    state = load.upsert_companies(companies, _normalized(payloads.company_sightings(rows, boards)), "cycle-companies")
    arrivals = payloads.postings(rows).filter(payloads.has_company()).select(*_TOLD)
    fresh = stash(load.insert_if_absent(arrivals, job_keys, [*ORDER, "row"]), "cycle-fresh")
    named = load.with_company_id(_normalized(payloads.with_company_name(fresh, boards)).drop("name"), state)
    by_name = load.company_id(F.col("name_normalized"))
    own_id = F.when(F.col("company_id") != by_name, F.col("company_id")).alias("own_id")
    inserted = stash(named.select(*[c for c in _TOLD if c != "company"], "name_normalized", own_id), "cycle-inserted")
    found = inserted.withColumns({
        "company_id": F.coalesce("own_id", by_name),
        "id": F.coalesce("loose_id", load.job_id(F.col("source"), F.col("external_id")))})
    new_jobs = load.new_job_rows(found.join(_payload(rows), "row", "left"), as_of)
    if details is not None:
        wanted = load.detail_selection(new_jobs).select(*load.JOB_KEY)
        # only rows of providers with details meet them
        may = F.col("source").isin(*fv.DETAIL_CAPS)
        told = load.apply_details(new_jobs.filter(may), details.join(wanted, list(load.JOB_KEY), "left_semi"))
        new_jobs = told.unionByName(new_jobs.filter(~F.coalesce(may, F.lit(False))))
    sent = alerts.select_alerts(new_jobs, state, run=("source",), notified=notified,
                                insert_order=("token", "insert_rank", "fetched_at", "page", "position", "id"))
    log = runlog.poll_summary(payloads.board_status(rows), new_jobs, ran_at=as_of, watchlist=watchlist)
    return Cycle(state, new_jobs, sent, log)


def _normalized(named: DataFrame) -> DataFrame:
    """Named rows with their normalized name. Boards bring theirs, made once for all of their postings; listings bring a name only."""
    return named.withColumn("name_normalized", F.coalesce("name_normalized", normalize_company(F.col("name"))))


def _numbered(rows: DataFrame) -> DataFrame:
    """Typed rows with a number, the new-grad flag and, where there is no key to make it from, the id.

    What is no posting carries no payload.
    """
    shown = F.col("shown")
    return rows.withColumns({
        "row": F.monotonically_increasing_id(),
        "is_new_grad": F.when(shown, is_new_grad(F.col("title"), F.col("description"))),
        "loose_id": F.when(shown & F.col("external_id").isNull(), load.posting_id()),
    }).withColumns({c: F.when(shown, F.col(c)) for c in _PAYLOAD})


def _payload(rows: DataFrame) -> DataFrame:
    """The payload per row number.

    Numbers are unique; grouped by them, a reader that asks for no payload is known to lose no row without this side,
    and the planner leaves it out.
    """
    return (rows.filter("shown").select("row", *_PAYLOAD).repartition("row").groupBy("row")
            .agg(*[F.first(c).alias(c) for c in _PAYLOAD]))
