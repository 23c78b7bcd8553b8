"""Incremental load: insert-if-absent, company upsert, slice reload, details.

There is no MERGE on plain Parquet, so the operators return new rows or the
new table state and the writers at the end append or overwrite partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import is_new_grad, non_empty, normalize_company
from vacantia.operators.keystore import KeyStore
from vacantia.session import stash

JOB_KEY = ("source", "external_id")
KEY_TYPES = {"source": "string", "external_id": "string"}


def job_id(source: Column, external_id: Column, *otherwise: Column) -> Column:
    """Deterministic id; rows without an external id are told apart by the rest."""
    rest = F.concat_ws("\u0001", *otherwise)
    return F.sha2(F.concat_ws("\u0000", source, F.coalesce(external_id, F.concat(F.lit("\u0002"), rest))), 256)


def company_id(name_normalized: Column) -> Column:
    return F.sha2(name_normalized, 256)


def first_arrivals(arrivals: DataFrame, order_by: list[str], keys: tuple[str, ...] = JOB_KEY) -> DataFrame:
    """The first arrival per key; copies of a key are combined before the shuffle. No key is NULL."""
    rest = [c for c in arrivals.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by))
    kinds = " ".join(t for _, t in arrivals.dtypes)
    if set(order_by) <= set(rest) and "variant" not in kinds and "map<" not in kinds:
        # the same row, without the columns of the order twice; only types that can be compared allow it
        first = F.min(F.struct(*order_by, *[c for c in rest if c not in order_by]))
    return arrivals.groupBy(*keys).agg(first.alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def insert_if_absent(arrivals: DataFrame, stored: DataFrame | KeyStore, order_by: list[str],
                     keys: tuple[str, ...] = JOB_KEY) -> DataFrame:
    """The arrivals to add: unknown keys only, the first arrival per key.

    The de-duplication comes first: it combines copies of a key before the
    shuffle, so a key that holds most of a batch never meets in one task, and
    the anti join reuses its partitioning. A ``KeyStore`` is asked through its
    filter and is not shuffled. Rows with a NULL key conflict with nothing and all pass.
    """
    keyless = " OR ".join(f"{k} IS NULL" for k in keys)
    first = first_arrivals(arrivals.filter(f"NOT ({keyless})"), order_by, keys)
    fresh = (stored.absent(first) if isinstance(stored, KeyStore)
             else first.join(stored.select(*keys), list(keys), "left_anti"))
    return fresh.select(*arrivals.columns).unionByName(arrivals.filter(keyless))


def one_per_key(rows: DataFrame, order_by: list[str], keys: tuple[str, ...] = JOB_KEY) -> DataFrame:
    """The first row per key, for wide rows whose keys rarely repeat.

    Repeated keys are found on the key columns alone; only their rows are
    combined, all others pass as they are. NULL keys all pass. The repeated
    keys are written, so that few of them do not shuffle the wide rows.
    """
    keyless = F.expr(" OR ".join(f"{k} IS NULL" for k in keys))
    repeated = stash(rows.filter(~keyless).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys),
                     "repeated-keys")
    if repeated.isEmpty():
        return rows
    rest = [c for c in rows.columns if c not in keys]
    first = (rows.join(repeated, list(keys), "left_semi").groupBy(*keys)
             .agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("r")).select(*keys, "r.*"))
    return (rows.join(repeated, list(keys), "left_anti").select(*rows.columns)
            .unionByName(first.select(*rows.columns)))


def upsert_companies(stored: DataFrame, incoming: DataFrame, saved_as: str | None = None) -> DataFrame:
    """New company state from ``incoming(name, ats_type, ats_token, seq[, name_normalized])``.

    The first name stays. Board type and token change only to a non-empty
    value, so a source without boards cannot erase a token. With ``saved_as``
    the state is written under that label, without the ids that follow from the names.
    """
    own = [c for c in stored.columns
           if c not in ("name", "name_normalized", "ats_type", "ats_token")]
    old = stored.select(
        "name_normalized", "name", "ats_type", "ats_token",
        F.lit(None).cast("bigint").alias("seq"), F.struct(*own).alias("own"))
    # what is normalized already is not normalized again
    key = F.col("name_normalized") if "name_normalized" in incoming.columns else normalize_company(F.col("name"))
    new = incoming.select(
        key.alias("name_normalized"), "name", "ats_type",
        "ats_token", F.col("seq").cast("bigint").alias("seq"),
        F.lit(None).cast(old.schema["own"].dataType).alias("own"))
    # NULL sorts first, so the stored row precedes every incoming one.
    order = F.struct("seq", "name", "ats_type", "ats_token")

    def latest(c: str) -> Column:
        given = non_empty(F.col(c)).isNotNull()
        return F.coalesce(F.max_by(c, F.when(given, order)), F.min_by(c, order)).alias(c)

    merged = (old.unionByName(new).groupBy("name_normalized")
              .agg(F.min_by("name", order).alias("name"), latest("ats_type"),
                   latest("ats_token"),
                   F.max_by("own", F.when(F.col("own").isNotNull(), 1)).alias("own")))
    if saved_as is not None:
        merged = stash(merged, saved_as)
    fill = {"id": company_id(F.col("name_normalized")), "sponsor_status": F.lit("unknown")}
    return merged.select(*[
        F.coalesce(F.col(f"own.{c}"), fill[c]).alias(c) if c in own and c in fill
        else F.col(f"own.{c}").alias(c) if c in own else F.col(c)
        for c in stored.columns])


def with_company_id(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Look up ``company_id`` by normalized name; the lookup side is unique.

    Postings that bring ``name_normalized`` are looked up by it, others by their ``name``. Companies
    compress well and grow with the boards, so their size in files must not make the driver collect them.
    """
    lookup = companies.select(F.col("id").alias("company_id"), "name_normalized")
    keyed = (postings if "name_normalized" in postings.columns
             else postings.withColumn("name_normalized", normalize_company(F.col("name"))))
    return keyed.join(lookup.hint("merge"), "name_normalized")


def posting_id() -> Column:
    """``job_id`` of a posting."""
    return job_id(F.col("source"), F.col("external_id"), F.col("url"), F.col("title"), F.col("posted_at").cast("string"))


def new_job_rows(postings: DataFrame, seen_at: Column) -> DataFrame:
    """Fill the load-time defaults of a job row; ``id`` and ``is_new_grad`` are taken from postings that have them."""
    def given(name: str, value: Column) -> Column:
        return (F.col(name) if name in postings.columns else value).alias(name)

    return postings.select(
        given("id", posting_id()),
        "company_id", "source", "external_id", "title", "location", "url", "description",
        "posted_at", seen_at.alias("first_seen_at"), "raw",
        given("is_new_grad", is_new_grad(F.col("title"), F.col("description"))),
        F.lit("new").alias("status"), F.lit(None).cast("string").alias("note"),
        "ats", "token", "fetched_at", "page", "position", _insert_rank().alias("insert_rank"))


def _insert_rank() -> Column:
    """Insert order of a board: newest first for the paged provider, undated last, else as listed."""
    paged = F.col("source") == "smartrec"
    newest = F.coalesce(-F.unix_micros("posted_at"), F.lit(2**62))
    return F.when(paged, newest).otherwise(F.lit(0))


def detail_selection(new_jobs: DataFrame) -> DataFrame:
    """New rows that get a detail payload, capped per board.

    One provider is taken newest first with undated rows last, the other in
    payload order. ``row_number <= cap`` becomes a per-task limit before the
    shuffle, so a board with a huge backlog sends few rows.
    """
    capped = new_jobs.filter(F.col("source").isin(*fv.DETAIL_CAPS))
    newest = F.when(F.col("source") == "smartrec", F.col("posted_at"))
    board = Window.partitionBy("source", "token").orderBy(
        newest.desc_nulls_last(), "fetched_at", "position", "external_id")
    cap = F.create_map(*[F.lit(x) for pair in fv.DETAIL_CAPS.items() for x in pair])
    return (capped.withColumn("rank", F.row_number().over(board))
            .filter(F.col("rank") <= max(fv.DETAIL_CAPS.values()))
            .filter(F.col("rank") <= cap[F.col("source")]))


def apply_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Set description, URL and the new-grad flag from detail rows.

    ``details(source, external_id, description, url[, fetched_at])``. One
    provider writes only non-empty text, the other writes whatever came, and a
    posting URL replaces the constructed one. The newest detail of a posting
    counts, so no job is repeated; jobs without a detail stay as they are.
    """
    at = F.col("fetched_at") if "fetched_at" in details.columns else F.lit(None).cast("timestamp")
    newest = F.max_by(F.struct("description", "url"), F.struct(at, "description", "url"))
    d = (details.groupBy(*JOB_KEY).agg(newest.alias("d"))
         .select(*JOB_KEY, F.col("d.description").alias("new_description"),
                 F.col("d.url").alias("new_url"), F.lit(True).alias("has_detail")))
    text = F.col("new_description")
    hit = (F.coalesce(F.col("has_detail"), F.lit(False))
           & ((F.col("source") == "smartrec") | non_empty(text).isNotNull()))
    return (jobs.join(d, list(JOB_KEY), "left")
            .withColumns({
                "description": F.when(hit, text).otherwise(F.col("description")),
                "url": F.when(hit, F.coalesce("new_url", "url")).otherwise(F.col("url")),
                "is_new_grad": F.when(hit, is_new_grad(F.col("title"), text))
                                .otherwise(F.col("is_new_grad"))})
            .select(*jobs.columns))


def replace_slice(stored: DataFrame, incoming: DataFrame, src: str) -> DataFrame:
    """Table state after deleting and reloading one ``src`` slice."""
    kept = stored.filter(~F.col("src").eqNullSafe(src))
    return kept.unionByName(incoming.filter(F.col("src") == src))


def write_slice(incoming: DataFrame, path: str) -> None:
    """Overwrite exactly the ``src`` partitions present in ``incoming``."""
    (incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("src").parquet(path))


def append_jobs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("source").parquet(path)
