"""Landed board payloads to typed postings.

Input is the landing table ``(ats, token, fetched_at, status, body)``. A body
is parsed once into VARIANT elements, whatever the provider, and fields are
read from the elements; the element itself is kept as ``raw``. All providers
go through one scan and one explode, without a shuffle (``typed``); postings,
board names and outcomes are read off that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia import schemas
from vacantia.functions.text import first_non_empty, non_empty, section_text

# The job source and the board type differ in name for two providers.
SOURCE_OF = {"greenhouse": "greenhouse", "lever": "lever", "ashby": "ashby",
             "smartrecruiters": "smartrec", "github_repos": "github_repo"}
MISSING_BOARD_ALLOWED = ("greenhouse", "lever", "ashby")

# what is known of an element without its payload
KEYS = ["source", "external_id", "ats", "token", "fetched_at", "page", "position", "company", "status", "readable",
        "shown"]

# seconds of the first day of year 1 and the last of year 9999
EPOCH_FIRST, EPOCH_LAST = -62_135_596_800, 253_402_300_799

_JOBS = "struct<jobs:array<variant>,_corrupt_record:string>"
_PAGE = "struct<totalFound:bigint,offset:bigint,content:array<variant>,_corrupt_record:string>"
_ROWS = "array<variant>"
_TIMED = "array<struct<raw:variant,stated:boolean,posted_at:timestamp,shown:boolean>>"
# what each element is read for before its payload
_HEADS = {"greenhouse": "first_published:string,updated_at:string", "lever": "createdAt:bigint",
          "ashby": "publishedAt:string,isListed:variant", "smartrecruiters": "releasedDate:string",
          "github_repos": "date_posted:bigint,active:variant,is_visible:variant"}


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landing files as JSON lines with an explicit schema."""
    return spark.read.schema(schemas.LANDING).json(path)


def value_at(raw: Column, path: str, kind: str) -> Column:
    """The value of a field, NULL where it is missing or of another kind.

    The object is read as a struct of this field: a path that leads nowhere costs many times a field that is NULL.
    """
    names, value = path.removeprefix("$.").split("."), kind
    for name in reversed(names):
        value = f"struct<`{name}`:{value}>"
    out = F.try_variant_get(raw, "$", value)
    for name in names:
        out = out.getField(name)
    return out


def text_at(raw: Column, path: str) -> Column:
    return value_at(raw, path, "string")


def switched_on(flag: Column) -> Column:
    """A flag that defaults to true; an explicit null, false, 0 or '' is off."""
    return F.coalesce(~F.lower(F.try_variant_get(flag, "$", "string")).isin("false", "0", ""), flag.isNull())


def instant(text: Column) -> Column:
    """ISO-8601 text with offset or Z to an instant; empty text is NULL."""
    return non_empty(text).try_cast("timestamp")


def epoch(number: Column, per_second: int) -> Column:
    """A non-zero epoch number; what lies outside of the calendar is NULL."""
    return F.when((number != 0) & number.between(EPOCH_FIRST * per_second, EPOCH_LAST * per_second), number)


def answered(status: Column) -> Column:
    return status.between(200, 299)


def answers(landing: DataFrame) -> DataFrame:
    """The answered responses. Only these hold postings; what the rest says is not looked at."""
    return landing.filter(answered(F.col("status")))


def parsed(landing: DataFrame) -> DataFrame:
    """Landing rows with their parsed parts.

    ``elements`` holds the postings with their times (see ``_with_times``), ``total`` and ``page`` the paging fields,
    ``readable`` tells whether an answered body parses and all its times are
    times. One that does not is lost with all its elements; others go on.
    """
    in_jobs, in_page = F.col("ats").isin("greenhouse", "ashby"), F.col("ats") == "smartrecruiters"
    ok = answered(F.col("status"))
    # what was not answered is not looked at, so that a body made on the way is not made for it
    shapes = landing.withColumn("body", F.when(ok, F.col("body"))).withColumns({
        "jobs": F.when(ok & in_jobs, F.from_json("body", _JOBS)),
        "paged": F.when(ok & in_page, F.from_json("body", _PAGE)),
        "rows": F.when(ok & ~in_jobs & ~in_page, F.from_json("body", _ROWS))})
    intact = (F.when(in_jobs, F.col("jobs._corrupt_record").isNull())
              .when(in_page, F.col("paged._corrupt_record").isNull())
              .otherwise(F.col("rows").isNotNull()))
    elements = (F.when(in_jobs, F.col("jobs.jobs")).when(in_page, F.col("paged.content"))
                .otherwise(F.col("rows")))
    listed = shapes.select(
        "ats", "token", "fetched_at", "status", (ok & intact).alias("intact"),
        _with_times(F.coalesce(elements, F.array().cast(_ROWS))).alias("listed"),
        F.coalesce("paged.totalFound", F.lit(0)).alias("total"),
        F.coalesce("paged.offset", F.lit(0)).alias("page"))
    readable = F.col("intact") & F.forall("listed", lambda e: F.coalesce(~e.stated | e.posted_at.isNotNull(), F.lit(True)))
    return listed.select(
        "ats", "token", "fetched_at", "status", readable.alias("readable"),
        F.when(readable, F.col("listed")).otherwise(F.array().cast(_TIMED)).alias("elements"), "total", "page")


def _with_times(elements: Column) -> Column:
    """Elements as ``(raw, stated, posted_at, shown)``.

    ``stated`` tells whether there is a posting time, ``posted_at`` is the time if it is one, ``shown`` whether the provider
    still shows the posting. Reading a variant costs more than all that follows, so these fields are read at once
    and held by one transform; an expression that names them twice would read them twice.
    """
    read = F.transform(elements, lambda e: F.struct(
        e.alias("raw"), *[F.when(F.col("ats") == ats, F.try_variant_get(e, "$", f"struct<{fields}>")).alias(ats)
                          for ats, fields in _HEADS.items()]))
    return F.transform(read, _head)


def _head(e: Column) -> Column:
    text = _by_provider({"greenhouse": first_non_empty(e.greenhouse.first_published, e.greenhouse.updated_at),
                         "ashby": e.ashby.publishedAt, "smartrecruiters": e.smartrecruiters.releasedDate})
    number = _by_provider({"lever": e.lever.createdAt, "github_repos": e.github_repos.date_posted})
    posted = _by_provider({"lever": F.timestamp_millis(epoch(number, 1000)),
                           "github_repos": F.timestamp_seconds(epoch(number, 1))}, instant(text))
    shown = _by_provider({"ashby": switched_on(e.ashby.isListed),
                          "github_repos": switched_on(e.github_repos.active) & switched_on(e.github_repos.is_visible)}, F.lit(True))
    return F.struct(e.raw.alias("raw"), (non_empty(text).isNotNull() | (number != 0)).alias("stated"),
                    posted.alias("posted_at"), shown.alias("shown"))


# --- fields per provider ----------------------------------------------------------

# ``at`` gives the value of a path, text unless another kind is named

def _greenhouse(at: Callable[..., Column]) -> dict[str, Column]:
    return {
        "external_id": at("$.id"), "title": at("$.title"),
        "location": at("$.location.name"), "url": at("$.absolute_url"),
        "description": at("$.content"), "company": at("$.company_name")}


def _lever(at: Callable[..., Column]) -> dict[str, Column]:
    return {
        "external_id": at("$.id"), "title": at("$.text"),
        "location": at("$.categories.location"), "url": at("$.hostedUrl"),
        "description": F.coalesce(non_empty(at("$.descriptionPlain")), at("$.description")),
        "company": F.lit(None).cast("string")}


def _ashby(at: Callable[..., Column]) -> dict[str, Column]:
    return {
        "external_id": at("$.id"), "title": at("$.title"),
        "location": at("$.location"), "url": at("$.jobUrl"),
        "description": F.coalesce(non_empty(at("$.descriptionPlain")), at("$.descriptionHtml")),
        "company": F.lit(None).cast("string")}


def _smartrecruiters(at: Callable[..., Column]) -> dict[str, Column]:
    """The list has no description and no posting URL."""
    job = at("$.id")
    return {
        "external_id": job, "title": at("$.name"),
        "location": F.coalesce(non_empty(at("$.location.fullLocation")), at("$.location.city")),
        "url": F.concat(F.lit(fv.SMARTRECRUITERS_URL), F.col("token"), F.lit("/"), job),
        "description": F.lit(None).cast("string"), "company": at("$.company.name")}


def _listing(at: Callable[..., Column]) -> dict[str, Column]:
    places = at("$.locations", "array<string>")
    return {
        "external_id": at("$.id"), "title": at("$.title"),
        "location": non_empty(F.array_join(places, ", ")), "url": at("$.url"),
        "description": F.lit(None).cast("string"), "company": at("$.company_name")}


FIELDS = {"greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby,
          "smartrecruiters": _smartrecruiters, "github_repos": _listing}


def _struct_type(of: Callable[[Callable[..., Column]], dict[str, Column]]) -> str:
    """Type of a struct that holds every field that ``of`` asks for."""
    tree: dict = {}

    def noted(path: str, kind: str = "string") -> Column:
        *above, last = path.removeprefix("$.").split(".")
        node = tree
        for name in above:
            node = node.setdefault(name, {})
        node[last] = kind
        return F.lit(None).cast(kind)

    def text(node: dict) -> str:
        return "struct<" + ",".join(f"`{k}`:{v if isinstance(v, str) else text(v)}" for k, v in node.items()) + ">"

    of(noted)
    return text(tree)


def _by_provider(values: dict[str, Column], other: Column | None = None) -> Column:
    (ats, value), *rest = values.items()
    out = F.when(F.col("ats") == ats, value)
    for ats, value in rest:
        out = out.when(F.col("ats") == ats, value)
    return out if other is None else out.otherwise(other)


def typed(landing: DataFrame, whole: bool = False) -> DataFrame:
    """One pass over the landing table: a typed row per element.

    A response without elements keeps one row with a NULL position, so boards
    and outcomes can be told from the same table. ``shown`` marks postings.
    Fields are read one by one, so that those that nobody asks for are not read;
    a caller that needs the ``whole`` row has them read at once, which costs about as much as one of them.
    """
    raw, ats = F.col("element.raw"), F.col("ats")
    rows = parsed(landing).select(
        "ats", "token", "fetched_at", "status", "readable", "page",
        F.posexplode_outer("elements").alias("position", "element"))
    if whole:
        rows = rows.select("*", *[F.when(ats == a, F.try_variant_get(raw, "$", _struct_type(of))).alias(f"of_{a}")
                                  for a, of in FIELDS.items()])

    def reader(a: str) -> Callable[..., Column]:
        if not whole:
            return lambda path, kind="string": value_at(raw, path, kind)
        return lambda path, kind="string": F.col(f"of_{a}.{path.removeprefix('$.')}")

    fields = {a: of(reader(a)) for a, of in FIELDS.items()}
    named = {n: _by_provider({a: f[n] for a, f in fields.items()}).alias(n) for n in fields["greenhouse"]}
    company = named.pop("company")
    return rows.select(
        _by_provider({a: F.lit(s) for a, s in SOURCE_OF.items()}).alias("source"),
        "ats", "token", "fetched_at", "position", *named.values(),
        F.col("element.posted_at").alias("posted_at"), raw.alias("raw"), "status", "readable", "page", company,
        (F.col("position").isNotNull() & F.col("element.shown")).alias("shown"))


def postings(rows: DataFrame) -> DataFrame:
    """The postings among typed rows."""
    return rows.filter("shown").drop("status", "readable", "shown")


def all_postings(landing: DataFrame) -> DataFrame:
    """Every provider in one shape."""
    return postings(typed(answers(landing))).drop("company", "page")


def postings_of(landing: DataFrame, ats: str) -> DataFrame:
    """The postings of one provider; the condition reaches the landing scan."""
    return all_postings(landing.filter(F.col("ats") == ats))


# --- companies and boards -----------------------------------------------------------

def _per_response(rows: DataFrame) -> DataFrame:
    return rows.filter("position IS NULL OR position = 0")


def with_run(rows: DataFrame, *board: str) -> DataFrame:
    """Adds ``run``: the number of the run of its board that a response belongs to.

    A pause of more than ``RUN_PAUSE_MINUTES`` between responses of a board starts a new run.
    """
    order = Window.partitionBy(*board).orderBy("fetched_at")
    pause = F.make_dt_interval(mins=F.lit(fv.RUN_PAUSE_MINUTES))
    begins = F.coalesce(F.col("fetched_at") > F.lag("fetched_at").over(order) + pause, F.lit(True))
    return (rows.withColumn("begins", begins.cast("int"))
            .withColumn("run", F.sum("begins").over(order)).drop("begins"))


def board_companies(rows: DataFrame) -> DataFrame:
    """Company names of the boards: ``(ats, token, fetched_at, name)``.

    Empty boards still name a company, except paged boards, where the first
    item of the first non-empty page gives the name. Listing files are no
    boards; they name the company on every row. A board has one name per run:
    pages that were fetched shortly after one another are one run.
    """
    named = (F.col("ats") != "smartrecruiters") | F.col("position").isNotNull()
    own = F.when(F.col("ats").isin("greenhouse", "smartrecruiters"), F.col("company"))
    page = F.when(named & F.col("readable"), F.struct("page", "fetched_at", own.alias("own")))
    # a filter on what the parse tells would be moved below it, and each body parsed twice; so it comes after the aggregate
    # dealt by board, responses need no further shuffle for the runs of their board
    times = (_per_response(answers(rows)).filter(F.col("ats") != "github_repos").repartition("ats", "token")
             .groupBy("ats", "token", "fetched_at").agg(F.min(page).alias("p"), F.bool_or("readable").alias("any")).filter("any").drop("any"))
    runs = with_run(times, "ats", "token")
    first = F.min("p").over(Window.partitionBy("ats", "token", "run"))
    return (runs.withColumn("first", first).filter("first IS NOT NULL")
            .select("ats", "token", "fetched_at", first_non_empty(F.col("first.own"), F.col("token")).alias("name")))


def has_company() -> Column:
    """Whether a posting can be given a company: listings name it, boards have a token."""
    return (F.when(F.col("ats") == "github_repos", F.col("company").isNotNull())
            .otherwise(F.col("token").isNotNull() & F.col("fetched_at").isNotNull()))


def with_company_name(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Attach the company name each posting belongs to.

    Listings name their company themselves and stay out of the join, where all
    rows of a listing file would meet under one key. What else ``boards`` tell is NULL for them.
    """
    listing = F.coalesce(F.col("ats") == "github_repos", F.lit(False))
    of_boards = rows.filter(~listing).drop("company").join(boards, ["ats", "token", "fetched_at"], "left")
    return of_boards.unionByName(rows.filter(listing).withColumnRenamed("company", "name"), allowMissingColumns=True)


def company_sightings(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Rows for the company upsert: boards with their token, listings without. What else ``boards`` tell is kept."""
    listed = (rows.filter("shown AND ats = 'github_repos'").groupBy(F.col("company").alias("name"))
              .agg(F.min("fetched_at").alias("fetched_at"))
              .select("name", F.lit(None).cast("string").alias("ats_type"),
                      F.lit(None).cast("string").alias("ats_token"), "fetched_at"))
    told = boards.withColumnsRenamed({"ats": "ats_type", "token": "ats_token"}).unionByName(listed, allowMissingColumns=True)
    return told.withColumn("seq", F.unix_micros("fetched_at")).drop("fetched_at")


def board_status(rows: DataFrame) -> DataFrame:
    """Outcome per landed response: ``ok``, ``missing`` or ``failed``.

    A 404 means a missing board where the provider uses it that way; any other
    error, or a body that does not parse, fails that board only.
    """
    gone = (F.col("status") == 404) & F.col("ats").isin(*MISSING_BOARD_ALLOWED)
    outcome = F.when(gone, "missing").when(F.col("readable"), "ok").otherwise("failed")
    return _per_response(rows).select("ats", "token", "fetched_at", "status",
                                      outcome.alias("outcome"))


# --- details ------------------------------------------------------------------------

def _readable_details(detail: DataFrame, schema: str) -> DataFrame:
    """Details ``d`` whose body parses and, where a status is given, whose request was answered.

    ``fetched_at`` is kept, or NULL where the input has none.
    """
    ok = answered(F.col("status")) if "status" in detail.columns else F.lit(True)
    at = F.col("fetched_at") if "fetched_at" in detail.columns else F.lit(None)
    with_rest = schema[:-1] + ",_corrupt_record:string>"
    return (detail.filter(ok).select("external_id", at.cast("timestamp").alias("fetched_at"),
                                     F.from_json("body", with_rest).alias("d"))
            .filter("d IS NOT NULL AND d._corrupt_record IS NULL"))


def smartrecruiters_details(detail: DataFrame) -> DataFrame:
    """Detail payloads ``(external_id, body[, fetched_at, status])`` to text and exact URL."""
    return (_readable_details(detail, schemas.SMARTRECRUITERS_DETAIL)
            .select(F.lit("smartrec").alias("source"), "external_id",
                    section_text(F.col("d.jobAd.sections")).alias("description"),
                    F.col("d.postingUrl").alias("url"), "fetched_at"))


def greenhouse_details(detail: DataFrame) -> DataFrame:
    return (_readable_details(detail, schemas.GREENHOUSE_DETAIL)
            .select(F.lit("greenhouse").alias("source"), "external_id",
                    F.col("d.content").alias("description"),
                    F.lit(None).cast("string").alias("url"), "fetched_at"))
