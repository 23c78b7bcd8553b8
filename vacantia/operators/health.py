"""Board health from landed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.sources.payloads import parsed

HEALTH_CHECKED = ("greenhouse", "lever", "ashby", "smartrecruiters")


def board_health(watchlist: DataFrame, landing: DataFrame) -> DataFrame:
    """One row per watched board: alive, number of postings, detail text.

    The latest response of each board counts. An empty board is alive, except
    where the provider answers 200 for unknown boards. An answer that cannot be
    read is not alive.
    """
    paged = F.col("ats") == "smartrecruiters"
    counted = F.when(paged, F.col("total")).otherwise(F.size("elements")).cast("bigint")
    answers = (parsed(landing.filter(F.col("ats").isin(*HEALTH_CHECKED)))
               .select("ats", "token", "fetched_at", "status", "readable",
                       F.when((F.col("status") == 200) & F.col("readable"), counted).alias("postings")))
    latest = (answers.groupBy("ats", "token")
              .agg(F.max_by(F.struct("status", "readable", "postings"),
                            F.struct("fetched_at", "postings")).alias("r"))
              .select("ats", "token", "r.*"))
    suspect = paged & (F.col("postings") == 0)
    alive = (F.col("status") == 200) & F.col("readable") & ~F.coalesce(suspect, F.lit(False))
    detail = (F.when(F.col("status").isNull(), "no response")
              .when(F.col("status") == 404, "404")
              .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status")))
              .when(~F.col("readable"), "unreadable answer")
              .when(suspect, fv.SUSPECT_BOARD)
              .otherwise(F.concat(F.col("postings"), F.lit(" postings"))))
    return (watchlist.join(latest, ["ats", "token"], "left")
            .select("ats", "token", F.coalesce(alive, F.lit(False)).alias("alive"),
                    "postings", detail.alias("detail")))


def dead_boards(health: DataFrame) -> DataFrame:
    return health.groupBy("ats").agg(F.count("*").alias("boards"),
                                     F.count_if(~F.col("alive")).alias("dead"))
