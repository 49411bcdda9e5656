"""Sources and sinks: delimited files, nested JSON feeds, parquet with pushdown, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that mean null in delimited files.
NULLS = ("", "NA", "null")


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """Delimited files with a header; ``NULLS`` are null, headers and values are trimmed, only ``columns`` are kept.

    Values are read as strings, then cast: a malformed one becomes null instead of shifting a row.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = spark.read.csv(paths, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in raw.columns}
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    picked = []
    for f in fields:
        value = F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None).cast("string")
        picked.append(F.when(~value.isin(*NULLS), value).try_cast(f.dataType).alias(f.name))
    return raw.select(*picked)


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parts(spark: SparkSession, parts: list[tuple[list[str], str]], keep: DataFrame, key: str) -> DataFrame:
    """Delimited parts of different layouts as one table, restricted to the keys of ``keep``."""
    return union_by_name([read_csv(spark, paths, schema) for paths, schema in parts]).join(keep.select(key).distinct(), key, "left_semi")


def read_period(spark: SparkSession, path: str, columns: list[str], day: str, first: str, last: str, where: Column | None = None) -> DataFrame:
    """Columns of parquet rows in a period: columns and limits reach the scan."""
    rows = spark.read.parquet(path).filter(F.col(day).between(F.lit(first), F.lit(last)))
    return (rows if where is None else rows.filter(where)).select(*columns)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited reference table, or an empty one where the file is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return read_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


SCHEDULE = "dates array<struct<date: string, games: array<struct<gamePk: long, gameType: string, officialDate: string, status: struct<abstractGameState: string, detailedState: string>, teams: struct<away: struct<team: struct<id: long>>, home: struct<team: struct<id: long>>>>>>>"


def schedule(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """Regular games of schedule documents: the game's own date, else that of the day it is listed under."""
    day = documents.select(F.explode(F.from_json(json_col, SCHEDULE)["dates"]).alias("d"))
    game = day.select(F.col("d.date").alias("listed"), F.explode("d.games").alias("g")).filter("g.gameType = 'R'")
    return game.select(
        F.col("g.gamePk").alias("game_pk"), F.to_date(F.coalesce("g.officialDate", "listed")).alias("game_date"), F.col("g.status.abstractGameState").alias("phase"), F.col("g.status.detailedState").alias("status"),
        F.col("g.teams.away.team.id").alias("away_team_id"), F.col("g.teams.home.team.id").alias("home_team_id"),
    )


def completed(games: DataFrame) -> DataFrame:
    final = F.coalesce(F.col("phase") == "Final", F.lit(False)) | F.col("status").isin("Final", "Completed Early", "Game Over")
    return games.filter(final & ~F.col("status").isin("Cancelled", "Postponed")).dropDuplicates(["game_pk"])


def monthly_periods(games: DataFrame) -> DataFrame:
    """First and last day of completed games in each month."""
    return completed(games).groupBy(F.date_format("game_date", "yyyy-MM").alias("month")).agg(F.min("game_date").alias("start"), F.max("game_date").alias("end"))


_REVIEW = "reviewType: string, isOverturned: boolean, challengeTeamId: long, player: struct<id: long, fullName: string>"
REVIEW = f"struct<{_REVIEW}, additionalReviews: array<struct<{_REVIEW}>>>"
FEED = (
    "gamePk long, gameData struct<datetime: struct<officialDate: string>, status: struct<detailedState: string>, teams: struct<away: struct<id: long>, home: struct<id: long>>, "
    "players: map<string, struct<primaryPosition: struct<code: string>>>, absChallenges: struct<hasChallenges: boolean, away: struct<usedSuccessful: int, usedFailed: int, remaining: int>, home: struct<usedSuccessful: int, usedFailed: int, remaining: int>>>, "
    "liveData struct<boxscore: struct<officials: array<struct<officialType: string, official: struct<id: long, fullName: string>>>>, plays: struct<allPlays: array<struct<atBatIndex: int, about: struct<isTopInning: boolean, inning: int>, "
    f"matchup: struct<batter: struct<id: long>, pitcher: struct<id: long>>, reviewDetails: {REVIEW}, playEvents: array<struct<isPitch: boolean, index: int, pitchNumber: int, playId: string, "
    f"details: struct<call: struct<code: string, description: string>>, count: struct<balls: int, strikes: int, outs: int>, pitchData: struct<coordinates: struct<pX: double, pZ: double>, strikeZoneTop: double, strikeZoneBottom: double>, reviewDetails: {REVIEW}>>>>>>"
)
#: Fixed value: the review type of challenges to the zone.
ZONE_REVIEW = "MJ"


def reviews(details: Column) -> Column:
    """A review and its additional ones as one array; empty for null."""
    flat = lambda r: F.struct(*[r[n].alias(n) for n in ("reviewType", "isOverturned", "challengeTeamId", "player")])
    more = F.coalesce(F.transform(details["additionalReviews"], flat), F.array())
    return F.when(details.isNull(), F.array().cast(f"array<struct<{_REVIEW}>>")).otherwise(F.concat(F.array(flat(details)), more))


def feed(documents: DataFrame, json_col: str = "value") -> DataFrame:
    return documents.select(F.from_json(json_col, FEED).alias("f")).select("f.*")


def called_pitches(feeds: DataFrame) -> DataFrame:
    """One row per pitch that was called a ball or a strike, with the zone review made on it, if any.

    A review listed with the plate appearance belongs to its last pitch, unless the pitch's own details hold it already.
    """
    from stakewise.functions.scalar import normal_call

    plays = feeds.select("gamePk", "gameData", F.explode("liveData.plays.allPlays").alias("p"))
    pitches = F.filter("p.playEvents", lambda e: F.coalesce(e["isPitch"], F.lit(False)))
    rows = plays.withColumn("last", F.element_at(F.transform(pitches, lambda e: e["index"]), -1)).select("gamePk", "gameData", "p", "last", F.explode(pitches).alias("e"))
    of_play = F.when(F.col("e.index") == F.col("last"), reviews(F.col("p.reviewDetails"))).otherwise(reviews(F.lit(None).cast(REVIEW)))
    both = F.array_distinct(F.concat(reviews(F.col("e.reviewDetails")), of_play))
    zone = F.get(F.filter(both, lambda r: r["reviewType"] == ZONE_REVIEW), F.lit(0))
    call = normal_call(F.col("e.details.call.code"), F.col("e.details.call.description"))
    out = rows.select(
        F.col("gamePk").alias("game_pk"), (F.col("p.atBatIndex") + 1).alias("at_bat_number"), F.col("e.pitchNumber").alias("pitch_number"), F.col("e.playId").alias("play_id"),
        F.col("p.about.inning").alias("inning"), F.col("p.about.isTopInning").alias("is_top"), F.col("p.matchup.batter.id").alias("batter_id"), F.col("p.matchup.pitcher.id").alias("pitcher_id"),
        call.alias("call"), zone.alias("review"), (F.exists(both, lambda r: (r["reviewType"] != ZONE_REVIEW) & r["isOverturned"]) & ~F.exists(both, lambda r: r["reviewType"] == ZONE_REVIEW)).alias("other_review"),
        F.col("gameData.players")[F.concat(F.lit("ID"), F.col("p.matchup.pitcher.id").cast("string"))]["primaryPosition"]["code"].alias("pitcher_position"),
        F.col("e.pitchData.coordinates.pX").alias("plate_x"), F.col("e.pitchData.coordinates.pZ").alias("plate_z"), F.col("e.pitchData.strikeZoneTop").alias("sz_top"), F.col("e.pitchData.strikeZoneBottom").alias("sz_bot"),
    )
    outcome = F.when(F.col("review").isNotNull(), F.when(F.col("review.isOverturned").isNull(), "unresolved").when(F.col("review.isOverturned"), "overturned").otherwise("upheld"))
    return out.filter("call IS NOT NULL").withColumns({"outcome": outcome, "challenger_team_id": F.col("review.challengeTeamId")}).drop("review")


def feed_totals(feeds: DataFrame) -> DataFrame:
    """Challenges used and left, as the feed states them, one row per team."""
    sides = [F.struct(F.col(f"gameData.teams.{s}.id").alias("team_id"), F.col(f"gameData.absChallenges.{s}").alias("t")) for s in ("away", "home")]
    rows = feeds.select(F.col("gamePk").alias("game_pk"), F.explode(F.array(*sides)).alias("s"))
    return rows.select("game_pk", "s.team_id", F.col("s.t.usedSuccessful").alias("used_successful"), F.col("s.t.usedFailed").alias("used_failed"), F.col("s.t.remaining").alias("remaining"))


def plate_umpire(feeds: DataFrame) -> DataFrame:
    home = F.get(F.filter("liveData.boxscore.officials", lambda o: o["officialType"] == "Home Plate"), F.lit(0))
    return feeds.select(F.col("gamePk").alias("game_pk"), home["official"]["id"].alias("umpire_id"), home["official"]["fullName"].alias("umpire"))


def latest_first(rows: DataFrame, key: str, order: list[Column], cutoff: Column | None = None) -> DataFrame:
    """The first row of each key in the given order, of the rows up to a cutoff."""
    rows = rows if cutoff is None else rows.filter(cutoff)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Zstandard parquet, or delimited text with nulls as empty fields; a job's files appear together when it commits."""
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, SHA-256 and time of the files below ``path``. Files are read one by one, so keep them of moderate size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def stale(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """Cached feeds that have to be fetched again: their header does not say that the game is final."""
    return documents.filter(~F.coalesce(F.rlike(F.substring(F.col(json_col), 1, 65536), F.lit(r'"abstractGameState"\s*:\s*"Final"')), F.lit(False)))


def export_bundle(tables: dict[str, tuple[DataFrame, list[str]]], folder: str) -> DataFrame:
    """Write projected tables below ``folder`` as compressed parquet; the manifest of what was written."""
    for name, (df, columns) in tables.items():
        write_table(df.select(*columns), f"{folder}/{name}")
    return manifest(next(iter(tables.values()))[0].sparkSession, folder).filter("path LIKE '%.parquet'")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the session's ``spark.checkpoint.dir``, which driver and executors share; a local session without
    the setting gets a temporary one. It goes when the driver's JVM ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stakewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
