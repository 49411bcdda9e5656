"""Sources and sinks met by queries: tables are written in the format in question, read by its reader, and must come out
as the SQL says."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakewise.plans.base import T, query, rounded, table, timeline
from stakewise.sources import readers

_SEGMENT = "CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END"


def delimited(spark, rows, header: str, columns: list) -> str:
    """A folder of one delimited text per task, each with the header."""
    path = readers.scratch(spark, "delimited")
    named = [c.cast("string").alias(n.strip()) for n, c in zip(header.split(","), columns, strict=True)]
    rows.select(*named).write.option("header", True).option("emptyValue", "").csv(path)
    return path


def customers_csv(spark, sf) -> str:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    segment = F.when(k % 5 == 0, "NA").when(k % 7 == 0, "").when(k % 11 == 0, "null").otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return delimited(spark, c, "key,name,balance,segment", [k, F.col("c_name"), F.when(k % 13 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")), segment])


@query("s1_delimited_scan", f"SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 13 > 0 THEN c_acctbal END AS balance, {_SEGMENT} AS segment, -1::BIGINT AS absent FROM customer")
def delimited_scan(spark, sf):
    """Null strings, trimmed values, a malformed number and a column that the file lacks."""
    rows = readers.read_csv(spark, customers_csv(spark, sf), "key long, name string, balance double, segment string, absent long")
    return rows.withColumn("absent", F.coalesce("absent", F.lit(-1)))


@query("s3_projected_scan", f"SELECT c_custkey AS key, {_SEGMENT} AS segment FROM customer")
def projected_scan(spark, sf):
    """S3: only the columns asked for."""
    return readers.read_csv(spark, customers_csv(spark, sf), "key long, name string, balance double, segment string", ["key", "segment"])


@query("s2_parts_by_name", "SELECT o_orderkey AS key, o_custkey AS customer, o_orderstatus AS status, NULL AS priority FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 3 = 0")
def parts_by_name(spark, sf):
    """Parts of different layouts as one table, restricted to the keys of another."""
    o = table(spark, sf, "orders")
    even = delimited(spark, o.filter("o_orderkey % 2 = 0"), "key,customer,status", [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    odd = delimited(spark, o.filter("o_orderkey % 2 = 1"), "key,customer,priority", [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderpriority")])
    keep = o.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("customer"))
    parts = [([even], "key long, customer long, status string"), ([odd], "key long, customer long, priority string")]
    return readers.read_parts(spark, parts, keep, "customer").select("key", "customer", "status", "priority")


@query("s4_period_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus = 'F'")
def period_scan(spark, sf):
    """Two columns of a period; columns and limits reach the parquet scan."""
    return readers.read_period(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderdate", "1995-01-01", "1996-12-31", F.col("o_orderstatus") == "F")


@query(
    "s5_schedule_games",
    "SELECT o_orderkey AS game_pk, cast(cast(o_orderdate AS date) AS varchar) AS game_date, (o_custkey % 30)::BIGINT AS away_team_id, (o_custkey % 29)::BIGINT AS home_team_id FROM orders WHERE o_orderkey % 7 > 0 AND o_orderstatus = 'F' AND o_orderkey % 10 > 0",
)
def schedule_games(spark, sf):
    """Completed regular games of nested schedules, dated by the game or by the day they are listed under."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    team = lambda n: F.struct(F.struct((F.col("o_custkey") % n).alias("id")).alias("team"))
    game = F.struct(
        k.alias("gamePk"), F.when(k % 7 > 0, "R").otherwise("S").alias("gameType"), F.when(k % 3 > 0, day).alias("officialDate"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "Final").otherwise("Live").alias("abstractGameState"), F.when(k % 10 == 0, "Postponed").when(F.col("o_orderstatus") == "F", "Final").otherwise("In Progress").alias("detailedState")).alias("status"),
        F.struct(team(30).alias("away"), team(29).alias("home")).alias("teams"),
    )
    days = table(spark, sf, "orders").select(day.alias("date"), game.alias("game")).groupBy("date").agg(F.collect_list("game").alias("games"))
    documents = days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.to_json(F.struct(F.collect_list(F.struct("date", "games")).alias("dates"))).alias("value"))
    return readers.completed(readers.schedule(documents)).select("game_pk", F.col("game_date").cast("string").alias("game_date"), "away_team_id", "home_team_id")


@query(
    "s6_called_pitches",
    f"""WITH {T} SELECT event_id::VARCHAR AS play_id, pitch_order AS at_bat_number, inning, CASE WHEN event_id % 2 = 0 THEN 'called_strike' ELSE 'ball' END AS call, outcome, CASE WHEN outcome IS NOT NULL THEN team ELSE -1 END AS challenger_team_id, outcome IS NULL AND event_id % 6 = 0 AS other_review FROM t WHERE event_id % 5 > 0""",
)
def called_pitches(spark, sf):
    """Called pitches and their zone reviews out of nested feeds, one document a timeline; a review stands at
    the pitch or at the plate appearance, alone or among additional ones."""
    t = timeline(spark, sf)
    e = F.col("event_id")
    plain = "array<struct<reviewType: string, isOverturned: boolean, challengeTeamId: long>>"

    def made(kind: str, overturned, more=None):
        return F.struct(F.lit(kind).alias("reviewType"), overturned.alias("isOverturned"), F.col("team").alias("challengeTeamId"), *([] if more is None else [more.alias("additionalReviews")]))

    none = F.lit(None).cast(plain)
    zone = F.when(e % 4 == 0, made("NA", F.lit(True), F.array(made("MJ", F.col("success"))))).otherwise(made("MJ", F.col("success"), none))
    review = F.when(F.col("outcome").isNotNull(), zone).when(e % 6 == 0, made("NA", F.lit(True), none))
    pitch = F.struct(
        F.lit(True).alias("isPitch"), F.lit(0).alias("index"), F.lit(1).alias("pitchNumber"), e.cast("string").alias("playId"),
        F.struct(F.struct(F.when(e % 5 == 0, "X").when(e % 2 == 0, "C").otherwise("B").alias("code"), F.lit("").alias("description")).alias("call")).alias("details"), F.when(e % 3 > 0, review).alias("reviewDetails"),
    )
    play = F.struct((F.col("pitch_order") - 1).alias("atBatIndex"), F.struct(F.lit(True).alias("isTopInning"), F.col("inning").alias("inning")).alias("about"), F.when(e % 3 == 0, review).alias("reviewDetails"), F.array(pitch).alias("playEvents"))
    plays = t.groupBy("game", "team").agg(F.collect_list(play).alias("allPlays"))
    documents = plays.select(F.to_json(F.struct(F.xxhash64("game", "team").alias("gamePk"), F.struct(F.struct("allPlays").alias("plays")).alias("liveData"))).alias("value"))
    out = readers.called_pitches(readers.feed(documents))
    return rounded(out.select("play_id", "at_bat_number", "inning", "call", "outcome", F.coalesce("challenger_team_id", F.lit(-1)).alias("challenger_team_id"), "other_review"))


@query("s8_latest_rows", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30') WHERE k = 1")
def latest_rows(spark, sf):
    """The first row of each key in order, up to a cutoff."""
    o = table(spark, sf, "orders")
    cutoff = F.col("o_orderdate") <= F.lit("1997-06-30").cast("timestamp")
    return readers.latest_first(o, "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], cutoff).select("o_custkey", "o_orderkey", "o_totalprice")


@query("s15_sink_round_trip", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, p_retailprice FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name END, p_retailprice FROM part")
def sink_round_trip(spark, sf):
    """The same rows through compressed parquet and through delimited text with nulls as empty fields."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("name"), "p_retailprice")
    one, two = readers.scratch(spark, "sink"), readers.scratch(spark, "sink")
    readers.write_table(rows, one)
    readers.write_table(rows, two, "csv")
    return spark.read.parquet(one).unionByName(readers.read_csv(spark, two, rows.schema))


@query("s17_bundle_manifest", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def bundle_manifest(spark, sf):
    """A bundle of projected tables; each file's hash stands in the manifest, and is checked when it is read."""
    folder = readers.scratch(spark, "bundle")
    tables = {n: (table(spark, sf, n), [f"{n[0]}_{n}key", f"{n[0]}_name"]) for n in ("nation", "region")}
    listed = readers.export_bundle(tables, folder)
    again = readers.manifest(spark, folder).filter("path LIKE '%.parquet'")
    differ = listed.select("path", "bytes", "sha256").exceptAll(again.select("path", "bytes", "sha256"))
    if not differ.isEmpty() or listed.isEmpty():
        raise ValueError("the bundle does not match its manifest")
    parts = [spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in tables]
    return parts[0].union(parts[1])


@query("s12_stale_feeds", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def stale_feeds(spark, sf):
    """Cached documents whose header does not say that they are final."""
    state = F.when(F.col("o_orderstatus") == "F", "Final").otherwise("Live")
    documents = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit('{"gameData": {"status": {"abstractGameState" : "'), state, F.lit('"}}}')).alias("value"))
    return readers.stale(documents).select("o_orderkey")
