"""Event feeds normalised to (date, start_hour, venue_id, event_type, title, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts.functions.calendar import local_time
from tripmarts.functions.trip import hour_or_default

COLUMNS = ["date", "start_hour", "venue_id", "event_type", "title", "tags"]
SCHEDULE = ("struct<dates:array<struct<games:array<struct<gameDate:string,gameType:string,"
            "teams:struct<home:struct<team:struct<id:bigint,name:string>>,away:struct<team:struct<id:bigint,name:string>>>>>>>>")


def _lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), key)


def schedule_games(payload: DataFrame, column: str, home_venues: dict[int, str], event_type: str, tags: str) -> DataFrame:
    """Nested schedule documents (dates -> games) to home games in local time; play-off games carry a suffix."""
    games = (payload.select(F.explode(F.from_json(column, SCHEDULE)["dates"]).alias("d")).select(F.explode("d.games").alias("g"))
             .select("g.gameDate", "g.gameType", F.col("g.teams.home.team").alias("home"), F.col("g.teams.away.team").alias("away")))
    utc = F.to_timestamp_ntz(F.regexp_replace("gameDate", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    local = local_time(utc)
    suffix = F.when(F.col("gameType") != "R", " (POST)").otherwise("")
    return games.withColumn("venue_id", _lookup(home_venues, F.col("home.id"))).where("venue_id is not null").select(
        F.to_date(local).alias("date"), F.hour(local).alias("start_hour"), "venue_id", F.lit(event_type).alias("event_type"),
        F.concat("away.name", F.lit(" @ "), "home.name", suffix).alias("title"), F.lit(tags).alias("tags"))


def league_games(games: DataFrame, home_teams: list[str], years: tuple[int, int], game_types: list[str], venue_id: str, event_type: str,
                 default_hour: int, tags: str) -> DataFrame:
    """Flat game tables (gameday, gametime 'HH:MM', home_team, away_team, game_type): home games of some teams and years."""
    day = F.to_date("gameday")
    keep = F.col("home_team").isin(home_teams) & F.year(day).between(*years) & F.col("game_type").isin(game_types)
    return games.where(keep).select(
        day.alias("date"), hour_or_default("gametime", default_hour).alias("start_hour"), F.lit(venue_id).alias("venue_id"), F.lit(event_type).alias("event_type"),
        F.concat("away_team", F.lit(" @ "), "home_team").alias("title"), F.lit(tags).alias("tags"))


def curated(df: DataFrame, default_hour: int, default_tags: str) -> DataFrame:
    """Hand-kept calendars: missing hours and tags take the defaults."""
    hour = F.col("start_hour") if "start_hour" in df.columns else F.lit(None)
    tags = F.col("tags") if "tags" in df.columns else F.lit(None)
    return df.select(F.to_date("date").alias("date"), F.coalesce(hour.cast("int"), F.lit(default_hour)).alias("start_hour"), "venue_id", "event_type", "title",
                     F.coalesce(tags.cast("string"), F.lit(default_tags)).alias("tags"))


def combine(feeds: list[DataFrame]) -> DataFrame:
    """All feeds in one calendar, one row per (date, venue, title): the earlier feed wins."""
    out = None
    for i, f in enumerate(feeds):
        part = f.select(*COLUMNS).withColumn("_feed", F.lit(i))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("date", "venue_id", "title").orderBy("_feed", "start_hour", "event_type", "tags")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_feed").orderBy("date", "start_hour", "venue_id")
