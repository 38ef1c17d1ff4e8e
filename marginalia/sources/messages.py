"""Message archives: JavaScript files that assign a JSON array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URL = "struct<url:string,expanded_url:string,display_url:string>"
_MEDIA = "struct<url:string,media_url:string,media_url_https:string,type:string>"
_COLUMNS = {c: "string" for c in "id_str created_at full_text lang favorite_count retweet_count in_reply_to_status_id_str in_reply_to_screen_name".split()} | {"entities": f"struct<urls:array<{_URL}>,media:array<{_MEDIA}>>", "extended_entities": f"struct<media:array<{_MEDIA}>>"}
_FIELDS = ",".join(f"{c}:{t}" for c, t in _COLUMNS.items())
TITLE_LENGTH = 60


def unwrapped(text: Column) -> Column:
    """The JSON array behind `window.X =`, without a closing semicolon."""
    return F.rtrim(F.trim(F.when(text.startswith("window."), F.regexp_replace(text, r"(?s)^[^=]*=", "")).otherwise(text)), F.lit("; \n\r\t"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a message from all parts of an archive; objects without the wrapper count too."""
    whole = spark.read.text(path, wholetext=True).select(unwrapped(F.col("value")).alias("json"))
    items = whole.select(F.explode(F.from_json("json", f"array<struct<tweet:struct<{_FIELDS}>,{_FIELDS}>>")).alias("i"))
    own = F.struct(*[F.col(f"i.{c}").alias(c) for c in _COLUMNS])
    return items.select(F.coalesce("i.tweet", own).alias("m")).select("m.*").where("id_str is not null")


def username(spark: SparkSession, path: str) -> str | None:
    """The account's name; None where the file is missing or says nothing."""
    try:
        row = spark.read.text(path, wholetext=True).select(F.get(F.from_json(unwrapped(F.col("value")), "array<struct<account:struct<username:string>>>"), F.lit(0))["account"]["username"].alias("n")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row and row["n"]


def created(text: Column) -> Column:
    """`Wed Oct 10 20:19:24 +0000 2018` as a timestamp."""
    return F.to_timestamp(F.substr(text, F.lit(5)), "MMM dd HH:mm:ss Z yyyy")


def shown_time(moment: Column, zone: str = "UTC") -> Column:
    return F.ltrim(F.date_format(F.from_utc_timestamp(moment, zone), "hh:mm a · MMM dd, yyyy"), F.lit("0"))


def expanded(text: Column, urls: Column) -> Column:
    """Short links replaced by what the archive says they stand for."""
    known = F.filter(F.coalesce(urls, F.array().cast(f"array<{_URL}>")), lambda u: (F.coalesce(u["url"], F.lit("")) != "") & (F.coalesce(u["expanded_url"], F.lit("")) != ""))
    return F.aggregate(known, text, lambda t, u: F.replace(t, u["url"], u["expanded_url"]))


def title(text: Column, moment: Column) -> Column:
    """The first line, cut at a word to TITLE_LENGTH signs; the time for a message without text."""
    first = F.trim(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)))
    head = F.substring(first, 1, TITLE_LENGTH)
    cut = F.when(F.instr(head, " ") > 0, F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""))).otherwise(head)
    return F.when(F.coalesce(first, F.lit("")) == "", F.concat(F.lit("Tweet "), F.date_format(moment, "yyyy-MM-dd HH:mm"))).when(F.length(first) <= TITLE_LENGTH, first).otherwise(F.concat(cut, F.lit("…")))


def count_of(value: Column) -> Column:
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0))


def footer(message_id: Column, moment: Column, reposts: Column, likes: Column, zone: str = "UTC") -> Column:
    n = lambda c: F.format_number(count_of(c), 0)
    return F.concat(F.lit("["), shown_time(moment, zone), F.lit("](https://x.com/i/web/status/"), message_id, F.lit(") 🔁 "), n(reposts), F.lit(" 💙 "), n(likes))


def reply_line(reply_id: Column, name: Column) -> Column:
    """A link to the message that this one answers; empty without an id and a proper name."""
    good = reply_id.isNotNull() & (reply_id != "") & F.trim(name).rlike(r"^[A-Za-z0-9_]{1,15}$")
    return F.when(good, F.concat(F.lit("In reply to: [@"), F.trim(name), F.lit("](https://x.com/i/web/status/"), reply_id, F.lit(")"))).otherwise("")


def notes(messages: DataFrame, zone: str = "UTC") -> DataFrame:
    """id, note_title, body, created, media of each message."""
    from ..functions.scanners import html_unescaped

    at = created(F.col("created_at"))
    body_text = html_unescaped(expanded(F.col("full_text"), F.col("entities.urls")))
    media = F.coalesce(F.when(F.size("extended_entities.media") > 0, F.col("extended_entities.media")), F.col("entities.media"))
    out = messages.select("id_str", at.alias("created"), body_text.alias("text"), media.alias("media"), footer(F.col("id_str"), at, F.col("retweet_count"), F.col("favorite_count"), zone).alias("foot"), reply_line(F.col("in_reply_to_status_id_str"), F.col("in_reply_to_screen_name")).alias("reply"))
    parts = F.filter(F.array("reply", F.trim("text"), "foot"), lambda p: p != "")
    return out.select(F.col("id_str").alias("id"), title(F.col("text"), F.col("created")).alias("note_title"), F.array_join(parts, "\n\n").alias("body"), "created", "media")


def media_files(files: DataFrame) -> DataFrame:
    """The first file, by name, of each message: the name's start up to the first hyphen is its id."""
    return files.groupBy(F.split_part(F.col("name"), F.lit("-"), F.lit(1)).alias("id")).agg(F.min("name").alias("name"))
