"""Schedules read from the text of posts by rules: a grammar of days, clock times and ranges of them, in built-in expressions.

The text is cut into its mentions of days and of times, in order. Each time makes an item, on the day that was mentioned last before it, or on the
post's own day. Days: a date, with or without its year; today; tomorrow, which is the post's own day for a post written before six; a day of the
week, the next one from the post's day on. Times: hours and minutes, with a word for the part of the day or without; without a word, or with one for
the afternoon, hours below twelve are in the afternoon; midnight, as hour 24 or as twelve at night, is of the day after. A text that says that there is no broadcast has no items.
Without a time an item starts when the post was written, if the text says that it starts now, and else has no start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PARSED, WHITE
from ..functions.timeutil import WEEKDAYS

# Words for days, parts of the day, half an hour, starting at once, not broadcasting, and broadcasting together.
TODAY, TOMORROW = ("오늘", "오방공", "금일"), "내일"
MORNING, LATER = ("오전", "아침", "새벽"), ("오후", "저녁", "밤", "낮", "점심")
NIGHT, HALF, NOW, OFF, TOGETHER = "밤", "반", ("시작합니다", "갑니다", "킵니다", "지금", "바로"), ("쉽니다", "휴방", "오프"), ("합방", "좌표", "제방")

_GAP = f"[{WHITE}]*"
_PART = "|".join((*MORNING, *LATER))
_CLOCK = rf"(?:({_PART}){_GAP})?(?<![\d:])(\d{{1,2}})(?::(\d{{2}})(?!\d)|{_GAP}시(?!간)(?:{_GAP}(?:(\d{{1,2}}){_GAP}분|({HALF})))?)"
_DATE = rf"(?:(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}})(?!\d)|(?<!\d)(\d{{1,2}})(?:{_GAP}월{_GAP}|/)(\d{{1,2}})(?!\d)(?:{_GAP}일)?)"
_DAY = f"{'|'.join((*TODAY, TOMORROW))}|[{''.join(WEEKDAYS)}]요일"
_MENTION = f"{_DATE}|{_DAY}|{_CLOCK}(?:{_GAP}(?:~|-|부터){_GAP}{_CLOCK})?"
LENGTH = 20


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def _read(mention: Column) -> Column:
    """The parts of a mention: of its one or two times (`clock`), or of its date; each pattern is met once."""
    clock = F.split(F.regexp_replace(mention, f"^{_CLOCK}(?:{_GAP}(?:~|-|부터){_GAP}{_CLOCK})?$", ",".join(f"${i}" for i in range(1, 11))), ",")
    date = F.split(F.regexp_replace(mention, f"^{_DATE}$", "$1,$2,$3,$4,$5"), ",")
    return F.struct(mention.alias("text"), F.when(F.size(clock) == 10, clock).alias("clock"), F.when(F.size(date) == 5, date).alias("date"))


def _at(parts: Column, i: int) -> Column:
    return F.nullif(F.get(parts, F.lit(i)), F.lit(""))


def _day(read: Column, posted: Column) -> Column:
    """The day that a mention names; null for a time, and for a date that is none."""
    own, mention = posted.cast("date"), read["text"]
    number = lambda i: _at(read["date"], i).cast("int")
    whole, short = _made(number(0), number(1), number(2)), _made(F.year(own), number(3), number(4))
    # Of a date without a year, one long past is of the next year.
    near = F.when(F.date_diff(own, short) > 180, F.add_months(short, 12)).otherwise(short)
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.substring(mention, 1, 1)).cast("int")
    ahead = F.pmod(weekday - F.dayofweek(own), F.lit(7)).cast("int")
    return (
        F.when(mention.isin(*TODAY), own)
        .when(mention == TOMORROW, F.date_add(own, F.when(F.hour(posted) < 6, 0).otherwise(1)))
        .when((weekday > 0) & F.endswith(mention, F.lit("요일")), F.date_add(own, ahead))
        .otherwise(F.coalesce(whole, near))
    )


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _minutes(read: Column, second: bool = False) -> Column:
    """Minutes since midnight of a mention's time, or of the one that ends its range; null if it has none."""
    clock, i = read["clock"], 5 if second else 0
    part, hour = _at(clock, i), _at(clock, i + 1).cast("int")
    minute = F.coalesce(_at(clock, i + 2).cast("int"), _at(clock, i + 3).cast("int"), F.when(_at(clock, i + 4).isNotNull(), 30), F.lit(0))
    if second:  # a range's end is in the part of the day that its start names, if it names none itself
        part = F.coalesce(part, _at(clock, 0))
    early = F.coalesce(part.isin(*MORNING), F.lit(False))
    at = F.when(early, F.when(hour == 12, 0).otherwise(hour)).when((part == NIGHT) & (hour == 12), 24).when((hour > 0) & (hour < 12), hour + 12).otherwise(hour)
    return F.when((hour <= 24) & (minute < 60), at * 60 + minute)


def _clock(minutes: Column) -> Column:
    of_day = F.pmod(minutes, F.lit(1440))
    return F.concat(F.lpad(F.floor(of_day / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((of_day % 60).cast("string"), 2, "0"))


def items(title: Column, text: Column, posted: Column, names: list[str]) -> Column:
    """The items that a post's title and text tell, as those of a parse result; names are of members who may be mentioned."""
    whole = F.concat_ws(" ", title, text)
    kind = "array<struct<date:string,start_time:string,end_time:string>>"
    start = F.struct(posted.cast("date").alias("day"), F.array().cast(kind).alias("items"))

    def step(state: Column, told: Column) -> Column:
        date = F.date_format(F.date_add(state["day"], F.floor(told["start"] / 1440).cast("int")), "yyyy-MM-dd")
        end = F.when(told["end"] <= told["start"], told["end"] + 720).otherwise(told["end"])  # a range ends after its start
        item = F.struct(date.alias("date"), _clock(told["start"]).alias("start_time"), _clock(end).alias("end_time"))
        found = F.when(told["start"].isNotNull(), F.concat(state["items"], F.array(item))).otherwise(state["items"])
        return F.struct(F.coalesce(told["day"], state["day"]).alias("day"), found.alias("items"))

    mentions = F.transform(F.regexp_extract_all(whole, F.lit(f"({_MENTION})"), F.lit(1)), _read)
    told = F.transform(mentions, lambda r: F.struct(_day(r, posted).alias("day"), _minutes(r).alias("start"), _minutes(r, True).alias("end")))
    none = F.lit(None).cast("string")

    def read(timed: Column) -> Column:
        day = F.when(_any(whole, NOW), posted.cast("date")).otherwise(timed["day"])
        alone = F.struct(F.date_format(day, "yyyy-MM-dd").alias("date"), F.when(_any(whole, NOW), F.date_format(posted, "HH:mm")).alias("start_time"), none.alias("end_time"))
        return F.when(_any(whole, OFF), F.array().cast(kind)).when(F.size(timed["items"]) > 0, timed["items"]).otherwise(F.array(alone))

    known = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: F.contains(whole, n))
    mentioned = F.when(_any(whole, TOGETHER), known).otherwise(F.array().cast("array<string>"))
    about = F.substring(F.coalesce(title, F.lit("")), 1, LENGTH)
    full = lambda i: F.struct(i["date"].alias("date"), i["start_time"].alias("start_time"), i["end_time"].alias("end_time"), about.alias("description"), mentioned.alias("mentioned_bjs"))
    once = F.transform(F.array(F.aggregate(told, start, step)), lambda timed: F.transform(read(timed), full))  # the mentions are gone through once
    return F.get(once, F.lit(0)).cast(PARSED)


def results(found: DataFrame, names: list[str]) -> DataFrame:
    """Parse results of candidates by these rules, as `parse.parse` takes them."""
    read = items(F.col("title"), F.col("text"), F.col("posted_at"), names)
    return found.select("post_id", F.lit("ok").alias("status"), F.to_json(read).alias("json"))
