"""Documents and their links: what they are about, and the lists of dates, weeks and lessons in their text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import HEAD, TAIL, clean_text
from chronoweave.operators.grid import _after_place, weekday_of

# How programs are named in titles and addresses.
PROGRAMS = (
    ("37.05.01", r"37\.05\.01|370501|клиническ\p{L}*\s+психолог|klin(?:ich)?\p{L}*[-_ ]psih"),
    ("31.05.02", r"31\.05\.02|310502|педиатр|pediatr"),
    ("31.05.01", r"31\.05\.01|310501|лечебн\p{L}*\s+(?:дело|факультет)|(?:^|[/_-])ld(?:[/_.-]|$)|lechebnoe"),
)
# Words of links that are no regular timetables.
OTHER_LINKS = "куг|календарный учебный график|график учебных недель|индивидуальн|зач.кн|промежуточная аттестация|академический отпуск|ликвидац|задолженн|likvidacziya|zadolzhenn"
# What a period of a study plan is called, in order of precedence.
PERIODS = (("study", "обучение|дискретная"), ("assessment", "итоговая аттестация|промежуточная аттестация|сессия"), ("vacation", "каникул"), ("practice", "практик"))
_DATE = r"\d{1,2}\.\d{1,2}\.\d{4}"
_TO = r"\s*[-–—]\s*"


class _Links(HTMLParser):
    """All links with their text and the heading they stand under."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []
        self.heading, self.in_heading = "", False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self._end()
            self.href, self.text = dict(attrs).get("href"), []
        elif tag in ("h1", "h2", "h3", "h4"):
            self.heading, self.in_heading = "", True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end()
        elif tag in ("h1", "h2", "h3", "h4"):
            self.in_heading = False

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)
        if self.in_heading:
            self.heading += data

    def _end(self) -> None:
        if self.href:
            self.out.append((self.href, " ".join("".join(self.text).split()), " ".join(self.heading.split())))
        self.href = None


def links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """The links of pages, each address once per page: ``page``, ``url`` (absolute, without fragment), ``title``, ``heading``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for base, text in zip(batch["page"], batch["html"], strict=True):
                found = _Links()
                found.feed(text or "")
                found.close()
                found._end()
                seen: dict[str, tuple[str, str]] = {}
                for href, title, heading in found.out:
                    seen.setdefault(urldefrag(urljoin(base or "", href)).url, (title, heading))
                out += [(base, url, *rest) for url, rest in seen.items()]
            yield pd.DataFrame(out, columns=["page", "url", "title", "heading"])

    return pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(run, "page string, url string, title string, heading string")


def program_of(text: Column) -> Column:
    """The program that a text names, else null."""
    low = F.lower(clean_text(text))
    out = F.lit(None).cast("string")
    for code, pattern in reversed(PROGRAMS):
        out = F.when(low.rlike(pattern), code).otherwise(out)
    return out


def course_of(text: Column) -> Column:
    """The course that a text or a file name names (``4 курс``, ``4k_``, ``4-kurs``), else null."""
    low = F.lower(clean_text(text))
    found = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (rf"(?<!\d)([1-6])\s*курс{TAIL}", r"(?<!\d)([1-6])[-_ ]?k(?:urs)?(?=[_\-.\s]|$)")]
    return F.coalesce(*found).cast("int")


def stream_of(text: Column) -> Column:
    """The stream that a heading (``поток А``) or a file name (``_a_``) names, else null."""
    up = F.translate(F.upper(clean_text(text)), "АБ", "AB")
    found = [F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in (rf"ПОТОК\s*([AB]){TAIL}", r"[/_-]([AB])(?=[_\-.]|$)")]
    return F.coalesce(*found)


def kind_of(text: Column) -> Column:
    """Whether a text speaks of lectures or of practice, else null."""
    low = F.lower(clean_text(text))
    return F.when(low.rlike(r"лекци|лекцион|lekc|lekcz|lecture|[/_-]lec[_-]"), "lecture").when(low.rlike(rf"семинар|seminar|практик|praktik|[/_-]prak[_-]|{HEAD}пз{TAIL}|_ld[_-]"), "practice")


def classify(docs: DataFrame, heading: str, url: str) -> DataFrame:
    """What documents are about: ``program``, ``course``, ``stream``, ``kind``. What the heading says goes before the address,
    and ``mismatch`` tells that the two name different streams."""
    h, u = F.col(heading), F.col(url)
    both = lambda f: F.coalesce(f(h), f(u))
    differs = F.coalesce(stream_of(h) != stream_of(u), F.lit(False))
    return docs.select("*", both(program_of).alias("program"), both(course_of).alias("course_number"), both(stream_of).alias("stream"), both(kind_of).alias("kind"), differs.alias("mismatch"))


def timetable_links(found: DataFrame) -> DataFrame:
    """Links to timetables, with what they are about: those to debts, study plans and the like are left out."""
    text = F.concat_ws(" ", "heading", "title", "url")
    return classify(found.where(~F.lower(text).rlike(OTHER_LINKS)).withColumn("__h", F.concat_ws(" ", "heading", "title")), "__h", "url").drop("__h").where("program IS NOT NULL AND kind IS NOT NULL")


def best_or_fallback(candidates: DataFrame, fallback: DataFrame, key: Sequence[str], score: Column, order: Sequence[str]) -> DataFrame:
    """For every key of ``fallback`` the candidate ``url`` with the highest score (not below 0), the first of equals, else the fallback's: ``key``, ``url``, ``origin``."""
    best = candidates.withColumn("__s", score).where("__s >= 0").groupBy(*key).agg(F.max_by("url", F.struct("__s", *[F.col(o) for o in order])).alias("__best"))
    return fallback.join(best, list(key), "left").select(*key, F.coalesce("__best", "url").alias("url"), F.when(F.col("__best").isNull(), "fallback").otherwise("found").alias("origin"))


def best_attempt(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of several parsers' attempts (``attempt_no``, ``parser``, ``events``, ``warnings``) the one with most: ten points an event, less one a warning; the first of equals."""
    score = F.col("events") * 10 - F.col("warnings")
    return attempts.groupBy(*key).agg(F.max_by("parser", F.struct(score.alias("s"), -F.col("attempt_no"))).alias("parser"), F.max(score).alias("score"))


def study_periods(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The periods in the text of study plans: a range of dates, and as label what follows up to the next range.
    ``doc``, ``from_date``, ``to_date``, ``label``, ``kind``. Labels that name no kind of period, holidays, and ranges with
    impossible or reversed days are left out; each period comes out once."""
    plain = clean_text(F.col(text))
    pattern = rf"({_DATE}){_TO}({_DATE})\s*(.*?)(?={_DATE}{_TO}{_DATE}|$)"
    part = lambda k: F.regexp_extract_all(plain, F.lit(pattern), F.lit(k))
    rows = docs.select(F.col(doc).alias("doc"), F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("z"), part(3).alias("l"))).alias("r"))
    label = F.regexp_replace(F.regexp_replace(F.trim("r.l"), r"(?iu)^\d{1,2}\s+семестр\s*", ""), r"(?iu)\s+\d{1,2}\s+семестр.*$", "")
    date = lambda c: F.try_to_date(c, "d.M.yyyy")
    rows = rows.select("doc", date(F.col("r.a")).alias("from_date"), date(F.col("r.z")).alias("to_date"), label.alias("label"))
    kind = F.lit(None).cast("string")
    for name, words in reversed(PERIODS):
        kind = F.when(F.lower("label").rlike(words), name).otherwise(kind)
    rows = rows.withColumn("kind", F.when(~F.lower("label").contains("праздничные дни"), kind))
    return rows.where("kind IS NOT NULL AND from_date <= to_date").distinct()


def week_calendar(docs: DataFrame, doc: str, text: str, least: int = 20) -> DataFrame:
    """The week lists in texts: ``doc``, ``week_number``, ``from_date``, ``to_date``, ``complete``. Of a week that is listed
    twice the last one counts. ``complete`` tells that the weeks are at least ``least`` and run from 1 without a gap."""
    plain = clean_text(F.col(text))
    pattern = rf"(?<![\d.])(\d{{1,2}})\s+({_DATE}){_TO}({_DATE})"
    part = lambda k: F.regexp_extract_all(plain, F.lit(pattern), F.lit(k))
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.arrays_zip(part(1).alias("n"), part(2).alias("a"), part(3).alias("z"))).alias("at", "r"))
    date = lambda c: F.try_to_date(c, "d.M.yyyy")
    rows = rows.select("doc", "at", F.col("r.n").cast("int").alias("week_number"), date(F.col("r.a")).alias("a"), date(F.col("r.z")).alias("z")).where("week_number >= 1 AND a <= z")
    weeks = rows.groupBy("doc", "week_number").agg(F.max_by(F.struct("a", "z"), "at").alias("w"))
    all_ = Window.partitionBy("doc")
    whole = (F.count("*").over(all_) >= least) & (F.count("*").over(all_) == F.max("week_number").over(all_))
    return weeks.select("doc", "week_number", F.col("w.a").alias("from_date"), F.col("w.z").alias("to_date"), whole.alias("complete"))


def date_labels(docs: DataFrame, doc: str, text: str, start_year: int, samples: int = 40) -> DataFrame:
    """The dates printed in texts: ``doc``, ``years``, ``conflicting_years`` (outside the academic year), ``samples`` (the first ones), ``labels`` (their number)."""
    pattern = r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?!\d)"
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(part(0).alias("l"), part(1).cast("array<int>").alias("d"), part(2).cast("array<int>").alias("m"), part(3).cast("array<int>").alias("y"))
    good = F.filter(zipped, lambda r: r["d"].between(1, 31) & r["m"].between(1, 12))
    years = F.array_sort(F.array_distinct(F.transform(good, lambda r: F.when(r["y"] < 100, r["y"] + 2000).otherwise(r["y"]))))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), years.alias("years"), F.slice(F.transform(good, lambda r: r["l"]), 1, samples).alias("samples"), F.size(good).alias("labels"))
    return rows.select("doc", "years", F.filter("years", lambda y: (y < start_year) | (y > start_year + 1)).alias("conflicting_years"), "samples", "labels")


def listed_lessons(lines: DataFrame) -> DataFrame:
    """Lessons of a list (``doc``, ``line`` number, ``text``): a weekday's name is a heading, a clock range begins a lesson, and
    what follows up to the next of both belongs to it: ``doc``, ``line``, ``weekday``, ``clock``, ``text``."""
    clock = r"(\d{1,2}\s*[:.]\s*\d{2}\s*[-–—]\s*\d{1,2}\s*[:.]\s*\d{2})"
    day = weekday_of(F.col("text"))
    starts = F.col("text").rlike(clock)
    down = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("d", day).withColumn("c", F.nullif(F.regexp_extract("text", clock, 1), F.lit("")))
    rows = rows.withColumn("block", F.sum(F.when(starts | F.col("d").isNotNull(), 1).otherwise(0)).over(down)).withColumn("weekday", F.last("d", ignorenulls=True).over(down))
    body = F.trim(F.regexp_replace("text", clock, ""))
    blocks = rows.groupBy("doc", "block").agg(F.min("line").alias("line"), F.first("weekday").alias("weekday"), F.max("c").alias("clock"), F.array_sort(F.collect_list(F.struct("line", body.alias("t")))).alias("parts"))
    joined = clean_text(F.array_join(F.transform("parts", lambda p: p["t"]), " "))
    return blocks.where("clock IS NOT NULL AND weekday IS NOT NULL").select("doc", "line", "weekday", "clock", joined.alias("text")).where("text <> ''")


def clock_for_place(text: Column, place: Column, first_place: str = "солнечное") -> Column:
    """Of two clock ranges in a row the first for lessons at ``first_place``, the second elsewhere; the only one if there is one."""
    clocks = F.regexp_extract_all(text, F.lit(r"\d{1,2}[:.]\d{2}\s*[-–—]\s*\d{1,2}[:.]\d{2}"), F.lit(0))
    return F.when(F.lower(place).contains(first_place), F.try_element_at(clocks, F.lit(1))).otherwise(F.coalesce(F.try_element_at(clocks, F.lit(2)), F.try_element_at(clocks, F.lit(1))))


def repaired(text: Column, broken: dict[str, str]) -> Column:
    """A text with words that were broken in extraction made whole, whatever their letter case."""
    for wrong, right in broken.items():
        text = F.regexp_replace(text, rf"(?iu)\Q{wrong}\E", right)
    return text


@F.pandas_udf(T.StructType([T.StructField("place", T.StringType()), T.StructField("subject", T.StringType())]))
def split_leading_place(texts: pd.Series) -> pd.DataFrame:
    """A place written before a subject, apart from it."""
    return pd.DataFrame([_after_place(t) if t else (None, None) for t in texts], columns=["place", "subject"])


def provenance_issues(sources: DataFrame, url: str, now: Column, academic_year: str, fresh_hours: int = 36) -> DataFrame:
    """What is wrong with the provenance of sources: ``url``, ``issue``."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("checked_at").cast("timestamp"))) / 3600
    rules = {
        "no digest": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "too small": F.coalesce(F.col("content_bytes"), F.lit(0)) < 500,
        "stale": (age > fresh_hours) | F.col("checked_at").isNull(),
        "from the future": age < -5 / 60,
        "other year": ~F.col("academic_year_in_document").eqNullSafe(F.lit(academic_year)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return sources.select(F.col(url).alias("url"), F.explode(found).alias("issue"))


def preview(lines: DataFrame, most_lines: int = 100, most_characters: int = 30_000) -> DataFrame:
    """The beginning of each document's text (``doc``, ``line``, ``text``), for a first look at its kind."""
    head = lines.where(F.col("line") < most_lines).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"))
    return head.select("doc", F.substring(F.array_join(F.transform("ls", lambda x: x["text"]), "\n"), 1, most_characters).alias("text"))
