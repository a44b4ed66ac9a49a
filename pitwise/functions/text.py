"""Dates, seasons, names and identifiers: everything parsed out of source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the source formats.
YEAR_PIVOT = 69  # two-digit years from here on are nineteen-hundreds
SEASON_PIVOT = 93  # the same for season codes such as 9394
SEASON_BREAK_DAYS = 30
SEASON_SLACK_DAYS = 60
CLUB_FORMS = ("fc", "afc", "cf", "sc")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPLIT = r"^\d{4}-\d{2}$"
_YEAR = r"^\d{4}$"


def parse_date(text: Column) -> Column:
    """``dd/mm/yyyy`` or ``dd/mm/yy``; anything else, blank included, is null."""
    t = F.trim(text)
    full = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"

    def build(pattern, year):
        return F.concat_ws(
            "-",
            year,
            F.lpad(F.regexp_extract(t, pattern, 2), 2, "0"),
            F.lpad(F.regexp_extract(t, pattern, 1), 2, "0"),
        ).try_cast("date")

    yy = F.regexp_extract(t, short, 3)
    century = F.when(yy.try_cast("int") >= YEAR_PIVOT, "19").otherwise("20")
    return F.when(t.rlike(full), build(full, F.regexp_extract(t, full, 3))).when(
        t.rlike(short), build(short, F.concat(century, yy))
    )


def is_bad_date(text: Column) -> Column:
    """Text that is there and is not a date: the file it sits in is unreadable."""
    return (F.trim(text) != "") & parse_date(text).isNull()


def parse_float(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def parse_int(text: Column) -> Column:
    """An integer that may be written ``2.0``; blank or anything else is null."""
    return parse_float(text).try_cast("int")


def normalise_season(text: Column) -> Column:
    """``2024``, ``2024/25`` and ``2024/2025`` as a label; other shapes are null."""
    t = F.trim(text)
    pattern = r"^(\d{4})/(\d{2}|\d{4})$"
    start, end = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    end_yy = F.substring(end, -2, 2)
    follows = (start.try_cast("int") + 1) % 100 == end_yy.try_cast("int")
    return F.when(t.rlike(_YEAR), t).when(t.rlike(pattern) & follows, F.concat_ws("-", start, end_yy))


def season_code_to_label(code: Column) -> Column:
    """``2425`` as ``2024-25``; halves that do not follow each other are null."""
    a, b = F.substring(code, 1, 2).try_cast("int"), F.substring(code, 3, 2).try_cast("int")
    ok = code.rlike(_YEAR) & ((a + 1) % 100 == b)
    century = F.when(a >= SEASON_PIVOT, 1900).otherwise(2000)
    return F.when(
        ok, F.concat_ws("-", (century + a).cast("string"), F.substring(code, 3, 2))
    )


def season_label_to_code(label: Column) -> Column:
    return F.when(
        label.rlike(_SPLIT), F.concat(F.substring(label, 3, 2), F.substring(label, 6, 2))
    )


def season_start_year(label: Column) -> Column:
    return F.when(
        label.rlike(_SPLIT) | label.rlike(_YEAR), F.substring(label, 1, 4).try_cast("int")
    )


def is_season_label(label: Column) -> Column:
    return label.rlike(r"^\d{4}(-\d{2})?$")


def season_window(label: Column) -> tuple[Column, Column]:
    """First and last date a season's rows may carry, slack included."""
    year = F.substring(label, 1, 4).try_cast("int")
    split = label.contains("-")
    start = F.when(split, F.make_date(year, F.lit(7), F.lit(1))).otherwise(
        F.make_date(year, F.lit(1), F.lit(1))
    )
    end = F.when(split, F.make_date(year + 1, F.lit(6), F.lit(30))).otherwise(
        F.make_date(year, F.lit(12), F.lit(31))
    )
    return F.date_sub(start, SEASON_SLACK_DAYS), F.date_add(end, SEASON_SLACK_DAYS)


def season_for(date: Column, last_date: Column, last_season: Column) -> Column:
    """The season a future row belongs to, from the latest played row of its competition."""
    year = F.year(date)
    start = F.when(F.month(date) >= 7, year).otherwise(year - 1)
    split = F.concat_ws(
        "-", start.cast("string"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    )
    return (
        F.when(
            last_date.isNotNull() & (F.datediff(date, last_date) <= SEASON_BREAK_DAYS), last_season
        )
        .when(last_season.isNotNull() & ~last_season.contains("-"), year.cast("string"))
        .otherwise(split)
    )


def _fold(text: str) -> str:
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c))


def _over_unique(series: pd.Series, fn) -> pd.Series:
    """Apply ``fn`` once per distinct value of a batch."""
    table = {v: fn(v) for v in series.dropna().unique()}
    return series.map(table).astype(object).where(series.notna(), None)


@F.pandas_udf(T.StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """Compatibility decomposition with combining marks removed.

    Spark has no Unicode normal forms, so this one step runs over Arrow
    batches, once per distinct name of a batch.
    """
    return _over_unique(names, _fold)


def slugify(name: Column) -> Column:
    """A stable ASCII token for a name; null when nothing is left of it."""
    slug = F.regexp_replace(fold_accents(F.lower(F.trim(name))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug != "", slug)


def country_code(competition_id: Column) -> Column:
    """``ENG`` of ``ENG_1``; null for any other shape."""
    return F.when(
        competition_id.rlike(r"^[A-Z]{3}_.+$"), F.substring(competition_id, 1, 3)
    )


def team_id(competition_id: Column, name: Column) -> Column:
    """``eng:some-club``, scoped to the country so it outlives a change of division."""
    return F.concat_ws(":", F.lower(country_code(competition_id)), slugify(name))


def _natural_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


@F.pandas_udf(T.StringType())
def _blake(keys: pd.Series) -> pd.Series:
    return keys.map(
        lambda k: hashlib.blake2b(k.encode("utf-8"), digest_size=8).hexdigest(), na_action="ignore"
    )


def match_id(provider, competition_id, season, date, home, away) -> Column:
    """Sixteen hex digits over the natural key, the same on every run.

    Byte-compatible with ids already stored by others (BLAKE2b, eight bytes).
    """
    return _blake(_natural_key(provider, competition_id, season, F.date_format(date, "yyyy-MM-dd"),
                               home, away))


def native_match_id(provider, competition_id, season, date, home, away) -> Column:
    """The same key hashed inside the JVM, for tables that start fresh."""
    key = _natural_key(
        provider, competition_id, season, F.date_format(date, "yyyy-MM-dd"), home, away
    )
    return F.substring(F.sha2(key, 256), 1, 16)


def lookup_form(name: Column) -> Column:
    """Case- and whitespace-insensitive form of a name."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def club_words(name: Column, drop=CLUB_FORMS) -> Column:
    """Accent-folded words of a club name without its club-form tokens."""
    plain = F.regexp_replace(fold_accents(F.lower(name)), "'", "")
    words = F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*drop)) if drop else F.filter(
        words, lambda w: w != ""
    )


def feed_words(name: Column) -> Column:
    """Words of a feed's short name: ASCII letters and digits only, nothing dropped."""
    plain = F.regexp_replace(fold_accents(F.regexp_replace(F.lower(name), "'", "")), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def words_within(words: Column, other: Column) -> Column:
    """Every word starts some word of the other name; no words is no match."""
    return (F.size(words) > 0) & F.forall(
        words, lambda w: F.exists(other, lambda o: F.startswith(o, w))
    )


def word_prefixes(words: Column) -> Column:
    """Every prefix of every word, without repeats: the keys a prefix match can meet on."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                words,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n)
                ),
            )
        )
    )


def uk_time(utc: Column) -> Column:
    return zone_time(utc, "Europe/London")


def zone_time(utc: Column, zone: str) -> Column:
    """Wall-clock time of an instant in a zone, whatever the session's own zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), utc.cast("timestamp_ntz"))


def kickoff_label(utc: Column, zone: str, label: str) -> Column:
    """``20:30 IST``: the clock of a named zone, with its name beside it."""
    return F.concat_ws(" ", F.date_format(zone_time(utc, zone), "HH:mm"), F.lit(label))


IDENTIFIER = re.compile(r"^[a-z_][a-z0-9_]*$")
