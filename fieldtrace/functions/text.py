"""Jersey, clock, title and lexicon functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_number(text: Column) -> Column:
    """FN-10: "05" -> "5"; anything but digits up to 99 is null."""
    t = F.trim(text)
    n = F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    return F.when(n <= 99, n.cast("string"))


def first_digits(text: Column) -> Column:
    """FN-10: first run of digits of a text as a normalised number."""
    return normalize_number(F.get(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), F.lit(0)))


def truncation_ambiguous(candidate: Column, roster: Column) -> Column:
    """FN-11: a one-digit read inside any two-digit roster number cannot be told from a cut-off read."""
    return (F.length(candidate) == 1) & F.exists(roster, lambda r: (F.length(r) == 2) & r.contains(candidate))


def attribution_allowed(candidate: Column, cluster: Column, bound: Column, roster: Column) -> Column:
    """FN-11: candidates of the bound cluster must be roster numbers and unambiguous."""
    return F.when(bound.isNull() | (cluster != bound), True).otherwise(
        F.array_contains(roster, candidate) & ~truncation_ambiguous(candidate, roster))


def parse_clock(text: Column) -> Column:
    """FN-12: MM:SS, or seconds with tenths below a minute; null otherwise."""
    m = F.regexp_extract(text, "^([0-9]+):([0-9]+)$", 1)
    s = F.regexp_extract(text, "^([0-9]+):([0-9]+)$", 2).try_cast("int")
    value = text.try_cast("double")
    return F.when(text.contains(":"), F.when(s < 60, (m.try_cast("int") * 60 + s).cast("double"))).when(
        text.rlike(r"^[0-9]*\.[0-9]*$") & (value < 60), value)


def parse_hms(text: Column) -> Column:
    """FN-12: h:m:s (or m:s) to seconds."""
    parts = F.split(text, ":")
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60.0 + p.try_cast("double"))


def matchup(title: Column, aliases: Column | None = None) -> Column:
    """FN-13: struct(a, b) of the two sides of "A vs. B Full Game ...", null unless there are two."""
    stem = F.get(F.split(title, r"(?i)\s+Full\s+(?:Game|Match)|\s+Game\s+Replay"), F.lit(0))
    parts = F.split(stem, r"(?i)\s+vs\.?\s+", 2)

    def side(i):
        raw = F.trim(F.get(parts, F.lit(i)))
        return raw if aliases is None else F.coalesce(F.try_element_at(aliases, raw), raw)

    return F.when(F.size(parts) == 2, F.struct(side(0).alias("a"), side(1).alias("b")))


# Month abbreviations in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def title_date_window(title: Column) -> Column:
    """FN-13: struct(lo, hi) of yyyymmdd bounds.

    An explicit date (a day either side) beats a tournament year (March 1 to April 15), a season
    (November 1 to April 30 of the next year) and a bare year after a bar (January 1 to April 30).
    """
    stem = F.regexp_replace(title, r"\.[^.]*$", "")
    num = r"(\d{1,2})[/.⧸-](\d{1,2})[/.⧸-](\d{2,4})"
    word = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2}),?\s*(\d{4})?"

    def group(pattern, i):
        return F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))

    def window(year, month, day):
        d = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.when(d.isNotNull(), F.struct(
            F.date_format(F.date_sub(d, 1), "yyyyMMdd").alias("lo"),
            F.date_format(F.date_add(d, 1), "yyyyMMdd").alias("hi")))

    def fixed(year, lo, year2, hi):
        return F.when(year.isNotNull(), F.struct(
            F.concat(year, F.lit(lo)).alias("lo"), F.concat(year2.cast("string"), F.lit(hi)).alias("hi")))

    y = group(num, 3).cast("int")
    numeric = window(F.when(y < 100, y + 2000).otherwise(y), group(num, 1).cast("int"), group(num, 2).cast("int"))
    mon = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(group(word, 1))).cast("int")
    named = F.when(group(word, 3).isNotNull(), window(group(word, 3).cast("int"), mon, group(word, 2).cast("int")))
    tour = group(r"(?i)\b(20\d{2})\b(?!-).*\bTour", 1)
    season = group(r"(20\d{2})-(\d{2})", 1)
    bare = group(r"[｜|]\s*(20\d{2})\s", 1)
    return F.coalesce(
        numeric, named, fixed(tour, "0301", tour, "0415"),
        fixed(season, "1101", season.cast("int") + 1, "0430"), fixed(bare, "0101", bare, "0430"))


def tokens(text: Column) -> Column:
    """Lower-case words with apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))


def lexicon_hits(segments: DataFrame, lexicon: DataFrame, segment_id: list[str], text: str, word: str,
                 entry: str) -> DataFrame:
    """FN-14: whole-word lexicon hits per segment; a word shared by several entries is ambiguous.

    Words are counted once per segment before the join, and the lexicon is grouped by word, so the
    join sees one row per (segment, word) against one row per word.
    """
    words = segments.select(*segment_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("_w"))
    lex = lexicon.groupBy(F.lower(word).alias("_w")).agg(F.array_sort(F.collect_set(entry)).alias("candidates"))
    return words.join(lex, "_w").select(
        *segment_id, F.col("_w").alias("word"), "candidates", (F.size("candidates") > 1).alias("ambiguous"))


def is_free_throw(type_text: Column) -> Column:
    """FN-15: the row type names a free throw."""
    return F.replace(F.lower(type_text), F.lit(" "), F.lit("")).contains("freethrow")
