"""Lenient scan of provider CSV files.

Each file has its own header, width and encoding, and any one file may be very
large, so files are read as *lines*: Spark splits a big file over many tasks,
and only one small row per file (its header and encoding) is gathered and
joined back. Splitting a record into fields is a native expression.

A quoted field may go on over line ends. Whether a line begins inside quotes
depends on everything before it, so every line that holds a quote is read as a
function from "begins inside" to "ends inside". The functions are composed
within a block, one per block is left, and those are composed over the blocks of
a file. Only blocks in which a line ends inside quotes, or that are entered so,
are stitched; a block of the others is a record per line, and never moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.session import durable

_BOM = "\ufeff"
# The fallback code page: what its bytes 80 to 9f stand for, and the five of them
# that stand for nothing.
_CODES = range(0x80, 0xA0)
_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"
_PAGE = {c: bytes([c]).decode("cp1252", "ignore") for c in _CODES}


def _fallback(value: Column) -> Column:
    """Text of a line that is not UTF-8, read as Windows-1252."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    known = {c: t for c, t in _PAGE.items() if t}
    return F.translate(latin, "".join(map(chr, known)), "".join(known.values()))


# What a value is stripped of, at both ends: white space of any script.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))
) + "\u2028\u2029\u202f\u205f\u3000"
_CUT = "\uffff"  # no character, so in no text
# States at a quote: at the start of a field, inside an unquoted one, inside
# quotes, just behind a quote that was inside quotes. Eight more: a quote stood
# inside an unquoted field, where it means itself.
_EDGE, _PLAIN, _INSIDE, _BEHIND, _STRAY = 0, 1, 2, 3, 8
# One field and the comma before it, for records with stray quotes.
_FIELD = r'(?s),("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+)?|[^,]*+)'


def _after_quotes(parts: Column, begin: int) -> Column:
    """The state behind the last quote of a record, which is given as split at its quotes."""

    def step(state: Column, part: Column) -> Column:
        base = state.bitwiseAND(F.lit(3))
        stray = state.bitwiseAND(F.lit(_STRAY))
        outside = (
            F.when(part == "", base).when(part.endswith(","), _EDGE).otherwise(_PLAIN)
        )
        then = (
            F.when(base == _INSIDE, _BEHIND)
            .when((base == _BEHIND) & (part == ""), _INSIDE)
            .when(outside == _EDGE, _INSIDE)
            .otherwise(_PLAIN + _STRAY)
        )
        return then.bitwiseOR(stray)

    before_quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.aggregate(before_quotes, F.lit(begin), step)


def _ends_inside(line: Column, begin: int) -> Column:
    state = _after_quotes(F.split(line, '"', -1), begin)
    return (state.bitwiseAND(F.lit(3)) == _INSIDE).cast("int")


def _fields(record: Column) -> Column:
    """The stripped fields of one record; commas inside quotes do not split."""
    parts = F.split(record, '"', -1)
    # Without stray quotes every second part is inside quotes.
    marked = F.array_join(
        F.transform(
            parts, lambda x, i: F.when(i % 2 == 0, F.translate(x, ",", _CUT)).otherwise(x)
        ),
        '"',
    )
    stray = _after_quotes(parts, _EDGE).bitwiseAND(F.lit(_STRAY)) != 0
    cut = F.when(
        stray, F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), 1)
    ).otherwise(F.split(marked, _CUT, -1))

    def bare(x: Column) -> Column:
        inner = F.split(F.substring(x, F.lit(2), F.length(x)), '"', -1)
        closed = F.regexp_extract(x, r'(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
        body = F.regexp_extract(x, r'(?s)^"([^"]*+(?:""[^"]*+)*+)', 1)
        whole = F.concat(F.replace(body, F.lit('""'), F.lit('"')), closed)
        simple = F.element_at(inner, 1)
        return F.when(~x.startswith('"'), x).when(
            (F.size(inner) == 2) & (F.element_at(inner, 2) == ""), simple
        ).otherwise(whole)

    fields = F.when(record.contains('"'), F.transform(cut, bare)).otherwise(
        F.split(record, ",", -1)
    )
    return F.transform(fields, lambda x: F.btrim(x, F.lit(_WHITE)))


def _once(value: Column) -> Column:
    """``value``, worked out once a row: a filter on it stays above, and does not work it out again."""
    return F.explode(F.array(value))


def _text(spark: SparkSession, root, names: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return reader.text(root)


def _lines(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )


# The longest record over several lines, in characters. A quote that is never
# closed would make the rest of a file one field; such a file is refused.
RECORD_LIMIT = 1 << 20
OPEN_QUOTE = "quote left open"


def _entering(df: DataFrame, keys: list[str], order: list[str], enter: Column) -> Column:
    """Whether each row is entered inside quotes, where the first of its group is so by ``enter``.

    Rows carry ``f0`` and ``f1``, what they make of outside and inside. A row
    either decides by itself, swaps or keeps, so the state is that of the last
    row that decided, swapped as often as rows swapped since.
    """
    upto = Window.partitionBy(*keys).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")
    swaps = F.sum(swap).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    decided = F.when(F.col("f0") == F.col("f1"), F.struct("f0", swaps.alias("swaps")))
    last = F.last(decided, ignorenulls=True).over(before)
    since = F.coalesce(F.sum(swap).over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    return (F.coalesce(last["f0"], enter) + since) % 2


def _leaving(enter: Column) -> Column:
    return F.when(enter == 1, F.col("f1")).otherwise(F.col("f0"))


def _functions(lines: DataFrame) -> DataFrame:
    """``lines`` with what each makes of "begins inside quotes"."""
    quoted = F.col("value").contains('"')
    return lines.withColumns({
        "f0": F.when(quoted, _ends_inside(F.col("value"), _EDGE)).otherwise(0),
        "f1": F.when(quoted, _ends_inside(F.col("value"), _INSIDE)).otherwise(1),
    })


def _open_blocks(lines: DataFrame) -> DataFrame:
    """``(path, block, enter)`` of the blocks that hold a part of a record over several lines."""
    place = ["path", "block"]
    turns = _functions(lines.filter(F.col("value").contains('"'))).drop("value")
    walked = turns.select(
        "*",
        *[_entering(turns, place, ["position"], F.lit(e)).alias(f"e{e}") for e in (0, 1)],
    )
    of_block = walked.groupBy(*place).agg(
        *[F.max_by(_leaving(F.col(f"e{e}")), "position").alias(f"g{e}") for e in (0, 1)],
        F.max(_leaving(F.col("e0"))).alias("opens"),
    )
    every = lines.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).join(of_block, place, "left")
    blocks = every.select(
        *place,
        F.coalesce("g0", F.lit(0)).alias("f0"),
        F.coalesce("g1", F.lit(1)).alias("f1"),
        F.coalesce("opens", F.lit(0)).alias("opens"),
    )
    entered = blocks.withColumn("enter", _entering(blocks, ["path"], ["block"], F.lit(0)))
    return entered.filter("enter = 1 OR opens = 1").select(*place, "enter")


def _stitched(lines: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, refused)``: the records of open blocks, and the files with an endless one.

    A record is its lines one after the other, without the line ends. It has the
    block and the position of its first line, which may lie in an earlier block.
    """
    place = ["path", "block"]
    held = _functions(lines.join(blocks, place))
    by_line = Window.partitionBy(*place).orderBy("position")
    walked = held.withColumn("inside", _entering(held, place, ["position"], F.col("enter")))
    walked = walked.withColumns({
        "whole": (F.col("inside") == 0) & (F.col("f0") == 0),
        "start": F.last(F.when(F.col("inside") == 0, F.struct("block", "position")), True).over(
            by_line.rowsBetween(Window.unboundedPreceding, 0)
        ),
    })
    whole = walked.filter("whole").select(*place, "position", "value")
    parts = walked.filter("NOT whole")
    # Lines before the first start of their block belong to the last start before it.
    by_block = Window.partitionBy("path").orderBy("block")
    tails = walked.groupBy(*place).agg(F.max("start").alias("last_start")).withColumn(
        "carried",
        F.last("last_start", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)),
    )
    owned = parts.join(tails.select(*place, "carried"), place).select(
        "path", F.coalesce("start", "carried").alias("start"), "block", "position", "value"
    )
    size = owned.groupBy("path", "start").agg(F.sum(F.length("value")).alias("size"))
    refused = size.filter(F.col("size") > RECORD_LIMIT).select("path").distinct()
    joined = (
        owned.join(refused, "path", "left_anti")
        .groupBy("path", "start")
        .agg(F.array_sort(F.collect_list(F.struct("block", "position", "value"))).alias("lines"))
        .select(
            "path",
            F.col("start.block").alias("block"),
            F.col("start.position").alias("position"),
            F.array_join(F.col("lines.value"), "").alias("value"),
        )
    )
    return whole.join(refused, "path", "left_anti").unionByName(joined), refused


def scan_files(spark: SparkSession, root, names: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """``(files, rows)`` of a landing directory, over the files whose names match.

    ``files``: one row per file with its header, whether it is CSV at all,
    whether it decodes and whether a quote is left open. ``rows``: one row per
    data record of the usable files as ``(path, fields map<string,string>,
    padded, short, truncated, discarded)``; blank records are gone, short ones
    padded, long ones cut. A quoted field goes on over line ends, which are not
    part of it.
    """
    text = _lines(_text(spark, root, names))
    place = ["path", "block"]
    # One small row per block that needs it; read twice below.
    blocks = durable(_open_blocks(text), "open-blocks")
    stitched, refused = _stitched(text, blocks)
    lines = text.join(blocks, place, "left_anti").unionByName(stitched)
    raw = F.col("value").cast("binary")
    # The header is the first line of the block at offset zero. Everything here
    # is a partial aggregate: one row per file and task reaches the shuffle.
    per_file = lines.groupBy("path").agg(
        F.min(F.when(F.col("block") == 0, F.col("position"))).alias("first"),
        F.min_by("value", F.when(F.col("block") == 0, F.col("position"))).alias("head"),
        F.bool_and(F.is_valid_utf8(F.col("value"))).alias("utf8"),
        F.bool_or(F.decode(raw, "ISO-8859-1").rlike(_UNDEFINED)).alias("undefined"),
    )
    endless = refused.select("path", F.lit(True).alias("endless"))
    per_file = per_file.join(endless, "path", "full_outer")
    head = F.when(F.col("utf8"), F.col("head")).otherwise(_fallback(F.col("head")))
    start = F.lower(F.trim(F.replace(head, F.lit(_BOM), F.lit(""))))
    is_csv = F.coalesce(
        start.contains(",") & ~start.rlike(r"^(<!doctype|<html|<\?xml)"), F.col("endless")
    )
    names = _fields(F.replace(head, F.lit(_BOM), F.lit("")))
    files = per_file.select(
        "path",
        "first",
        "utf8",
        is_csv.alias("is_csv"),
        F.coalesce(F.col("utf8") | ~F.col("undefined"), F.lit(True)).alias("decodable"),
        F.coalesce("endless", F.lit(False)).alias("endless"),
        names.alias("names"),
    ).select(
        "*",
        F.size("names").alias("width"),
        # Named columns only; a repeated name keeps its last position.
        F.filter(
            F.transform("names", lambda n, i: F.struct(n.alias("name"), i.alias("at"))),
            lambda e: (e["name"] != "")
            & ~F.exists(
                F.transform("names", lambda m, j: F.struct(m.alias("name"), j.alias("at"))),
                lambda o: (o["name"] == e["name"]) & (o["at"] > e["at"]),
            ),
        ).alias("columns"),
    )
    fit = F.col("is_csv") & F.col("decodable") & ~F.col("endless")
    usable = files.filter(fit & (F.size("columns") > 0))
    headers = usable.select("path", "first", "utf8", "width", "columns")
    # All reads number the lines alike: they are one relation, cut into the same partitions. A
    # header that comes again further down is a row like any other.
    data = lines.join(headers, "path").filter(F.col("position") != F.col("first"))
    decoded = F.when(F.col("utf8"), F.col("value")).otherwise(_fallback(F.col("value")))
    data = data.select("path", "width", "columns", _once(_fields(decoded)).alias("cells"))
    data = data.filter(F.exists("cells", lambda c: c != ""))
    have = F.size("cells")
    last_named = F.array_max(F.transform("columns", lambda c: c["at"]))
    named = F.map_from_entries(
        F.transform(
            "columns",
            lambda c: F.struct(c["name"], F.coalesce(F.get(F.col("cells"), c["at"]), F.lit(""))),
        )
    )
    rows = data.select(
        "path",
        _once(named).alias("fields"),
        (have < F.col("width")).alias("padded"),
        (have <= last_named).alias("short"),
        (have > F.col("width")).alias("truncated"),
        F.exists(
            F.slice("cells", F.least(F.col("width"), have) + 1, F.greatest(have, F.lit(1))),
            lambda c: c != "",
        ).alias("discarded"),
    )
    return files, rows


def repairs(rows: DataFrame) -> DataFrame:
    """How often each repair was made, per file."""
    names = ("padded", "short", "truncated", "discarded")
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(n)).alias(n) for n in names]
    )


def unusable(files: DataFrame) -> DataFrame:
    """Files that are not CSV, do not decode or leave a quote open, with the reason."""
    reason = (
        F.when(~F.col("is_csv"), "not csv")
        .when(~F.col("decodable"), "undecodable")
        .when(F.col("endless"), OPEN_QUOTE)
    )
    return files.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def field(name: str) -> Column:
    """One named field of a scanned row; absent reads as an empty string."""
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.lit(""))
