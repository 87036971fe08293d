"""Problem 4: splitting oversized texts at natural boundaries, by bounded-quantifier regular expressions.

The text is viewed as its UTF-8 bytes, one character for each byte, so a quantifier ``{1,n}`` counts bytes. The
alternatives of one expression are ordered by the strength of the boundary; the last one cuts between characters.
Everything runs in the JVM as array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _alternatives(limit: int) -> str:
    half = max(1, limit // 2)
    return "|".join(
        [
            rf".{{1,{limit}}}\z",  # what is left fits
            rf".{{{half},{max(half, limit - 3)}}}\n\r?\n",  # blank line, if the piece is at least half full
            rf".{{0,{limit - 1}}}\n",  # line end
            rf".{{0,{limit - 1}}}\r(?!\n)",  # lone carriage return
            rf".{{{half},{max(half, limit - 2)}}}[;.!?](?=[ \t])",  # end of a statement or sentence inside a line
            rf".{{{half},{max(half, limit - 1)}}}[ \t]",  # white space
            rf".{{1,{limit}}}(?![\x80-\xBF])",  # between two characters
        ]
    )


def boundary_pattern(limit: int, overlap: int) -> str:
    """First piece: up to ``limit`` bytes; later ones leave room for the overlap."""
    return rf"(?s)\A(?:{_alternatives(limit)})|(?:{_alternatives(limit - overlap)})"


def _as_bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _as_text(data: Column) -> Column:
    return F.decode(F.encode(data, "ISO-8859-1"), "UTF-8")


def _lines(data: Column) -> Column:
    return F.length(data) - F.length(F.replace(data, F.lit("\n"), F.lit("")))


def split_oversized(
    chunks: DataFrame,
    limit: int = 4096,
    overlap: int = 256,
    id_col: str = "id",
    text_col: str = "text",
    start_col: str = "start_line",
    end_col: str = "end_line",
    header_col: str = "context_header",
) -> DataFrame:
    """Pieces of all texts above ``limit`` bytes of UTF-8.

    Columns ``chunk_id, part, n_parts, text, overlap_bytes, start_line, end_line, context_header``. A piece has at most
    ``limit`` bytes. Each later piece begins with up to ``overlap`` bytes of whole last lines of the piece before it
    (``overlap_bytes`` says how many; 0 where that piece ends inside a line or its last line is longer). Dropping the
    overlaps and joining the pieces gives the text back. Texts within the limit, empty and null ones give no rows.

    The first line of the text is the smaller of the two lines given (1 if both are null); a null header becomes ''.
    Repeated input rows count once; an empty table gives an empty result. No shuffle but the one for repeated rows,
    which only oversized texts take part in.
    """
    if not 4 <= overlap + 4 <= limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    big = chunks.where(F.octet_length(F.col(text_col)) > limit).select(
        F.col(id_col).alias("chunk_id"),
        F.col(text_col).cast("string").alias("__text"),
        F.coalesce(F.least(F.col(start_col), F.col(end_col)), F.lit(1)).cast("int").alias("__first"),
        F.coalesce(F.col(header_col), F.lit("")).alias("context_header"),
    )
    data = big.dropDuplicates().withColumn("__bodies", F.regexp_extract_all(_as_bytes(F.col("__text")), F.lit(boundary_pattern(limit, overlap)), F.lit(0)))

    def lookback(piece: Column, whole_lines: Column) -> Column:
        tail = F.regexp_extract(F.substring(piece, -(overlap + 1), overlap + 1), r"(?s)\A[^\n]*\n(.*\n)\z", 1)
        return F.when((F.length(piece) <= overlap) & whole_lines & piece.endswith("\n"), piece).otherwise(tail)

    def step(state: Column, body: Column) -> Column:
        before = F.when(F.size(state["out"]) == 0, F.lit("")).otherwise(lookback(state["piece"], state["whole"]))
        piece = F.concat(before, body)
        first = state["lines"] - _lines(before)
        # A piece ends on the line of its last byte, which may be the line feed itself.
        last = first + _lines(piece) - F.when(piece.endswith("\n"), 1).otherwise(0)
        row = F.struct(piece.alias("data"), F.length(before).alias("overlap_bytes"), first.cast("int").alias("first"), last.cast("int").alias("last"))
        whole = (F.length(before) > 0) | (F.size(state["out"]) == 0) | state["piece"].endswith("\n")
        return F.struct(F.concat(state["out"], F.array(row)).alias("out"), piece.alias("piece"), whole.alias("whole"), (state["lines"] + _lines(body)).cast("int").alias("lines"))

    none = F.expr("cast(array() as array<struct<data:string,overlap_bytes:int,first:int,last:int>>)")
    start = F.struct(none.alias("out"), F.lit("").alias("piece"), F.lit(True).alias("whole"), F.lit(0).alias("lines"))
    pieces = data.withColumn("__pieces", F.aggregate("__bodies", start, step, lambda s: s["out"]))
    rows = pieces.select("chunk_id", "context_header", "__first", F.size("__pieces").alias("n_parts"), F.posexplode("__pieces").alias("__i", "p"))
    return rows.select(
        "chunk_id",
        (F.col("__i") + 1).alias("part"),
        "n_parts",
        _as_text(F.col("p.data")).alias("text"),
        F.col("p.overlap_bytes"),
        (F.col("__first") + F.col("p.first")).alias("start_line"),
        (F.col("__first") + F.col("p.last")).alias("end_line"),
        "context_header",
    )
