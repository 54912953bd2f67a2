"""Problem 3: oversized items cut at natural boundaries, by bounded-quantifier regex extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pattern(limit: int, lines: int) -> str:
    """Alternatives ordered by the strength of the boundary each ends at, within the room that the repeats leave.

    What is repeated in front of a piece are the ``lines`` lines before it. How long those are is told by looking back
    from the end of the last match (``\\G``), in steps of a 24th of the limit; the alternatives then consume what is left
    of the limit at most. Where not one line fits behind the repeats, or those are too long themselves, the piece has
    the whole limit; only a line longer than that is cut inside.
    """

    def cuts(room: int) -> str:
        half = max(1, room // 2)
        return (
            rf"(?:.{{1,{room}}}\z"  # all that is left
            rf"|.{{{half},{room}}}(?<=\n[ \t\r]{{0,64}}\n)"  # after a blank line
            rf"|.{{{half},{room}}}(?<=\n[\]\)\}};,]{{1,4}}\r{{0,1}}\n)"  # after the end of an outermost block
            rf"|.{{{half},{room}}}(?<=\n[ \t]{{1,64}}[\]\)\}};,]{{1,4}}\r{{0,1}}\n)"  # after the end of an inner block
            rf"|.{{1,{room}}}(?<=\n))"  # between lines
        )

    one = rf"(?=.)[^\n]{{0,{limit - 1}}}(?:\n|\z)"  # one line, though it leaves less room for repeats than there should be
    before = lambda most: rf"(?<=(?:(?<![^\n])(?=(?:[^\n]*+\n){{{lines}}}\G)|\A(?=(?:[^\n]*+\n){{1,{lines}}}\G)).{{1,{most}}})"
    step = max(1, limit // 24)
    some = [rf"{before(r)}(?:{cuts(limit - r)}|{one})" for r in range(step, limit, step)] if lines else []
    return "(?s)" + "|".join([*some, cuts(limit), rf".{{1,{limit}}}"])


def bodies(text: Column, limit: int = 2400, overlap_lines: int = 2) -> Column:
    """Array of consecutive parts of ``text``, each of at most ``limit`` characters; joined they are ``text``.

    Each part leaves room for the ``overlap_lines`` lines before it where that is possible.
    """
    if limit < 1 or overlap_lines < 0:
        raise ValueError("limit must be 1 at least and overlap_lines not negative")
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern(limit, overlap_lines)), F.lit(0)))


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def _tail(text: Column, lines: int) -> Column:
    """The last ``lines`` lines of ``text``."""
    parts = F.split(text, "\n")
    more = F.when(F.endswith(text, F.lit("\n")), lines + 1).otherwise(lines)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - more + 1), more), "\n")


def split_items(df: DataFrame, key: str, text: str, start_line: str | None = None, limit: int = 2400, overlap_lines: int = 2) -> DataFrame:
    """Pieces of every item: key, piece_no (from 0), n_pieces, body, overlap, piece, start_line, end_line.

    ``body`` of all pieces of an item, in order, is the item. ``piece`` is ``overlap`` + ``body`` and has at most
    ``limit`` characters; ``overlap`` is the ``overlap_lines`` whole lines before the body, which yields as far as a
    piece of one line allows; it is empty where the repeats and one line exceed the limit, and behind a cut inside a
    line. An item within the limit is one piece, the empty text too; a null text gives no piece. ``start_line`` is
    the line on which ``piece`` begins and ``end_line`` the one on which its last character stands, both reckoned
    from the item's first line (1 if it is null or not given). ``key`` must be unique.
    """
    first = F.coalesce(F.col(start_line).cast("int"), F.lit(1)) if start_line else F.lit(1)
    parts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), first.alias("f"), bodies(F.col(text), limit, overlap_lines).alias("b"))
    # The lines before a part stand in as many parts before it as there are lines: each part is one line at least.
    at = lambda i: F.try_element_at("b", F.col("piece_no") + 1 - i)
    rows = parts.select("k", "f", "b", F.size("b").alias("n_pieces"), F.posexplode("b").alias("piece_no", "body"))
    has = lambda i: F.col("piece_no") >= i
    near = F.concat(*[F.when(has(i), at(i)).otherwise("") for i in range(overlap_lines, 0, -1)]) if overlap_lines else F.lit("")
    whole = F.when(has(overlap_lines + 1), F.endswith(at(overlap_lines + 1), F.lit("\n"))).otherwise(True)
    rows = rows.select("k", "f", "n_pieces", "piece_no", "body", near.alias("near"), whole.alias("whole")).withColumn("tail", _tail(F.col("near"), overlap_lines) if overlap_lines else F.lit(""))
    fits = F.endswith("near", F.lit("\n")) & (F.length("tail") + F.length("body") <= limit) & (F.col("whole") | (F.length("tail") < F.length("near")))
    rows = rows.withColumn("overlap", F.when(fits, F.col("tail")).otherwise("")).drop("near", "tail", "whole")
    w = W.partitionBy("k").orderBy("piece_no")
    rows = rows.withColumn("before", F.coalesce(F.sum(_lines(F.col("body"))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = (F.col("f") + F.col("before")).cast("int")
    end = at + _lines(F.col("body")) - F.when(F.endswith(F.col("body"), F.lit("\n")), 1).otherwise(0)
    return rows.select(
        F.col("k").alias(key), "piece_no", "n_pieces", "body", "overlap", F.concat("overlap", "body").alias("piece"),
        (at - _lines(F.col("overlap"))).cast("int").alias("start_line"), end.cast("int").alias("end_line"),
    )
