"""Column helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that operators add for their own use start with this, so that no input column clashes.
OWN = "__fl_"

#: ASCII white space, \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_WORKER_TABLE: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]):
    """A table that a Python worker keeps between tasks.  It keeps one operator's at a time, so stages
    that follow each other don't add up in its memory."""
    if name not in _WORKER_TABLE:
        _WORKER_TABLE.clear()
        _WORKER_TABLE[name] = make()
    return _WORKER_TABLE[name]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once for body; without it Catalyst may copy the expression into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the runs of [^\\x20\\x09-\\x0D]; empty for a text without any."""
    return let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")),
    )


def crc_remainder(identifier: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, mod divisor; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")) % divisor


def number_table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small table of whole numbers, written into the plan."""
    values = ", ".join("(" + ", ".join(f"{v}L" if v > -(2**63) else "-9223372036854775807L - 1L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{x}`' for x in names)})")


def shielded(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names put aside under other ones, and what gives a result of docs its
    own columns back, under their own names and in their order."""
    aside = {c: OWN + "aside_" + c for c in docs.columns if c in names}

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])

    return docs.withColumnsRenamed(aside), back
