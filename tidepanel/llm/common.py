"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the operators see it, for Java and for DuckDB.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or ("*",)))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns of these names, whatever their case: an operator's own output replaces them."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def lower_ascii(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def small_side(df: DataFrame, max_rows: int, wide: str | None = None, max_bytes: int = 32 << 20) -> DataFrame:
    """A broadcast hint when the counted rows stay within `max_rows`, and the bytes of the column `wide`, if one is named,
    within `max_bytes`; else the plain table, for a shuffled join."""
    if wide is None:
        return F.broadcast(df) if df.count() <= max_rows else df
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def beside_text(docs: DataFrame, text: str = "text", out: str = "_row") -> Column:
    """The columns of `docs` other than its text as one struct: a text then goes to Python once, not twice."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias(out)


def with_text(names: list[str], text: str = "text", kept: str = "text", row: str = "_row") -> list[Column]:
    """The columns `names` again, from `beside_text`'s struct and the text in the column `kept`."""
    return [(F.col(kept) if c == text else F.col(row)[c]).alias(c) for c in names]


#: Bytes of text that `map_text` hands over at once.
PIECE = 4 << 20


def _cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, rows) of stretches of rows with about PIECE bytes each."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > PIECE:
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes) - first


def map_text(df: DataFrame, new: T.StructType, work: Callable[[], Callable[[list[bytes | None]], dict[str, list | pa.Array]]],
             text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the columns `new`, which `work()` computes from batches of UTF-8 texts; columns of those names are replaced.

    `work` runs once a task (it builds tables there) and returns the function that handles texts. A batch, which Spark
    bounds by rows and bytes, is handed over and sent on in pieces, so memory does not depend on the partition's size.
    """
    df = without(df, *new.fieldNames())
    keep = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(keep + list(new.fields))
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(new)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = work()
        for b, first, n in ((b, *cut) for b in batches for cut in _cuts(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_pylist())):
            b = b.slice(first, n)
            got = handle(b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            cols += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(cols, names + kinds.names)

    return df.mapInArrow(run, schema)


def sql_words(text: str, pattern: str = WORDS) -> str:
    """DuckDB: the words of a column."""
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def sql_lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A character of the letter categories; superscript digits, fractions and the like are none."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))
