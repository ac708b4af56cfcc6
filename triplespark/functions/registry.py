"""The engine's functions under SQL names, for ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .similarity import _ratio_arrays
from .text import CHUNK, OVERLAP, _decoded, split_text

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
_BARE = r"regexp_replace(page, r'(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<![^>]*>', '<>')"


class ChunkText:
    """A table function: the chunks of a text, numbered from 0; none for null."""

    def eval(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(split_text(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Registers ``fuzz_ratio(a, b)``, ``cosine(x, y)``, ``html_text(page)`` and the table function
    ``chunk_text(text, size, overlap)`` for the session.

    ``cosine`` is a SQL function, so it's inlined and stays native; it is null for a zero vector. ``fuzz_ratio`` compares
    its arguments as they are. The two others run in Arrow batches, with their native parts before them.
    """
    spark.udf.register("fuzz_ratio", F.arrow_udf(_ratio_arrays, "double"))
    spark.udf.register("html_decoded", F.arrow_udf(_decoded, "string"))
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_idx int, chunk string"))
    norm = lambda c: f"sqrt({_DOT.format(c, c)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine(x ARRAY<FLOAT>, y ARRAY<FLOAT>) RETURNS DOUBLE RETURN try_divide({_DOT.format('x', 'y')}, {norm('x')} * {norm('y')})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION html_text(page STRING) RETURNS STRING RETURN html_decoded(regexp_replace({_BARE}, '(?:<[^>]*>)+', '\ufdd0'))")
