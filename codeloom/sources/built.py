"""Python-like source files derived from the ``part`` table.

Each part is a function; parts of one type, brand and key range form a file. Spans, docs and changes follow from
the keys by arithmetic. A file holds the parts of one key range only, so that files keep their size and their
number grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part keys per range; no file holds more functions than this.
KEYS_PER_RANGE = 2000


def built_sources(part: DataFrame, revs: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """(rev, path, content), hash-partitioned by (path, rev)."""
    extension = "CASE p_type WHEN 'PROMO' THEN '.java' WHEN 'SMALL' THEN '.txt' ELSE '.py' END"
    functions = (
        part.selectExpr(
            "p_partkey AS k",
            f"concat(lower(p_type), '/m', p_partkey div {KEYS_PER_RANGE}, '/', replace(lower(p_brand), '#', '_'), {extension}) AS path",
            "p_name",
            "p_size",
            f"explode(array({', '.join(f'{r}L' for r in revs)})) AS rev",
        )
        .where("NOT (rev = 0 AND k % 13 = 0) AND NOT (rev >= 1 AND k % 11 = 0)")
        .selectExpr(
            "path",
            "rev",
            "k",
            "concat(p_name, ' ', k, if(rev >= 1 AND k % 7 = 0, ' v2', '')) AS words",
            "p_size + if(k % 5 = 0, rev, 0) AS number",
        )
        .selectExpr(
            "path",
            "rev",
            "k",
            """concat('def f_', k, '(x):\\n',
                 CASE k % 3 WHEN 0 THEN ''
                            WHEN 1 THEN concat('    \"\"\"', words, '\"\"\"\\n')
                            ELSE concat('    \"\"\"\\n    ', words, '\\n    \"\"\"\\n') END,
                 '    y = x + ', number, ' + ', k, '\\n    return y * ', k, '\\n\\n') AS body""",
        )
    )
    bodies = F.array_sort(F.collect_list(F.struct("k", "body")))
    return (
        functions.groupBy("path", "rev")
        .agg(F.array_join(bodies["body"], "").alias("content"))
        .select("rev", "path", "content")
    )
