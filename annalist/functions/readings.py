"""Script bodies in SQL: table functions that parse a text once and give all that it says.

`script_assignments(text, base_line)` gives the assignments of a text in order. `script_readings(...)` gives one row for an operation with every reading of its body
by the recognisers of `effects` and `forms`, so a query that needs several kinds of readings parses each body once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from annalist.functions import effects, forms, script

READINGS = "array<struct<origin: string, name: string, owner: string, value: string, second: string, required_date: int, step: int, complete: boolean>>"


@udtf(returnType="position int, key string, value_kind string, raw_value string, line int", useArrow=True)
class Assignments:
    """Nothing for a null text; comments are passed over. base_line: the line that the text starts on."""

    def eval(self, text: str, base_line: int) -> Iterator[tuple]:
        for k, a in enumerate(script.assignments(script.without_comments(text), base_line) if text else ()):
            yield k, a.key, a.kind, a.raw, a.line_start


# With Arrow each row's result would be a frame of its own, which costs far more than its parse.
@udtf(returnType=f"readings {READINGS}", useArrow=False)
class Readings:
    """One row, with an empty array where nothing is recognised. origin: `form` for a whole body of reviewed form, `said` for each thing that it says."""

    def eval(self, entity: str, path: str, effective_date: int, key: str, kind: str, raw: str) -> Iterator[tuple]:
        raw = raw or ""
        found = [x for f in effects.RECOGNISERS for x in f(key, kind, raw)]
        whole = effects.said_whole(found, key, kind, raw)
        out = [("said", *x, step, whole) for step, x in enumerate(found)]
        if effective_date is not None:
            out += [("form", name, None, value, None, required, 0, complete) for name, value, required, complete in forms.events(entity, path or "", int(effective_date), key, kind, raw)]
        yield (out,)


def register(spark: SparkSession) -> None:
    """Make both functions known to the session's SQL."""
    spark.udtf.register("script_assignments", Assignments)
    spark.udtf.register("script_readings", Readings)


def read(operations: DataFrame) -> DataFrame:
    """operations with `readings`. operations: title_id, path, effective_date, declaration_order, operation_key, value_kind, raw_value and others.

    Operations are dealt evenly over all tasks first: a small file is read by one task, and a title may own very many of them."""
    spark = operations.sparkSession
    register(spark)
    operations = operations.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    call = "script_readings(o.title_id, o.path, o.effective_date, o.operation_key, o.value_kind, o.raw_value)"
    return spark.sql(f"SELECT o.*, r.readings FROM {{operations}} o, LATERAL {call} r", operations=operations)
