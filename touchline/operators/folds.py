"""Sequential folds over long groups, run in bounded pieces.

Some rules (a pass state machine, a filter, a clamp) need the state left by the
row before. A group is cut into buckets; each bucket is folded in its own task.
A bucket warms up on the last rows of the bucket before it, which nearly always
brings it to the true state. The entry state it used is then checked against the
state the bucket before really left. Only buckets that entered with another state
are folded again, until all agree, so the result equals the one serial fold. A
wrong bucket and those after it are folded as one run, up to where they agree again,
and runs grow from round to round, so the rounds grow with the logarithm of the buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.operators.scans import FRAME_BUCKET
from touchline.session import durable

Step = Callable[[tuple, int, tuple], tuple[tuple, tuple]]

# a run holds so many times the pieces of a run of the round before
RUN_GROWTH = 8


def fold(
    df: DataFrame,
    keys: list[str],
    order: str,
    inputs: list[str],
    step: Step,
    start: tuple,
    output: str,
    size: int = FRAME_BUCKET,
    warmup: int = 256,
) -> DataFrame:
    """Fold ``step(state, at, row) -> (state, result)`` along ``order`` inside ``keys``.

    ``order`` is a non-negative integer column, unique inside a group, and ``at`` its
    value. ``row`` is the tuple of ``inputs``; ``result`` the tuple of the DDL ``output``. Every input
    row gives one row (keys, order, output). States are flat tuples of JSON values.
    """
    results = T.StructType.fromDDL(output)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("_bucket", T.LongType()), T.StructField(order, T.LongType())]
        + results.fields
        + [T.StructField("_entry", T.StringType()), T.StructField("_exit", T.StringType())]
    )
    names, arrow = schema.names, to_arrow_schema(schema)
    result_names = results.names

    piece = F.floor(F.col(order) / F.lit(size)).cast("long")
    warmup = min(warmup, size)
    tail = F.pmod(F.col(order), F.lit(size)) >= F.lit(size - warmup)
    cut = df.select(*keys, order, *inputs, piece.alias("_home"))

    piece_key, width, no_result = [f.name for f in key_fields] + ["_bucket"], len(keys), (None,) * len(result_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folds the sorted pieces of a partition one after another; holds a batch of rows and one state."""
        piece = state = entry = None
        skip = False

        def edge() -> list[tuple]:
            return [] if entry is None else [(*piece, None, *no_result, entry, json.dumps(state))]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            out = []
            places = _tuples(batch, ["_home", order, "_given", "_before", "_was"])
            for now, (home, at, given, before, was), row in zip(_tuples(batch, piece_key), places, _tuples(batch, inputs)):
                if now != piece:
                    out += edge()
                    # a piece that follows one folded just before goes on with its state; nothing to do if it entered with that
                    if entry is not None and before is not None and piece == (*now[:width], before):
                        entry = json.dumps(state)
                    else:
                        entry, state = given, start if given is None else tuple(json.loads(given))
                    skip = was is not None and entry == was
                    piece, entry = now, None if skip else entry
                if skip or at < 0:
                    continue
                own = home == now[width]
                if own and entry is None:
                    entry = json.dumps(state)
                state, result = step(state, at, row)
                if own:
                    out.append((*now, at, *result, None, None))
            if out:
                yield table(out)
        if entry is not None:
            yield table(edge())

    def folded(rows: DataFrame, pieces: int = 1) -> DataFrame:
        # pieces share a Python call: one call for each would cost more than its rows. Dealt by a hash of the keys: after a join
        # on them the planner would leave a plain repartition out, and the join may still be changed to one that splits pieces
        run_of = F.xxhash64(*keys, F.floor(F.col("_bucket") / F.lit(pieces)))
        return rows.repartition(run_of).sortWithinPartitions(*piece_key, order).mapInArrow(run, schema)

    # in repairs a row before all others tells a piece its entry state, the one it had, and the piece before it
    none = {"_given": F.lit(None).cast("string"), "_before": F.lit(None).cast("long"), "_was": F.lit(None).cast("string")}
    first = cut.withColumn(
        "_bucket", F.explode(F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    ).withColumns(none)

    def stored(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, edges) of folded pieces, kept apart so that checking reads edges only."""
        table = durable(pieces.withColumn("_edge", F.col("_exit").isNotNull()), "fold", "_edge").select(*names, "_edge")
        return table.filter(~F.col("_edge")).drop("_edge"), table.filter("_edge").drop("_edge")

    rows, edges = stored(folded(first))
    by_group = Window.partitionBy(*keys).orderBy("_bucket")
    given = F.coalesce(F.lag("_exit").over(by_group), F.lit(json.dumps(start)))
    done, source, pieces = [rows], None, 1
    while True:
        pieces *= RUN_GROWTH
        checked = edges.select(*piece_key, F.col("_entry").alias("_was"), given.alias("_given"), F.lag("_bucket").over(by_group).alias("_before"))
        in_run = Window.partitionBy(*keys, F.floor(F.col("_bucket") / F.lit(pieces))).orderBy("_bucket")
        reached = F.max(F.col("_was") != F.col("_given")).over(in_run)
        wrong = durable(checked.withColumn("_reached", reached).filter("_reached").drop("_reached"), "wrong")
        if wrong.isEmpty():
            break
        # repairs read a written table, so what comes before the fold is computed twice at most
        source = durable(cut, "cut") if source is None else source
        again = source.withColumn("_bucket", F.col("_home")).join(wrong.select(*piece_key), piece_key, "left_semi")
        heads = wrong.withColumns({"_home": F.col("_bucket"), order: F.lit(-1).cast(df.schema[order].dataType)})
        rows, redone = stored(folded(again.unionByName(heads, allowMissingColumns=True), pieces))
        edges = edges.join(redone.select(*piece_key), piece_key, "left_anti").unionByName(redone)
        done = [r.join(redone.select(*piece_key), piece_key, "left_anti") for r in done] + [rows]
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select(*keys, order, *result_names)


def _tuples(batch: pa.RecordBatch, columns: list[str]) -> Iterable[tuple]:
    """Rows as tuples of Python values, missing values and NaN as None."""
    lists = []
    for c in columns:
        values = batch.column(c)
        if pa.types.is_floating(values.type):
            values = pc.if_else(pc.is_nan(values), None, values)
        plain = values.null_count == 0 and pa.types.is_primitive(values.type) and not pa.types.is_temporal(values.type) and not pa.types.is_boolean(values.type)
        lists.append(values.to_numpy().tolist() if plain else values.to_pylist())
    return zip(*lists)
