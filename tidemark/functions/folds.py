"""Folds over the bars of each symbol: Arrow batches in time order, with state carried between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.windows import SYMBOL

#: Gives, for the next bars of a symbol, the new columns' values; arguments are the columns it reads.
Step = Callable[..., Sequence]


def folded(bars: DataFrame, new: dict[str, T.DataType], read: Sequence[str], start: Callable[[], Step], keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Bars with new columns, each a fold over its symbol's bars in time order.

    ``start`` makes a fold for each symbol; it gets the columns ``read`` (doubles with NaN for
    unknown, flags or integers, as arrays) of some bars at a time and returns a sequence for each
    new column. Other columns pass through untouched, and no symbol has to fit in memory. Bars that
    a window has dealt by the keys already aren't dealt or sorted again.
    """
    bars = bars.drop(*new)
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, t) for n, t in new.items())])
    names, kinds = list(bars.columns), [to_arrow_type(t) for t in new.values()]
    at = [names.index(c) for c in read]
    own = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k) for k in own]
            change = np.zeros(batch.num_rows, dtype=bool)
            for k in key:
                codes = k.dictionary_encode().indices.fill_null(-1).to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in at]
            out: list[list] = [[] for _ in new]
            for a, b in zip(edges, edges[1:], strict=False):
                name = tuple(k[a].as_py() for k in key)
                if step is None or name != now:
                    now, step = name, start()
                for into, values in zip(out, step(*(c[a:b] for c in columns)), strict=True):
                    into.append(values)
            made = [pa.concat_arrays([pa.array(v, kind, from_pandas=pa.types.is_floating(kind)) for v in part]) for part, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *new])

    ordered = bars.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "ts")
    return ordered.mapInArrow(run, schema)
