"""Table functions in SQL: detectors over a partitioned table argument.

    SELECT * FROM spindles(TABLE(e) PARTITION BY (rec, ch), 64.0D, 512)

A table has columns epoch and samples; all other columns are the keys of a trace, must be constant inside a partition and come back
in front of the events, with the types that they have. A partition is one channel of one recording and holds 24 bytes for each of its samples
(140 MB for eight hours at 200 Hz); ``operators.detectors`` has the same detectors without that bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, ShortType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from wavelake.functions import dsp
from wavelake.session import ship


class TraceFunction:
    """The common part of the table functions: what comes in, what goes out, and the joined trace."""

    #: Names of the events' columns (doubles), and of the constant arguments behind fs and per_epoch.
    columns: tuple[str, ...] = ()
    more: tuple[str, ...] = ()

    @classmethod
    def describe(cls, table: AnalyzeArgument, *constants: AnalyzeArgument) -> AnalyzeResult:
        names = ("fs", "per_epoch", *cls.more)
        if not table.isTable:
            raise ValueError("the first argument must be a table of epochs")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        if not isinstance(fields.get("epoch"), (ShortType, IntegerType, LongType)) or not isinstance(fields.get("samples"), ArrayType):
            raise ValueError("the table needs a whole number named epoch and an array named samples")
        if len(constants) != len(names) or any(a.isTable or not a.isConstantExpression or a.value is None or not float(a.value) > 0 for a in constants):
            raise ValueError(f"the table is followed by positive constants: {', '.join(names)}")
        out = StructType()
        for name, kind in fields.items():
            if name not in ("epoch", "samples"):
                out = out.add(name, kind)
        for name in cls.columns:
            if name in fields:
                raise ValueError(f"the table may not have a column {name}: the result has one")
            out = out.add(name, DoubleType())
        return AnalyzeResult(schema=out)

    def __init__(self):
        self.epochs, self.key, self.constants = [], None, ()

    def take(self, row, constants) -> None:
        values = row.asDict()
        epoch, samples = values.pop("epoch"), values.pop("samples")
        key = tuple(values.values())
        if self.key is not None and key != self.key:
            raise ValueError("a partition holds one trace: PARTITION BY all other columns of the table")
        self.key, self.constants = key, constants
        if epoch is not None and samples is not None:
            self.epochs.append((epoch, np.array([np.nan if v is None else v for v in samples], float)))

    def events(self, runs, fs, *more):
        raise NotImplementedError

    def found(self):
        from wavelake.operators.traces import pieces

        if self.key is None or not self.epochs:
            return
        fs, per_epoch, *more = self.constants
        size = max(e for e, _ in self.epochs) + 1
        low = min(0, min(e for e, _ in self.epochs))
        moved = [(e - low, x) for e, x in self.epochs]
        runs = [(first + low * int(per_epoch), arrays[0]) for first, _, _, arrays in pieces(moved, int(per_epoch), 0, size - low, 0, 0, lambda x, left, right: (x,))]
        for event in self.events(runs, float(fs), *map(float, more)):
            yield (*self.key, *event)


class Spindles(TraceFunction):
    columns = ("start_s", "end_s", "peak_s", "duration_s", "amplitude", "peak_hz")

    @staticmethod
    def analyze(table: AnalyzeArgument, fs: AnalyzeArgument, per_epoch: AnalyzeArgument) -> AnalyzeResult:
        return Spindles.describe(table, fs, per_epoch)

    def eval(self, row, fs, per_epoch):
        self.take(row, (fs, per_epoch))

    def terminate(self):
        yield from self.found()

    def events(self, runs, fs):
        from wavelake.operators.detectors import spindle_events, spindle_kernel

        made = [(first, *spindle_kernel(fs)(x, False, False)) for first, x in runs]
        limit = np.percentile(np.concatenate([env for _, _, env in made]), 90)
        for first, band, env in made:
            yield from spindle_events(fs)(band, env, 0, len(env), first, limit)


class SlowWaves(TraceFunction):
    columns = ("start_s", "neg_peak_s", "zero_cross_s", "end_s", "neg_peak_uv", "pos_peak_uv", "ptp_uv", "duration_s", "slope_uv_per_s")
    more = ("depth",)

    @staticmethod
    def analyze(table: AnalyzeArgument, fs: AnalyzeArgument, per_epoch: AnalyzeArgument, depth: AnalyzeArgument) -> AnalyzeResult:
        return SlowWaves.describe(table, fs, per_epoch, depth)

    def eval(self, row, fs, per_epoch, depth):
        self.take(row, (fs, per_epoch, depth))

    def terminate(self):
        yield from self.found()

    def events(self, runs, fs, depth):
        from wavelake.operators.detectors import SLOW_BAND, slow_wave_events

        for first, x in runs:
            yield from slow_wave_events(fs)(dsp.sosfiltfilt(dsp.butter_sos(4, SLOW_BAND, fs), x)[0], 0, len(x), first, depth)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``spindles`` and ``slow_waves`` callable in SQL."""
    ship(spark)
    spark.udtf.register("spindles", udtf(Spindles))
    spark.udtf.register("slow_waves", udtf(SlowWaves))
