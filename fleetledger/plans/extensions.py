"""Extension points: an external token counter and custom plan sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetledger.functions.binding import let
from fleetledger.operators import plans

# Fixed value: shape of a plan source's name.
SOURCE_NAME = re.compile(r"^[a-z][a-z0-9-]*$")
BUILT_IN = ("headings", "task-list")
MIN_CONFIDENCE = 0.3
#: Rows that a task gathers before they leave.
BLOCK_ROWS = 5_000


def token_counter(count: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Wrap a batch token counter as ``struct<tokens, accurate>``.

    Where the counter fails on a batch, its texts are counted one by one, and those on which it fails alone fall back to
    the byte estimate and are marked inaccurate: the result doesn't depend on how rows were batched. A null text has null
    tokens and is not given to the counter. A lack of memory is no failure of the counter and stops the job.
    """

    def one(text: str | None) -> tuple[int | None, bool]:
        try:
            counts = count(pd.Series([] if text is None else [text], dtype=object))
            return None if text is None else int(counts.iloc[0]), True
        except MemoryError:
            raise
        except Exception:
            return None if text is None else -(-len(text.encode("utf-8")) // 4), False

    @F.pandas_udf("tokens long, accurate boolean")
    def counted(texts: pd.Series) -> pd.DataFrame:
        known = texts.notna()
        try:
            tokens = count(texts[known]).astype("int64").astype("Int64").reindex(texts.index)
            return pd.DataFrame({"tokens": tokens, "accurate": True})
        except Exception:
            each = [one(t if there else None) for t, there in zip(texts, known, strict=True)]
            tokens, accurate = zip(*each, strict=True) if each else ((), ())
            return pd.DataFrame({"tokens": pd.array(tokens, dtype="Int64"), "accurate": pd.array(accurate, dtype=bool)})

    return counted


class PlanSources:
    """Named plan formats: the built-in ones and those a user adds. Of all that are registered the most confident parses a
    file, from the first on a tie, built-in ones being first; a file on which none reaches the floor has no format."""

    def __init__(self) -> None:
        self._sources: dict[str, tuple[Callable[[str], float], Callable[[str], Iterable[tuple[float, str]]]]] = {}

    def register(self, name: str, detect: Callable[[str], float], parse: Callable[[str], Iterable[tuple[float, str]]]) -> None:
        if not SOURCE_NAME.match(name):
            raise ValueError(f"plan source names are lowercase kebab-case: {name!r}")
        if name in BUILT_IN or name in self._sources:
            raise ValueError(f"plan source {name!r} is already registered")
        self._sources[name] = (detect, parse)

    def unregister(self, name: str) -> bool:
        return self._sources.pop(name, None) is not None

    def ranked(self, files: DataFrame) -> DataFrame:
        """``files`` with ``ranking``, every source and its confidence, the most confident first, and ``format``, the first
        of them or ``none``. Built-in confidences are column expressions; a text goes to the user's sources once."""
        detects = [detect for detect, _ in self._sources.values()]

        @F.arrow_udf("array<double>")
        def confidences(texts: pa.Array) -> pa.Array:
            # a batch stays Arrow's, one text of it at a time is Python's
            return pa.array([[float(detect(t.as_py() or "")) for detect in detects] for t in texts], pa.list_(pa.float64()))

        own = confidences("text") if detects else F.array().cast("array<double>")
        names = F.array(*map(F.lit, (*BUILT_IN, *self._sources)))

        def rank(all_confidences: Column) -> Column:
            # descending confidence, then the order of registration
            entries = F.transform(
                F.arrays_zip(names.alias("name"), all_confidences.alias("confidence")),
                lambda s, i: F.struct(
                    (-F.coalesce(F.nanvl(s["confidence"], F.lit(0.0)), F.lit(0.0))).alias("less"), i.alias("i"), s["name"].alias("name")
                ),
            )
            return F.transform(F.array_sort(entries), lambda s: F.struct(s["name"].alias("name"), (-s["less"]).alias("confidence")))

        def choose(ranking: Column) -> Column:
            best = F.get(ranking, F.lit(0))
            name = F.when(best["confidence"] >= MIN_CONFIDENCE, best["name"]).otherwise("none")
            return F.struct(ranking.alias("ranking"), name.alias("format"))

        built_in = let(F.col("confidences"), lambda c: F.array(c["headings"], c["task_list"]))
        chosen = let(F.concat(built_in, own), lambda values: let(rank(values), choose))
        scored = plans.format_confidences(files).withColumn("__chosen", chosen)
        return scored.select(*files.columns, "__chosen.ranking", "__chosen.format")

    def chunks(self, files: DataFrame) -> DataFrame:
        """``repo_id, path, source, chunk_id, title`` of every file that a source recognizes, parsed by its winner."""
        sources = dict(self._sources)
        found = self.ranked(files.select("repo_id", "path", "text"))

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a file's text becomes Python's alone, and rows leave in blocks of bounded number
            rows: list[tuple[str, str, str, float, str]] = []
            for batch in batches:
                for repo, path, text, name in zip(*(batch.column(c) for c in ("repo_id", "path", "text", "format")), strict=True):
                    lead = repo.as_py(), path.as_py(), name.as_py()
                    for i, title in sources[lead[2]][1](text.as_py() or ""):
                        rows.append((*lead, float(i), title))
                        if len(rows) == BLOCK_ROWS:
                            yield block(rows)
                            rows = []
            if rows:
                yield block(rows)

        def block(rows: list[tuple[str, str, str, float, str]]) -> pa.RecordBatch:
            types = {"repo_id": pa.string(), "path": pa.string(), "source": pa.string(), "chunk_id": pa.float64(), "title": pa.string()}
            columns = zip(types.values(), zip(*rows, strict=True), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for kind, values in columns], names=list(types))

        schema = "repo_id string, path string, source string, chunk_id double, title string"
        custom = found.where(~F.col("format").isin(*BUILT_IN, "none")).select("repo_id", "path", "text", "format")
        out = custom.mapInArrow(parse, schema)
        for name, built_in in zip(BUILT_IN, (plans.heading_chunks, plans.task_list_chunks), strict=True):
            won = built_in(found.where(F.col("format") == name).select("repo_id", "path", "text"))
            out = out.unionByName(
                won.select("repo_id", "path", F.lit(name).alias("source"), F.col("chunk_id").cast("double").alias("chunk_id"), "title")
            )
        return out
