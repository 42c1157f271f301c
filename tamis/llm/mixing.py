"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Raking multiplies cell weights until each
margin's token shares meet their targets.  The sampling rate is then set so that the expected
tokens meet the budget with no probability over one, and every document is kept or not by a fixed
uniform of its id.  A cell whose probability is capped at one says in ``weight`` how often its
documents should count, so weighted margins still meet their targets.

A topic, unless a column names it, comes from the words of the text.  Words of at least LETTERS bytes
are hashed into buckets, and the documents that have each bucket are counted over all of them.  The
TOPICS buckets that most documents have, of those that no more than a tenth has, are the topics; a
document's topic is the one that it says most, weighed by rarity, or "(other)" if it says none.

Up to MOST_CELLS cells are raked in the driver's memory, a checked bound; beyond it the same iteration
runs on tables: the same rounds, the same tolerance, the same rate.

Defined cases: nulls are the category "(none)"; a null text is empty; a text without words weighs
nothing and has its cell's probability; a text of any length is counted whole; targets name shares of
a margin, those of absent categories are left out, and categories without a target share what the
temperature rule gives; without documents nothing is returned; margins that contradict each other end
after ``rounds``; rows that share an id are kept or dropped together, a null id is one id; other
columns, whatever their names, are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.llm.textbytes import LOWER, NONSPACE, flat, forget_powers, pieces, word_bounds, word_hashes
from tamis.tables import read

PIECE_BYTES = 1 << 20
#: Rows described at once.
SLICE = 1 << 12
MOST_CELLS = 50_000
NONE, OTHER = "(none)", "(other)"
#: A margin's target share is its token share to this power, unless targets are given.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.75
ROUNDS = 100
TOLERANCE = 1e-9
SEED = 20_240_101
TOPICS, LETTERS, BUCKETS, MOST_SHARE = 24, 5, 1 << 16, 0.1


# ---- tokens and topics ----


def _said(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's words; and (row, bucket, times) of the buckets that its longer words fall into."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NONSPACE)
    long = ends - starts >= LETTERS
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[long]
    key = row * BUCKETS + (word_hashes(data, starts[long], ends[long]) >> np.uint64(48)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    return np.diff(first), key // BUCKETS, key % BUCKETS, times


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for whole in pieces(iter([batch]), text, PIECE_BYTES):
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)
        forget_powers(4 * PIECE_BYTES)


@dataclass(frozen=True)
class Topics:
    """Buckets of words that name topics, in order, and how rare each is."""

    buckets: tuple[int, ...]
    rarity: tuple[float, ...]

    def describe(self, column: pa.Array) -> pa.StructArray:
        """(tokens, topic) of each text."""
        tokens, topic = [], []
        names = np.array([f"topic-{b:04x}" for b in self.buckets] + [OTHER])
        rare = np.append(self.rarity, 0.0)
        for part in _slices(pa.record_batch([column], names=["t"]), "t"):
            n, row, bucket, times = _said(part.column("t"))
            at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
            hit = np.array(self.buckets, np.int64)[at] == bucket if self.buckets else np.zeros(len(bucket), bool)
            row, at = row[hit], at[hit]
            weight = times[hit] * rare[at]
            best = np.full(len(n), len(self.buckets))
            order = np.lexsort((at, -weight, row))  # of equal ones the first bucket
            own, first = np.unique(row[order], return_index=True)
            best[own] = at[order][first]
            tokens.append(n)
            topic.append(names[best])
        if not tokens:
            return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["tokens", "topic"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(topic).tolist(), pa.string())], names=["tokens", "topic"])


def find_topics(docs: DataFrame, text: str, topics: int = TOPICS) -> Topics:
    """Count in how many documents each bucket of words stands; all documents are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(BUCKETS), 0
        for batch in batches:
            for part in _slices(batch, "t"):
                count += np.bincount(_said(part.column("t"))[2], minlength=BUCKETS)
                n += part.num_rows
        if n:
            yield shared.vectors({"n": np.array([n]), "count": count})

    got = shared.add_up(docs.select(F.col(text).alias("t")).mapInArrow(run, "key string, vector binary"))
    if not got:
        return Topics((), ())
    n, count = float(got["n"][0]), got["count"]
    common = np.where(count <= MOST_SHARE * n, count, 0)
    chosen = np.sort(np.lexsort((np.arange(BUCKETS), -common))[:topics])
    chosen = chosen[common[chosen] > 0]
    return Topics(tuple(int(b) for b in chosen), tuple(float(x) for x in np.log(n / count[chosen])))


# ---- fitting ----


def shares(tokens: dict[str, float], power: float, given: Mapping[str, float] | None) -> dict[str, float]:
    """Target shares of a margin's categories; they sum to one."""
    rule = {k: v**power for k, v in tokens.items()}
    total = sum(rule.values()) or 1.0
    out = {k: v / total for k, v in rule.items()}
    if given:
        out = {k: given.get(k, out[k]) for k in out}
        total = sum(out.values()) or 1.0
        out = {k: v / total for k, v in out.items()}
    return out


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights under which each margin's share of tokens meets its targets."""
    w, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(rounds):
        off = 0.0
        for code, want in zip(codes, targets, strict=True):
            have = np.bincount(code, tokens * w, len(want)) / total
            factor = np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
            off = max(off, float(np.abs(have - want)[have > 0].max(initial=0.0)))
            w = w * factor[code]
        if off < tolerance:
            break
    return w


def solve_rate(budget: float, least: float, sums) -> float:
    """r with sum(tokens * min(1, r * w)) = budget, or the r that keeps everything.

    sums(r): over cells with r * w < 1 the sum of tokens * w, over the others the sum of tokens, and how many those
    are.  The function rises and bends down, so steps along its tangent rise to the solution and end there."""
    r, capped = 0.0, -1
    while True:
        rest, full, n = sums(r)
        if n == capped:
            return r
        if rest <= 0:  # everything is kept
            return 1 / least
        capped, r = n, max((budget - full) / rest, 0.0)


def sampling_rate(tokens: np.ndarray, w: np.ndarray, budget: float) -> float:
    some = (w > 0) & (tokens > 0)
    t, v = tokens[some], w[some]
    if not len(t):
        return 1.0

    def sums(r: float) -> tuple[float, float, int]:
        full = r * v >= 1
        return float((t * v)[~full].sum()), float(t[full].sum()), int(full.sum())

    return solve_rate(budget, float(v.min()), sums)


def _cells_in_memory(spark: SparkSession, cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float, rounds: int) -> DataFrame:
    rows = cells.toPandas()
    tokens = rows["tokens"].to_numpy(float)
    codes, wants = [], []
    for m in TEMPERATURE:
        names, code = np.unique(rows[m].to_numpy(str), return_inverse=True)
        sums = dict(zip(names.tolist(), np.bincount(code, tokens, len(names)).tolist(), strict=True))
        want = shares(sums, TEMPERATURE[m], targets.get(m))
        codes.append(code)
        wants.append(np.array([want[x] for x in names.tolist()]))
    w = rake(tokens, codes, wants, rounds) if tokens.sum() > 0 else np.ones(len(tokens))
    rows["rate"] = w * sampling_rate(tokens, w, budget * tokens.sum())
    return spark.createDataFrame(rows[[*TEMPERATURE, "rate"]], "source string, lang string, topic string, rate double")


def _cells_as_tables(spark: SparkSession, cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float, rounds: int) -> DataFrame:
    """The same fit by joins, for more cells than the driver should hold.  A round is one table in the shared folder."""
    base = shared.scratch(spark, "rake")
    now = shared.table(spark, cells.withColumn("w", F.lit(1.0)), f"{base}/0")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    wants: dict[str, DataFrame] = {}
    for m, power in TEMPERATURE.items():
        sums = now.groupBy(m).agg(F.sum("tokens").alias("t")).withColumn("rule", F.pow("t", F.lit(power)))
        sums = shared.table(spark, sums, f"{base}/sums-{m}")
        part = sums.select(m, (F.col("rule") / float(sums.agg(F.sum("rule")).first()[0] or 1.0)).alias("share"))
        if targets.get(m):
            given = F.create_map(*[F.lit(x) for kv in targets[m].items() for x in kv])
            part = part.select(m, F.coalesce(F.try_element_at(given, F.col(m)), "share").alias("share"))
        whole = float(part.agg(F.sum("share")).first()[0] or 1.0)
        wants[m] = shared.table(spark, part.select(m, (F.col("share") / whole).alias("want")), f"{base}/want-{m}")
    for k in range(1, rounds + 1 if total > 0 else 1):
        moved, off = now, 0.0
        for m, want in wants.items():
            have = moved.groupBy(m).agg((F.sum(F.col("tokens") * F.col("w")) / total).alias("have"))
            both = shared.table(spark, have.join(want, m), f"{base}/{k}-{m}")
            off = max(off, both.where("have > 0").agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            factor = both.select(m, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("f"))
            moved = moved.join(shared.broadcast_if_small(factor), m).withColumn("w", F.col("w") * F.col("f")).drop("f")
        moved = shared.table(spark, moved.select(*TEMPERATURE, "tokens", "w"), f"{base}/{k}")
        shared.drop(spark, f"{base}/{k - 1}", *[f"{base}/{k}-{m}" for m in wants])
        now = moved
        if off < TOLERANCE:
            break
    some = now.where("w > 0 and tokens > 0")
    least = some.agg(F.min("w")).first()[0]

    def sums(r: float) -> tuple[float, float, int]:
        full = F.col("w") * r >= 1
        row = some.agg(F.sum(F.when(~full, F.col("tokens") * F.col("w"))), F.sum(F.when(full, F.col("tokens"))), F.count_if(full)).first()
        return float(row[0] or 0), float(row[1] or 0), int(row[2])

    rate = 1.0 if least is None else solve_rate(budget * total, least, sums)
    out = shared.table(spark, now.select(*TEMPERATURE, (F.col("w") * rate).alias("rate")), f"{base}/rates")
    shared.drop(spark, f"{base}/{k if total > 0 else 0}", *[f"{base}/{x}-{m}" for x in ("sums", "want") for m in wants])
    return out


def mix(
    spark: SparkSession,
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    seed: int = SEED,
    rounds: int = ROUNDS,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``docs`` in a column ``row``, and: id, tokens, source, lang, topic, probability, weight, kept."""
    found = find_topics(docs, text) if topic is None else Topics((), ())

    @F.arrow_udf("struct<tokens:bigint,topic:string>")
    def described(t: pa.Array) -> pa.Array:
        return found.describe(t)

    described = described.asNondeterministic()  # so that the optimizer does not compute it once for each field
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    given = docs.select(whole, F.col(doc_id).alias("id"), described(F.col(text)).alias("d"), named(F.col(source)).alias("source"), named(F.col(lang)).alias("lang"), (F.lit(None) if topic is None else named(topic)).alias("given"))
    counted = given.select("row", "id", F.col("d.tokens").alias("tokens"), "source", "lang", F.coalesce(F.col("given").cast("string"), "d.topic").alias("topic"))
    uri = shared.scratch(spark, "cells")
    cells = shared.table(spark, counted.groupBy(*TEMPERATURE).agg(F.sum("tokens").alias("tokens")), uri)
    if cells.count() <= most_cells:
        rates = F.broadcast(_cells_in_memory(spark, cells, targets or {}, budget, rounds))
    else:
        rates = shared.broadcast_if_small(_cells_as_tables(spark, cells, targets or {}, budget, rounds))
    shared.drop(spark, uri)
    joined = counted.join(rates, list(TEMPERATURE))
    uniform = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)
    chance = F.least(F.lit(1.0), F.col("rate"))
    return joined.select("row", "id", "tokens", *TEMPERATURE, chance.alias("probability"), F.when(F.col("rate") > 0, F.col("rate") / chance).otherwise(F.lit(1.0)).alias("weight"), (uniform < chance).alias("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark, read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "tokens", "source", "lang", "topic", "probability", "weight", "kept")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
