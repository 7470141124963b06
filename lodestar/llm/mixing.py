"""Mixing sources to target weights by iterative proportional fitting (raking).

The tokens of all documents are summed over cells of source, language and topic. Raking scales
the cells' probabilities until the expected sums along each of the three dimensions meet their
target shares of the tokens to draw. Documents are then drawn independently, each with its cell's
probability; the weight is that probability over the overall rate.

Topics are the clusters of a spherical k-means over hashed word counts: each round is one pass of
tasks over the counts, and the driver gets TOPICS sums. Every source and language is a category of
its own, however many there are: up to DRIVER_CELLS cells are raked on the driver (counted first),
more of them by the same steps as joins and aggregations.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import hashing
from lodestar.llm.common import batches, discard, fresh, small_or_shuffled, stored, table

TOPICS = 8
#: Groups of the hashed vocabulary (a power of two), and rounds of the k-means.
BUCKETS, ROUNDS_TOPICS = 64, 5
#: Cells that are raked on the driver at most (a few dozen bytes each).
DRIVER_CELLS = 200_000
#: Target share of a category: its observed share to this power, normalised.
TEMPERATURE = 0.5
#: Share of all tokens to draw.
KEEP = 0.5
#: Raking ends when no probability moves by this much in a round; it warns if that takes more rounds.
ROUNDS, TOLERANCE = 500, 1e-8
NONE = "(none)"
SEED = 11
DIMENSIONS = ("source", "lang", "topic")
U = np.uint64


def groups_of(texts) -> np.ndarray:
    """Words of each text in each of the BUCKETS groups (texts x BUCKETS)."""
    words = hashing.batch_word_hashes([hashing.lowered(t) for t in texts])
    if not words:
        return np.zeros((0, BUCKETS), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    group = (np.concatenate(words) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(words)) * BUCKETS, sizes) + group, minlength=len(words) * BUCKETS).reshape(len(words), BUCKETS)


def directions(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Unit vectors of the excess over the expected words of each group, in standard deviations; zero without words."""
    expected = counts.sum(1, keepdims=True) * share
    excess = (counts - expected) / np.sqrt(np.maximum(expected, 1e-9))
    return excess / np.maximum(np.sqrt((excess * excess).sum(1, keepdims=True)), 1e-300)


def topics_of(counts: np.ndarray, share: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre by cosine; ties, and texts without words: the first."""
    return (directions(counts, share) @ centres.T).argmax(1)


def centres_of(stats: DataFrame, share: np.ndarray) -> np.ndarray:
    """TOPICS unit vectors by k-means over `stats` (counts array<long>). It begins with the texts of the least hashes; sums are of integers, so the order of tasks changes nothing."""
    spark = stats.sparkSession
    first = stats.where(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) > 0).select(F.xxhash64("counts").alias("h"), "counts").groupBy("h").agg(F.first("counts").alias("counts")).orderBy("h").limit(TOPICS)
    seeds = [r["counts"] for r in first.collect()]
    centres = directions(np.array(seeds, np.float64).reshape(len(seeds), BUCKETS), share)
    if len(seeds) < TOPICS:
        return np.concatenate([centres, np.zeros((TOPICS - len(seeds), BUCKETS))])
    for _ in range(ROUNDS_TOPICS):
        shared = spark.sparkContext.broadcast(centres)

        def sums(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            total = np.zeros((TOPICS, BUCKETS), np.int64)
            for pdf in it:
                if len(pdf):
                    counts = np.stack(pdf["counts"].to_list())
                    np.add.at(total, topics_of(counts, share, shared.value), np.rint(directions(counts, share) * 1e6).astype(np.int64))
            yield pd.DataFrame({"topic": np.repeat(np.arange(TOPICS), BUCKETS), "bucket": np.tile(np.arange(BUCKETS), TOPICS), "x": total.ravel()})

        rows = stats.select("counts").mapInPandas(sums, "topic int, bucket int, x long").groupBy("topic", "bucket").agg(F.sum("x").alias("x")).collect()  # TOPICS x BUCKETS rows
        total = np.zeros((TOPICS, BUCKETS))
        for r in rows:
            total[r["topic"], r["bucket"]] = r["x"]
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def wanted(mass: dict[str, float], target: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the categories with mass: those of `target`, tempered observed shares for what it doesn't name, normalised together."""
    power = {k: v**TEMPERATURE for k, v in mass.items() if v > 0}
    whole = sum(power.values())
    out = {k: (target or {}).get(k, v / whole) for k, v in power.items()}
    if target is not None and (not target or min(target.values()) < 0 or not any(target.get(k, 0) > 0 for k in out)):
        raise ValueError("targets must name a category that has tokens, with shares that are not negative")
    return {k: v / sum(out.values()) for k, v in out.items()}


def _unsettled(moved: float) -> None:
    warnings.warn(f"raking did not settle in {ROUNDS} rounds; in the last, a probability moved by {moved:.2g}", RuntimeWarning, stacklevel=3)


def rake(cells: dict[tuple, float], targets: list[dict], keep: float = KEEP) -> dict[tuple, float]:
    """Probability of each cell, such that the expected mass is `keep` of all and its shares are the targets.

    Iterative proportional fitting with no probability over 1: where targets ask for more of a
    category than there is, all of it is taken and the others keep their proportions as nearly as
    they can. Cells without mass get `keep`; a target of a category without mass is left out.
    Warns (RuntimeWarning) if the probabilities still move after ROUNDS rounds.
    """
    keys = sorted(k for k, v in cells.items() if v > 0)
    if not keys:
        return dict.fromkeys(cells, keep)
    mass = np.array([cells[k] for k in keys]) / sum(cells[k] for k in keys)
    chance = np.full(len(keys), keep)
    margins = []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        place = {n: i for i, n in enumerate(names)}
        index = np.array([place[k[d]] for k in keys])
        want = np.array([target.get(n, 0.0) for n in names])
        margins.append((index, keep * want / want.sum()))
    for _ in range(ROUNDS):
        before = chance
        for index, want in margins:
            have = np.bincount(index, chance * mass, len(want))
            chance = np.minimum(1.0, chance * (want / np.maximum(have, 1e-300))[index])
        if (moved := np.abs(chance - before).max()) < TOLERANCE:
            break
    else:
        _unsettled(moved)
    return dict.fromkeys(cells, keep) | dict(zip(keys, chance.tolist(), strict=True))


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float = KEEP) -> DataFrame:
    """`rake` for any number of `cells` (source, lang, topic, n): adds `chance`. Each step is an aggregation along a dimension and a join back; rounds, tolerance and warning are those of `rake`."""
    spark = cells.sparkSession
    live = cells.where("n > 0")
    total = live.agg(F.sum("n")).first()[0]
    margins = {}
    for name in DIMENSIONS:
        own = live.groupBy(name).agg((F.sum("n") / F.lit(float(total))).alias("share"))
        target = (targets or {}).get(name)
        if target is not None:
            wanted({r[0]: 1.0 for r in own.where(F.col(name).isin(list(target))).collect()} or {"": 1.0}, target)
            named = spark.createDataFrame([(k, float(v)) for k, v in target.items()], f"{name} string, named double")
            own = own.join(small_or_shuffled(named), name, "left")
        else:
            own = own.withColumn("named", F.lit(None).cast("double"))
        power = own.agg(F.sum(F.pow("share", F.lit(TEMPERATURE)))).first()[0]
        own = own.select(name, F.coalesce("named", F.pow("share", F.lit(TEMPERATURE)) / power).alias("want"))
        whole = own.agg(F.sum("want")).first()[0]
        margins[name] = stored(own.select(name, (F.col("want") * (keep / whole)).alias("want")), f"margin-{name}")
    now = stored(live.select(*DIMENSIONS, (F.col("n") / F.lit(float(total))).alias("mass"), F.lit(float(keep)).alias("chance")), "raked")
    for _ in range(ROUNDS):
        new = now.withColumn("was", F.col("chance"))
        for name in DIMENSIONS:
            factor = new.groupBy(name).agg(F.sum(F.col("chance") * F.col("mass")).alias("have")).join(margins[name], name)
            factor = factor.select(name, (F.col("want") / F.greatest("have", F.lit(1e-300))).alias("factor"))
            old, new = new, stored(new.join(small_or_shuffled(factor), name).withColumn("chance", F.least(F.lit(1.0), F.col("chance") * F.col("factor"))).drop("factor"), "raked")
            if name != DIMENSIONS[0]:
                discard(old)
        moved = new.agg(F.max(F.abs(F.col("chance") - F.col("was")))).first()[0]
        discard(now)
        now = new.drop("was")
        if moved is None or moved < TOLERANCE:  # None: no cell has tokens
            break
    else:
        _unsettled(moved)
    for name in DIMENSIONS:
        discard(margins[name])
    return now.select(*DIMENSIONS, "chance")


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """`docs` (doc_id, text, source, lang, ...) with topic, n_tokens, weight, probability, kept.

    targets: wanted shares by dimension and category (topics as strings); categories they don't
    name are tempered from the observed shares, and all are normalised together. ValueError for a
    dimension without a named category that has tokens. Null sources and languages are the category
    `(none)`. Null and empty texts have no tokens and topic 0; they are drawn like their cell, with
    KEEP where it has no tokens. The draw depends on doc_id alone (on the text where it is null), so
    repeated rows are drawn together. Columns of `docs` with the names of the new ones are
    replaced; the rest stays, whatever its names.
    """

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            yield pd.DataFrame({"source": pdf["source"], "lang": pdf["lang"], "counts": list(groups_of(pdf["text"]))})

    category = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(NONE))
    stats = stored(docs.select(category("source").alias("source"), category("lang").alias("lang"), "text").mapInPandas(measure, "source string, lang string, counts array<long>"), "mixing")
    total = stats.agg(*[F.sum(F.col("counts")[i]).alias(str(i)) for i in range(BUCKETS)]).first()
    share = np.array([float(x or 0) for x in total])
    share = share / share.sum() if share.sum() else np.full(BUCKETS, 1 / BUCKETS)
    centres = centres_of(stats, share)

    def topic(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            counts = np.stack(pdf["counts"].to_list()) if len(pdf) else np.zeros((0, BUCKETS))
            yield pd.DataFrame({"source": pdf["source"], "lang": pdf["lang"], "topic": topics_of(counts, share, centres).astype(str), "n": counts.sum(1)})

    cells = stored(stats.mapInPandas(topic, "source string, lang string, topic string, n long").groupBy(*DIMENSIONS).agg(F.sum("n").alias("n")), "mixing-cells")
    discard(stats)
    if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        mass = {(r["source"], r["lang"], r["topic"]): float(r["n"]) for r in cells.collect()}
        shares = []
        for d, name in enumerate(DIMENSIONS):
            margin: dict[str, float] = {}
            for k, v in mass.items():
                margin[k[d]] = margin.get(k[d], 0.0) + v
            shares.append(wanted(margin, (targets or {}).get(name)) if sum(margin.values()) else {})
        chances = docs.sparkSession.createDataFrame([(*k, v) for k, v in rake(mass, shares).items()], "source string, lang string, topic string, chance double")
    else:
        chances = rake_table(cells, targets)
    names = ("topic", "n_tokens", "weight", "probability", "kept")
    rest = [f for f in docs.schema.fields if f.name not in names]

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            counts = groups_of(pdf["text"])
            yield pdf.assign(topic=topics_of(counts, share, centres).astype(np.int32), n_tokens=counts.sum(1))

    schema = T.StructType([*rest, T.StructField("topic", T.IntegerType()), T.StructField("n_tokens", T.LongType())])
    cell, found = fresh(docs, "_cell", "_chance")
    chances = small_or_shuffled(chances.select(F.struct(*DIMENSIONS).alias(cell), F.col("chance").alias(found)))
    measured = docs.select([F.col(f"`{f.name}`") for f in rest]).mapInPandas(assign, schema)
    drawn = measured.withColumn(cell, F.struct(category("source").alias("source"), category("lang").alias("lang"), F.col("topic").cast("string").alias("topic"))).join(chances, cell, "left")
    chance = F.coalesce(found, F.lit(KEEP))
    draw = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(SEED))).otherwise(F.xxhash64("doc_id", F.lit(SEED))), F.lit(1 << 30)) / float(1 << 30)
    return drawn.select(*[F.col(f"`{f.name}`") for f in rest], "topic", "n_tokens", (chance / KEEP).alias("weight"), chance.alias("probability"), (draw < chance).alias("kept"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, probability and draw."""
    return weigh(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).drop("text")
