"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed
from lodestone.llm.textcore import LOWER, Words, batches, column_bytes, released

AXES = ("source", "lang", "topic")
#: Places of a text's word profile, and leading directions of the profiles; a topic is one of them and a side of it.
PLACES, DIRECTIONS = 64, 4
#: Cells (source, language, topic) that one task rakes.
TASK_CELLS = 200_000
#: Tasks among which the rows of one cell are dealt where they meet its rate.
SALTS = 32


# --- Topics: learnt from all texts, each language about its own mean. ---


@released
def _profiled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of words, and the root of the shares of its words by 64 places of their hashes, in 1/65535."""
    for batch in batches(stream, "text"):
        raw, docs = column_bytes(batch.column("text"))
        words = Words(LOWER[raw], docs)
        counts = words.counts()
        place = words.doc_of() * PLACES + (words.hashes() >> np.uint64(58)).astype(np.int64)
        share = np.bincount(place, minlength=len(counts) * PLACES).reshape(-1, PLACES) / np.maximum(counts, 1)[:, None]
        profile = np.rint(65535 * np.sqrt(share)).astype("<u2")
        others = [batch.column(n) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(counts), pa.array([x.tobytes() for x in profile], pa.binary())], names=[*(n for n in batch.schema.names if n != "text"), "n_tokens", "profile"])


def _profiles(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    x = np.frombuffer(b"".join(batch.column("profile").to_pylist()), "<u2").reshape(-1, PLACES).astype(float) / 65535
    return x, ["" if v is None else v for v in batch.column("lang").to_pylist()]


def _sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language: how many texts with words, the sum of their profiles and that of the profiles' products, in whole millionths so that any order adds up alike."""
    totals: dict[str, np.ndarray] = {}
    for batch in stream:
        x, languages = _profiles(batch)
        has, languages = x.any(axis=1), np.array(languages, object)
        for language in sorted(set(languages[has].tolist())):
            mine = x[has & (languages == language)]
            sums = np.concatenate([[len(mine) * 1e6], mine.sum(axis=0) * 1e6, (mine.T @ mine).ravel() * 1e6])
            totals[language] = totals.get(language, 0) + np.rint(sums).astype(np.int64)
    for language, s in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(s)), pa.array(np.arange(len(s))), pa.array(s)], names=["lang", "i", "s"])


def _directions(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Each language's mean profile, and the leading directions in which profiles differ from their language's mean.

    Spark sums profiles and their products over all texts; a language's 4,161 sums come to the driver.
    """
    sums = rows.select("lang", "profile").mapInArrow(_sums, "lang string, i long, s long").groupBy("lang", "i").agg(F.sum("s").alias("s"))
    means, scatter = {}, np.zeros((PLACES, PLACES))
    size = 1 + PLACES + PLACES**2
    one: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        own = one.setdefault(r["lang"], np.zeros(size))
        own[r["i"]] = r["s"] / 1e6
    for language in sorted(one):
        n, mean, products = one[language][0], one[language][1 : PLACES + 1], one[language][PLACES + 1 :].reshape(PLACES, PLACES)
        means[language] = mean / n
        scatter += products - np.outer(mean, mean) / n
    vectors = np.linalg.eigh((scatter + scatter.T) / 2)[1][:, ::-1][:, :DIRECTIONS]
    return means, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(DIRECTIONS)])


def _with_topics(means: dict[str, np.ndarray], directions: np.ndarray):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x, languages = _profiles(batch)
            none = np.zeros(PLACES)
            along = (x - np.array([means.get(v, none) for v in languages]).reshape(-1, PLACES)) @ directions
            best = np.abs(along).argmax(axis=1)
            side = along[np.arange(len(x)), best] > 0
            topics = [f"{'+' if s else '-'}{b + 1}" if any_ else None for b, s, any_ in zip(best.tolist(), side.tolist(), x.any(axis=1).tolist(), strict=True)]
            names = ["doc_id", "source", "lang", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(topics, pa.string())], names=[*names, "topic"])

    return run


# --- Raking: sources in Spark, languages and topics on the driver. ---


def _shares(sums: dict, asked: dict | None, power: float) -> dict:
    """Target shares by value: those asked for, or the values' own token shares to a power. Values without tokens have none."""
    weights = {k: (float(asked.get(k, 0.0)) if asked is not None else float(v) ** power) if v > 0 else 0.0 for k, v in sums.items()}
    total = sum(weights.values())
    if total <= 0 and asked is not None and any(v > 0 for v in sums.values()):
        raise ValueError("no value of the axis has a positive target")
    return {k: v / max(total, 1e-300) for k, v in weights.items()}


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """The place of each value, nulls too, among the distinct ones."""
    coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = coded.dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


class Factors:
    """A factor for each language and each topic; those of sources follow from them (``of``)."""

    def __init__(self, by_lang: dict, by_topic: dict):
        self.by_lang, self.by_topic = by_lang, by_topic

    def of(self, cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each cell's factor, all three axes, its source's place, and the sums of the sources before their own factor."""
        source, names = _codes(cells["source"])
        factor = np.ones(cells.num_rows)
        for axis, by in (("lang", self.by_lang), ("topic", self.by_topic)):
            code, values = _codes(cells[axis])
            factor *= np.array([by[v] for v in values] or [0.0])[code]
        sums = np.bincount(source, cells["tokens"].to_numpy() * factor, len(names))
        target = np.zeros(len(names))
        target[source] = cells["target"].to_numpy()
        own = np.divide(target, sums, out=np.zeros(len(names)), where=sums > 0)
        return factor * own[source], source, sums


def _tallied(now: Factors, before: Factors | None):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights by language and topic when sources have met their targets; and how far the sources were off. A source's cells lie in one task."""
        parts = list(stream)
        if not parts:
            return
        cells = pa.Table.from_batches(parts)
        factor, _, sums = now.of(cells)
        off = 1.0
        if before is not None:
            old = before.of(cells)[2]
            off = float(np.abs(np.divide(sums, old, out=np.ones(len(old)), where=old > 0) - 1).max(initial=0))
        lang, langs = _codes(cells["lang"])
        topic, topics = _codes(cells["topic"])
        weights = np.bincount(lang * len(topics) + topic, cells["tokens"].to_numpy() * factor, len(langs) * len(topics))
        some = np.flatnonzero(np.bincount(lang * len(topics) + topic, minlength=len(weights)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs[k // len(topics)] for k in some.tolist()], pa.string()), pa.array([topics[k % len(topics)] for k in some.tolist()], pa.string()), pa.array(weights[some]), pa.array(np.full(len(some), off))],
            names=["lang", "topic", "weight", "off"],
        )

    return run


def _factored(factors: Factors):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(stream)
        if parts:
            cells = pa.Table.from_batches(parts)
            raw = np.where(cells["tokens"].to_numpy() > 0, factors.of(cells)[0], 0.0)
            yield from cells.select([*AXES, "tokens"]).append_column("raw", pa.array(raw)).to_batches()

    return run


def raked(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict | None], rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """Cells with ``raw``, the factor that rakes their tokens to the targets, and the greatest relative gap that is left on any axis.

    A round scales sources, then languages, then topics. Sources may be many: their factors follow in Spark tasks
    from those of the few languages and topics, which the driver holds; a round is one pass over the cells.
    """
    spark = cells.sparkSession
    sums = {axis: {r[axis]: r["t"] for r in cells.groupBy(axis).agg(F.sum("tokens").alias("t")).collect()} for axis in AXES[1:]}
    want = {axis: _shares(sums[axis], targets.get(axis), powers[axis]) for axis in sums}
    of_source = cells.groupBy("source").agg(F.sum("tokens").alias("_t"))
    if (asked := targets.get("source")) is not None:
        given = spark.createDataFrame([(k, float(v)) for k, v in asked.items()], "_value string, _asked double")
        of_source = of_source.join(given, of_source["source"].eqNullSafe(given["_value"]), "left").withColumn("_w", F.coalesce("_asked", F.lit(0.0)))
    else:
        of_source = of_source.withColumn("_w", F.pow("_t", F.lit(powers["source"])))
    of_source = checkpointed(of_source.select(F.col("source").alias("_source"), F.when(F.col("_t") > 0, F.col("_w")).otherwise(0.0).alias("_w")))
    total = of_source.agg(F.sum("_w")).first()[0] or 0.0
    if total <= 0 and asked is not None and any(sums["lang"].values()):
        raise ValueError("no value of the axis has a positive target")
    parts = max(1, -(-cells.count() // TASK_CELLS))
    cells = cells.join(of_source, cells["source"].eqNullSafe(of_source["_source"])).select(*AXES, "tokens", (F.col("_w") / F.lit(max(total, 1e-300))).alias("target"))
    cells = checkpointed(cells.repartition(parts, "source"))
    now, before, left = Factors({k: 1.0 for k in want["lang"]}, {k: 1.0 for k in want["topic"]}), None, 1.0
    for _ in range(rounds):
        # A row for each pair of language and topic and each task of TASK_CELLS cells.
        tally = sorted(cells.mapInArrow(_tallied(now, before), "lang string, topic string, weight double, off double").collect(), key=repr)
        weights = {pair: 0.0 for pair in dict.fromkeys((r["lang"], r["topic"]) for r in tally)}
        for r in tally:
            weights[r["lang"], r["topic"]] += r["weight"]
        gap = max((r["off"] for r in tally), default=0.0)
        factors = {"lang": dict(now.by_lang), "topic": dict(now.by_topic)}
        for place, axis in enumerate(AXES[1:]):
            have = dict.fromkeys(want[axis], 0.0)
            for pair in sorted(weights, key=repr):
                have[pair[place]] += weights[pair]
            scale = {k: want[axis][k] / v if v > 0 else 0.0 for k, v in have.items()}
            gap = max([gap, *(abs(s - 1) for k, s in scale.items() if have[k] > 0)])
            factors[axis] = {k: v * scale[k] for k, v in factors[axis].items()}
            weights = {pair: w * scale[pair[place]] for pair, w in weights.items()}
        now, before, left = Factors(factors["lang"], factors["topic"]), now, gap
        if gap < tolerance:
            break
    return checkpointed(cells.mapInArrow(_factored(now), "source string, lang string, topic string, tokens long, raw double")), left


def _level(cells: DataFrame, budget: float) -> float:
    """The factor at which tokens * min(1, factor * raw) sum to the budget: Newton's steps from below on a concave line of pieces, each one aggregate."""
    level = 0.0
    while True:
        capped = F.col("raw") * F.lit(level) >= 1
        got = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("tokens") * F.col("raw"))).alias("slope")).first()
        if not got["slope"]:
            return level
        following = (budget - float(got["full"])) / got["slope"]
        if following <= level * (1 + 1e-13):
            return max(following, 0.0)
        level = following


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    lang_column: str = "lang",
    topic_column: str | None = None,
    powers: dict[str, float] | None = None,
    targets: dict[str, dict | None] | None = None,
    share: float = 0.8,
    rounds: int = 60,
    tolerance: float = 1e-9,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate, kept, residual: each document's sampling rate and whether it is drawn.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``. The token weights of the cells (source, language, topic)
    are raked until each axis has its target shares within ``tolerance`` or ``rounds`` are over; residual is
    the greatest relative gap left on an axis. Targets are those in ``targets`` by axis and value, or else
    the axis's own token shares to a power below one (``powers``), which lifts small sources. A
    document's rate is min(1, f * weight / tokens) of its cell, f being such that ``share`` of all
    tokens is expected; it is drawn if the leading 52 bits of md5(id:seed), as a fraction, are below the rate.

    Topics come from ``topic_column``, or are learnt from all texts: the direction among the four in which word
    profiles differ most from their language's mean, and the side of it, on which the text lies farthest.

    Null values are a value of their own on each axis; a text without words has no topic (null), weighs nothing and
    has the rate of its cell (0 if that has no tokens at all). Rows that repeat an id are drawn together. An empty
    table gives an empty result; other columns are not looked at. The driver holds a factor for each language and topic.
    """
    powers = {"source": 0.7, "lang": 0.9, "topic": 0.9} | (powers or {})
    targets = targets or {}
    topic: Column = F.col(topic_column).cast("string") if topic_column else F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(lang_column).cast("string").alias("lang"), topic.alias("topic"), F.col(text_column).cast("string").alias("text")
    )
    rows = checkpointed(rows.mapInArrow(_profiled, "doc_id long, source string, lang string, topic string, n_tokens long, profile binary"))
    if topic_column is None:
        rows = rows.mapInArrow(_with_topics(*_directions(rows)), "doc_id long, source string, lang string, n_tokens long, topic string")
    rows = checkpointed(rows.select("doc_id", *AXES, "n_tokens"))
    cells = checkpointed(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    factored, residual = raked(cells, powers, targets, rounds, tolerance)
    level = _level(factored, share * float(cells.agg(F.sum("tokens")).first()[0] or 0))
    rated = factored.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.least(F.lit(1.0), F.col("raw") * F.lit(level)).alias("rate"))
    # A cell with many rows meets its rate in several tasks.
    rated = rated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = (F.col("_own") == F.col("_salt")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("topic").eqNullSafe(F.col("_topic"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return rows.join(rated, same).select("doc_id", *AXES, "n_tokens", "rate", (draw < F.col("rate")).alias("kept"), F.lit(residual).alias("residual"))


def sampled(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents drawn by ``mixed``, all columns unchanged; rows with one id stay or go together."""
    drawn = mixed(docs, id_column, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drawn, docs[id_column].eqNullSafe(drawn["_gone"]), "left_anti")
