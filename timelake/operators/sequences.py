"""Windows of adjacent blocks with a condition for each place, and islands in ordered events."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.operators.intervals import overlap_join
from timelake.sources.shared import saved

MAX_BLOCKS = 64


@dataclass(frozen=True)
class BlockCondition:
    """What one block must satisfy; None leaves an attribute free. An unknown attribute satisfies nothing."""

    pitch: float | None = None  # MIDI
    pitch_class: float | None = None  # 0 <= x < 12
    tolerance: float = 50.0  # cents
    max_spread: float | None = None
    min_coverage: float = 0.5
    vowels: tuple[str, ...] = ()
    consonants: tuple[str, ...] | None = None
    duration: tuple[float, float] | None = None
    strength: tuple[float, float] | None = None
    character: str | None = None
    trend: tuple[int, float] | None = None  # sign and threshold in semitones


@dataclass(frozen=True)
class WindowQuery:
    blocks: tuple[BlockCondition, ...]
    cross_pauses: bool = False
    max_space: float | None = None
    head: bool = False
    tail: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= len(self.blocks) <= MAX_BLOCKS:
            raise ValueError(f"a query has 1 to {MAX_BLOCKS} blocks")


def pitch_distance(x: Column, target: float, octave_free: bool) -> Column:
    """Cents between a pitch and the target, or the nearest of its octaves."""
    return (F.abs(F.pmod(x - target + 6, F.lit(12.0)) - 6) if octave_free else F.abs(x - target)) * 100


def match(c: BlockCondition) -> tuple[Column, Column]:
    """(whether a block matches, its score). Columns: onset, end, vowel, consonants, midi, spread, coverage, trend, strength, sustain, character."""
    tests, score = [], F.lit(0.0)
    target = c.pitch if c.pitch is not None else c.pitch_class
    if target is not None:
        d = pitch_distance(F.col("midi"), target, c.pitch is None)
        tests.append(d <= c.tolerance + 1e-9)
        score = score + d / max(1.0, c.tolerance)
    if c.max_spread is not None:
        tests.append(F.col("spread") <= c.max_spread + 1e-9)
        score = score + F.col("spread") / max(1.0, c.max_spread)
    if target is not None or c.max_spread is not None:
        tests.append(F.col("coverage") >= c.min_coverage - 1e-12)
    if c.vowels:
        tests.append(F.col("vowel").isin(*c.vowels))
    if c.consonants is not None:
        tests.append(F.col("consonants") == F.array(*map(F.lit, c.consonants)).cast("array<string>"))
    if c.duration is not None:
        length = F.when(F.col("sustain").isNotNull(), F.greatest(F.least("end", "sustain") - F.col("onset"), F.lit(0.0)))
        tests.append(length.between(c.duration[0] - 1e-9, c.duration[1] + 1e-9))
    if c.strength is not None:
        tests.append(F.col("strength").between(*c.strength))
    if c.character is not None:
        tests.append(F.col("character") == c.character)
    if c.trend is not None:
        sign, least = c.trend
        tests.append(F.col("trend") * sign >= least if sign else F.abs("trend") < least)
    whole = reduce(lambda a, b: a & b, tests, F.lit(True))
    return F.coalesce(whole, F.lit(False)), score


def search_blocks(blocks: DataFrame, query: WindowQuery, carry: dict[str, str] | None = None) -> DataFrame:
    """(sample_id, first, start, end, score): runs of adjacent blocks of a sample (ordered by k) that match block by block.

    carry: columns of the blocks that a hit brings along, as an array over its blocks, by the name it gets.

    One sort by (sample_id, k) serves all places of the window: place j looks j rows ahead. Blocks of different pause
    segments (pseg) join only if `cross_pauses`; the space between neighbours is at most `max_space`; `head` and `tail`
    ask for the sample's first and last block.
    """
    w = Window.partitionBy("sample_id").orderBy("k")
    n = len(query.blocks)
    ahead = lambda c, j: F.lead(c, j).over(w) if j else c
    cols = blocks
    for j, c in enumerate(query.blocks):
        ok, score = match(c)
        cols = cols.withColumn(f"_m{j}", ok).withColumn(f"_s{j}", F.when(ok, score))
    tests = [F.coalesce(ahead(F.col(f"_m{j}"), j), F.lit(False)) for j in range(n)]
    tests.append(F.coalesce(ahead(F.col("k"), n - 1) == F.col("k") + n - 1, F.lit(False)))
    if not query.cross_pauses:
        tests.append(ahead(F.col("pseg"), n - 1) == F.col("pseg"))
    if query.max_space is not None and n > 1:
        tests += [ahead(F.col("onset"), j) - ahead(F.col("end"), j - 1) <= query.max_space + 1e-9 for j in range(1, n)]
    if query.head:
        tests.append(F.lag("k").over(w).isNull())
    if query.tail:
        tests.append(F.lead("k", n).over(w).isNull())
    score = reduce(lambda a, b: a + b, [ahead(F.col(f"_s{j}"), j) for j in range(n)])
    hit = reduce(lambda a, b: a & b, tests)
    brought = [F.array(*(ahead(F.col(c), j) for j in range(n))).alias(name) for name, c in (carry or {}).items()]
    out = cols.select("sample_id", F.col("k").alias("first"), F.coalesce("lead", "onset").alias("start"), ahead(F.col("end"), n - 1).alias("end"), score.alias("score"), hit.alias("_hit"), *brought)
    return out.where("_hit").drop("_hit")


#: Ranges that samples are ordered by, and samples drawn to find their bounds.
RANGES, DRAWN = 256, 8192


def order_hits(hits: DataFrame) -> DataFrame:
    """Hits with `rank`: samples by their best score and id, hits of one by score, start and first; scores to 1e-10.

    The order is over all samples, so they are counted by ranges of (best score, id) whose bounds come from a bounded
    draw; a range's samples are numbered together, and each range begins where those before it end. The hits are written to
    the shared folder first, as they are read three times.
    """
    s = F.round("score", 10)
    hits = saved(hits, "hits")
    groups = hits.groupBy("sample_id").agg(F.min(s).alias("best"), F.count("*").alias("n"))
    drawn = groups.orderBy(F.xxhash64("sample_id"), "sample_id").limit(DRAWN).select("best", "sample_id").toPandas().sort_values(["best", "sample_id"])
    cuts = drawn.iloc[[i * len(drawn) // RANGES for i in range(1, RANGES)]].drop_duplicates() if len(drawn) >= RANGES else drawn.iloc[:0]
    place = F.struct("best", "sample_id")
    bounds = F.array(*(F.struct(F.lit(float(b)).alias("best"), F.lit(k.item() if hasattr(k, "item") else k).alias("sample_id")) for b, k in cuts.itertuples(index=False)))
    number = F.size(F.filter(bounds, lambda c: c <= place)) if len(cuts) else F.lit(0)
    ranged = groups.withColumn("range", number)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"))  # at most RANGES rows
    starts = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("range").orderBy("best", "sample_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(starts), "range").select("sample_id", (F.col("base") + F.col("own")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("sample_id").orderBy(s, "start", "first"))
    return hits.withColumn("_in", inside).join(placed, "sample_id").withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_in", "_before")


def event_islands(events: DataFrame, key: str, order: list[str], time: str, gap: float, same: str | None = None) -> DataFrame:
    """Events with `island`: a new one starts after a space above `gap` or, if `same` names a column, when it changes."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap)
    if same:
        new = new | (F.lag(same).over(w) != F.col(same))
    return events.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def pair_markers(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, start, end, error) from markers (mark 'start' or 'end', at, order, duration): the last of several starts wins.

    Errors: duplicate-start (a start that another replaces), start-without-end, end-without-start, out-of-range.
    """
    w = Window.partitionBy(key).orderBy("at", "order")
    m = cues.withColumn("_prev", F.lag("mark").over(w)).withColumn("_next", F.lead("mark").over(w)).withColumn("_to", F.lead("at").over(w))
    start, end = F.col("mark") == "start", F.col("mark") == "end"
    error = (
        F.when(start & (F.col("_next") == "start"), "duplicate-start")
        .when(start & F.col("_next").isNull(), "start-without-end")
        .when(end & (F.col("_prev").isNull() | (F.col("_prev") == "end")), "end-without-start")
        .when(start & ((F.col("at") < 0) | (F.col("_to") > F.col("duration") + 1e-6) | (F.col("_to") <= F.col("at"))), "out-of-range")
    )
    return m.withColumn("error", error).where(start | F.col("error").isNotNull()).select(key, F.col("at").alias("start"), F.when(start & (F.col("_next") == "end"), F.col("_to")).alias("end"), "error")


def name_pairs(pairs: DataFrame, durations: DataFrame, key: str = "source_id") -> DataFrame:
    """Good pairs of sources without errors, with kind: of two the first is op and the second ed, else by the midpoint."""
    clean = pairs.join(pairs.where("error is not null").select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("start"))
    middle = (F.col("start") + F.col("end")) / 2
    kind = F.when(n == 2, F.when(i == 1, "op").otherwise("ed")).otherwise(F.when(middle < F.col("duration") / 2, "op").otherwise("ed"))
    return clean.join(durations, key).withColumn("kind", kind).select(key, "start", "end", "kind")


def register_pairs(pairs: DataFrame, durations: DataFrame, existing: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, start, end, kind, state) of marked pairs: register, overlap (an existing range of the source is in the way) or error.

    A source with any faulty marker registers nothing: its sound pairs have the state error too. existing: key, start, end.
    """
    faulty = pairs.where("error is not null").select(key).distinct()
    named = name_pairs(pairs, durations, key).select(key, "start", "end", "kind")
    found = named.join(faulty, key, "left_anti").withColumn("_id", F.xxhash64(key, "start", "end"))
    met = overlap_join(found.select(F.col(key).alias("source_id"), "_id", "start", "end"), existing.select(F.col(key).alias("source_id"), "start", "end")).select("_id").distinct().withColumn("_met", F.lit(True))
    sound = found.join(met, "_id", "left").select(key, "start", "end", "kind", F.when(F.col("_met"), "overlap").otherwise("register").alias("state"))
    held = pairs.where("error is null").join(faulty, key, "left_semi").select(key, "start", "end", F.lit(None).cast("string").alias("kind"), F.lit("error").alias("state"))
    return sound.unionByName(held)
