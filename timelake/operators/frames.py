"""Exact search over 10 ms pitch frames, by prefix sums over one sort of the frames."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.clocks import to_source

MAX_FRAMES, MIN_BLOCK = 1000, 10


@dataclass(frozen=True)
class PitchBlock:
    """A stretch of frames near one pitch (or gliding to another)."""

    frames: int
    midi: float
    to: float | None = None


@dataclass(frozen=True)
class PitchQuery:
    blocks: tuple[PitchBlock, ...]
    tolerance: float = 50.0  # cents
    coverage: float = 0.8
    max_gap: float = 0.12  # seconds
    octave_free: bool = False
    elastic: tuple[float, float] | None = None

    def __post_init__(self):
        if not 1 <= len(self.blocks) <= 16 or any(b.frames < MIN_BLOCK for b in self.blocks) or sum(b.frames for b in self.blocks) > MAX_FRAMES:
            raise ValueError("a query has 1 to 16 blocks of at least 10 frames, 1000 frames in all")
        if self.octave_free and any(b.to is not None for b in self.blocks):
            raise ValueError("glides are searched at their own octave")


def reliable(conf: Column, energy: Column, f0: Column) -> Column:
    """Frames whose pitch counts; unmeasured (null) ones never do."""
    return F.coalesce((conf > 0.05) & (energy > 1e-10) & (f0 > 0) & (conf >= 0.5), F.lit(False))


def with_pitch(frames: DataFrame) -> DataFrame:
    ok = reliable(F.col("conf"), F.col("energy"), F.col("f0"))
    return frames.withColumn("ok", ok).withColumn("midi", F.when(ok, 69 + 12 * F.log2(F.col("f0") / 440.0)))


def elastic_lengths(query: PitchQuery) -> list[tuple[float, list[int]]]:
    """(ratio, block lengths) of each length variant: whole lengths at ratios in steps of 0.01, block edges in proportion, rounded."""
    if query.elastic is None:
        return [(1.0, [b.frames for b in query.blocks])]
    edges = [sum(b.frames for b in query.blocks[:i]) for i in range(len(query.blocks) + 1)]
    whole, (low, high) = edges[-1], query.elastic
    half_up = lambda x: math.floor(x + 0.5 + 1e-9)
    out = []
    for total in sorted({half_up(whole * (low + 0.01 * k)) for k in range(round((high - low) * 100) + 1)}):
        at = [half_up(e * total / whole) for e in edges]
        sizes = [b - a for a, b in zip(at[:-1], at[1:], strict=True)]
        if min(sizes) > 0:
            out.append((total / whole, sizes))
    return out


def _variant(frames: DataFrame, query: PitchQuery, sizes: list[int], octave: int, salt: list[str]) -> DataFrame:
    """Hits of one length variant in one octave. Columns of `frames`: sound, frame, ok, midi; frames of a sound have no holes."""
    w = Window.partitionBy("sound", *salt).orderBy("frame")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, n: F.lead(c, n).over(w)
    prefix, cols = {}, {"_ok": F.col("ok").cast("int")}
    for j, b in enumerate(query.blocks):
        if b.to is None:
            d = F.abs(F.col("midi") - (b.midi + 12 * octave)) * 100
            cols[f"_in{j}"] = F.coalesce((d <= query.tolerance + 1e-6).cast("int"), F.lit(0))
            cols[f"_d{j}"] = F.coalesce(d, F.lit(0.0))
    # one more row closes each sum: the prefix before the frame after the last
    df = frames.withColumns(cols)
    sums = {f"P{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in cols}
    good = F.max(F.when(F.col("ok"), F.col("frame"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns(sums | {"_run": F.when(F.col("ok"), 0).otherwise(F.col("frame") - F.coalesce(good, F.min("frame").over(w) - 1))})
    total, gap = sum(sizes), int(query.max_gap / 0.01 + 0.5 + 1e-9)
    last = lambda c, n: ahead(F.col(f"P{c}"), n - 1) + ahead(F.col(c), n - 1) if n else F.col(f"P{c}")
    tests = [ahead(F.col("frame"), total - 1).isNotNull()]
    if total > gap:
        over = (F.col("_run") > gap).cast("int")
        df = df.withColumn("_over", over).withColumn("P_over", F.coalesce(F.sum("_over").over(before), F.lit(0)))
        # a run that began before the window counts from the window's first frame on
        tests.append(last("_over", total) - (ahead(F.col("P_over"), gap) if gap < total else F.lit(0)) == 0)
    scores, at = [], 0
    for j, size in enumerate(sizes):
        within = lambda c, a=at, b=at + size: last(c, b) - (last(c, a) if a else F.col(f"P{c}"))
        n, hit, dist = within("_ok"), within(f"_in{j}"), within(f"_d{j}")
        tests += [n >= 1, hit >= query.coverage * size - 1e-9]
        scores.append(dist / n)
        at += size
    score = reduce(lambda a, b: a + b, scores) / len(sizes)
    found = df.select(*salt, "sound", F.col("frame").alias("start"), reduce(lambda a, b: a & b, tests).alias("_hit"), score.alias("score"))
    return found.where("_hit").select(*salt, "sound", "start", F.lit(total).alias("frames"), F.lit(octave).alias("octave"), (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


#: Frames of a sound that one piece answers for; it also holds those that windows beginning in it reach.
PIECE = 12_000
_HITS = "start int, frames int, octave int, score double"


def _cumulated(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype if x.dtype.kind == "f" else np.int64), np.cumsum(x)])


class Piece:
    """Runs of consecutive frames (of one or many pieces of sounds) and the prefix sums that all variants share."""

    def __init__(self, query: PitchQuery, ok: np.ndarray, midi: np.ndarray, end: np.ndarray):
        # end: for each frame the place after the last one of its run
        self.q, self.ok, self.midi, self.end = query, ok, np.where(ok, midi, np.nan), end
        self.voiced = _cumulated(ok)
        self.sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        gap, self.gaps = int(query.max_gap / 0.01 + 0.5 + 1e-9), None
        if len(ok) > gap:
            silent = _cumulated(~ok)
            self.gaps = _cumulated(silent[gap + 1 :] - silent[: len(ok) - gap] == gap + 1)  # silence of gap + 1 frames from here
        self.gap = gap

    def block_sums(self, j: int, octave: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of frames near a block's pitch, and of all frames' distances from it."""
        if (j, octave) not in self.sums:
            d = np.abs(self.midi - (self.q.blocks[j].midi + 12 * octave)) * 100
            self.sums[j, octave] = _cumulated(d <= self.q.tolerance + 1e-6), _cumulated(np.nan_to_num(d))
        return self.sums[j, octave]

    def score(self, sizes: list[int], octave: int) -> np.ndarray:
        """The score of the window at each frame; infinite where it does not fit."""
        total = sum(sizes)
        at = np.flatnonzero(np.arange(len(self.end)) + total <= self.end)
        out = np.full(len(self.end), np.inf)
        if total > self.gap and self.gaps is not None:
            at = at[self.gaps[at + total - self.gap] == self.gaps[at]]
        score, first = np.zeros(len(at)), 0
        for j, (block, size) in enumerate(zip(self.q.blocks, sizes, strict=True)):
            a = at + first
            n = self.voiced[a + size] - self.voiced[a]
            if block.to is None:
                near, far = self.block_sums(j, octave)
                hit, dist = near[a + size] - near[a], far[a + size] - far[a]
            else:  # a band that moves: frame by frame
                hit, dist = np.zeros(len(at), np.int64), np.zeros(len(at))
                for i in range(size):
                    d = np.abs(self.midi[a + i] - (block.midi + (block.to - block.midi) * (i + 0.5) / size)) * 100
                    hit += d <= self.q.tolerance + 1e-6
                    dist += np.nan_to_num(d)
            keep = (n >= 1) & (hit >= self.q.coverage * size - 1e-9)
            at, score = at[keep], score[keep] + dist[keep] / n[keep]
            first += size
        out[at] = np.floor(score / len(sizes) * 10000 + 0.5) / 10000
        return out

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(frames, octave, score) of the best variant at each frame: least score, then nearest length, then nearest octave."""
        n, whole = len(self.end), sum(b.frames for b in self.q.blocks)
        frames, octave, score = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, np.inf)
        octaves = [0]
        if self.q.octave_free:
            heard = self.midi[self.ok]
            octaves = [] if not len(heard) else list(_octaves(float(heard.min()), float(heard.max()), self.q))
        lengths = [sizes for _, sizes in elastic_lengths(self.q)]
        order = sorted(((round(abs(math.log(sum(sizes) / whole)), 12), abs(o), o, sum(sizes), i) for i, sizes in enumerate(lengths) for o in octaves))
        for *_, o, total, i in order:
            own = self.score(lengths[i], o)
            better = own < score
            frames[better], octave[better], score[better] = total, o, own[better]
        return frames, octave, score


def search_pitch(frames: DataFrame, query: PitchQuery) -> DataFrame:
    """(sound, start, frames, octave, score): the best variant of every start frame whose window fits the query.

    frames: sound, frame, ok, midi. A window has no hole and lies in one sound. Sounds are cut into pieces of PIECE frames, each
    with the frames after it that a window may reach; a start is judged in its own piece. So one shuffle serves all variants of
    length and octave, and a long track is spread over tasks.
    """
    longest = max((sum(sizes) for _, sizes in elastic_lengths(query)), default=1)
    pieces = F.sequence(F.floor((F.col("frame") - longest + 1) / PIECE), F.floor(F.col("frame") / PIECE))
    cut = frames.select("sound", "frame", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("midi").cast("double").alias("midi"), F.explode(pieces).alias("piece"))
    placed = cut.repartition("sound", "piece").sortWithinPartitions("sound", "piece", "frame")

    def judge(t: pa.Table) -> pa.RecordBatch | None:
        if not t.num_rows:
            return None
        t = t.combine_chunks()
        sound = t["sound"].combine_chunks().dictionary_encode()
        piece, frame = t["piece"].to_numpy(), t["frame"].to_numpy().astype(np.int64)
        name = sound.indices.to_numpy() if not isinstance(sound, pa.ChunkedArray) else sound.combine_chunks().indices.to_numpy()
        new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (piece[1:] != piece[:-1]) | (frame[1:] != frame[:-1] + 1)])
        end = np.repeat(np.r_[new[1:], len(frame)], np.diff(np.r_[new, len(frame)]))
        midi = t["midi"].to_numpy()
        length, octave, score = Piece(query, t["ok"].to_numpy() & np.isfinite(midi), midi, end).best()
        at = np.flatnonzero(np.isfinite(score) & (frame // PIECE == piece))
        columns = [t["sound"].combine_chunks().take(pa.array(at)), pa.array(frame[at].astype(np.int32)), pa.array(length[at]), pa.array(octave[at]), pa.array(score[at])]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["sound", "start", "frames", "octave", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < PIECE:
                continue
            # whole pieces are judged, the last one may go on in the next batch
            sound, piece = held["sound"].combine_chunks(), held["piece"].to_numpy()
            last = held.num_rows - 1
            same = np.r_[piece == piece[last]] & np.asarray(pc.equal(sound, sound[last]).to_numpy(zero_copy_only=False), bool)
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            out = judge(held.slice(0, first))
            if out is not None:
                yield out
            held = held.slice(first)
        if held is not None:
            out = judge(held)
            if out is not None:
                yield out

    return placed.mapInArrow(run, f"sound {frames.schema['sound'].dataType.simpleString()}, {_HITS}")


def _octaves(low: float, high: float, query: PitchQuery) -> range:
    slack, targets = query.tolerance / 100, [x for b in query.blocks for x in (b.midi, b.to if b.to is not None else b.midi)]
    return range(math.floor((low - max(targets) - slack) / 12) - 1, math.ceil((high - min(targets) + slack) / 12) + 2)


def octave_range(frames: DataFrame, query: PitchQuery) -> range:
    """The octaves by which a query may be moved and still meet the frames' own range of pitches, one more on both sides."""
    m = frames.agg(F.min("midi").alias("low"), F.max("midi").alias("high")).first()
    return range(0) if m.low is None else _octaves(m.low, m.high, query)


def steady_hits(hits: DataFrame, frames: DataFrame, query: PitchQuery, spread: float | None = None, energy: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Hits whose every block is steady: the 90th less the 10th percentile of its reliable pitches is at most `spread` cents,
    and its mean energy within bounds, where all its frames are measured.

    frames: sound, frame, midi, energy (null: unmeasured). Only the frames of hits are read again: an equi-join on sound and
    frame. Lengths of blocks follow from the hit's length.
    """
    lengths = F.create_map(*(x for _, sizes in elastic_lengths(query) for x in (F.lit(sum(sizes)), F.array(*map(F.lit, sizes)))))
    sized = hits.select("sound", "start", "frames", "octave", lengths[F.col("frames")].alias("sizes"))
    blocks = sized.select("sound", "start", "frames", "octave", F.posexplode("sizes").alias("block", "size"), F.col("sizes").alias("all"))
    first = F.col("start") + F.aggregate(F.slice("all", F.lit(1), F.col("block")), F.lit(0), lambda a, x: a + x)
    asked = blocks.withColumn("frame", F.explode(F.sequence(first, first + F.col("size") - 1))).drop("all")
    met = asked.join(frames.select("sound", "frame", "midi", "energy"), ["sound", "frame"], "left")
    keys = ["sound", "start", "frames", "octave"]
    per = met.groupBy(*keys, "block").agg((F.percentile("midi", 0.9) - F.percentile("midi", 0.1)).alias("wide"), F.avg("energy").alias("mean"), F.max(F.col("energy").isNull()).alias("gap"))
    tests = [F.coalesce(F.col("wide") * 100 <= spread + 1e-9, F.lit(False))] if spread is not None else []
    low, high = energy
    if low is not None or high is not None:
        tests.append(~F.col("gap"))
    tests += [F.col("mean") >= low - 1e-15] if low is not None else []
    tests += [F.col("mean") <= high + 1e-15] if high is not None else []
    if not tests:
        return hits
    good = per.groupBy(*keys).agg(F.min(reduce(lambda a, b: a & b, tests)).alias("_good")).where("_good").drop("_good")
    return hits.join(good, keys, "left_semi")


def group_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each island of consecutive starts of a sound."""
    w = Window.partitionBy("sound").orderBy("start")
    rows = hits.withColumn("island", F.col("start") - F.row_number().over(w))
    best = Window.partitionBy("sound", "island").orderBy("score", F.abs("octave"), "octave", "start", "frames")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "island")


def allowed_starts(hits: DataFrame, spans: DataFrame, lines: DataFrame | None = None, head: float | None = None, tail: float | None = None) -> DataFrame:
    """Hits whose whole window lies inside one span (sound, f_start, f_end) of their sound.

    With `head` (`tail`) a hit also begins (ends) within so many seconds of the start (end) of a line (sound, start, end).
    """
    # equi-join on sound and the piece that a hit begins in; a span stands in each piece that it reaches
    within = spans.select(F.col("sound").alias("_sound"), "f_start", "f_end", F.explode(F.sequence(F.floor(F.col("f_start") / PIECE), F.floor(F.greatest("f_start", "f_end") / PIECE))).alias("_piece"))
    own = hits.withColumn("_at", F.floor(F.col("start") / PIECE))
    inside = (own["start"] >= within["f_start"]) & (own["start"] + own["frames"] <= within["f_end"])
    found = own.join(within, (own["sound"] == within["_sound"]) & (own["_at"] == within["_piece"]) & inside, "left_semi").drop("_at")
    for limit, edge, at in ((head, "start", F.col("start") * 0.01), (tail, "end", (F.col("start") + F.col("frames")) * 0.01)):
        if limit is not None:
            # equi-join on the second that a hit's edge lies in; a line offers those within its reach
            e = lines.select("sound", F.col(edge).alias("_e")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_e") - limit - 1e-9), F.floor(F.col("_e") + limit + 1e-9))))
            own = found.withColumn("_at", at).withColumn("_cell", F.floor("_at"))
            found = own.join(e, (own["sound"] == e["sound"]) & (own["_cell"] == e["_cell"]) & (F.abs(own["_at"] - e["_e"]) <= limit + 1e-9), "left_semi").drop("_at", "_cell")
    return found


#: Fixed values of the coarse search: frames of a cell, its slack, its budgets and its largest answer.
CELL, SHARE_SLACK, PITCH_SLACK, BUDGET, RADIUS, MOST_HITS = 5, 0.15, 1.0, 2000, 5, 100


def coarse(frames: DataFrame, step: int = CELL) -> DataFrame:
    """A summary of the frames, whole cells of 50 ms alone: the mean reliable pitch and the reliable share."""
    g = frames.groupBy("sound", F.floor(F.col("frame") / step).alias("cell")).agg(F.avg("midi").alias("midi"), F.avg(F.col("ok").cast("double")).alias("share"), F.count("*").alias("n"))
    return g.where(F.col("n") == step).drop("n")


def search_coarse(frames: DataFrame, spans: DataFrame, query: PitchQuery) -> DataFrame:
    """At most MOST_HITS hits (sound, start, frames, octave, score), found coarse to fine.

    Starts on whole cells whose blocks lie near their pitch in the summary form basins; the basins' best starts are
    taken in turns up to a budget, and the exact search runs on the frames around those alone. Not for octave-free,
    elastic or gliding queries.
    """
    if query.octave_free or query.elastic or any(b.to is not None for b in query.blocks):
        raise ValueError("the coarse search takes plain queries")
    length, at, cells = sum(b.frames for b in query.blocks), 0, coarse(frames)
    w = Window.partitionBy("sound").orderBy("cell")
    names = []
    for j, b in enumerate(query.blocks):
        slack = query.tolerance / 100 + PITCH_SLACK
        near = F.when(F.col("midi").between(b.midi - slack, b.midi + slack), F.col("share")).otherwise(0.0)
        first, last = at // CELL, -(-(at + b.frames) // CELL)
        cells = cells.withColumn(f"_n{j}", near)
        whole = F.lead("cell", last - 1).over(w) == F.col("cell") + last - 1
        share = F.sum(f"_n{j}").over(w.rowsBetween(first, last - 1)) / (last - first)
        cells = cells.withColumn(f"_c{j}", F.when(whole & (share >= max(0.0, query.coverage - SHARE_SLACK) - 1e-12), 1 - share))
        names.append(f"_c{j}")
        at += b.frames
    rough = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    starts = cells.withColumn("rough", rough).where("rough is not null").select("sound", (F.col("cell") * CELL).alias("start"), "rough", F.lit(length).alias("frames"))
    starts = allowed_starts(starts, spans)
    order = Window.partitionBy("sound").orderBy("start")
    new = (F.coalesce(F.col("start") - F.lag("start").over(order) > 2 * CELL, F.lit(True))).cast("int")
    basins = starts.withColumn("_new", new).withColumn("basin", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("sound", "basin")
    turns = basins.withColumn("depth", F.row_number().over(inside.orderBy("rough", "start"))).withColumn("best", F.min("rough").over(inside)).withColumn("head", F.min("start").over(inside))
    leaders = turns.where("depth = 1").orderBy("best", "sound", "head").limit(BUDGET).select("sound", "basin")
    taken = turns.join(leaders, ["sound", "basin"], "left_semi").orderBy("depth", "best", "sound", "head").limit(BUDGET).select("sound", "basin", F.col("start").alias("seed"))
    around = taken.withColumn("frame", F.explode(F.sequence(F.col("seed") - RADIUS, F.col("seed") + RADIUS + length - 1)))
    local = around.join(frames, ["sound", "frame"]).select("basin", "seed", "sound", "frame", "ok", "midi")
    exact = _variant(local, query, [b.frames for b in query.blocks], 0, ["basin", "seed"])
    exact = exact.where(F.col("start").between(F.col("seed") - RADIUS, F.col("seed") + RADIUS))
    fit = allowed_starts(exact, spans)
    best = fit.withColumn("_r", F.row_number().over(Window.partitionBy("sound", "basin").orderBy("score", "start"))).where("_r = 1")
    return best.select("sound", "start", "frames", "octave", "score").distinct().orderBy("score", "sound", "start").limit(MOST_HITS)


def search_tracks(frames: DataFrame, tracks: DataFrame, chunks: DataFrame, query: PitchQuery, tags_of=None, predicate: Column | None = None) -> DataFrame:
    """Hits on whole tracks that are measured in full, with their times on the source's clock (source_start, source_end).

    tracks: sound, id, f_start, f_end, mapping; chunks: sound, chunk. `tags_of` makes (id, tag, ...) of windows (id, asset_id, start,
    end, judge_start, judge_end), and `predicate` is a condition on their array `tags`: hits without it go.
    """
    ready = frame_coverage(tracks, chunks).where("ready").select("id")
    whole = tracks.join(ready, "id", "left_semi")
    hits = group_hits(search_pitch(frames.join(whole.select("sound"), "sound", "left_semi"), query))
    timed = hits.join(whole.select("sound", "mapping"), "sound").withColumns({"start_s": F.col("start") * 0.01, "end_s": (F.col("start") + F.col("frames")) * 0.01})
    if predicate is not None:
        timed = timed.withColumn("_id", F.concat_ws("/", "sound", "start", "frames"))
        none = F.lit(None).cast("double")
        found = tags_of(timed.select(F.col("_id").alias("id"), F.col("sound").alias("asset_id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), none.alias("judge_start"), none.alias("judge_end")))
        sets = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set("tag").alias("tags"))
        timed = timed.join(sets, "_id", "left").where(predicate).drop("_id", "tags")
    return timed.select("sound", "start", "frames", "octave", "score", to_source(F.col("mapping"), F.col("start_s")).alias("source_start"), to_source(F.col("mapping"), F.col("end_s")).alias("source_end"))


def hits_of_samples(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, sound, start, frames, score): hits given to every sample (id, sound, f_start, f_end) that contains them."""
    size = 12_000  # frames of a bin: the join is on sound and bin
    s = samples.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("f_start") / size), F.floor(F.col("f_end") / size))))
    h = hits.withColumn("_bin", F.floor(F.col("start") / size))
    return h.join(s, ["sound", "_bin"]).where((F.col("start") >= F.col("f_start")) & (F.col("start") + F.col("frames") <= F.col("f_end"))).select(F.col("id").alias("sample_id"), "sound", "start", "frames", "octave", "score")


def frame_coverage(spans: DataFrame, chunks: DataFrame, size: int = 6000) -> DataFrame:
    """(id, ready, missing): whether all 60 s chunks that a span needs are there, and which are not."""
    need = spans.select("id", "sound", F.explode(F.sequence(F.floor(F.col("f_start") / size), F.floor((F.col("f_end") - 1) / size))).alias("chunk"))
    have = chunks.select("sound", "chunk", F.lit(True).alias("there"))
    per = need.join(have, ["sound", "chunk"], "left").groupBy("id").agg(F.collect_set(F.when(F.col("there").isNull(), F.col("chunk"))).alias("gone"))
    return per.select("id", (F.size("gone") == 0).alias("ready"), F.array_sort("gone").alias("missing"))
