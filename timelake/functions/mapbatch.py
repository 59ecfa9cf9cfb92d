"""Time maps of a batch of plans at once, in numpy on Arrow arrays: errors, knots and speeds as `timemap.scheme` gives them.

Every step is one over all rows, in the order of `timemap`'s sums, so that both agree to the bit. What no tempo changes (points,
the pauses that a bridge may meet, the places of knots) is laid out once a density, end to end over the rows (`Maps`).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from timelake.functions.timemap import CORE, EXPONENT, HALVINGS, LAST, LONGEST, RESERVE, SPEED_EPS, SPEED_OFF, STEPS, TEMPI

ERRORS = np.array([None, "rhythm-map-not-monotonic", "rhythm-output-too-long", "rhythm-original-speed-impossible"], object)
IMPOSSIBLE = 3
#: Cells of the largest matrix of a part of a batch.
MOST = 400_000
#: Above the range of a source's frames, so that rows and frames sort as one number.
SPAN = 1 << 38


def padded(values: np.ndarray, sizes: np.ndarray, fill) -> np.ndarray:
    out = np.full((len(sizes), max(int(sizes.max(initial=0)), 1)), fill, values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _rint(x) -> np.ndarray:
    return np.rint(np.where(np.isfinite(x), x, 0)).astype(np.int64)


def _sorting(row: np.ndarray, frame: np.ndarray) -> np.ndarray:
    return row * SPAN + np.clip(frame + SPAN // 2, 0, SPAN - 1)


class Plans:
    """Plans of like size as matrices: blocks and pauses by place, and before which blocks a phrase is cut."""

    def __init__(self, n, p, blocks, pauses, cuts, w0, w1, rate):
        self.n, self.p, self.blocks, self.pauses, self.cuts, self.w0, self.w1, self.rate = n, p, blocks, pauses, cuts, w0, w1, rate

    @classmethod
    def parts(cls, batch: pa.RecordBatch):
        """(rows, plans) of the rows without an error, those of like size together."""
        sound = np.flatnonzero(batch.column("error").is_null().to_numpy(zero_copy_only=False))
        take = lambda c, rows: batch.column(c).take(pa.array(rows))
        sizes = lambda c, rows: take(c, rows).value_lengths().fill_null(0).to_numpy().astype(np.int64)
        n, p = sizes("blocks", sound), sizes("pauses", sound)
        order = np.lexsort((p, n))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * 4 * n[order[end]] * (1 + p[order[begin : end + 1]].max()) <= MOST:
                end = min(len(order), end + max(1, (end - begin) // 2))
            rows = sound[np.sort(order[begin:end])]
            begin = end
            ns, ps, cs = (sizes(c, rows) for c in ("blocks", "pauses", "cuts"))
            field = lambda c, f, k, fill: padded(take(c, rows).flatten().field(f).to_numpy(zero_copy_only=False).astype(float), k, fill)  # noqa: B023, E731
            blocks = {f: field("blocks", f, ns, fill) for f, fill in (("onset", np.inf), ("end", np.inf), ("cells", 0.0), ("dur", 0.0), ("rest", 0.0))}
            cuts = np.zeros(blocks["onset"].shape, np.int64)
            at, k = np.repeat(np.arange(len(rows)), cs), take("cuts", rows).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            inner = (k >= 1) & (k < ns[at])
            np.add.at(cuts, (at[inner], k[inner]), 1)
            ends = (take(c, rows).to_numpy(zero_copy_only=False).astype(float) for c in ("w0", "w1", "rate"))
            yield rows, cls(ns, ps, blocks, (field("pauses", "start", ps, np.inf), field("pauses", "end", ps, np.inf)), cuts, *ends)

    def points(self, density):
        """(src, beat, ratio without the tempo's part): control points in order, those beyond a row's number at infinity."""
        b, n, rows = self.blocks, self.n, np.arange(len(self.n))
        seconds, cells = np.cumsum(b["dur"], 1)[:, -1], np.cumsum(b["cells"], 1)[:, -1]
        rests = np.fmax(0.0, np.rint(b["rest"] / (seconds / cells)[:, None]))
        real = np.arange(b["onset"].shape[1]) < n[:, None]
        beat = np.cumsum(np.where(real, (b["cells"] + rests) / density[:, None], 0.0), 1)
        whole, beat = beat[:, -1], np.c_[np.zeros(len(n)), beat[:, :-1]]
        on, after = b["onset"], np.c_[b["onset"][:, 1:], np.full(len(n), np.inf)]
        start = self.pauses[0][:, None, :]
        quiet = np.where((start > on[:, :, None]) & (start < after[:, :, None]), start, np.inf).min(2)
        tail = np.minimum(b["end"], quiet)
        cut = np.c_[self.cuts[:, 1:], np.zeros(len(n), np.int64)]
        inside = (cut > 0) & (rests >= 1) & (tail > on) & (tail < after)
        twice = (inside & (cut > 1)).any(1)
        last = b["onset"][rows, n - 1]
        end = np.minimum(np.maximum(b["end"][rows, n - 1], last + LAST), self.w1 - LAST)
        src = np.c_[on, np.where(inside, tail, np.inf), end]
        beats = np.c_[np.where(real, beat, np.inf), np.where(inside, beat + b["cells"] / density[:, None], np.inf), whole]
        order = np.lexsort((beats, src), axis=1)
        m = n + inside.sum(1) + 1
        order = order[:, : int(m.max())]
        return np.take_along_axis(src, order, 1), np.take_along_axis(beats, order, 1), m, cells / density, seconds, twice

    def judged(self, density: np.ndarray, bpm: np.ndarray):
        """(error by its place in ERRORS, speed, knots s and t of all rows end to end, how many each row has)."""
        return Maps.of(self, density).judged(bpm)

    def near_fast(self, k: np.ndarray, bpm: np.ndarray):
        """(k, error): the exponent of the least density not slower than speech: down from `k` while it is fast, else up until it is."""
        return Maps.of(self, 2.0**k).near_fast(k, bpm)[1:]

    def original_tempo(self, density: np.ndarray):
        """(bpm, off, error): the tempo at which speech keeps its own speed, by halving, and how far off it stays."""
        bpm, off, _, bad = Maps.of(self, density).original_tempo()
        return bpm, off, bad

    def candidates(self, k: np.ndarray, bpm: float | None, probe: float, steps: tuple[int, ...]):
        """(bpm, a (density, speed, error) for each step from the near-fast exponent, error), all on one layout of the plans."""
        maps, k, bad = Maps.of(self, 2.0**k).near_fast(k, np.full(len(k), float(probe if bpm is None else bpm)))
        tempo, own = np.full(len(k), bpm, float), None
        if bpm is None:
            tempo, off, own, wrong = maps.original_tempo()
            wrong = np.where((wrong == 0) & (off > SPEED_OFF), IMPOSSIBLE, wrong)
            bad = np.where(bad == 0, wrong, bad)
        found = []
        for by in steps:
            # the search for the tempo has seen its map, and no other row of it is asked for
            error, speed = (bad, own) if own is not None and by == 0 else maps.scaled(np.full(len(k), by)).judged(tempo)[:2]
            found.append((2.0 ** (k + by), speed, error))
        return tempo, found, bad


class Maps:
    """Maps of plans at a density, but for the tempo: control points of all rows end to end, and what may follow each of them."""

    @classmethod
    def of(cls, plans: Plans, density: np.ndarray) -> Maps:
        src, beat, m, cells, seconds, bad = plans.points(density)
        self = cls()
        self.m, self.cells, self.seconds, self.w0, self.w1, self.rate = m, cells, seconds, plans.w0, plans.w1, plans.rate
        real = np.arange(src.shape[1]) < m[:, None]
        with np.errstate(invalid="ignore"):
            self.bad = bad | (real[:, 1:] & ~((src[:, 1:] > src[:, :-1]) & (beat[:, 1:] > beat[:, :-1]))).any(1)
            self.beat, src = (beat - beat[:, :1])[real], src[real]
            self.row = np.repeat(np.arange(len(m)), m)
            self.frame, self.size = _rint((src - self.w0[self.row]) * self.rate[self.row]), _rint((self.w1 - self.w0) * self.rate)
            paused = np.arange(plans.pauses[0].shape[1]) < plans.p[:, None]
            self._heard(src, *(x[paused] for x in plans.pauses), np.nonzero(paused)[0])
        return self

    def _heard(self, src, start, end, row):
        """The speech of each row in source frames: its ends, and pauses between them; none depends on a density or a tempo."""
        last = np.cumsum(self.m) - 1
        at = lambda x, r: (x - self.w0[r]) * self.rate[r]
        rows = np.arange(len(self.m))
        self.a, self.b = at(src[last - self.m + 1], rows), at(src[last], rows)
        c, d = at(start, row), at(end, row)
        met = (d > self.a[row]) & (c < self.b[row])
        self.still = row[met]
        self.c, self.d = np.maximum(self.a[self.still], c[met]), np.minimum(self.b[self.still], d[met])
        self.quiet = np.bincount(self.still, self.d - self.c, len(rows))
        self.pa, self.pb, self.prow = _rint(at(start, row)), _rint(at(end, row)), row

    def only(self, rows: np.ndarray) -> Maps:
        """Some rows, each once, in rising order."""
        out, keep = Maps(), np.zeros(len(self.m), bool)
        keep[rows] = True
        new = np.cumsum(keep) - 1
        for x in ("m", "cells", "seconds", "w0", "w1", "rate", "bad", "size", "a", "b", "quiet"):
            setattr(out, x, getattr(self, x)[rows])
        for at, names in (("row", ("beat", "frame")), ("still", ("c", "d")), ("prow", ("pa", "pb"))):
            here = keep[getattr(self, at)]
            setattr(out, at, new[getattr(self, at)[here]])
            for x in names:
                setattr(out, x, getattr(self, x)[here])
        return out

    def scaled(self, by: np.ndarray) -> Maps:
        """The same plans at densities of 2**by times these: beats are divided by a power of two, which is exact."""
        out = Maps()
        out.__dict__.update(self.__dict__)
        out.beat, out.cells = self.beat / 2.0 ** by[self.row], self.cells / 2.0**by
        return out

    @cached_property
    def layout(self):
        """(first and last points, points with a next one, bridge and place of each pause that it may meet, slots of knots)."""
        last = np.cumsum(self.m) - 1
        first = last - self.m + 1
        inner = np.ones(len(self.row), bool)
        inner[last] = False
        bridge = np.flatnonzero(inner)
        # pauses and points rise, so a pause meets the bridges from the one that ends behind its start to the one before its end
        brow = self.row[bridge]
        low = np.searchsorted(np.maximum.accumulate(_sorting(brow, self.frame[bridge + 1])), _sorting(self.prow, self.pa), "right")
        high = np.searchsorted(np.maximum.accumulate(_sorting(brow, self.frame[bridge])), _sorting(self.prow, self.pb), "left")
        many = np.maximum(high - low, 0)
        pause = np.repeat(np.arange(len(self.pa)), many)
        at = np.arange(len(pause)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        order = np.lexsort((pause, at))
        at, pause = at[order], pause[order]
        # bridges with pauses, and for each of their pauses its bridge among these and its place there
        begins = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        held, begin = at[begins], np.flatnonzero(begins)
        among = np.cumsum(begins) - 1
        nth = np.arange(len(at)) - begin[among] if len(at) else among
        met = np.bincount(at, minlength=len(bridge))
        # knots: the start, the first edge, each point's core, two for each pause of its bridge, the bridge's end, the end
        width = np.ones(len(self.row), np.int64)
        width[bridge] = 2 + 2 * met
        width[first] += 2
        width[last] += 1
        end = np.cumsum(width)
        core = end - width
        core[first] += 2
        pair = core[bridge[at]] + 1 + 2 * nth
        return first, last, bridge, brow, held, among, nth, pause, core, pair, end[bridge] - 1, int(end[-1]) if len(end) else 0

    def judged(self, bpm: np.ndarray):
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            beat_seconds = 60.0 / bpm
            return self._map(self.cells * beat_seconds / self.seconds, beat_seconds)

    def _map(self, ratio, beat_seconds):
        first, last, bridge, brow, held, among, nth, pause, core, pair, close, slots = self.layout
        s, size, cap = self.frame, self.size, _rint(CORE * self.rate)
        rel = _rint(self.beat * beat_seconds[self.row] * self.rate[self.row])
        whole = lambda x: np.trunc(x * ratio).astype(np.int64)
        quarter = lambda x, y, most: np.maximum(0, np.minimum(most, np.minimum(x, y) // 4))
        space = quarter(s[bridge + 1] - s[bridge], rel[bridge + 1] - rel[bridge], cap[brow])
        head, foot = s[first], size - s[last]
        over, under = whole(head), whole(foot)
        left, right = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        left[bridge + 1], right[bridge] = space, space
        left[first], right[last] = quarter(head, over, cap), quarter(foot, under, cap)
        le, re = (head == 0) | (over == 0), (foot == 0) | (under == 0)
        outer, inner = right[first], left[last]
        left = right = np.minimum(left, right)
        if le.any() or re.any():
            left, right = left.copy(), right.copy()
            left[first[le]], right[first[le]] = 0, outer[le]
            left[last[re]], right[last[re]] = inner[re], 0
        s0 = head - left[first]
        t = rel + (_rint(s0 * ratio) + left[first])[self.row]
        sa, sb, ta, tb = s[bridge] + right[bridge], (s - left)[bridge + 1], t[bridge] + right[bridge], (t - left)[bridge + 1]
        tz, rz = t[last], right[last]
        tail = foot - rz
        out = tz + rz + _rint(tail * ratio)

        ks, kt, on = (np.zeros(slots, d) for d in (np.int64, np.int64, bool))
        begin = core[first] - 2
        on[begin] = True
        ks[begin + 1], kt[begin + 1] = s0, t[first] - left[first]
        on[begin + 1] = (ks[begin + 1] > 0) | (kt[begin + 1] > 0)
        ks[core], kt[core], on[core] = s + right, t + right, left + right > 0
        final = core[last] + 1
        ks[final], kt[final], on[final] = size, out, (tail > 0) | (out > tz + rz)
        ks[close], kt[close], on[close] = sb, tb, (sb > sa) | (tb > ta)
        if len(held):
            hsa, hsb, hta, htb = sa[held], sb[held], ta[held], tb[held]
            a, b = np.maximum(hsa[among], self.pa[pause]), np.minimum(hsb[among], self.pb[pause])
            here = b > a
            silence = np.bincount(among, np.where(here, b - a, 0), len(held)).astype(np.int64)
            speech, length = (hsb - hsa) - silence, htb - hta
            spoken = np.minimum(speech * ratio[brow[held]], length - np.minimum(silence, RESERVE * length))
            laid = (silence > 0) & (speech > 0)
            slow, fast = (length - spoken) / silence, spoken / speech
            here &= laid[among]
            at, done, gone = hta.astype(float), hsa.copy(), np.zeros(len(held))
            for n in range(int(nth.max()) + 1):
                these = np.flatnonzero(here & (nth == n))
                for h, p, x in ((among[these], these, 0), (among[these], these, 1)):
                    stop = b[p] if x else a[p]
                    if not x:
                        live = stop > done[h]
                        h, p, stop = h[live], p[live], stop[live]
                    # lengths are added up before they meet the bridge's start, as in SQL: at a half the order decides
                    far = gone[h] + (stop - done[h]) * (slow if x else fast)[h]
                    end = hta[h] + far
                    if x:
                        end = np.where(stop == hsb[h], htb[h], end)
                    near, place = _rint(end), pair[p] + x
                    ks[place], kt[place], on[place] = stop, near, near > _rint(at[h])
                    at[h], done[h], gone[h] = end, stop, far
            laid = np.flatnonzero(laid)
            on[close[held[laid]]] = ((hsb > done) & (htb > _rint(at)))[laid]

        which = np.flatnonzero(on)
        ks, kt = ks[which], kt[which]
        row = np.repeat(np.arange(len(self.m)), np.diff(np.r_[begin, slots]))[which]
        within = row[1:] == row[:-1]
        ds, dt = np.diff(ks), np.diff(kt)
        same = within & (ds == 0) & (dt == 0)
        if same.any():
            keep = ~np.r_[False, same]
            row, ks, kt = row[keep], ks[keep], kt[keep]
            within, ds, dt = row[1:] == row[:-1], np.diff(ks), np.diff(kt)
        error = np.where(out / self.rate > LONGEST, 2, 0)
        falls = row[1:][within & ~((ds > 0) & (dt > 0))]
        error[falls[error[falls] == 0]] = 1
        error[self.bad] = 1
        count = np.bincount(row, minlength=len(self.m))
        return error, np.where(error == 0, self._speed(row, ks, kt, count), np.nan), ks, kt, count

    @cached_property
    def ears(self):
        """(source frames at which speech begins and ends and its pauses do, their rows, and their places among sorted knots)."""
        rows = np.arange(len(self.m))
        x, row = np.concatenate([self.a, self.b, self.c, self.d]), np.concatenate([rows, rows, self.still, self.still])
        # a knot lies below x where it lies below the next whole frame
        return x, row, _sorting(row, _rint(np.ceil(x)))

    def _speed(self, row, ks, kt, count):
        x, r, place = self.ears
        begin = np.cumsum(count) - count
        first, n = begin[r], count[r]
        i = np.searchsorted(_sorting(row, ks), place, "left") - first
        j = first + np.minimum(np.clip(i, 1, np.maximum(n - 1, 1)), n - 1)
        k = np.maximum(j - 1, first)
        sl, tl = ks[k], kt[k]
        target = tl + (x - sl) * (kt[j] - tl) / (ks[j] - sl)
        target = np.where(i == 0, kt[first], np.where(i >= n, kt[first + n - 1], target))
        a, b, c, d = np.split(target, np.cumsum([len(self.a), len(self.b), len(self.c)]))
        made = b - a - np.bincount(self.still, d - c, len(self.m))
        return np.where(made > 0, ((self.b - self.a) - self.quiet) / made, np.inf)

    def near_fast(self, k: np.ndarray, bpm: np.ndarray):
        """(maps at the found densities, their exponents, error) of maps at densities 2**k."""
        start, k = k.astype(np.int64), k.astype(np.int64).copy()
        bad, speed = self.judged(bpm)[:2]
        bad, down = bad.copy(), (bad == 0) & (speed >= 1 - SPEED_EPS)
        todo = np.flatnonzero(bad == 0)
        for _ in range(STEPS):
            to = k[todo] + np.where(down[todo], -1, 1)
            todo, to = todo[np.abs(to) <= EXPONENT], to[np.abs(to) <= EXPONENT]
            if not len(todo):
                break
            error, speed = self.only(todo).scaled(to - start[todo]).judged(bpm[todo])[:2]
            fast = (error == 0) & (speed >= 1 - SPEED_EPS)
            k[todo] = np.where((error > 0) | ~down[todo] | fast, to, k[todo])
            bad[todo] = error
            todo = todo[(error == 0) & (down[todo] == fast)]
        return self.scaled(k - start), k, bad

    def original_tempo(self):
        """(bpm, how far off speech stays, its speed, error): the tempo at which speech keeps its own speed, by halving."""
        n = len(self.m)
        lo, hi = (np.full(n, x) for x in TEMPI)
        best, off, own, bad, todo, maps = lo.copy(), np.full(n, np.inf), np.full(n, np.nan), np.zeros(n, int), np.arange(n), self
        for _ in range(HALVINGS):
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) / 2
            error, speed = maps.judged(mid)[:2]
            bad[todo] = error
            keep = error == 0
            rows, mid, speed = todo[keep], mid[keep], speed[keep]
            away, slow = np.abs(speed - 1), speed < 1
            nearer = away < off[rows]
            best[rows], off[rows], own[rows] = np.where(nearer, mid, best[rows]), np.where(nearer, away, off[rows]), np.where(nearer, speed, own[rows])
            lo[rows], hi[rows] = np.where(slow, mid, lo[rows]), np.where(slow, hi[rows], mid)
            keep[keep] = away >= SPEED_EPS
            if not keep.all():
                maps, todo = maps.only(np.flatnonzero(keep)), todo[keep]
        return best, off, own, bad
