"""Kernels on one curve, for arrays of numpy. A curve is small; sums of prefixes make each straight line cost O(1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Lines:
    """Least squares of y on x over any run of points, from sums of prefixes of centred values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        self.mx, self.my = (float(self.x.mean()), float(self.y.mean())) if len(self.x) else (0.0, 0.0)
        u, v = self.x - self.mx, self.y - self.my
        self.sums = [np.append(0.0, np.cumsum(z)) for z in (u, v, u * u, u * v, v * v)]

    def fit(self, i, j):
        """r2, slope, intercept, relative error of points i to j - 1; works on arrays of runs. Constant x gives zeros and a
        relative error of 1, constant y an r2 of 0."""
        i, j = np.asarray(i), np.asarray(j)
        n = (j - i).astype(float)
        u, v, uu, uv, vv = (s[j] - s[i] for s in self.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            sxx, sxy, syy = uu - u * u / n, uv - u * v / n, vv - v * v / n
            good = (n >= 3) & (sxx > 1e-18)
            slope = np.where(good, sxy / sxx, 0.0)
            r2 = np.where(good & (syy > 1e-18), np.clip(sxy * sxy / (sxx * syy), 0, 1), 0.0)
            intercept = np.where(good, v / n + self.my - slope * (u / n + self.mx), 0.0)
            error = np.where(good & (slope != 0), np.sqrt(np.maximum(0, (1 - r2) * syy / sxx / (n - 2))) / np.abs(slope), 1.0)
        return r2, slope, intercept, error


def savgol(y: np.ndarray, window: int = 7, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends follow the polynomial of the end windows. Short input comes back unchanged."""
    y = np.asarray(y, float)
    if len(y) < window:
        return y.copy()
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    solve = np.linalg.pinv(basis)
    out = np.convolve(y, solve[0][::-1], "same")
    at = np.arange(-half, half + 1)
    for cells, part in ((slice(0, half), y[:window]), (slice(len(y) - half, len(y)), y[-window:])):
        fitted = np.vander(at, degree + 1, increasing=True) @ (solve @ part)
        out[cells] = fitted[:half] if cells.start == 0 else fitted[-half:]
    return out


@dataclass
class Region:
    """A straight part of a curve."""

    start: int
    stop: int
    r2: float
    slope: float
    intercept: float
    confidence: str

    @property
    def crossing(self) -> float:
        return -self.intercept / self.slope if self.slope else float("nan")


R2_GOOD, R2_FAIR, LEAST_SLOPE, LEAST_GAP = 0.997, 0.990, 0.1, 1.8


def quarter_windows(lines: Lines) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Rising windows of a quarter of the points: where they start, best r2 first (the first of equals first), their size, slopes and
    crossings."""
    n = len(lines.x)
    size = max(5, int(0.25 * n))
    if n < size:
        return np.array([], int), size, np.array([]), np.array([])
    starts = np.arange(n - size + 1)
    r2, slope, intercept, _ = lines.fit(starts, starts + size)
    rising = slope > LEAST_SLOPE
    order = starts[rising][np.argsort(-r2[rising], kind="stable")]
    with np.errstate(divide="ignore", invalid="ignore"):
        return order, size, slope[order], -intercept[order] / slope[order]


def widened(lines: Lines, i: int, j: int, gap: float | None, both_sides_capped: bool) -> tuple[int, int]:
    """A run of points, longer by a point to the right and one to the left in turn while its line is good and crosses at ``gap`` or above,
    up to four tenths of the points. both_sides_capped: the limit also stops the step to the left within a turn."""
    n = len(lines.x)
    cap = int(0.4 * n)

    def good(i: int, j: int) -> bool:
        r2, slope, intercept, _ = map(float, lines.fit(i, j))
        return r2 >= R2_GOOD and slope > LEAST_SLOPE and (gap is None or -intercept / slope >= gap)

    moved = True
    while moved and j - i < cap:
        moved = False
        if j < n and good(i, j + 1):
            j, moved = j + 1, True
        if i > 0 and not (both_sides_capped and j - i >= cap) and good(i - 1, j):
            i, moved = i - 1, True
    return i, j


def trimmed(i: int, j: int) -> tuple[int, int]:
    """Without a twentieth of its points at each end, two at least, if five are left."""
    trim = min(max(2, int(0.05 * (j - i))), max(0, (j - i - 5) // 2))
    return i + trim, j - trim


def refined(lines: Lines, i: int, j: int, rise: float = 0.005, keep: float = 0.55) -> tuple[int, int]:
    """A run without the points at its low end, then at its high end, of which each that goes lets the slope rise by more than ``rise``;
    ``keep`` of seven points or more stay, and five."""
    size = j - i
    least = max(5, int(keep * size))
    if size < 7 or float(lines.fit(i, j)[1]) <= 0:
        return i, j
    for low in (True, False):
        gone = np.arange(max(0, (j - i) - least) + 1)
        slope = lines.fit(i + gone, j)[1] if low else lines.fit(i, j - gone)[1]
        steps = (slope[1:] > 0) & (slope[1:] - slope[:-1] > rise * slope[:-1])
        k = int(np.argmin(np.append(steps, False)))
        i, j = (i + k, j) if low else (i, j - k)
    return i, j


def labelled_edge(lines: Lines, i: int, j: int) -> Region | None:
    """The line of a run, if it rises and crosses at ``LEAST_GAP`` or above."""
    r, s, c, _ = map(float, lines.fit(i, j))
    if not (s > 0 and -c / s >= LEAST_GAP):
        return None
    share = (j - i) / len(lines.x)
    return Region(i, j, r, s, c, "high" if r >= R2_GOOD and share >= 0.10 else "medium" if r >= R2_FAIR and share >= 0.05 else "low")


def linear_edge(x: np.ndarray, y: np.ndarray, *, refine: bool = False) -> Region | None:
    """The straight part of an absorption edge: of windows that cross at ``LEAST_GAP`` or above, best r2 first, the first that does so
    still when it is widened, trimmed, and with ``refine`` rid of ends that bend."""
    lines = Lines(x, y)
    starts, size, _, crossing = quarter_windows(lines)
    for start in starts[crossing >= LEAST_GAP].tolist():
        i, j = trimmed(*widened(lines, start, start + size, LEAST_GAP, False))
        if found := labelled_edge(lines, *(refined(lines, i, j) if refine else (i, j))):
            return found
    return None


def legacy_edge(x: np.ndarray, y: np.ndarray) -> Region | None:
    """The older search: all rising windows are tried, and where none crosses high enough the best of them comes back, widened as far as
    its line crosses at 0 or above, trimmed, and labelled invalid. None if nothing rises."""
    lines = Lines(x, y)
    starts, size, _, _ = quarter_windows(lines)
    for start in starts.tolist():
        if found := labelled_edge(lines, *trimmed(*widened(lines, start, start + size, LEAST_GAP, True))):
            return found
    if not len(starts):
        return None
    i, j = trimmed(*widened(lines, int(starts[0]), int(starts[0]) + size, 0.0, True))
    r, s, c, _ = map(float, lines.fit(i, j))
    return Region(i, j, r, s, c, "invalid")


def baseline_level(energy: np.ndarray, absorbance: np.ndarray, low: float) -> float:
    """Median absorbance well below ``low``, else of the lowest tenth of the values."""
    far = absorbance[energy < low - 0.2]
    return float(np.median(far)) if len(far) >= 5 else float(np.median(np.sort(absorbance)[: max(3, len(absorbance) // 10)]))


@dataclass
class Tail:
    """An exponential tail: ln(absorbance) is straight in energy."""

    width_mev: float
    r2: float
    start_energy: float
    end_energy: float
    slope: float
    intercept: float
    confidence: str


def urbach(energy: np.ndarray, absorbance: np.ndarray, gap: float, *, reach: float = 0.35, window: int = 11) -> Tail | None:
    """Urbach tail below a gap: all runs of 0.12 to 0.28 eV in [gap - reach, gap - 0.08] are fitted at once; the width is the
    median over the runs whose score is within 0.005 of the best, the line is that of the run closest to it."""
    low, high = gap - reach, gap - 0.08
    inside = (energy >= low) & (energy <= high)
    if inside.sum() < 5:
        return None
    e, a = energy[inside], absorbance[inside] - baseline_level(energy, absorbance, low)
    e, a = e[a > 0], a[a > 0]
    n = len(e)
    if n < 5:
        return None
    a = savgol(a, window)
    e, a = e[a > 0], a[a > 0]
    n = len(e)
    lines, least = Lines(e, np.log(a)), max(5, int(0.2 * n))
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    wide = (j - i >= least) & (e[j] - e[i] >= 0.12) & (e[j] - e[i] <= 0.28)
    i, j = i[wide], j[wide]
    if not len(i):
        return None
    r2, slope, intercept, error = lines.fit(i, j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        width = np.where(slope > 0, 1000 / slope, np.inf)
    keep = (slope > 0) & (width >= 15) & (width <= 800) & (r2 >= 0.97)
    if not keep.any():
        return None
    i, j, r2, slope, intercept, error, width = (z[keep] for z in (i, j, r2, slope, intercept, error, width))
    score = r2 - 0.15 * error
    order = np.argsort(-score, kind="stable")
    chosen = order[score[order] >= score.max() - 0.005]
    middle = float(np.median(width[chosen]))
    best = chosen[np.argmin(np.abs(width[chosen] - middle))]
    q1, q3 = np.percentile(width[chosen], [25, 75])
    spread = (q3 - q1) / middle
    label = "high" if r2[best] >= 0.99 and spread <= 0.15 else "medium" if r2[best] >= 0.98 and spread <= 0.30 else "low"
    return Tail(middle, float(r2[best]), float(e[i[best]]), float(e[j[best]]), float(slope[best]), float(intercept[best]), label)


def noise_floor(ln_absorbance: np.ndarray) -> float:
    """Mean and two deviations of the first tenth."""
    head = ln_absorbance[: max(3, len(ln_absorbance) // 10)]
    return float(head.mean() + 2 * head.std())


def legacy_tail(energy: np.ndarray, ln_absorbance: np.ndarray, gap: float | None = None) -> Tail | None:
    """The older search: the best window above the noise floor and below the gap, widened while r2 stays at 0.995."""
    usable = ln_absorbance > noise_floor(ln_absorbance)
    if gap is not None:
        usable &= energy < gap
    e, y = energy[usable], ln_absorbance[usable]
    n, size = len(e), max(5, int(0.15 * len(e)))
    if n < size or n < 5:
        return None
    lines, starts = Lines(e, y), np.arange(n - size + 1)
    r2, slope, _, _ = lines.fit(starts, starts + size)
    if not (slope > 0).any():
        return None
    i = int(np.argmax(np.where(slope > 0, r2, -1)))
    j = i + size
    moved = True
    while moved and j - i < 0.5 * n:
        moved = False
        for a, b in ((i, j + 1), (i - 1, j)):
            if a >= 0 and b <= n:
                r, s, _, _ = map(float, lines.fit(a, b))
                if r >= 0.995 and s > 0:
                    i, j, moved = a, b, True
                    break
    r, s, c, _ = map(float, lines.fit(i, j))
    return Tail(1000 / s, r, float(e[i]), float(e[j - 1]), s, c, "high" if r >= 0.995 else "medium" if r >= 0.98 else "low")


@dataclass
class Excess:
    """Absorption below the gap beyond the exponential tail, per eV of the window."""

    per_ev: float
    area: float
    norm: float
    start: float
    stop: float
    coverage: float
    ideal_start: float
    confidence: str


def sub_gap_excess(energy: np.ndarray, absorbance: np.ndarray, tail: Tail, width: float = 0.5, floor: float = 1.3) -> Excess:
    plateau = absorbance[(energy >= 3.2) & (energy <= 3.6)]
    norm = float(plateau.mean()) if len(plateau) >= 3 else float(np.percentile(absorbance, 90))
    norm = norm if norm > 0 else float(absorbance.max())
    stop, ideal = tail.end_energy, tail.end_energy - width
    start = max(ideal, float(energy.min()), floor)
    coverage = min(1.0, max(0.0, (stop - start) / width))
    inside = (energy >= start) & (energy <= stop)
    if start >= stop or inside.sum() < 3:
        return Excess(0.0, 0.0, norm, start, stop, 0.0 if start >= stop else coverage, ideal, "invalid")
    e = energy[inside]
    over = np.maximum(0, (absorbance[inside] - np.exp(tail.slope * e + tail.intercept)) / norm)
    area, n = float(np.trapezoid(over, e)), int(inside.sum())
    label = "high" if coverage >= 0.8 and n >= 10 else "medium" if coverage >= 0.5 and n >= 5 else "low" if coverage >= 0.3 else "invalid"
    return Excess(area / (stop - start), area, norm, start, stop, coverage, ideal, label)


def shape_features(energy: np.ndarray, absorbance: np.ndarray, edge: tuple[float, float], gap: float, tail: Tail, excess: Excess) -> dict:
    """Slope below the gap, asymmetry of the edge, and the residual of the tail, on absorbance as it was measured."""
    positive = absorbance > 0
    ln = np.log(np.where(positive, absorbance, 1.0))
    below = positive & (energy >= excess.start) & (energy <= excess.stop)
    slope = float(Lines(energy[below], ln[below]).fit(0, int(below.sum()))[1]) if below.sum() >= 5 else 0.0
    half = float(np.clip(0.75 * (edge[1] - edge[0]), 0.12, 0.40))
    sides = [positive & (energy >= gap - half) & (energy < gap), positive & (energy >= gap) & (energy <= gap + half)]
    counts = [int(s.sum()) for s in sides]
    slopes = [abs(float(Lines(energy[s], absorbance[s]).fit(0, c)[1])) if c >= 4 else np.nan for s, c in zip(sides, counts, strict=True)]
    asymmetry = slopes[1] / slopes[0] if min(counts) >= 4 and slopes[0] > 0 else np.nan
    inside = positive & (energy >= tail.start_energy) & (energy <= tail.end_energy)
    off = ln[inside] - (tail.slope * energy[inside] + tail.intercept)
    return {"subgap_slope": slope, "edge_asymmetry": asymmetry, "edge_asymmetry_low_pts": min(counts) == 4, "urbach_residual": float(np.sqrt((off**2).mean())) if inside.sum() >= 3 else 0.0}


def baseline_delta(energy: np.ndarray, absorbance: np.ndarray, known_gap: float, exponent: float = 0.5) -> float:
    """The offset that, taken off, brings the gap of a calibrator nearest to the known one: 100 steps up to 0.3 of the largest
    absorbance, then 40 around the best; the first of equals."""

    def error(delta: float) -> float:
        a = np.maximum(absorbance - delta, 1e-12)
        edge = linear_edge(energy, savgol((a * energy) ** exponent))
        return abs(edge.crossing - known_gap) if edge else np.inf

    def best(grid: np.ndarray) -> float:
        return float(grid[int(np.argmin([error(d) for d in grid]))])

    grid = np.linspace(0, 0.30 * float(np.abs(absorbance).max()), 100)
    first, step = best(grid), grid[1] - grid[0]
    return best(np.linspace(max(0.0, first - 2 * step), first + 2 * step, 40))
