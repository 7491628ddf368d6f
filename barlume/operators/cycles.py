"""The dominant cycle of a price, after Ehlers: quadrature filter, homodyne discriminator, phase and mode.

A price is smoothed over four bars and split by a Hilbert filter into a part in
phase and one in quadrature. The filter's gain depends on the period found so far,
and the period on how the two parts have turned since the last bar, so all of it
is one recursion with coupled state. Prices before the first bar count as the
first one. Values are given from the 33rd bar on.
"""

from __future__ import annotations

import math

import numpy as np

WARM_UP = 32
# Fixed values of the published filter: its taps, its gain's line, the bounds of a period and of its change, the averages' shares.
TAPS, GAIN, PERIODS, CHANGE, SHARE, SLOW_SHARE = (0.0962, 0.5769), (0.075, 0.54), (6.0, 50.0), (0.67, 1.5), 0.2, 0.33
#: A price this far off its trend line is a trend.
OFF_TREND = 0.015


def smoothed(x: np.ndarray) -> np.ndarray:
    """Weighted mean of four bars, 4 to 1."""
    if not len(x):
        return np.zeros(0)
    p = np.concatenate((np.full(3, x[0]), x))
    return (4 * p[3:] + 3 * p[2:-1] + 2 * p[1:-2] + p[:-3]) / 10


def _quadrature(x0: float, x2: float, x4: float, x6: float) -> float:
    return TAPS[0] * (x0 - x6) + TAPS[1] * (x2 - x4)


def periods(x: np.ndarray) -> np.ndarray:
    """The cycle's smoothed period at each bar, from the first on."""
    smooth = smoothed(x).tolist()
    flat = [0.0] * 10
    turned, across = list(flat), list(flat)  # the filter's outputs: of the price, and of that again
    i2 = q2 = re = im = period = slow = 0.0
    out = []
    price = smooth[:1] * 6 + smooth
    for t in range(6, len(price)):
        gain = GAIN[0] * period + GAIN[1]
        turned.append(gain * _quadrature(price[t], price[t - 2], price[t - 4], price[t - 6]))
        across.append(gain * _quadrature(turned[-1], turned[-3], turned[-5], turned[-7]))
        ahead_i = gain * _quadrature(turned[-4], turned[-6], turned[-8], turned[-10])  # the part in phase lags by three bars
        ahead_q = gain * _quadrature(across[-1], across[-3], across[-5], across[-7])
        i, q = SHARE * (turned[-4] - ahead_q) + (1 - SHARE) * i2, SHARE * (across[-1] + ahead_i) + (1 - SHARE) * q2
        re, im = SHARE * (i * i2 + q * q2) + (1 - SHARE) * re, SHARE * (i * q2 - q * i2) + (1 - SHARE) * im
        i2, q2 = i, q
        found = 2 * math.pi / math.atan(im / re) if re and im else period
        found = max(min(found, CHANGE[1] * period), CHANGE[0] * period)
        period = SHARE * max(min(found, PERIODS[1]), PERIODS[0]) + (1 - SHARE) * period
        slow = SLOW_SHARE * period + (1 - SLOW_SHARE) * slow
        out.append(slow)
    return np.array(out)


def _warm(x: np.ndarray) -> np.ndarray:
    out = np.array(x, float)
    out[:WARM_UP] = np.nan
    return out


def _phases(smooth: np.ndarray, cycle: np.ndarray) -> np.ndarray:
    """The phase in degrees: the price against one turn of sine and cosine of the cycle's length, of the bars that there are."""
    out = np.zeros(len(smooth))
    for t, period in enumerate(cycle.tolist()):
        n = math.floor(period + 0.5)
        back = smooth[max(0, t - n + 1) : t + 1][::-1]
        turn = 2 * np.pi * np.arange(len(back)) / max(n, 1)
        real, imaginary = float(np.sin(turn) @ back), float(np.cos(turn) @ back)
        angle = math.degrees(math.atan(real / imaginary)) if abs(imaginary) > 0.001 else math.copysign(90.0, real)
        angle += 90 + (360 / period if period else 0) + (180 if imaginary < 0 else 0)
        out[t] = angle - 360 if angle > 315 else angle
    return out


def phase(x: np.ndarray) -> np.ndarray:
    return _warm(_phases(smoothed(x), periods(x)))


def sines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cycle's sine, and the same an eighth of a turn ahead."""
    angle = np.radians(phase(x))
    return np.sin(angle), np.sin(angle + np.pi / 4)


def trend_line(x: np.ndarray) -> np.ndarray:
    """The price without its cycle: its mean over one period, smoothed."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    n = np.floor(periods(x) + 0.5).astype(int)
    at = np.arange(len(x))
    start = np.maximum(at - np.maximum(n, 1) + 1, 0)
    return _warm(smoothed((total[at + 1] - total[start]) / (at + 1 - start)))


def trend_mode(x: np.ndarray) -> np.ndarray:
    """1 in a trend, 0 in a cycle.

    It is a cycle for half a period after the sines crossed and while the phase turns at
    the period's pace, unless the price is far off its trend line.
    """
    cycle, smooth = periods(x), smoothed(x)
    angle = _phases(smooth, cycle)
    gap = np.sin(np.radians(angle)) - np.sin(np.radians(angle + 45))
    crossed = np.zeros(len(x), bool)
    crossed[1:] = (gap[1:] > 0) != (gap[:-1] > 0)
    at = np.arange(len(x))
    since = at - np.maximum.accumulate(np.where(crossed, at, 0))
    pace = np.diff(angle, prepend=angle[:1])
    turn = 360 / np.where(cycle > 0, cycle, np.inf)
    calm = (since < cycle / 2) | ((pace > CHANGE[0] * turn) & (pace < CHANGE[1] * turn))
    line = trend_line(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.abs((smooth - line) / line) >= OFF_TREND
    return _warm(np.where(far, 1.0, np.where(calm, 0.0, 1.0)))
