"""Sample-wise operators: gap filling, baselines, derivatives, integrals, traces, decimation.

They take ``s(recording_id, idx, v)``, ``idx`` counting from 0.  Windows of a
bounded width run within parts of ``PART`` samples, each of which also gets the
few samples of its neighbours that its windows reach (``parts``); scans without
a bound run within parts, too, and take what came before or comes after from the
parts' summaries, a row each.  So one exchange by ``(recording_id, part)``
spreads a recording over as many tasks as it has parts.

Sums of windows are differences of running sums, two steps a sample however wide
the window is.  Values are summed as whole numbers, scaled by a power of ten: such sums
are exact, and the same in every engine and order.  A part whose sum would leave
64 bits ends the job.
"""

W = "(PARTITION BY recording_id ORDER BY idx)"
IN = "(PARTITION BY recording_id, part ORDER BY idx)"
UP_TO = "(PARTITION BY recording_id, part ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
#: What follows, seen from the end, so that a row costs one step and not a look at all the rest.
FROM_ON = "(PARTITION BY recording_id, part ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "(PARTITION BY recording_id, part ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
PART = 1024


def odd(seconds: float, fs: float) -> int:
    w = max(3, int(seconds * fs))
    return w + 1 - w % 2


def parts(left: int, right: int) -> str:
    """Samples by part, with the ``left`` ones before and the ``right`` ones after it; ``own`` tells them apart."""
    size = max(PART, left, right)
    return f"SELECT recording_id, CAST(floor(idx / {size}) AS BIGINT) + away AS part, idx, v, away = 0 AS own FROM {{s}} AS p0, SEQ(CASE WHEN idx >= {size} AND idx % {size} < {right} THEN -1 ELSE 0 END, CASE WHEN idx % {size} >= {size - left} THEN 1 ELSE 0 END, p1, away)"


KNOWN = "CASE WHEN v IS NOT NULL THEN idx END"
#: For every part: the last sample known before it, the first one known after it, and how many there are in the recording.
CARRY = f"""
SELECT recording_id AS r0, part AS part0, sum(n) OVER (PARTITION BY recording_id) AS finite,
       LASTV(li) OVER (PARTITION BY recording_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li0, LASTV(lv) OVER (PARTITION BY recording_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv0,
       LASTV(fi) OVER (PARTITION BY recording_id ORDER BY part DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fi0, LASTV(fv) OVER (PARTITION BY recording_id ORDER BY part DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fv0
FROM (SELECT recording_id, part, count(v) AS n, max({KNOWN}) AS li, max_by(v, {KNOWN}) AS lv, min({KNOWN}) AS fi, min_by(v, {KNOWN}) AS fv FROM ({parts(0, 0)}) AS c0 GROUP BY recording_id, part) AS c1
"""

GAP_FILL = f"""
SELECT recording_id, idx,
       round(CASE WHEN v IS NOT NULL THEN v WHEN finite < 2 THEN 0.0 WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
                  ELSE pv + (nv - pv) * (idx - pi) / (ni - pi) END, 6) AS v
FROM (SELECT recording_id, idx, v, finite, coalesce(pv, lv0) AS pv, coalesce(pi, li0) AS pi, coalesce(nv, fv0) AS nv, coalesce(ni, fi0) AS ni
      FROM (SELECT recording_id, part, idx, v, LASTV(v) OVER {UP_TO} AS pv, LASTV({KNOWN}) OVER {UP_TO} AS pi, LASTV(v) OVER {FROM_ON} AS nv, LASTV({KNOWN}) OVER {FROM_ON} AS ni FROM ({parts(0, 0)}) AS d) AS a
      JOIN ({CARRY}) AS c ON recording_id = r0 AND part = part0) AS b
"""

MISSING_PROFILE = """
SELECT recording_id, n, missing, round(missing / n, 6) AS missing_fraction,
       CASE WHEN missing / n < 0.005 THEN 'GOOD' WHEN missing / n < 0.05 THEN 'MODERATE' WHEN missing / n < 0.15 THEN 'POOR' ELSE 'CRITICAL' END AS level
FROM (SELECT recording_id, count(*) AS n, count(*) - count(v) AS missing FROM {s} AS a GROUP BY recording_id) AS b
"""


def moving_mean(window: int, left: int | None = None, value: str = "v", digits: int = 8) -> str:
    """Centred mean with replicated edges; an even window leans to the left. ``value`` counts to ``digits`` decimals."""
    left = window // 2 if left is None else left
    right = window - 1 - left
    return f"""
SELECT recording_id, idx, v, (coalesce(after, total) - coalesce(before, 0) + greatest(0, {left} - (idx - lo)) * fx + greatest(0, {right} - (hi - idx)) * lx) / {window * 10.0**digits:.1f} AS m
FROM (SELECT recording_id, idx, v, own, lo, hi, fx, lx, total, lead(run, {right}) OVER {IN} AS after, lag(run, {left + 1}) OVER {IN} AS before
      FROM (SELECT recording_id, part, idx, v, own, sum(x) OVER {UP_TO} AS run, sum(x) OVER {WHOLE} AS total, first_value(idx) OVER {WHOLE} AS lo, last_value(idx) OVER {WHOLE} AS hi, first_value(x) OVER {WHOLE} AS fx, last_value(x) OVER {WHOLE} AS lx
            FROM (SELECT recording_id, part, idx, v, own, coalesce(CAST(round({value} * {10.0**digits:.1f}) AS BIGINT), 0) AS x FROM ({parts(left, right)}) AS m0) AS m1) AS m2) AS m3
WHERE own
"""


def baseline(fs: float = 360.0, seconds: float = 0.6) -> str:
    return f"SELECT recording_id, idx, round(m, 6) AS baseline FROM ({moving_mean(odd(seconds, fs))}) AS c"


def detrend(fs: float = 360.0, seconds: float = 0.6) -> str:
    return f"SELECT recording_id, idx, round(v - m, 6) AS v FROM ({moving_mean(odd(seconds, fs))}) AS c"


def adaptive_width(fs: float = 360.0, seconds: float = 0.6) -> int:
    """Samples of the adaptive engine's baseline: ``seconds`` to either side."""
    return 2 * int(max(0.2, seconds) * fs) + 1


def adaptive_detrend(fs: float = 360.0, seconds: float = 0.6, digits: int = 8) -> str:
    """The adaptive engine's detrending: a recording no longer than the window takes one of all its samples but one, and one of under four its median.

    One reading does both kinds, without a count of the recording: parts are
    longer than the window, so the first part of a recording no longer than it
    is the whole, and has its count; its running sums (and, under four, samples)
    are a list beside each of its rows.  For Spark alone.
    """
    w = adaptive_width(fs, seconds)
    left, scale = w // 2, f"{10.0**digits:.1f}"
    size = max(PART, w + 1)
    short = f"part = 0 AND n <= {w}"
    at = lambda name, i: f"get({name}, CAST({i} AS INT))"
    return f"""
SELECT recording_id, idx, round(v - CASE
         WHEN NOT ({short}) THEN (coalesce(after, total) - coalesce(before, 0) + greatest(0, {left} - (idx - lo)) * fx + greatest(0, {left} - (hi - idx)) * lx) / {w * 10.0**digits:.1f}
         WHEN n < 4 THEN ({at("few", "(size(few) - 1) DIV 2")} + {at("few", "size(few) DIV 2")}) / 2
         ELSE ({at("runs", "least(n - 1, idx + n - 2 - back)")} - coalesce({at("runs", "idx - back - 1")}, 0) + greatest(0, back - idx) * fx + greatest(0, idx - back - 1) * lx) / ({scale} * (n - 1)) END, 6) AS v
FROM (SELECT recording_id, part, idx, v, own, n, lo, hi, fx, lx, total, (n - 1) DIV 2 AS back, lead(run, {left}) OVER {IN} AS after, lag(run, {left + 1}) OVER {IN} AS before,
             collect_list(CASE WHEN {short} THEN run END) OVER {WHOLE} AS runs, array_sort(collect_list(CASE WHEN {short} AND n < 4 THEN v END) OVER {WHOLE}) AS few
      FROM (SELECT recording_id, part, idx, v, own, sum(x) OVER {UP_TO} AS run, count(*) OVER {WHOLE} AS n, sum(x) OVER {WHOLE} AS total, first_value(idx) OVER {WHOLE} AS lo, last_value(idx) OVER {WHOLE} AS hi, first_value(x) OVER {WHOLE} AS fx, last_value(x) OVER {WHOLE} AS lx
            FROM (SELECT recording_id, CAST(floor(idx / {size}) AS BIGINT) + away AS part, idx, v, away = 0 AS own, coalesce(CAST(round(v * {scale}) AS BIGINT), 0) AS x
                  FROM {{s}} AS d0, SEQ(CASE WHEN idx >= {size} AND idx % {size} < {left} THEN -1 ELSE 0 END, CASE WHEN idx % {size} >= {size - left} THEN 1 ELSE 0 END, p1, away)) AS d1) AS d2) AS d3
WHERE own
"""


#: The same over lists, for DuckDB alone.
ADAPTIVE_DUCKDB = """
WITH r AS (SELECT recording_id, list(v ORDER BY idx) AS v, count(*) AS n FROM ({s}) GROUP BY recording_id),
w AS (SELECT *, least({w}, n - 1) AS w FROM r),
e AS (SELECT *, CASE WHEN w < 3 THEN [] ELSE list_concat(list_transform(range(w // 2), lambda k: v[1]), v, list_transform(range(w - 1 - w // 2), lambda k: v[-1])) END AS ext FROM w)
SELECT recording_id, unnest(range(n)) AS idx, unnest(list_transform(range(1, n + 1), lambda i: round(v[i] - CASE WHEN w < 3 THEN list_median(v) ELSE list_avg(ext[i : i + w - 1]) END, 6))) AS v FROM e
"""


def removed_component(fs: float = 360.0, seconds: float = 0.6) -> str:
    """Energy of the raw wave, of what is left and of what was taken out; the three and their cross term add up."""
    return f"""
SELECT recording_id, round(avg(v * v), 4) AS raw_energy, round(avg((v - m) * (v - m)), 4) AS kept_energy, round(avg(m * m), 4) AS removed_energy, round(2 * avg((v - m) * m), 4) AS cross_energy
FROM ({moving_mean(odd(seconds, fs))}) AS c GROUP BY recording_id
"""


def derivative(fs: float = 360.0, left: int = 2, inner: str = "WHERE own") -> str:
    """Central difference; the ends take their neighbour's value."""
    return f"""
SELECT recording_id, part, idx, v, own, CASE WHEN pv IS NULL THEN (nnv - v) * {fs / 2} WHEN nv IS NULL THEN (v - ppv) * {fs / 2} ELSE (nv - pv) * {fs / 2} END AS d
FROM (SELECT recording_id, part, idx, v, own, lag(v) OVER {IN} AS pv, lead(v) OVER {IN} AS nv, lag(v, 2) OVER {IN} AS ppv, lead(v, 2) OVER {IN} AS nnv FROM ({parts(left, 2)}) AS a) AS b {inner}
"""


def central_derivative(fs: float = 360.0) -> str:
    return f"SELECT recording_id, idx, round(d, 6) AS d FROM ({derivative(fs)}) AS c"


def squared_energy(fs: float = 360.0) -> str:
    """Squared derivative, and the gradient energy of the third detector."""
    return f"SELECT recording_id, idx, round(d * d, 4) AS d2, round(d * d / {fs * fs} + v * v, 6) AS gradient_energy FROM ({derivative(fs)}) AS c"


def integral(fs: float = 360.0, seconds: float = 0.15, digits: int = 4) -> str:
    """Trailing moving-window mean of the squared derivative, expanding at the start; squares count to ``digits`` decimals."""
    w = max(1, int(seconds * fs))
    return f"""
SELECT recording_id, idx, v, (run - coalesce(before, 0)) / ({10.0**digits:.1f} * least({w}, idx - lo + 1)) AS mwi
FROM (SELECT recording_id, part, idx, v, own, lo, run, lag(run, {w}) OVER {IN} AS before
      FROM (SELECT recording_id, part, idx, v, own, first_value(idx) OVER {WHOLE} AS lo, sum(coalesce(CAST(round(d * d * {10.0**digits:.1f}) AS BIGINT), 0)) OVER {UP_TO} AS run FROM ({derivative(fs, w + 2, "")}) AS i0) AS i1) AS i2
WHERE own
"""


def mwi_trailing(fs: float = 360.0, seconds: float = 0.15) -> str:
    return f"SELECT recording_id, idx, round(mwi, 3) AS mwi FROM ({integral(fs, seconds)}) AS d"


def rms(fs: float = 360.0, seconds: float = 0.1) -> str:
    w = max(1, int(seconds * fs))
    return f"SELECT recording_id, idx, sqrt(m) AS rms FROM ({moving_mean(w, w // 2, 'v * v', 6)}) AS c"


def rms_envelope(fs: float = 360.0) -> str:
    return f"SELECT recording_id, idx, round(rms, 6) AS rms FROM ({rms(fs)}) AS d"


def burst_fraction(fs: float = 360.0) -> str:
    return f"""
SELECT r.recording_id, round(avg(CASE WHEN rms > 2 * mid THEN 1.0 ELSE 0.0 END), 6) AS burst_fraction
FROM ({rms(fs)}) AS r JOIN (SELECT recording_id, MEDIAN(rms) AS mid FROM ({rms(fs)}) AS q GROUP BY recording_id) AS m ON r.recording_id = m.recording_id
GROUP BY r.recording_id
"""


FORWARD_FILL = f"SELECT recording_id, idx, round(coalesce(pv, lv0, 0.0), 6) AS v FROM (SELECT recording_id, part, idx, LASTV(v) OVER {UP_TO} AS pv FROM ({parts(0, 0)}) AS d) AS a JOIN ({CARRY}) AS c ON recording_id = r0 AND part = part0"


def decimate(points: int = 5500) -> str:
    """Least and greatest sample of each block, in order; the tail block is dropped."""
    return f"""
SELECT DISTINCT recording_id, idx, round(v, 6) AS v
FROM (SELECT recording_id, idx, v, row_number() OVER (PARTITION BY recording_id, block ORDER BY v, idx) AS low, row_number() OVER (PARTITION BY recording_id, block ORDER BY v DESC, idx) AS high
      FROM (SELECT recording_id, idx, v, CAST(floor(idx / step) AS BIGINT) AS block, step, n
            FROM (SELECT recording_id, idx, v, n, greatest(2, CAST(floor(n / {points // 2}) AS BIGINT)) AS step FROM (SELECT recording_id, idx, v, n FROM {{s}} AS a JOIN (SELECT recording_id AS rn, count(*) AS n FROM {{s}} AS a0 GROUP BY recording_id) AS a1 ON recording_id = rn) AS b) AS c
           ) AS d WHERE block < CAST(floor(n / step) AS BIGINT)) AS e
WHERE low = 1 OR high = 1
"""


def crop(start_s: float, end_s: float, fs: float = 360.0) -> str:
    return f"SELECT recording_id, idx, round(v, 6) AS v FROM {{s}} AS a WHERE idx / {fs} BETWEEN {start_s} AND {end_s}"


def channel_select(channel: int) -> str:
    """The wanted channel, or the last one there is; negative numbers select nothing."""
    return f"""
SELECT recording_id, channel, count(*) AS n, round(avg(v), 6) AS mean FROM {{s}} AS a
JOIN (SELECT recording_id AS rid, max(channel) AS most FROM {{s}} AS b GROUP BY recording_id) AS c ON recording_id = rid
WHERE channel = least({channel}, most) GROUP BY recording_id, channel
"""


def step_differences(fs: float = 360.0) -> str:
    """Backward difference (nought at the first sample) and gradient with one-sided ends, per recording."""
    return f"""
SELECT recording_id, round(avg(abs(v - coalesce(pv, v))), 6) AS mean_abs_step, round(avg(CASE WHEN pv IS NULL THEN nv - v WHEN nv IS NULL THEN v - pv ELSE (nv - pv) / 2 END), 6) AS mean_gradient, count(*) AS n
FROM (SELECT recording_id, v, lag(v) OVER {W} AS pv, lead(v) OVER {W} AS nv FROM {{s}} AS a) AS b GROUP BY recording_id
"""
