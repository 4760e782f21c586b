"""What kernels compute, said anew in DuckDB SQL: filters by their difference equation, spectra by a written-out transform, text by its round trip."""

from __future__ import annotations

from ..functions import dsp


def _section(source: str, b0: float, b1: float, b2: float, a1: float, a2: float, zi: tuple[float, float], edge: str) -> str:
    """One second-order section over ``ys``, sample by sample; it starts from the steady state of ``edge``."""
    w = f"({b0!r} * e.x + a.p)"
    return f"""SELECT * REPLACE (list_reduce(list_transform(ys, lambda x: {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'x': x::DOUBLE, 'out': []::DOUBLE[]}}),
  lambda a, e: {{'p': ({b1!r} * e.x - {a1!r} * {w} + a.q)::DOUBLE, 'q': ({b2!r} * e.x - {a2!r} * {w})::DOUBLE, 'x': e.x, 'out': list_append(a.out, {w}::DOUBLE)}},
  {{'p': ({zi[0]!r} * {edge})::DOUBLE, 'q': ({zi[1]!r} * {edge})::DOUBLE, 'x': 0.0::DOUBLE, 'out': []::DOUBLE[]}}).out AS ys) FROM {source}"""


def zero_phase(signal: str, sos, column: str, digits: int | None = 5) -> str:
    """Forward and backward over an odd extension of ``signal(recording_id, idx, v)``; ``digits=None`` leaves the values unrounded."""
    trailing = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    pad = 3 * (2 * len(sos) + 1 - trailing)
    state = dsp.sos_state(sos).tolist()
    steps = [f"base AS (SELECT recording_id, list(v ORDER BY idx) AS v FROM ({signal}) GROUP BY recording_id)"]
    steps.append(f"s0 AS (SELECT recording_id, list_concat(list_transform(generate_series({pad}, 1, -1), lambda k: 2 * v[1] - v[k + 1]), v, list_transform(generate_series(1, {pad}), lambda k: 2 * v[-1] - v[len(v) - k])) AS ys FROM base)")
    at = "s0"
    for way in ("f", "b"):
        steps.append(f"{way}0 AS (SELECT recording_id, {'ys' if way == 'f' else 'list_reverse(ys)'} AS ys, {'ys[1]' if way == 'f' else 'ys[-1]'} AS x0 FROM {at})")
        at = f"{way}0"
        for k, (row, zi) in enumerate(zip(sos.tolist(), state, strict=True)):
            steps.append(f"{way}{k + 1} AS ({_section(at, *row[:3], *row[4:], tuple(zi), 'x0')})")
            at = f"{way}{k + 1}"
    steps.append(f"y AS (SELECT recording_id, list_reverse(ys)[{pad + 1} : len(ys) - {pad}] AS ys FROM {at})")
    value = "unnest(ys)" if digits is None else f"round(unnest(ys), {digits})"
    return f"WITH {', '.join(steps)} SELECT recording_id, unnest(generate_series(0, len(ys) - 1)) AS idx, {value} AS {column} FROM y"


def detrended(signal: str, window: int) -> str:
    """``signal`` less its centred mean of an odd ``window``, ends repeated, in doubles as the kernels take it."""
    half = window // 2
    frame = "(PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""SELECT recording_id, idx, v - (inside + greatest(0, {half} - idx) * a + greatest(0, {half} - (n - 1 - idx)) * z) / {window} AS v
FROM (SELECT recording_id, idx, v, sum(v) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS inside, first_value(v) OVER {frame} AS a, last_value(v) OVER {frame} AS z, count(*) OVER (PARTITION BY recording_id) AS n FROM ({signal}))"""


def causal(signal: str, sos, column: str, digits: int = 5) -> str:
    """Forwards only, from the steady state of the first sample."""
    steps, at = [f"c0 AS (SELECT recording_id, list(v ORDER BY idx) AS ys, first(v ORDER BY idx) AS x0 FROM ({signal}) GROUP BY recording_id)"], "c0"
    for k, (row, zi) in enumerate(zip(sos.tolist(), dsp.sos_state(sos).tolist(), strict=True)):
        steps.append(f"c{k + 1} AS ({_section(at, *row[:3], *row[4:], tuple(zi), 'x0')})")
        at = f"c{k + 1}"
    return f"WITH {', '.join(steps)} SELECT recording_id, unnest(generate_series(0, len(ys) - 1)) AS idx, round(unnest(ys), {digits}) AS {column} FROM {at}"


def welch(signal: str, fs: float, nperseg: int, digits: tuple[int, int] = (6, 4)) -> str:
    """Welch's average of half-overlapping, mean-free segments under a periodic Hann window; a short recording is one segment."""
    return f"""
WITH s AS ({signal}), n AS (SELECT recording_id, count(*) AS n, least({nperseg}, count(*)) AS l FROM s GROUP BY recording_id),
g AS (SELECT recording_id, l, l - l // 2 AS hop, unnest(generate_series(0, (n - l) // (l - l // 2))) AS seg FROM n),
x AS (SELECT recording_id, seg, l, idx - seg * hop AS i, (v - avg(v) OVER (PARTITION BY recording_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * (idx - seg * hop) / l)) AS y FROM g JOIN s USING (recording_id) WHERE idx >= seg * hop AND idx < seg * hop + l),
f AS (SELECT recording_id, seg, l, k, sum(y * cos(2 * pi() * ((k * i) % l) / l)) AS re, sum(y * sin(2 * pi() * ((k * i) % l) / l)) AS im FROM (SELECT *, unnest(generate_series(0, l // 2)) AS k FROM x) GROUP BY ALL),
w AS (SELECT l, (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / l)) ** 2) FROM generate_series(0, l - 1) AS t(i)) AS power FROM (SELECT DISTINCT l FROM n))
SELECT recording_id, k, round(k * {fs} / l, {digits[0]}) AS freq, round(avg((re * re + im * im) / ({fs} * power)) * CASE WHEN k = 0 OR 2 * k = l THEN 1 ELSE 2 END, {digits[1]}) AS p FROM f JOIN w USING (l) GROUP BY recording_id, k, l
"""


def text_scan(signal: str, fs: float) -> str:
    """Recordings written as ``time,ecg`` with six decimals, and read again."""
    return f"SELECT recording_id, CAST(0 AS INTEGER) AS channel, 'ecg' AS channel_name, idx, CAST(format('{{:.6f}}', idx / {fs}) AS DOUBLE) AS t, CAST(format('{{:.6f}}', v) AS DOUBLE) AS v FROM ({signal})"


def rates(signal: str, fs: float) -> str:
    return f"""
WITH s AS (SELECT recording_id, idx, t - lag(t) OVER (PARTITION BY recording_id ORDER BY idx) AS step FROM ({text_scan(signal, fs)})),
r AS (SELECT recording_id, round(1 / quantile_cont(step, 0.5), 2) AS fs, max(idx) + 1 AS n FROM s GROUP BY recording_id)
SELECT recording_id, fs, n / fs AS duration_s, CAST(NULL AS VARCHAR) AS warning FROM r
"""


def peaks(signal: str, height: float | None = None, distance: int = 1, prominence: str = "") -> str:
    """``recording_id, idx`` of local maxima: plateaus count once, in their middle; the highest silences those nearer than ``distance``; a peak stands ``prominence`` (an aggregate of ``v``) above the higher of its two valleys, each reaching to the next higher sample."""
    lowest = "" if height is None else f" AND v >= {height!r}"
    kept = f"""
WITH s AS ({signal}),
flat AS (SELECT recording_id, run, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM (SELECT *, count(*) FILTER (moved) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY recording_id ORDER BY idx) AS moved FROM s)) GROUP BY recording_id, run),
top AS (SELECT recording_id, (a + b) // 2 AS idx, v FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM flat WINDOW w AS (PARTITION BY recording_id ORDER BY run)) WHERE v > before AND v > after{lowest}),
kept AS (SELECT recording_id, unnest(list_reduce(list([idx] ORDER BY v DESC, idx DESC), lambda a, e: CASE WHEN len(list_filter(a, lambda k: abs(k - e[1]) < {distance})) > 0 THEN a ELSE list_concat(a, e) END, []::BIGINT[])) AS idx FROM top GROUP BY recording_id)"""
    if not prominence:
        return kept + " SELECT recording_id, idx FROM kept"
    return kept + f""",
peak AS (SELECT k.recording_id, k.idx, s.v FROM kept AS k JOIN s USING (recording_id, idx)),
reach AS (SELECT p.recording_id, p.idx, any_value(p.v) AS v, max(s.idx) FILTER (s.v > p.v AND s.idx < p.idx) AS l, min(s.idx) FILTER (s.v > p.v AND s.idx > p.idx) AS r FROM peak AS p JOIN s USING (recording_id) GROUP BY p.recording_id, p.idx),
valley AS (SELECT q.recording_id, q.idx, any_value(q.v) - greatest(min(s.v) FILTER (s.idx <= q.idx AND (l IS NULL OR s.idx > l)), min(s.v) FILTER (s.idx >= q.idx AND (r IS NULL OR s.idx < r))) AS height FROM reach AS q JOIN s USING (recording_id) GROUP BY q.recording_id, q.idx)
SELECT recording_id, idx FROM valley JOIN (SELECT recording_id, {prominence} AS least FROM s GROUP BY recording_id) USING (recording_id) WHERE height >= least"""


def event_windows(length: str, slide: str, copies: int) -> str:
    """Hopping windows of ``events``: each row lies in ``copies`` of them."""
    return f"""
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(start + INTERVAL '{length}', '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 3) AS total, max(value) AS most
FROM (SELECT event_type, value, time_bucket(INTERVAL '{slide}', ts) - k * INTERVAL '{slide}' AS start FROM events, generate_series(0, {copies - 1}) AS g(k) WHERE ts IS NOT NULL) GROUP BY event_type, start"""


def event_sessions(gap: str) -> str:
    """Sessions of ``events`` by user: a row that comes later than ``gap`` after the one before begins another."""
    return f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL '{gap}', '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n
FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '{gap}' AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, session"""
