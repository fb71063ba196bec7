"""The sequential operators in SQL: one row of state a key, moved on row by row by recursion."""

from __future__ import annotations

from bandsift import params as P

#: Samples before and after a trigger and in a capture, as the queries ask for.
PRE, POST, MOST = (max(1, int(2_400_000 * s)) for s in (1e-4, 2e-4, 6e-4))

_CAPTURE = "STRUCT(segment BIGINT, rate INT, start BIGINT, deadline BIGINT, max_end BIGINT, triggers BIGINT[])"

#: After META: `state` has a row for each block, `captures` one for each capture.
CAPTURES = f"""b AS (SELECT session_id, segment_start, start_sample, end_sample, sample_rate, (start_sample // 32) % 17 = 0 AS fired,
    row_number() OVER (PARTITION BY session_id ORDER BY start_sample) AS k FROM segs),
  state AS (SELECT DISTINCT session_id, 0::BIGINT AS k, NULL::BIGINT AS segment_start, NULL::BIGINT AS end_sample, NULL::{_CAPTURE} AS p, NULL::{_CAPTURE} AS lost, NULL::{_CAPTURE} AS done FROM b
    UNION ALL
    SELECT session_id, k, segment_start, end_sample, CASE WHEN q.start IS NOT NULL AND end_sample < q.deadline THEN q END, lost, CASE WHEN end_sample >= q.deadline THEN q END FROM (
      SELECT *, CASE WHEN NOT fired THEN held
          WHEN held.start IS NULL THEN {{'segment': segment_start, 'rate': sample_rate, 'start': greatest(segment_start, end_sample - {PRE}),
            'deadline': end_sample + {POST}, 'max_end': greatest(segment_start, end_sample - {PRE}) + {MOST}, 'triggers': [start_sample]}}
          ELSE {{'segment': held.segment, 'rate': held.rate, 'start': held.start, 'deadline': least(held.max_end, end_sample + {POST}),
            'max_end': held.max_end, 'triggers': list_append(held.triggers, start_sample)}} END AS q FROM (
        SELECT b.*, CASE WHEN p.segment = b.segment_start THEN p END AS held, CASE WHEN p.segment <> b.segment_start THEN p END AS lost
        FROM state s JOIN b ON b.session_id = s.session_id AND b.k = s.k + 1) x) y),
  ended AS (SELECT session_id, lost AS c, NULL::BIGINT AS capture_end FROM state WHERE lost.start IS NOT NULL
    UNION ALL SELECT session_id, done, least(end_sample, done.max_end) FROM state WHERE done.start IS NOT NULL
    UNION ALL SELECT session_id, p, NULL FROM state JOIN (SELECT session_id, max(k) AS k FROM b GROUP BY ALL) USING (session_id, k) WHERE p.start IS NOT NULL),
  captures AS (SELECT session_id, c.segment AS segment_start, c.rate AS sample_rate, c.start AS capture_start, c.deadline AS deadline,
    c.max_end AS max_end, c.triggers AS triggers, capture_end FROM ended)"""


def clusters(regions: str, proximity_hz: int) -> str:
    """CTEs `assigned` (each region with its channel's state after it) over a CTE of regions."""
    near, far = f"{1 - P.CENTER_ALPHA!r}::DOUBLE", f"{P.CENTER_ALPHA!r}::DOUBLE"
    old, new = f"{1 - P.POWER_ALPHA!r}::DOUBLE", f"{P.POWER_ALPHA!r}::DOUBLE"
    moved = f"""{{'born_seq': x.born_seq, 'born_hz': x.born_hz, 'first_us': x.first_us,
        'center': CAST(round_even({near} * x.center + {far} * center_hz, 0) AS BIGINT), 'width': CAST(round_even({near} * x.width + {far} * bandwidth_hz, 0) AS BIGINT),
        'current': round(peak_power_db, 3), 'peak': round(greatest(x.peak, peak_power_db), 3), 'avg': round({old} * x.avg + {new} * avg_power_db, 3),
        'snr': round({old} * x.snr + {new} * snr_db, 3), 'n': x.n + 1}}"""
    fresh = """{'born_seq': frame_seq, 'born_hz': center_hz, 'first_us': us, 'center': center_hz, 'width': bandwidth_hz, 'current': peak_power_db,
        'peak': peak_power_db, 'avg': avg_power_db, 'snr': snr_db, 'n': 1}"""
    kind = "STRUCT(born_seq BIGINT, born_hz BIGINT, first_us BIGINT, center BIGINT, width BIGINT, current DOUBLE, peak DOUBLE, avg DOUBLE, snr DOUBLE, n BIGINT)[]"
    return f"""r AS (SELECT session_id, frame_seq, epoch_us(ts) AS us, CAST(center_hz AS BIGINT) AS center_hz, CAST(bandwidth_hz AS BIGINT) AS bandwidth_hz, CAST(peak_power_db AS DOUBLE) AS peak_power_db,
    CAST(avg_power_db AS DOUBLE) AS avg_power_db, CAST(snr_db AS DOUBLE) AS snr_db, row_number() OVER (PARTITION BY session_id ORDER BY frame_seq, center_hz) AS k FROM {regions}),
  folded AS (SELECT DISTINCT session_id, 0::BIGINT AS k, NULL::BIGINT AS frame_seq, NULL::BIGINT AS us, NULL::BIGINT AS center_hz, 0 AS pos, []::{kind} AS ch FROM r
    UNION ALL
    SELECT session_id, k, frame_seq, us, center_hz, CASE WHEN near THEN pos ELSE len(ch) + 1 END,
      CASE WHEN near THEN [CASE WHEN i = pos THEN {moved} ELSE x END FOR x, i IN ch] ELSE list_append(ch, {fresh}) END FROM (
      SELECT *, list_position(away, list_min(away)) AS pos, coalesce(list_min(away) <= {proximity_hz}, FALSE) AS near FROM (
        SELECT r.*, ch, [abs(x.center - r.center_hz) FOR x IN ch] AS away FROM folded f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1) y) z),
  assigned AS (SELECT session_id, frame_seq, us, center_hz, ch[pos] AS c FROM folded WHERE k > 0)"""


#: A region with its channel, as the clustering queries show it.
ASSIGNED = """SELECT session_id, c.born_seq AS born_seq, c.born_hz AS born_hz, frame_seq, center_hz, c.center AS state_center_hz, c.width AS state_bandwidth_hz,
  c.current AS current_power_db, c.peak AS peak_power_db, c.avg AS avg_power_db, c.snr AS snr_db, c.n AS observation_count, make_timestamp(us) AS ts, make_timestamp(c.first_us) AS first_ts FROM assigned"""

#: After `clusters`: the last state of each channel, numbered by birth.
CHANNELS = """chans AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY born_seq, born_hz) AS channel_id, s.c.center AS center_hz, s.c.width AS bandwidth_hz,
    s.c.current AS current_power_db, s.c.peak AS peak_power_db, s.c.avg AS avg_power_db, s.c.snr AS snr_db, s.c.n AS observation_count, s.c.first_us AS first_us, s.us AS last_us
    FROM (SELECT session_id, c.born_seq AS born_seq, c.born_hz AS born_hz, arg_max({'c': c, 'us': us}, frame_seq * 10000000000 + center_hz) AS s FROM assigned GROUP BY ALL))"""


def merged(proximity_hz: int) -> str:
    """CTE `survivors` over `chans`: every pair in order of ids, against what the first has grown to."""
    kind = "STRUCT(id BIGINT, hz BIGINT, width BIGINT, current DOUBLE, peak DOUBLE, avg DOUBLE, snr DOUBLE, n BIGINT, first_us BIGINT, last_us BIGINT, gone BOOLEAN)[]"
    both = """{'id': a.id, 'hz': CAST(round_even((a.hz * a.n + z.hz * z.n) / CAST(greatest(a.n + z.n, 1) AS DOUBLE), 0) AS BIGINT), 'width': greatest(a.width, z.width), 'current': a.current,
      'peak': greatest(a.peak, z.peak), 'avg': CAST(printf('%.3f', (a.avg + z.avg) / 2) AS DOUBLE), 'snr': greatest(a.snr, z.snr), 'n': a.n + z.n, 'first_us': least(a.first_us, z.first_us),
      'last_us': greatest(a.last_us, z.last_us), 'gone': FALSE}"""
    lost = """{'id': z.id, 'hz': z.hz, 'width': z.width, 'current': z.current, 'peak': z.peak, 'avg': z.avg, 'snr': z.snr, 'n': z.n, 'first_us': z.first_us, 'last_us': z.last_us, 'gone': TRUE}"""
    return f"""held AS (SELECT session_id, list({{'id': channel_id, 'hz': center_hz, 'width': bandwidth_hz, 'current': current_power_db, 'peak': peak_power_db, 'avg': avg_power_db, 'snr': snr_db,
      'n': observation_count, 'first_us': first_us, 'last_us': last_us, 'gone': FALSE}} ORDER BY channel_id)::{kind} AS ch FROM chans GROUP BY session_id),
  pairs AS (SELECT session_id, i, j, row_number() OVER (PARTITION BY session_id ORDER BY i, j) AS k FROM (SELECT session_id, unnest(range(1, len(ch) + 1)) AS i, ch FROM held), LATERAL (SELECT unnest(range(i + 1, len(ch) + 1)) AS j)),
  met AS (SELECT session_id, 0::BIGINT AS k, ch FROM held
    UNION ALL
    SELECT session_id, k, CASE WHEN NOT a.gone AND NOT z.gone AND abs(z.hz - a.hz) <= greatest({proximity_hz}, (a.width + z.width) // 2)
      THEN [CASE WHEN n = i THEN {both} WHEN n = j THEN {lost} ELSE x END FOR x, n IN ch] ELSE ch END FROM (
      SELECT m.session_id, p.k, p.i, p.j, m.ch, m.ch[p.i] AS a, m.ch[p.j] AS z FROM met m JOIN pairs p ON p.session_id = m.session_id AND p.k = m.k + 1) y),
  survivors AS (SELECT session_id, unnest(ch) AS c FROM met JOIN (SELECT session_id, max(k) AS k FROM met GROUP BY ALL) USING (session_id, k))"""


def tracks(regions: str, association_hz: int = P.ASSOCIATION_HZ, holdoff: int = P.HOLDOFF_FRAMES) -> str:
    """CTE `tracked` over a CTE of single-frame regions: all tracks, closed or not."""
    middle = lambda v: f"CASE WHEN len({v}) % 2 = 1 THEN list_sort({v})[len({v}) // 2 + 1] ELSE (list_sort({v})[len({v}) // 2] + list_sort({v})[len({v}) // 2 + 1]) / 2 END"
    kind = "STRUCT(start_frame BIGINT, start_sample BIGINT, first_hz DOUBLE, peak DOUBLE, snr DOUBLE, n BIGINT, centers DOUBLE[], widths DOUBLE[], hz DOUBLE, last_frame BIGINT, last_start BIGINT)[]"
    grown = f"""{{'start_frame': x.start_frame, 'start_sample': x.start_sample, 'first_hz': x.first_hz, 'peak': greatest(x.peak, peak_db), 'snr': greatest(x.snr, peak_snr_db), 'n': x.n + 1,
        'centers': list_append(x.centers, center_hz), 'widths': list_append(x.widths, width_hz), 'hz': {middle('list_append(x.centers, center_hz)')}, 'last_frame': frame_id, 'last_start': frame_start}}"""
    fresh = """{'start_frame': frame_id, 'start_sample': frame_start, 'first_hz': center_hz, 'peak': peak_db, 'snr': peak_snr_db, 'n': 1, 'centers': [center_hz], 'widths': [width_hz],
        'hz': center_hz, 'last_frame': frame_id, 'last_start': frame_start}"""
    return f"""r AS (SELECT session_id, segment_start, frame_id, frame_start, center_hz, peak_db, peak_snr_db, width_hz,
    row_number() OVER (PARTITION BY session_id, segment_start ORDER BY frame_id, center_hz) AS k FROM {regions}),
  folded AS (SELECT DISTINCT session_id, segment_start, 0::BIGINT AS k, []::{kind} AS open, []::{kind} AS closed FROM r
    UNION ALL
    SELECT session_id, segment_start, k, CASE WHEN coalesce(best <= {association_hz}, FALSE) THEN [CASE WHEN i = pos THEN {grown} ELSE x END FOR x, i IN open]
        ELSE list_append(open, {fresh}) END, closed FROM (
      SELECT *, list_min(away) AS best, len(away) + 1 - list_position(list_reverse(away), list_min(away)) AS pos FROM (
        SELECT *, [CASE WHEN x.last_frame < frame_id THEN abs(x.hz - center_hz) ELSE 1e300::DOUBLE END FOR x IN open] AS away FROM (
          SELECT r.*, [x FOR x IN f.open IF x.last_frame + {holdoff} >= r.frame_id] AS open, [x FOR x IN f.open IF x.last_frame + {holdoff} < r.frame_id] AS closed
          FROM folded f JOIN r ON r.session_id = f.session_id AND r.segment_start = f.segment_start AND r.k = f.k + 1) w) y) z),
  each AS (SELECT session_id, segment_start, unnest(closed) AS t FROM folded UNION ALL SELECT session_id, segment_start, unnest(open) FROM folded
    JOIN (SELECT session_id, segment_start, max(k) AS k FROM folded GROUP BY ALL) USING (session_id, segment_start, k)),
  tracked AS (SELECT session_id, segment_start, t.start_frame AS start_frame, t.last_frame AS last_frame, t.last_frame + {holdoff} AS close_frame, t.start_sample AS start_sample,
    t.last_start AS last_frame_start, t.first_hz AS first_hz, t.hz AS center_hz, {middle('t.widths')} AS width_hz, t.peak AS peak_db, t.snr AS peak_snr_db, t.n AS above_frames FROM each)"""
