"""Shared SQL building blocks of the DuckDB oracle.

Each registered query has an independent SQL formulation run by DuckDB on
the same parquet tables; these CTEs are the SQL twins of the fixture
projections in :mod:`pitchlens.sources.fixture` and of the common inputs
(cleaned events, windows, play time).
"""

from __future__ import annotations

from .. import constants as K

FIXTURE = """a AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props,'$.k') AS INT) AS k,
         hour(ts)*3600 + minute(ts)*60 + CAST(floor(second(ts)) AS INT) AS sod, CAST(ts AS DATE) AS d
  FROM events),
b AS (SELECT *, CAST(floor(sod/15.0) AS INT) AS t FROM a),
me AS (
SELECT event_id AS seq, CAST(d AS VARCHAR) AS game,
  CASE WHEN t < 2880 THEN 1 ELSE 2 END AS period_id,
  CASE WHEN t < 2880 THEN t ELSE 2700 + t - 2880 END AS game_time_in_sec,
  user_id AS player_id, CAST(user_id % 2 AS INT) AS team_id,
  CASE event_type
    WHEN 'view'     THEN 1
    WHEN 'click'    THEN CASE k%3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 6 END
    WHEN 'purchase' THEN 13 + k%4
    WHEN 'error'    THEN CASE k%8 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 10
                                  WHEN 4 THEN 17 WHEN 5 THEN 44 WHEN 6 THEN 61 ELSE 43 END
    ELSE CASE k%5 WHEN 0 THEN 18 WHEN 1 THEN 19 ELSE 1 END END AS type_id,
  k%2 AS outcome,
  CASE WHEN k%10 = 0 THEN 1 END AS keypass, CASE WHEN k%25 = 0 THEN 1 END AS assist,
  CAST(CAST(floor(value) AS INT) % 101 AS DOUBLE) AS x, CAST(k AS DOUBLE) AS y,
  CASE k%5 WHEN 1 THEN 'Back' WHEN 2 THEN 'Center' WHEN 3 THEN 'Left' WHEN 4 THEN 'Right' END AS zone
FROM b)"""

CLEAN = """clean AS (SELECT * FROM me WHERE period_id IN (1, 2) AND (type_id IS NULL OR type_id <> 43))"""

STATS = """st AS (
  SELECT seq, game, type_id, COALESCE(zone, 'no_position') AS zone, period_id, game_time_in_sec, player_id,
         team_id, outcome, COALESCE(keypass, 0) AS keypass, COALESCE(assist, 0) AS assist, x, y
  FROM clean
  WHERE game IS NOT NULL AND type_id IS NOT NULL AND period_id IS NOT NULL AND game_time_in_sec IS NOT NULL
    AND player_id IS NOT NULL AND team_id IS NOT NULL AND outcome IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"""

WINDOW_STARTS = """ws AS (
  SELECT 1 AS p, CAST(range AS INT) AS s FROM range(0, 31, 5)
  UNION ALL SELECT 2 AS p, CAST(range AS INT) AS s FROM range(45, 76, 5))"""

SLICES = """sl AS (
  SELECT st.*, ws.s AS start, CAST(ws.s AS VARCHAR) || '-' || CAST(ws.s + 15 AS VARCHAR) AS time_period
  FROM st JOIN ws ON st.period_id = ws.p AND st.game_time_in_sec BETWEEN ws.s * 60 AND (ws.s + 15) * 60),
slp AS (
  SELECT *, lag(type_id) OVER (PARTITION BY game, period_id, start ORDER BY seq) AS prev_type_id FROM sl)"""

RAW = """ends AS (
  SELECT 1000000000 + max(seq)*2 + i AS seq, game, period_id, CAST(max(game_time_in_sec) + i AS INT) AS game_time_in_sec,
         CAST(NULL AS BIGINT) AS player_id, CAST(i AS INT) AS team_id, 30 AS type_id, 1 AS outcome
  FROM (SELECT seq, game, period_id, game_time_in_sec, unnest([0, 1]) AS i FROM me) GROUP BY game, period_id, i),
lu AS (
  SELECT game, team_id, array_to_string(list_slice(list_sort(list(DISTINCT player_id)), 1, 14), ', ') AS value
  FROM me WHERE player_id IS NOT NULL GROUP BY game, team_id),
rawu AS (
  SELECT seq, game, period_id, game_time_in_sec, player_id, team_id, type_id, outcome, keypass, assist, x, y, zone,
         CAST(NULL AS VARCHAR) AS lineup FROM me
  UNION ALL SELECT seq, game, period_id, game_time_in_sec, player_id, team_id, type_id, outcome,
         NULL, NULL, NULL, NULL, NULL, NULL FROM ends
  UNION ALL SELECT -2 - team_id, game, 16, 0, NULL, team_id, 34, 1, NULL, NULL, NULL, NULL, NULL, value FROM lu),
raw AS (
  SELECT seq, CAST(replace(game, '-', '') AS INT) AS home_team_id, CAST(replace(game, '-', '') AS INT) + 1 AS away_team_id,
         period_id, CAST(game_time_in_sec // 60 AS INT) AS min, CAST(game_time_in_sec % 60 AS INT) AS sec, player_id,
         CASE WHEN team_id = 1 THEN CAST(replace(game, '-', '') AS INT) ELSE CAST(replace(game, '-', '') AS INT) + 1 END
           AS team_id,
         type_id, outcome, keypass, assist, x, y, zone, lineup
  FROM rawu),
traw AS (
  SELECT *, CAST(home_team_id AS VARCHAR) || '-' || CAST(away_team_id AS VARCHAR) AS game,
         CAST(min * 60 + sec AS INT) AS game_time_in_sec FROM raw)"""

PLAYTIME = f"""pends AS (
  SELECT game,
    CAST(COALESCE(max_by(game_time_in_sec, seq) FILTER (WHERE period_id = 1), -1) AS INT) AS end_first_half,
    CAST(COALESCE(max_by(game_time_in_sec, seq) FILTER (WHERE period_id = 2), -1) AS INT) AS end_second_half
  FROM traw WHERE type_id = 30 GROUP BY game),
subs AS (
  SELECT game, player_id,
    CAST(min_by(game_time_in_sec, seq) FILTER (WHERE type_id = 19) AS DOUBLE) AS start_game,
    CAST(min_by(game_time_in_sec, seq) FILTER (WHERE type_id = 18) AS DOUBLE) AS end_game
  FROM traw WHERE type_id IN (18, 19) AND player_id IS NOT NULL GROUP BY game, player_id),
starters AS (
  SELECT game, team_id, CAST(generate_subscripts(l, 1) AS INT) AS slot, CAST(trim(unnest(l)) AS BIGINT) AS player_id
  FROM (SELECT game, team_id, list_slice(string_split(lineup, ', '), 1, {K.STARTERS_PER_TEAM}) AS l
        FROM traw WHERE type_id = 34 AND lineup IS NOT NULL)),
fullp AS (
  SELECT DISTINCT s.game, s.player_id FROM starters s
  WHERE NOT EXISTS (SELECT 1 FROM subs u WHERE u.game = s.game AND u.player_id = s.player_id)),
pt0 AS (
  SELECT game, player_id, start_game, end_game FROM subs
  UNION ALL SELECT game, player_id, 0.0, CAST(NULL AS DOUBLE) FROM fullp),
pt1 AS (
  SELECT pt0.game, pt0.player_id, COALESCE(start_game, 0.0) AS start_game,
         COALESCE(end_game, CAST(end_second_half AS DOUBLE)) AS end_game, end_first_half
  FROM pt0 LEFT JOIN pends ON pt0.game = pends.game),
pt AS (
  SELECT game, player_id, start_game, end_game,
         (start_game < 2700.0 AND end_game > 2700.0) AS has_played_extra_time_first_half,
         end_game - start_game + (CAST(end_first_half AS DOUBLE) - 2700.0)
           * CAST((start_game < 2700.0 AND end_game > 2700.0) AS DOUBLE) AS game_time_in_sec
  FROM pt1)"""

REGISTRY = """reg AS (
  SELECT c.c_custkey AS player_id, CASE WHEN c.c_acctbal < 0 THEN '1' END AS loan, c.c_name AS name,
         c.c_mktsegment AS position,
         CASE WHEN c.c_custkey % 7 = 0 THEN CAST(DATE '2017-01-01' + CAST(c.c_custkey % 30 AS INT) AS DATE)
              ELSE CAST(DATE '2016-07-01' + CAST(c.c_custkey % 240 AS INT) AS DATE) END AS arrival_date,
         CASE WHEN c.c_custkey % 3 = 0 THEN NULL
              ELSE CAST(DATE '2018-06-30' + CAST(c.c_custkey % 365 AS INT) AS DATE) END AS leave_date,
         n.n_name || ' ' || CAST(c.c_custkey // 30 AS VARCHAR) AS team_name,
         c.c_mktsegment = 'AUTOMOBILE' AS moved
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

ELIGIBLE = """over AS (
  SELECT player_id, sum(game_time_in_sec) AS game_time_in_sec FROM pt GROUP BY player_id
  HAVING sum(game_time_in_sec) >= 48000),
elig AS (
  SELECT DISTINCT player_id FROM over
  WHERE player_id NOT IN (SELECT player_id FROM reg WHERE moved)
    AND player_id NOT IN (SELECT player_id FROM reg WHERE loan = '1' AND arrival_date >= DATE '2017-01-01'))"""

NEXT = """nin AS (
  SELECT *, CAST(team_id AS DOUBLE) * x + (1.0 - CAST(team_id AS DOUBLE)) * (100.0 - x) AS x_along_team1_axis,
            CAST(team_id AS DOUBLE) * y + (1.0 - CAST(team_id AS DOUBLE)) * (100.0 - y) AS y_along_team1_axis
  FROM clean WHERE type_id IS NULL OR type_id NOT IN (30, 32)),
nlag AS (
  SELECT seq, game, period_id, team_id, x_along_team1_axis, y_along_team1_axis,
    lag(period_id, 1) OVER w AS period_id_lag1, lag(period_id, 2) OVER w AS period_id_lag2,
    lag(period_id, 3) OVER w AS period_id_lag3,
    lag(type_id, 1) OVER w AS type_id_lag1, lag(team_id, 1) OVER w AS team_id_lag1,
    lag(x_along_team1_axis, 1) OVER w AS x_along_team1_axis_lag1, lag(y_along_team1_axis, 1) OVER w AS y_along_team1_axis_lag1,
    lag(type_id, 2) OVER w AS type_id_lag2, lag(team_id, 2) OVER w AS team_id_lag2,
    lag(x_along_team1_axis, 2) OVER w AS x_along_team1_axis_lag2, lag(y_along_team1_axis, 2) OVER w AS y_along_team1_axis_lag2,
    lag(type_id, 3) OVER w AS type_id_lag3, lag(team_id, 3) OVER w AS team_id_lag3,
    lag(x_along_team1_axis, 3) OVER w AS x_along_team1_axis_lag3, lag(y_along_team1_axis, 3) OVER w AS y_along_team1_axis_lag3
  FROM nin WINDOW w AS (PARTITION BY game ORDER BY seq)),
nxt AS (
  SELECT seq, game, period_id, team_id, x_along_team1_axis, y_along_team1_axis,
         type_id_lag1, team_id_lag1, x_along_team1_axis_lag1, y_along_team1_axis_lag1,
         type_id_lag2, team_id_lag2, x_along_team1_axis_lag2, y_along_team1_axis_lag2,
         type_id_lag3, team_id_lag3, x_along_team1_axis_lag3, y_along_team1_axis_lag3
  FROM nlag WHERE period_id = period_id_lag1 AND period_id = period_id_lag2 AND period_id = period_id_lag3)"""


def cnt(cond: str) -> str:
    """Rows where ``cond`` holds (NULL counts as false), INT."""
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS INT)"


def nb(prefix: str, ids) -> str:
    return ",\n".join(f'{cnt(f"type_id = {e}")} AS "{prefix}{e}_nb"' for e in ids)


def rate(prefix: str, ids) -> str:
    parts = []
    for e in ids:
        parts.append(f'{cnt(f"type_id = {e}")} AS "{prefix}{e}_nb"')
        parts.append(f'CAST({cnt(f"type_id = {e} AND outcome = 1")} AS DOUBLE) / '
                     f'NULLIF(CAST({cnt(f"type_id = {e}")} AS DOUBLE), 0.0) AS "{prefix}{e}_success_rate"')
    return ",\n".join(parts)


BOOL_COUNTERS = """CAST(COALESCE(sum(assist), 0) AS INT) AS nb_assist,
CAST(COALESCE(sum(keypass), 0) AS INT) AS nb_keypass,
CAST(sum(CASE WHEN type_id IN (10, 11, 41, 52, 53, 54, 58) THEN 1 ELSE 0 END) AS INT) AS nb_gk_events,
CAST(sum(CASE WHEN type_id IN (13, 14, 15, 16) THEN 1 ELSE 0 END) AS INT) AS nb_shots,
CAST(sum(CASE WHEN type_id = 1 AND prev_type_id = 4 THEN 1 ELSE 0 END) AS INT) AS nb_free_kick,
CAST(sum(CASE WHEN type_id = 1 AND prev_type_id = 6 THEN 1 ELSE 0 END) AS INT) AS nb_corner"""

ZONE_COUNTS = ",\n".join(
    [cnt("zone IS NOT NULL AND zone <> 'no_position'") + " AS _z_all"]
    + [cnt(f"zone = '{z}'") + f" AS _z_{z}" for z in K.ZONES])


def zone_finals(scope) -> str:
    """Zone shares; a zone absent from the whole scope is NULL for everyone."""
    part = ", ".join(scope)
    return ",\n".join(
        f"CASE WHEN sum(_z_{z}) OVER (PARTITION BY {part}) > 0 THEN "
        f"100.0 * CAST(_z_{z} AS DOUBLE) / NULLIF(CAST(_z_all AS DOUBLE), 0.0) END AS \"{z}\"" for z in K.ZONES)


def features_sql(src: str, slice_keys: list[str], labels: list[str], prefix: str = "") -> str:
    """Player + team aggregates of a sliced source, joined on (slice, team).

    CTE names get ``prefix`` so two feature tables can live in one query.
    """
    sk = ", ".join(slice_keys)
    pk = ", ".join([*slice_keys, *labels, "player_id", "team_id"])
    join_on = " AND ".join(f"p.{k} = t.{k}" for k in [*slice_keys, "team_id"])
    z = ", ".join(["_z_all", *[f"_z_{zz}" for zz in K.ZONES]])
    return f"""{prefix}pagg0 AS (
  SELECT {pk},
{BOOL_COUNTERS},
{ZONE_COUNTS},
{rate('p_', K.EVENTS_COMPUTE_SUCCESS_RATE)},
{nb('p_', K.EVENTS_COMPUTE_NUMBER)}
  FROM {src} GROUP BY {pk}),
{prefix}pagg AS (SELECT * EXCLUDE ({z}), {zone_finals(slice_keys)} FROM {prefix}pagg0),
{prefix}tagg AS (
  SELECT {sk}, team_id,
{rate('t_', K.EVENTS_COMPUTE_SUCCESS_RATE)},
{nb('t_', K.EVENTS_COMPUTE_NUMBER)}
  FROM {src} GROUP BY {sk}, team_id),
{prefix}feat AS (
  SELECT p.*, {', '.join('t.' + c for c in team_cols())}
  FROM {prefix}pagg p LEFT JOIN {prefix}tagg t ON {join_on})"""


def team_cols() -> list[str]:
    cols = []
    for e in K.EVENTS_COMPUTE_SUCCESS_RATE:
        cols += [f"t_{e}_nb", f"t_{e}_success_rate"]
    cols += [f"t_{e}_nb" for e in K.EVENTS_COMPUTE_NUMBER]
    return cols


def quoted(cols) -> str:
    return ", ".join(f'"{c}"' for c in cols)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
