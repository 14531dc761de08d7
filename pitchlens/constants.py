"""Fixed values of the event feed and of the feature contract.

These must equal the values of the data provider's event vocabulary for the
features to mean the same thing; they are stated here once, in natural order.
"""

# ---- fixed values: event type ids ------------------------------------------
PASS = 1
FOUL = 4
CORNER_AWARDED = 6
PLAYER_OFF = 18
PLAYER_ON = 19
END_PERIOD = 30
START_PERIOD = 32
LINE_UP = 34
DELETED_EVENT = 43

# ---- fixed values: event families --------------------------------------------
GK_EVENTS = [10, 11, 41, 52, 53, 54, 58]
SHOT_EVENTS = [13, 14, 15, 16]

# ---- fixed values: qualifier ids ------------------------------------------------
QUALIFIER_ALL_PLAYERS = 30
QUALIFIER_ZONE = 56

# ---- fixed values: pitch zones (qualifier 56 values) and the missing label -----
ZONES = ["Back", "Center", "Left", "Right"]
NO_POSITION = "no_position"

# ---- fixed values: feature contract of the player-identification problem -----
EVENTS_COMPUTE_NUMBER = [3, 4, 7, 8, 10, 14, 16, 17, 18, 19, 44, 61]
EVENTS_COMPUTE_SUCCESS_RATE = [1]

# ---- fixed values: time rules ----------------------------------------------------
HALF_TIME_SEC = 45 * 60          # second half starts at 2700 s
WINDOW_MIN = 15                  # length of a sliding window, minutes
FIRST_HALF_STARTS = (0, 30)      # first and last window start (minutes), period 1
SECOND_HALF_STARTS = (45, 75)    # same for period 2
MIN_SEASON_MINUTES = 800         # eligibility threshold
LOAN_CUTOFF = "2017-01-01"       # loans arriving on/after this date are excluded
MAX_SUBSTITUTED = 12             # at most this many substituted players per game
STARTERS_PER_TEAM = 11

# ---- fixed values: next-event problem ----------------------------------------------
NEXT_EVENT_LAGS = [1, 2, 3]
NEXT_EVENT_COLS_TO_LAG = ["period_id", "type_id", "team_id", "x_along_team1_axis", "y_along_team1_axis"]

# ---- fixed values: scoring fallbacks -------------------------------------------------
FALLBACK_PLAYER = 59957
FALLBACK_NEXT_EVENT = (0, 50.0, 50.0)   # team, y, x
MAX_L2_ERROR = (100 * 100 + 100 * 100) ** 0.5


def player_features() -> list[str]:
    """The 39 features of the player-identification model, in contract order."""
    feats = ["team_id"]
    feats += ["nb_assist", "nb_keypass", "nb_gk_events", "nb_shots", "nb_free_kick", "nb_corner"]
    feats += list(ZONES)
    for prefix in ("p", "t"):
        feats += [f"{prefix}_{e}_nb" for e in EVENTS_COMPUTE_SUCCESS_RATE]
        feats += [f"{prefix}_{e}_success_rate" for e in EVENTS_COMPUTE_SUCCESS_RATE]
        feats += [f"{prefix}_{e}_nb" for e in EVENTS_COMPUTE_NUMBER]
    return feats


def next_event_features(coordinate: str = "x") -> list[str]:
    """Lag features of the next-team / next-coordinates models."""
    cols = ["type_id", "team_id", f"{coordinate}_along_team1_axis"]
    return [f"{c}_lag{n}" for n in NEXT_EVENT_LAGS for c in cols]
