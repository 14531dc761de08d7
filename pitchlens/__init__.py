"""pitchlens: match-event analytics on Spark.

Entry points (all ``DataFrame -> DataFrame`` and lazy unless noted):

* sources: ``sources.xml.read_game_events`` / ``read_players`` (feeds),
  ``sources.fixture.match_events`` (test-data projection), ``sources.store.land`` /
  ``materialize`` (write-once tables in the shared checkpoint folder);
* features: ``plans.features.window_features`` (per game, 15-minute window and
  player), ``test_set_stats``, ``season_next_event``;
* eligibility: ``operators.playtime.play_time`` -> ``eligible_players``;
* models: ``plans.training.train_all`` and ``score_games`` (Spark ML);
* streaming: ``streaming.live.live_next_event_features``.

The registered queries and their SQL twins are in ``plans.catalog``.
"""

__version__ = "0.1.0"
