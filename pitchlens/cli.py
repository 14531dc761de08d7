"""Command line: the package's batch jobs over the provider's XML feeds.

    python -m pitchlens.cli features --games 'feeds/*.xml' --registry players.xml --out DIR
    python -m pitchlens.cli train    --games 'feeds/*.xml' --registry players.xml --models DIR
    python -m pitchlens.cli score    --games test_game.xml --models DIR --out DIR
    python -m pitchlens.cli search   --games 'feeds/*.xml' --registry players.xml --problem player --out DIR
    python -m pitchlens.cli sweep    --games 'feeds/*.xml' --registry players.xml --out DIR

The session is the one the cluster provides (``spark-submit``); ``--local N``
starts a local one for a single machine.
"""

from __future__ import annotations

import argparse
import sys

from . import constants as K


def _session(local: str | None):
    from pyspark.sql import SparkSession

    from .session import ensure_checkpoint_dir, local_session

    if local:
        return local_session(cores=local)
    spark = SparkSession.builder.appName("pitchlens").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="pitchlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("features", "train", "score", "search", "sweep"):
        p = sub.add_parser(name)
        p.add_argument("--games", required=True, help="game feed XML file, directory or glob")
        p.add_argument("--local", default=None, help="run on local[N] instead of the provided cluster")
        if name != "score":
            p.add_argument("--registry", default=None, help="player registry XML")
            p.add_argument("--min-minutes", type=int, default=K.MIN_SEASON_MINUTES)
        if name == "features":
            p.add_argument("--out", required=True)
            p.add_argument("--step", type=int, default=5, help="window slide, minutes")
        if name in ("search", "sweep"):
            p.add_argument("--out", required=True, help="folder of the result table")
        if name == "search":
            p.add_argument("--problem", required=True, choices=["player", "next_team", "coords_x", "coords_y"])
            p.add_argument("--model", default=None, help="model type of the problem's grids")
            p.add_argument("--draws", type=int, default=30)
            p.add_argument("--folds", type=int, default=3)
        if name == "sweep":
            p.add_argument("--trees", type=int, nargs=3, default=(60, 151, 5), help="start, end (excluded), step")
            p.add_argument("--depths", type=int, nargs=3, default=(18, 25, 1), help="start, end (excluded), step")
        if name == "train":
            p.add_argument("--models", required=True)
            p.add_argument("--no-ica", action="store_true", help="player model without the ICA branch")
        if name == "score":
            p.add_argument("--models", required=True)
            p.add_argument("--out", required=True)
            p.add_argument("--masked-player", type=int, default=1)
    a = ap.parse_args(argv)
    spark = _session(a.local)

    from .plans.season import season_from_xml

    if a.cmd == "features":
        from .plans.features import season_next_event, window_features

        s = season_from_xml(spark, a.games, a.registry, a.min_minutes)
        window_features(s.events, s.eligible, a.step).write.mode("overwrite").parquet(f"{a.out}/window_features")
        season_next_event(s.events).write.mode("overwrite").parquet(f"{a.out}/next_event")
        s.eligible.write.mode("overwrite").parquet(f"{a.out}/eligible_players")
    elif a.cmd == "train":
        from .plans.training import train_all

        s = season_from_xml(spark, a.games, a.registry, a.min_minutes)
        tm = train_all(s.events, s.eligible, out_dir=a.models, with_ica=not a.no_ica)
        tm.metrics.show(truncate=False)
    elif a.cmd == "search":
        from .plans.training import search

        s = season_from_xml(spark, a.games, a.registry, a.min_minutes)
        _, draws = search(s.events, s.eligible, a.problem, a.model, a.draws, a.folds)
        draws.write.mode("overwrite").parquet(a.out)
    elif a.cmd == "sweep":
        from .plans.training import player_sweep

        s = season_from_xml(spark, a.games, a.registry, a.min_minutes)
        player_sweep(s.events, s.eligible, range(*a.trees), range(*a.depths)).write.mode("overwrite").parquet(a.out)
    else:
        from .plans.training import load_trained, score_games
        from .sources.store import write_predictions

        s = season_from_xml(spark, a.games, None, 0)
        tm = load_trained(spark, a.models)
        write_predictions(score_games(s.events, tm, a.masked_player), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
