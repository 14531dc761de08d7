"""Hot-key experiment: the season's events re-keyed into one game (N copies), blocked vs single-window plan.

usage: python tools/hot_game.py [sf_dir] [copies]
Prints, for each plan, a few aggregates of the feature table (equal) and the time.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from pitchlens.plans import catalog as CAT
    from pitchlens.plans import features as FE
    from pitchlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 24
    spark = local_session(shuffle_partitions=16)
    me = CAT.me_(spark, sf)
    hot = (me.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
           .withColumn("seq", F.col("copy") * 1_000_000 + F.col("seq"))
           .withColumn("game", F.lit("hot")).drop("copy"))
    hot = hot.repartition(16).cache()
    print("rows", hot.count())
    for strategy in ("blocked", "direct"):
        t0 = time.time()
        agg = FE.window_features(hot, strategy=strategy).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("p_1_nb").alias("passes"),
            F.sum("nb_free_kick").alias("free_kicks"), F.sum("t_4_nb").alias("team_fouls")).first()
        print(strategy, agg.asDict(), f"{time.time() - t0:.1f}s")


if __name__ == "__main__":
    main()
