import pytest
import os
import time

from pitchlens.operators.clean import next_event_input
from pitchlens.operators.windows import next_event_dataset
from pitchlens.streaming.live import run_file_stream


def test_state_carries_lags_across_micro_batches(events, spark, tmp_path):
    rows = [{"period_id": 1, "game_time_in_sec": 10 * i, "team_id": i % 2, "type_id": 1 + (i % 3), "x": float(i)}
            for i in range(8)]
    rows += [{"period_id": 2, "game_time_in_sec": 2700 + i, "team_id": 1, "x": 1.0 * i} for i in range(5)]
    rows += [{"period_id": 2, "game_time_in_sec": 2800, "type_id": 30, "player_id": None}]
    ev = events(rows)
    src = tmp_path / "src"
    # two files, written one after the other: the second micro-batch continues the first one's game
    ev.where("seq < 6").coalesce(1).write.parquet(str(src / "a"))
    time.sleep(1.1)
    ev.where("seq >= 6").coalesce(1).write.parquet(str(src / "b"))
    os.makedirs(src / "all")
    for sub in ("a", "b"):
        for f in sorted(os.listdir(src / sub)):
            if f.endswith(".parquet"):
                os.link(src / sub / f, src / "all" / f"{sub}-{f}")
                time.sleep(1.1)
    got = run_file_stream(spark, str(src / "all"), ev.schema, str(tmp_path / "sink"), str(tmp_path / "ckpt"),
                          max_files_per_trigger=1)
    want = next_event_dataset(next_event_input(ev))
    cols = sorted(want.columns)
    key = lambda r: r["seq"]
    assert sorted([r.asDict() for r in got.select(*cols).collect()], key=key) == \
        sorted([r.asDict() for r in want.select(*cols).collect()], key=key)
    assert got.count() == (8 - 3) + (5 - 3)


def test_replay_with_table_state_across_batches(events, spark, tmp_path):
    from pitchlens.streaming.replay import run_replay

    rows = [{"period_id": 1, "game_time_in_sec": 10 * i, "team_id": i % 2, "type_id": 1 + (i % 3), "x": float(i)}
            for i in range(8)]
    rows += [{"game": "h", "period_id": 1, "game_time_in_sec": i, "team_id": 1, "x": 2.0 * i} for i in range(6)]
    rows += [{"period_id": 2, "game_time_in_sec": 2700 + i, "team_id": 1, "x": 1.0 * i} for i in range(5)]
    rows += [{"period_id": 2, "game_time_in_sec": 2800, "type_id": 30, "player_id": None}]
    ev = events(rows)
    src = tmp_path / "src"
    for lo, hi in ((0, 6), (6, 11), (11, 30)):
        ev.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    got = run_replay(spark, str(src), ev.schema, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                     max_files_per_trigger=1)
    want = next_event_dataset(next_event_input(ev))
    cols = sorted(want.columns)
    key = lambda r: r["seq"]
    assert sorted([r.asDict() for r in got.select(*cols).collect()], key=key) == \
        sorted([r.asDict() for r in want.select(*cols).collect()], key=key)
    # the final whistle closed game "g": only game "h" keeps a tail
    last = sorted(p.name for p in (tmp_path / "out" / "state").iterdir() if p.name.startswith("batch="))[-1]
    tails = spark.read.parquet(str(tmp_path / "out" / "state" / last))
    assert {r.game for r in tails.collect()} == {"h"}


def test_events_out_of_order_stop_the_replay(spark, events, tmp_path):
    from pitchlens.streaming.replay import process_batch

    me = events([{"seq": s} for s in (10, 11, 12, 13)])
    late = events([{"seq": s} for s in (5, 6)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    process_batch(spark, me, 0, out, state)
    with pytest.raises(ValueError, match="out of order"):
        process_batch(spark, late, 1, out, state)
