"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are put in hash order and cut into blocks. With integer weight w of W in all, block j of a
source may not start before its release floor(j * W / w) and is due by ceil((j + 1) * W / w). One
earliest-deadline-first pass over all slots of the mix deals them, its state carried from one stretch of slots to
the next, so at every slot each source is less than one block away from its target, however long the mix is.
When a source runs out its slots are skipped: the others go on in proportion, and no row is dropped or
repeated. Sources of weight 0 come after all others.

The pass is one fold, slots x sources steps long. Blocks grow with the input so that it has ``STEPS`` steps and
``MOST_SLOTS`` slots at most (two slots per source at least): a block stays under a millionth of a large corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitchlens.llm._common import cut, fresh

#: Rows of one numbering window that the number of hash chunks aims at.
CHUNK_ROWS = 50_000
RUN = 10_000
MOST_SLOTS = 1 << 20
STEPS = 1 << 24
STRETCH = 1000         # slots whose picks the fold keeps in one array
WEIGHT_BITS = 30       # given weights are integers of so many bits, relative to the largest


def _name(source: Column) -> Column:
    """Sources by name; NULL is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def shares(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source") -> DataFrame:
    """s (source key), n (rows), w (integer weight), i (number by name). One row per source.

    ``weights`` gives relative targets (sources without one: 0); without it the target is the square root
    of a source's rows, which lifts small sources.
    """
    n = docs.groupBy(_name(F.col(source_col)).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = n.withColumn("w", F.floor(F.sqrt(F.col("n").cast("double")) * 1000))
    else:
        if any(v < 0 or not math.isfinite(v) for v in weights.values()):
            raise ValueError("weights must be finite and at least 0")
        top = max(weights.values(), default=0) or 1
        given = docs.sparkSession.createDataFrame(
            [("-" if k is None else "+" + k, round(v / top * (1 << WEIGHT_BITS))) for k, v in weights.items()], "s string, w long")
        w = n.join(F.broadcast(given), "s", "left").na.fill(0, ["w"])
    return w.select("s", "n", F.col("w").cast("long").alias("w"), (F.row_number().over(W.partitionBy().orderBy("s")) - 1).alias("i"))


#: Slots until the last block of every source with a weight: the largest ceil(blocks * W / w).
_SLOTS = "max(((n + {b} - 1) div {b} * t + w - 1) div w)"


def block_size(share: DataFrame, block_rows: int) -> tuple[int, int]:
    """(rows of a block, slots of the mix). Blocks are the smallest multiple of ``block_rows`` within the bounds
    that doubling finds."""
    weighted = share.where("w > 0").withColumn("t", F.sum("w").over(W.partitionBy()))
    m = weighted.count()
    if not m:
        return block_rows, 0
    limit = max(2 * m, min(MOST_SLOTS, STEPS // m))
    sizes = [block_rows << k for k in range(40)]
    slots = weighted.agg(*[F.expr(_SLOTS.format(b=b)).alias(str(b)) for b in sizes]).first()
    for b, n in zip(sizes, slots):
        if n <= limit:
            return b, n
    return sizes[-1], slots[-1]


def schedule(share: DataFrame, slots: int) -> DataFrame:
    """i (source), w, t (sum of the weights), idx (block of the source), slot; ``slots`` rows at most."""
    one = share.where("w > 0").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("src"), F.sum("w").alias("t"))
    pick = """array_min(transform(filter(sequence(0, size(src) - 1), k -> (y.done[k] * t) div src[k].w <= slot),
                 k -> struct(((y.done[k] + 1) * t + src[k].w - 1) div src[k].w AS due, k AS k))).k"""
    stretch = f"""aggregate(sequence(c * {STRETCH}L, least((c + 1) * {STRETCH}L, {slots}L) - 1),
        struct(z.done AS done, cast(array() AS array<int>) AS picks),
        (y, slot) -> aggregate(array({pick}), y, (x, p) ->
            struct(transform(x.done, (d, k) -> if(k = p, d + 1, d)) AS done, concat(x.picks, array(p)) AS picks)))"""
    order = f"""aggregate(sequence(0L, {max(0, slots - 1) // STRETCH}L),
        struct(transform(src, x -> 0L) AS done, cast(array() AS array<array<int>>) AS all),
        (z, c) -> aggregate(array({stretch}), z, (x, y) -> struct(y.done AS done, concat(x.all, array(y.picks)) AS all)),
        z -> z.all)"""
    picked = (one.select("src", "t", F.expr(order).alias("all")).select("src", "t", F.posexplode("all").alias("c", "picks"))
              .select("src", "t", "c", F.posexplode("picks").alias("k", "p")))
    dealt = picked.select(F.expr("src[p].i").alias("i"), F.expr("src[p].w").alias("w"), "t",
                          (F.col("c").cast("long") * STRETCH + F.col("k")).alias("slot"))
    return dealt.withColumn("idx", F.row_number().over(W.partitionBy("i").orderBy("slot")).cast("long") - 1)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 64, seed: int = 0,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, block, release, due, slot, position.

    Within a source rows come in the order of md5(seed, id), ties by id. ``slot`` is the block's place in
    the schedule, ``position`` the row's place in the mix (from 0, without gaps). NULL ids and NULL
    sources are values like any other; repeated rows each get a position; rows of one id (or without) in one
    source are counted where they are read and dealt out in runs, so a third of all rows may share one.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       _name(F.col(source_col)).alias("s"), key.alias("key"))
    share = cut(shares(docs, weights, source_col))
    block_rows, slots = block_size(share, block_rows)
    most = share.agg(F.max("n")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(1, most / CHUNK_ROWS), 16)) + 1)
    # Rows that share an id differ in nothing but their count: one row for all of them until they have numbers.
    rows = rows.groupBy("doc_id", "source", "s", "key").agg(F.count(F.lit(1)).alias("times")).withColumn("chunk", F.substring("key", 1, digits))
    # Numbers within a source: within each hash chunk, plus the rows of the chunks before it.
    sizes = rows.groupBy("s", "chunk").agg(F.sum("times").alias("size"))
    before = sizes.select("s", "chunk", F.coalesce(
        F.sum("size").over(W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    past = lambda w: F.coalesce(F.sum("times").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = past(W.partitionBy("s", "chunk").orderBy("key", "doc_id"))
    # Equal rows come out in runs of RUN, dealt to all tasks before they are rows again.
    runs = (rows.withColumn("first", first).join(before, ["s", "chunk"])
            .select("doc_id", "source", "s", "times", (F.col("before") + F.col("first")).alias("first"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {RUN}"))).alias("run"))
            .select("doc_id", "source", "s", (F.col("first") + F.col("run") * RUN).alias("from"),
                    F.least(F.col("times") - F.col("run") * RUN, F.lit(RUN)).alias("size")).repartition("s", "from"))
    numbered = runs.select("doc_id", "source", "s", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("size") - 1)).alias("n"))
    # The schedule has MOST_SLOTS rows at most (or two per source); sources are numbers in it.
    plan = schedule(share, slots).select("i", "idx", "slot") if slots else None
    zero = share.where("w = 0").withColumn("blocks", F.expr(f"(n + {block_rows} - 1) div {block_rows}"))
    behind = zero.select("i", (F.lit(slots) + F.coalesce(F.sum("blocks").over(
        W.partitionBy().orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("behind"))
    total = share.agg(F.sum("w")).first()[0] or 0
    known = share.join(behind, "i", "left").select("s", "i", "w", "behind")
    placed = (numbered.select("doc_id", "source", "s", F.expr(f"n div {block_rows}").alias("block"), (F.col("n") % block_rows).alias("at"))
              .join(F.broadcast(known), "s"))
    if plan is not None:
        placed = placed.join(F.broadcast(plan.withColumnRenamed("idx", "block")), ["i", "block"], "left")
    else:
        placed = placed.withColumn("slot", F.lit(None).cast("long"))
    placed = cut(placed.withColumn("slot", F.coalesce("slot", F.col("behind") + F.col("block")))
                 .withColumn("round", F.expr(f"slot div {STRETCH}")).select("doc_id", "source", "block", "at", "round", "slot", "w"))
    blocks = placed.groupBy("round", "slot").agg(F.count(F.lit(1)).alias("times"))
    rounds = blocks.groupBy("round").agg(F.sum("times").alias("times"))
    start = (blocks.withColumn("inside", past(W.partitionBy("round").orderBy("slot")))
             .join(rounds.select("round", past(W.partitionBy().orderBy("round")).alias("outside")), "round")
             .select("round", "slot", (F.col("inside") + F.col("outside")).alias("start")))
    return placed.join(start, ["round", "slot"]).select(
        "doc_id", "source", "block", F.expr(f"if(w > 0, (block * {total}L) div w, slot)").alias("release"),
        F.expr(f"if(w > 0, ((block + 1) * {total}L + w - 1) div w, slot + 1)").alias("due"), "slot",
        (F.col("start") + F.col("at")).alias("position"))


def ordered_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 64, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of docs in mix order (partitions and the rows inside them follow the positions).

    Rows that share id and source are placed together, at the first of their positions.
    """
    i, s, p = fresh(docs, "mix_id", "mix_source", "mix_position")
    at = (mix(docs, weights, block_rows, seed, id_col, source_col)
          .groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).agg(F.min("position").alias(p)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(at, docs[id_col].eqNullSafe(F.col(i)) & docs[source_col].eqNullSafe(F.col(s)))
    return joined.repartitionByRange(p).sortWithinPartitions(p).select(*names)


def reread_positions(rows: DataFrame, name: str) -> DataFrame:
    """Rows read from the files that ``ordered_rows`` were written to, with their place in the mix (from 0).

    A reader takes files by size and not by name, but a row's file and its place there tell the order in which
    it was written: the files are numbered by their partition, and each starts where those before it end.
    """
    file, at, start = fresh(rows, "mix_file", "mix_at", "mix_start")
    meta = rows.metadataColumn("_metadata")
    numbered = rows.select("*", meta.getField("file_name").alias(file), meta.getField("row_index").alias(at))
    sizes = numbered.groupBy(file).agg(F.count(F.lit(1)).alias("size"))
    part = F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")
    past = F.sum("size").over(W.partitionBy().orderBy(part, file).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(file, F.coalesce(past, F.lit(0)).alias(start))
    return numbered.join(F.broadcast(starts), file).select(*[F.col(f"`{c}`") for c in rows.columns],
                                                           (F.col(start) + F.col(at)).alias(name))


def sql(block_rows: int = 64, seed: int = 0) -> str:
    """DuckDB twin of ``mix`` with square-root targets (the fold is a recursive query over the slots)."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
counts AS (SELECT s, count(*) AS n, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM rows GROUP BY s),
share AS (SELECT s, n, w, sum(w) OVER ()::BIGINT AS t, count(*) OVER () AS m FROM counts),
sizes AS (SELECT {block_rows} * (1::BIGINT << unnest(range(30))) AS b),
size AS MATERIALIZED (SELECT min(b) AS b, min_by(slots, b) AS slots FROM (
  SELECT b, max((((n + b - 1) // b) * t + w - 1) // w) AS slots, max(m) AS m FROM share, sizes GROUP BY b)
  WHERE slots <= greatest(2 * m, least({MOST_SLOTS}, {STEPS} // m))),
src AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS w, max(t) AS t FROM share),
fold AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS p, list_transform(w, lambda x: 0::BIGINT) AS done, w, t FROM src
  UNION ALL
  SELECT slot, p, list_transform(done, lambda d, k: CASE WHEN k = p THEN d + 1 ELSE d END), w, t
  FROM (SELECT slot + 1 AS slot, done, w, t,
               list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: (done[i] * t) // w[i] <= slot + 1),
                                       lambda i: [((done[i] + 1) * t + w[i] - 1) // w[i], i]))[2] AS p
        FROM fold WHERE slot + 1 < (SELECT slots FROM size))),
slots AS (SELECT src.names[p] AS s, slot, row_number() OVER (PARTITION BY p ORDER BY slot) - 1 AS block
          FROM fold, src WHERE slot >= 0),
numbered AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY key, doc_id) - 1 AS num FROM rows),
placed AS (
  SELECT doc_id, source, num // size.b AS block, num % size.b AS place, share.w, share.t, slots.slot
  FROM numbered JOIN share USING (s), size, slots WHERE slots.s = numbered.s AND slots.block = numbered.num // size.b)
SELECT doc_id, source, block, (block * t) // w AS release, ((block + 1) * t + w - 1) // w AS due, slot,
       row_number() OVER (ORDER BY slot, place) - 1 AS position
FROM placed
"""
