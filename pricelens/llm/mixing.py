"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of ``block_chars`` characters, its documents in the order
of a hash of their doc_id.  A source of weight w (of all weights) must get its block k
(from 0) within its window: not before the release floor(k / w) and before the deadline
ceil((k + 1) / w), counted in slots of one block.  In each slot the released block with
the earliest deadline is placed, so at every moment each source is less than one block
away from its share of the exact weights, however many sources there are.  The schedule is a
fold over the blocks, computed from the sources alone (a row a source) in runs of ``RUN``
blocks, each written before the next; its cost is the number of blocks times that of the
sources not yet run out.  Everything else is arithmetic on a document's offset in its source.

Weights become whole parts of about 2**61 / (most blocks of a source), so windows are exact
integers.  Sources of weight zero follow apart, in equal turns, after the last slot of the others.

No document is dropped or repeated.  When a source has run out its slots stay empty and
the others keep their proportions.  A document is placed by the block it begins in, so
a document longer than a block uses up the following windows of its source.

Only DataFrame functions are used.  A hot source is cut into hash buckets of about
``BUCKET_ROWS`` rows: sums are taken per bucket, combined in a small table, and running sums
inside a bucket finish the offsets, so no task sees a whole source.

Cases: a null source is a source of its own, named ''; null and empty texts take no space
and follow their predecessor; equal doc_ids are ordered by the hash of their texts; a
source without a given weight gets the least share; an empty table gives an empty
mix; ``mixed`` keeps all columns, whatever their names; ``placed`` adds ``PLACE``, which its input may not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS, PERIOD, POWER = 65_536, 1000, 0.7
BUCKET_ROWS = 20_000
#: Blocks folded in one job, blocks of a source in one row of slots, and blocks whose slots (8 bytes each) are broadcast.
RUN, ROW_BLOCKS, BROADCAST_BLOCKS = 65_536, 1024, 1 << 20
#: Columns that ``placed`` adds.
PLACE = ["mix_source", "mix_chars", "mix_order", "mix_before", "mix_block", "mix_release", "mix_slot", "mix_deadline"]

# ``period`` blocks at a time: live has the next block k of each of the sources that have not run out.  The
# released block of the earliest deadline gets the slot; while none is released, slots stay empty.
_NEXT = """named_struct('d', base + ((x.k + 2) * whole + x.w - 1) div x.w, 'r', base + (x.k + 1) * whole div x.w,
                        'i', x.i, 'k', x.k + 1, 'w', x.w, 'n', x.n)"""
_FOLD = f"""
aggregate(sequence(1, {{runs}}),
  named_struct('t', t, 'live', live, 'out', cast(array() as array<array<struct<i:int,k:bigint,slot:bigint>>>)),
  (all, _) -> element_at(transform(array(
    aggregate(sequence(1, {{period}}),
      named_struct('t', all.t, 'live', all.live, 'out', cast(array() as array<struct<i:int,k:bigint,slot:bigint>>)),
      (s, _) -> if(size(s.live) = 0, s, element_at(transform(transform(
          array(greatest(s.t, array_min(transform(s.live, x -> x.r)))),
          t -> named_struct('t', t, 'p', array_min(filter(s.live, x -> x.r <= t)))),
        y -> named_struct('t', y.t + 1,
          'live', filter(transform(s.live, x -> if(x.i = y.p.i, {_NEXT}, x)), x -> x.k < x.n),
          'out', concat(s.out, array(named_struct('i', y.p.i, 'k', y.p.k, 'slot', y.t))))), 1)))),
    z -> named_struct('t', z.t, 'live', z.live, 'out', concat(all.out, array(z.out)))), 1))
"""

def block_slots(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """Slots of all blocks of ``sources`` (mix_source, weight, blocks), ``ROW_BLOCKS`` blocks of a source a row:
    mix_source, mix_row, mix_slots, and its windows' mix_base, mix_whole and mix_part.

    Block k's window is from mix_base + floor(k * mix_whole / mix_part) to before
    mix_base + ceil((k + 1) * mix_whole / mix_part)."""
    spark = sources.sparkSession
    known = common.written(sources.select("mix_source", F.col("blocks").cast("long").alias("blocks"), F.when(
        (F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight").cast("double")).otherwise(0.0).alias("weight")), "mix-sources")
    found, base = [], 0
    for apart in (False, True):  # those of weight zero after the others
        group = known.where("weight = 0" if apart else "weight > 0")
        total, most = group.agg(F.sum("weight"), F.max("blocks")).first()
        if most is None:
            continue
        scale = 1 << (61 - int(most + 1).bit_length())
        part = F.lit(1.0) if apart else F.greatest(F.lit(1.0), F.round(F.col("weight") / F.lit(total) * F.lit(float(scale))))
        state = group.agg(F.sort_array(F.collect_list(F.struct("mix_source", part.cast("long").alias("w"), "blocks"))).alias("all"))
        state = state.selectExpr("all", "aggregate(all, 0L, (a, x) -> a + x.w) as whole", f"{base}L as base", f"{base}L as t")
        state = state.selectExpr("*", """transform(all, (x, i) -> named_struct('d', base + (whole + x.w - 1) div x.w, 'r', base,
            'i', i, 'k', 0L, 'w', x.w, 'n', x.blocks)) as live""")
        left = 1
        while left:
            runs = max(1, RUN // period)
            state = state.selectExpr("all", "whole", "base", _FOLD.format(runs=runs, period=period) + " as s")
            state = common.written(state.selectExpr("all", "whole", "base", "s.t as t", "s.live as live", "s.out as out"), "mix-slots")
            found.append(state.selectExpr("all", "whole", "base", "explode(flatten(out)) as o").selectExpr(
                "all[o.i] as of", "whole", "base", "o.k as k", "o.slot as slot"))
            base, left = state.selectExpr("t", "size(live)").first()
            state = state.drop("out")
    if not found:
        return spark.createDataFrame([], "mix_source string, mix_base long, mix_whole long, mix_part long, mix_row long, mix_slots array<long>")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows.groupBy(F.col("of.mix_source").alias("mix_source"), F.col("base").alias("mix_base"), F.col("whole").alias("mix_whole"),
                        F.col("of.w").alias("mix_part"), F.expr(f"k div {ROW_BLOCKS}").alias("mix_row")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"]).alias("mix_slots"))


def placed(documents: DataFrame, weights: dict[str, float] | None = None, power: float = POWER,
           block_chars: int = BLOCK_CHARS, period: int = PERIOD, salt: str = "") -> DataFrame:
    """``documents`` with the columns ``PLACE``; sort by mix_slot, mix_before, mix_order for the mix.

    ``weights``: target weight by source; without it a source weighs its characters to the
    ``power`` (1 keeps natural shares, 0 makes all sources equal).  ``period``: blocks folded
    into one array of slots; the mix doesn't depend on it."""
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt))
    docs = documents.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "mix_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"),
        "mix_order": F.concat(F.md5(ident), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))})
    rows = documents.select("doc_id").count()
    bits = min(16, max(0, (rows // BUCKET_ROWS).bit_length()))
    docs = docs.withColumn("_bucket", F.shiftright(F.conv(F.substring("mix_order", 1, 4), 16, 10).cast("int"), 16 - bits))
    # the sums need neither the text nor a shuffle of it
    sums = docs.groupBy("mix_source", "_bucket").agg(F.sum("mix_chars").alias("_chars"))
    of = sums.groupBy("mix_source").agg(F.sum("_chars").alias("_chars"))
    if weights is None:
        weight = F.pow(F.col("_chars").cast("double"), F.lit(float(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
        weight = F.coalesce(given[F.col("mix_source")], F.lit(0.0)) if weights else F.lit(0.0)
    blocks = F.expr(f"_chars div {block_chars} + 1")  # the last may be that of empty texts at the end
    of = of.select("mix_source", weight.alias("weight"), blocks.alias("blocks"))
    plan = common.written(block_slots(of, period), "mix-plan")
    if plan.agg(F.coalesce(F.sum(F.size("mix_slots")), F.lit(0))).first()[0] <= BROADCAST_BLOCKS:
        plan = F.broadcast(plan)
    below = common.sums_before(sums, "_bucket", "_chars", ["mix_source"]).select(
        "mix_source", "_bucket", F.col("before").alias("_below"))
    run = Window.partitionBy("mix_source", "_bucket").orderBy("mix_order").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(below, ["mix_source", "_bucket"]).withColumn(
        "mix_before", F.col("_below") + F.coalesce(F.sum("mix_chars").over(run), F.lit(0)))
    docs = docs.drop("_below", "_bucket").withColumn("mix_block", F.floor(F.col("mix_before") / block_chars).cast("long"))
    docs = docs.withColumn("mix_row", F.expr(f"mix_block div {ROW_BLOCKS}")).join(plan, ["mix_source", "mix_row"])
    docs = docs.withColumns({
        "mix_release": F.expr("mix_base + mix_block * mix_whole div mix_part"),
        "mix_slot": F.get("mix_slots", F.expr(f"cast(mix_block % {ROW_BLOCKS} as int)")),
        "mix_deadline": F.expr("mix_base + ((mix_block + 1) * mix_whole + mix_part - 1) div mix_part")})
    return docs.select(*documents.columns, *PLACE)


def positions(placed_docs: DataFrame, group_slots: int = 64) -> DataFrame:
    """``placed`` rows with ``mix_position``, their place in the mix from 0, by sums over groups of slots."""
    docs = placed_docs.withColumn("_group", F.floor(F.col("mix_slot") / group_slots))
    before = common.sums_before(docs.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")), "_group", "_n")
    order = Window.partitionBy("_group").orderBy("mix_slot", "mix_before", "mix_order")
    docs = docs.join(before.select("_group", "before"), "_group")
    return docs.withColumn("mix_position", F.col("before") + F.row_number().over(order) - 1).drop("_group", "before")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``documents``, sorted in the order of the mix: written as files,
    file after file and row after row is the mix."""
    # the row's columns travel in one struct, so none can clash with an operator's own
    row = F.struct(*[documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("_row")
    rows = placed(documents.select("doc_id", "source", "text", row), **options).orderBy("mix_slot", "mix_before", "mix_order")
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(documents.columns)])
