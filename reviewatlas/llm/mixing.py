"""Mixing sources to target weights by Pfair scheduling.

A source with weight w owns its k-th block from slot floor((k - 1) / w), its release, to slot
ceil(k / w), its deadline. One block runs per slot; among the released blocks the one with the
earliest deadline goes first. Integer shares that sum to H make the schedule repeat after H slots, so one
period is scheduled and laid out again and again: while every source lasts, each prefix of the slots holds
every source's target to within less than one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The period aims at so many slots; weights are rounded to shares of it.
RESOLUTION = 1000
#: Documents in a block.
BLOCK = 8
#: Cells of the hash order in which ranks are counted: a power of two.
CELLS = 1024

#: A fold over the slots of a period. State: blocks done per source, and the source picked in each slot. The released
#: blocks are those with floor(done / w) <= t; the least (deadline, place) runs.
_FOLD = """
aggregate(
  sequence(0L, h - 1),
  named_struct('done', transform(s, x -> 0L), 'picks', array_repeat(-1, 0)),
  (st, t) -> transform(
    array(array_min(filter(
      transform(s, (x, j) -> named_struct('deadline', ceil((st.done[j] + 1) * h / x.share), 'j', j, 'release', floor(st.done[j] * h / x.share))),
      b -> b.release <= t)).j),
    p -> named_struct('done', transform(st.done, (d, j) -> if(j = p, d + 1, d)), 'picks', concat(st.picks, array(p))))[0],
  st -> st.picks)
"""


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with _name, the source as a text that is never null."""
    return docs.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))


def shares(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, resolution: int = RESOLUTION) -> DataFrame:
    """(_name, n_docs, share): rows of each source and its integer share, 1 at least.

    ``targets`` gives weights by source; sources that it leaves out get the smallest of them. Without it, a weight is
    the source's size to the power ``temperature``.
    """
    sizes = _named(docs).groupBy("_name").agg(F.count("*").alias("n_docs"))
    if targets:
        known = F.create_map(*(F.lit(x) for name, w in targets.items() for x in ("=" + name, float(w))))
        weight = F.coalesce(F.try_element_at(known, F.col("_name")), F.lit(float(min(targets.values()))))
    else:
        weight = F.pow("n_docs", F.lit(temperature))
    weighed = sizes.withColumn("_w", weight.cast("double"))
    whole = F.sum("_w").over(Window.partitionBy())  # one row a source
    return weighed.select("_name", "n_docs", F.greatest(F.lit(1), F.round(resolution * F.col("_w") / whole)).cast("long").alias("share"))


def schedule(sources: DataFrame) -> DataFrame:
    """(_name, n_docs, share, period, slots): the slots of each source in one period, from a row per source (``shares``).

    Equal deadlines go by name, a null source first. The fold works on one row a source, never on documents.
    """
    one = sources.agg(F.sort_array(F.collect_list(F.struct("_name", "share", "n_docs"))).alias("s"), F.sum("share").alias("h")).where("h > 0")
    picked = one.select("s", "h", F.posexplode(F.expr(_FOLD)).alias("slot", "j"))
    own = F.get("s", F.col("j"))
    flat = picked.select(own["_name"].alias("_name"), own["n_docs"].alias("n_docs"), own["share"].alias("share"), F.col("h").alias("period"), F.col("slot").cast("long").alias("slot"))
    return flat.groupBy("_name", "n_docs", "share", "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


#: Slot of block b (from 1): whole periods before it, and its place in the period.
_SLOT = "((({b} - 1) div share) * period + slots[cast(({b} - 1) % share as int)])"


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, resolution: int = RESOLUTION, block: int = BLOCK) -> DataFrame:
    """``docs`` with mix_block, mix_slot, mix_place (long) and mix_on_target (boolean); sort by (mix_slot, mix_place) to read the mix.

    Inside a source, documents go in the order of a hash of id and text. All rows stay: up to the first slot that a
    source cannot fill, the mix is on target (mix_on_target); after it the others go on in the same relative order. A null source is a
    source of its own, null ids and texts take part, equal rows get consecutive places, an empty table gives none. Columns of these names are replaced.

    Ranks are counted inside cells of the hash order and lifted by the sizes of the cells before, so no task holds more
    than a cell of a source.
    """
    order = F.xxhash64("doc_id", "text")
    cell = F.shiftrightunsigned(order, 64 - (CELLS.bit_length() - 1)).cast("int")
    placed = _named(docs).withColumns({"_order": order, "_cell": cell})
    sizes = placed.groupBy("_name", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_name", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    plan = schedule(shares(docs, targets, temperature, resolution))
    blocks = F.expr(f"(n_docs + {block} - 1) div {block} + 1")
    empty_at = F.expr(_SLOT.format(b="_next"))
    plan = plan.withColumn("_next", blocks).withColumn("_cut", F.min(empty_at).over(Window.partitionBy()))
    lookup = starts.join(plan, "_name").select("_name", "_cell", "_before", "share", "period", "slots", "_cut")
    inside = Window.partitionBy("_name", "_cell").orderBy("_order", "doc_id")
    numbered = placed.drop("mix_block", "mix_slot", "mix_place", "mix_on_target").withColumn("_in", F.row_number().over(inside))
    extra = [c for c in ("share", "period", "slots") if c in docs.columns]
    numbered = numbered.withColumnsRenamed({c: f"_own_{c}" for c in extra})
    joined = numbered.join(lookup, ["_name", "_cell"]).withColumn("_rank", F.col("_in") + F.col("_before") - 1)
    out = joined.withColumn("mix_block", F.expr(f"_rank div {block} + 1")).withColumn("mix_place", F.expr(f"_rank % {block}"))
    out = out.withColumn("mix_slot", F.expr(_SLOT.format(b="mix_block")))
    out = out.withColumn("mix_on_target", F.col("mix_slot") < F.col("_cut"))
    out = out.drop("_name", "_cell", "_order", "_in", "_rank", "_before", "_cut", "share", "period", "slots")
    out = out.withColumnsRenamed({f"_own_{c}": c for c in extra})
    return out.select(*[c for c in docs.columns if not c.startswith("mix_")], "mix_block", "mix_slot", "mix_place", "mix_on_target")
