"""Operator 3: mixing sources to target weights by entropy balancing. DataFrame functions only.

Each document gets a rate, its expected number of copies, as near as possible in entropy to one
copy each while every source's tokens meet its target and no rate exceeds ``MOST``. The convex dual
has one multiplier for each source, and the rates are exponentially tilted by the document's tokens:
``rate = min(MOST, exp(multiplier * size / mean size of the source))``. Newton steps, kept inside a
bracket, solve the dual. Documents of a source and a size share a rate, so each step is one partial
aggregation over (source, size, documents), a hot source included, and one join with one row for
each source; the multipliers live in a table, not in the driver.

Rates become copies by one threshold for each source: a document has a number v = u - fraction of
its rate, with u in [0, 1) hashed from its id, and is rounded up where v lies below the threshold.
The thresholds that meet the targets are found by counting tokens in ``CELLS`` cells of v for each
source, then in as many cells of the cell that holds the target, so the sum misses its target by
about half of one document. Rates depend on sizes and ids only, so reruns agree.

Defined results: a null text has size 0 and takes nothing; a null source is a source, ordered last;
rows that repeat an id and a size are rounded alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import WORD, stage, table
from tremor.llm.registry import query

WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens of the mix in units of all tokens, and copies of one document at most.
SHARE, MOST = 1.5, 2.0
CELLS = 4096
STEPS = 60
#: Relative miss of a target at which the Newton steps end.
NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Weights repeat over the sources by code point, null last. The target is the smaller of the
    bound and a level times the weight; the level follows from running sums over the sources by
    bound / weight, so these two windows see one row for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.lit(len(weights))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, n) + 1).cast("int")))
    weighed = weighed.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = weighed.withColumn("level", level).withColumn("open", F.col("bound") / F.col("weight") > F.col("level"))
    # all sources from the first open one on share that one's level
    first = F.min(F.when(F.col("open"), F.struct((F.col("bound") / F.col("weight")).alias("k"), "source", "level"))).over(every)["level"]
    return filled.withColumn("shared", first).select("source", "source_size", F.when(F.col("open"), F.least("bound", F.col("weight") * F.col("shared"))).otherwise(F.col("bound")).alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(700.0))))


def multipliers(sizes: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """(source, lam) that meet the targets; ``sizes`` is (source, size, n) with size > 0.

    A target at the bound needs every rate at the bound: lam is null there and stands for it.
    """
    state = wanted.where("source_size > 0").join(sizes.groupBy("source").agg(F.sum("n").alias("docs")), wanted.source.eqNullSafe(sizes.source)).select(wanted.source, "target", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"))
    state = state.where(F.col("target") < F.lit(most * (1 - NEAR)) * F.col("source_size"))
    state = stage(state.select("source", "target", "mean", F.log(F.col("target") / F.col("source_size")).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("met")), "mix-lam")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        rows = sizes.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
        sums = rows.groupBy("source", "target", "mean", "lam", "low", "high").agg(
            (F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(most)), tilt)) - F.first("target")).alias("miss"),
            F.sum(F.when(tilt < most, F.col("n") * F.col("size") * x * tilt)).alias("slope"),
        )
        low = F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("miss") > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("miss") / F.col("slope"))
        inside = step.isNotNull() & F.coalesce(step > low, F.lit(True)) & F.coalesce(step < high, F.lit(True))
        half = F.coalesce((low + high) / 2, F.col("lam") - F.signum("miss") * (F.abs("lam") + 1))
        done = F.abs("miss") <= F.col("target") * NEAR
        state = stage(sums.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise(half).alias("lam"), low.alias("low"), high.alias("high"), done.alias("met")), "mix-lam")
        if not state.where(~F.col("met")).take(1):
            break
    return state.select("source", "mean", "lam")


def _cell(v: Column, low: Column, width: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((v - low) / F.lit(width)))).cast("int")


def _crossing(rows: DataFrame, low: Column, width: float) -> DataFrame:
    """Of each source (kept columns source, low, need): the first cell of v whose tokens pass the need.

    Adds the need that is left inside the cell; the window sees CELLS rows for each source at most.
    """
    cells = rows.groupBy("source", "low", "need", _cell(F.col("v"), low, width).alias("cell")).agg(F.sum("size").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = cells.withColumn("before", before).where(F.col("before") <= F.col("need"))
    return found.groupBy("source").agg(F.max(F.struct("cell", "low", "need", "before")).alias("c")).select("source", (F.col("c.low") + F.col("c.cell") * F.lit(width)).alias("low"), (F.col("c.need") - F.col("c.before")).alias("need"))


def copies(sized: DataFrame, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, n_copies) of a table (doc_id, source, size) that can be read more than once."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = stage(targets(sums), "mix-targets")
    sizes = stage(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    lams = multipliers(sizes, wanted, most).withColumnRenamed("source", "of")
    plan = wanted.join(lams, wanted.source.eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "mean", "lam")
    rated = sized.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source")))
    rate = F.when(F.col("target") >= F.lit(most * (1 - NEAR)) * F.col("source_size"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), most))
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0))).withColumn("whole", F.floor("rate"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "size"), 11) / F.lit(float(1 << 53))
    rated = rated.withColumn("v", F.when(F.col("rate") > F.col("whole"), u - (F.col("rate") - F.col("whole"))))
    rated = stage(rated.select("doc_id", "source", "size", "source_size", "target", "whole", "v"), "mix-rated")
    # tokens still to be rounded up in each source, and the threshold of v that takes them
    need = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"), F.lit(-1.0).alias("low")).withColumnRenamed("source", "of")
    open_ = rated.where("v is not null").select("source", "size", "v")
    width = 2.0 / CELLS
    cut = need
    for _ in range(3):
        inside = open_.join(cut, F.col("source").eqNullSafe(F.col("of"))).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.lit(width * CELLS)))
        cut = _crossing(inside, F.col("low"), width).withColumnRenamed("source", "of")
        cut = stage(cut, "mix-cut")
        width /= CELLS
    # inside the last cell, usually one document, the rounding that lies nearer is taken
    width *= CELLS
    last = open_.join(cut, F.col("source").eqNullSafe(F.col("of"))).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.lit(width)))
    up = last.groupBy("of", "low", "need").agg(F.sum("size").alias("tokens")).select("of", F.when(F.col("tokens") < 2 * F.col("need"), F.col("low") + F.lit(width)).otherwise(F.col("low")).alias("cut"))
    done = rated.join(up, F.col("source").eqNullSafe(F.col("of")), "left")
    more = F.when(F.col("v") < F.col("cut"), 1).otherwise(0)
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + more).cast("long").alias("n_copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, n_copies) of each row."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return copies(stage(sized, "mix-sized"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows of one source, id and size are taken alike."""
    size = n_words(F.col("text"))
    taken = mix(docs).where("n_copies > 0").select("doc_id", "source", "size", "n_copies").distinct().alias("taken")
    # columns of the input are addressed through one struct, so any of their names may clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), size.alias("size")).alias("rows")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"taken.{c}")) for c in ("doc_id", "source", "size")]
    copies = F.explode(F.sequence(F.lit(1), F.col("taken.n_copies").cast("int"))).alias("copy")
    return rows.join(taken, same).select("rows.row", copies).select("row.*")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))
