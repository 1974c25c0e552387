"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, by weight, but at most ``cap`` times its own words; what exceeds the cap is
shared again by weight (water filling, solved in closed form over the sources ordered by cap / weight). With
e = target / source words, each document of a source is taken floor(e) times for certain and perhaps once more.

The extra copies are a Pareto order sample of unequal probabilities. With f = e - floor(e), a document's inclusion probability is
p = f * (1 + LEAN * (1 - f) * (H - h)), where h = size / (size + KNEE) grows with its length and H is the mean of h over the source's words: a longer
document is less likely, p stays between 0 and 1, and the expected words, the sum of p * size, are f times the source's whatever
the sizes are. Documents are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p). The sample's size is fixed in
words: in rank order, every document that still fits into the words left to the target is taken, and one that doesn't is passed over, until
the gap is at most NEAR of the target or nothing fits; then the first passed over that exceeds the target by at most OVER of it has the last
place. So one very long document at the edge neither ends nor spoils a sample.

u is a hash of the doc_id, the text and a seed, so reruns agree on any partitioning. No source is sorted in one task: a rank is cut into bins by its
digits, words are summed per (source, bin), the bin in which the gap would be exceeded is found over those sums and cut again, until so few
documents are left that one sort orders them. Each round of passing over reads only the narrow table of sizes and shuffles sums.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null doc_id is hashed as the empty text.
Input columns named as those of the result are replaced; any other column is kept. Rows alike in doc_id and text have one rank and are
taken or passed over together. Empty tables give empty results. The table of sources has a row per source and is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
CAP = 3
#: How far odds lean to short documents (0 to 1), and the size at which h is a half.
LEAN = 0.5
KNEE = 256
#: A gap of this share of the target needs no filling.
NEAR = 0.001
#: By this share of the target may the last place exceed it.
OVER = 0.01
#: Bins of a source into which a rank's digits cut at a time, and documents of a bin that are ordered at once, on average.
BINS = 4096
BIN_DOCUMENTS = 1000
SEED = "mix"
#: What h is measured in: whole millionths, so that sums don't depend on their order.
_UNIT = 1_000_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash of the document."""
    of_text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), of_text, F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (a row per source: source, source_size and any others) with the target of each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("place") + 1))
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", F.col("source_size") * cap)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("nth", F.row_number().over(full))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / weight_left)
    # the level of the first source that it doesn't fill holds for all after that
    water = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(everything)["level"]
    w = w.withColumn("water", water)
    whole = F.col("cap").cast("double")
    reach = F.when(F.col("water").isNull(), whole).otherwise(F.least(whole, F.col("water") * F.col("weight")))
    return w.select(*sizes.columns, reach.alias("target"))


def _lean(size: Column) -> Column:
    """h of a document, in whole millionths."""
    return F.floor(size * _UNIT / (size + KNEE)).cast("long")


def _sources(narrow: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, rows, target, whole (certain copies), f (odds of one more) and mean_lean of each source."""
    leans = F.sum((_lean(F.col("size")) * F.col("size")).cast("decimal(38,0)"))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), leans.alias("leans"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of = targets(sums, weights, cap).withColumn("e", e).withColumn("mean_lean", F.when(F.col("source_size") > 0, F.col("leans").cast("double") / F.col("source_size")).otherwise(0.0))
    return of.select("source", "source_size", "rows", "target", F.floor("e").cast("long").alias("whole"), (F.col("e") - F.floor("e")).alias("f"), "mean_lean")


def _rank(size: Column, u: Column, f: Column, mean_lean: Column) -> Column:
    """The Pareto rank as a number of [0, 1): odds q as q / (1 + q)."""
    p = f * (1 + LEAN * (1 - f) * (mean_lean - _lean(size).cast("double")) / _UNIT)
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def _with(df: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """df with the columns of right, a row per source, as one column of that name; null matches null. No hint: Spark broadcasts
    it below its own threshold only, and splits a hot source beyond."""
    held = right.select(F.col("source").alias(f"{name}_source"), F.struct(*right.columns).alias(name))
    return df.join(held, F.col("source").eqNullSafe(F.col(f"{name}_source")), "left").drop(f"{name}_source")


def _filled(ranked: DataFrame, state: DataFrame, levels: int) -> DataFrame:
    """state after one more step down the order of each unfinished source.

    ranked: source, size, rank. state: source, target, gap, after (the rank reached) and steps, an array of (from, to, most): ranks above
    from and up to to were taken if their documents (of one rank together) had at most most words.
    """
    groups = _with(ranked, state.where("open"), "s").where((F.col("rank") > F.col("s.after")) & (F.col("size") <= F.col("s.gap")))
    fits = groups.select("source", "size", "rank", F.col("s.gap").alias("gap"), F.lit(0).cast("long").alias("before"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    for _ in range(levels):
        digit = F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("int")
        cut = fits.withColumn("bin", digit)
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = cut.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first("before").alias("before"), F.first("low").alias("low"), F.first("width").alias("width"))
        sums = sums.withColumn("sum", F.col("before") + F.sum("words").over(upto))
        # the bin in which the gap is exceeded, or else the last one
        over = F.min(F.when(F.col("sum") > F.col("gap"), F.struct("bin", (F.col("sum") - F.col("words")).alias("before"), "low", "width")))
        last = F.max(F.struct("bin", (F.col("sum") - F.col("words")).alias("before"), "low", "width"))
        edge = common.stored(sums.groupBy("source").agg(F.coalesce(over, last).alias("e")).select("source", "e.*"), "mix-bins")
        cut = _with(cut.drop("before"), edge, "x").where(F.col("bin") == F.col("x.bin"))
        fits = cut.select("source", "size", "rank", "gap", F.col("x.before").alias("before"), (F.col("low") + F.col("width") * F.col("bin") / BINS).alias("low"), (F.col("width") / BINS).alias("width"))
    run = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    inside = fits.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(run))
    # the first rank that doesn't fit is passed over; without one, all that fit are taken
    over = F.min(F.when(F.col("sum") > F.col("gap"), F.struct("rank", (F.col("sum") - F.col("size")).alias("taken"))))
    reached = inside.groupBy("source").agg(over.alias("over"), F.max(F.struct("rank", F.col("sum").alias("taken"))).alias("last"))
    reached = reached.select("source", F.coalesce("over", "last").alias("at"), F.col("over").isNotNull().alias("passed"))
    now = _with(state, reached, "r")
    step = F.struct(F.col("after").alias("from"), F.col("r.at.rank").alias("to"), F.col("gap").alias("most"), F.col("r.passed").alias("passed"))
    moved = F.col("r.at").isNotNull()
    gap = F.when(moved, F.col("gap") - F.col("r.at.taken")).otherwise(F.col("gap"))
    return now.select(
        "source",
        "target",
        gap.alias("gap"),
        F.when(moved, F.col("r.at.rank")).otherwise(F.col("after")).alias("after"),
        F.when(moved, F.array_append("steps", step)).otherwise(F.col("steps")).alias("steps"),
        (moved & F.col("r.passed") & (gap > F.col("target") * NEAR)).alias("open"),
    )


def _taken(rank: Column, size: Column, steps: Column, last: Column) -> Column:
    """Whether the steps took a document; the rank at which a step ended was taken unless it was passed over."""
    inside = lambda s: (rank > s["from"]) & ((rank < s["to"]) | ((rank == s["to"]) & ~s["passed"])) & (size <= s["most"])
    return F.exists(steps, inside) | F.coalesce(rank == last, F.lit(False))


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, bin_documents: int = BIN_DOCUMENTS) -> DataFrame:
    """documents (all columns) with size, source_size, target and copies.

    The texts are read twice: for the sizes, of which a narrow table is kept, and for the result.
    """
    documents = documents.drop("size", "source_size", "target", "copies")  # of the result, not of the input
    u = uniform(F.col("doc_id"), F.col("text"), seed)
    narrow = common.stored(documents.select("source", words("text").alias("size"), u.alias("u")), "mix-sizes")
    of_source = common.stored(_sources(narrow, weights, cap), "mix-sources")
    ranked = _with(narrow.where("size > 0"), of_source, "o").where("o.f > 0")
    ranked = ranked.select("source", "size", _rank(F.col("size"), F.col("u"), F.col("o.f"), F.col("o.mean_lean")).alias("rank"))
    # rows of one rank are alike in doc_id and text; counted together where there are any
    most = of_source.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    levels = 0
    while most > bin_documents:
        most, levels = most // BINS, levels + 1
    no_steps = F.expr("cast(array() as array<struct<from:double,to:double,most:double,passed:boolean>>)")
    state = of_source.select("source", "target", (F.col("target") - F.col("source_size") * F.col("whole")).alias("gap"), F.lit(-1.0).alias("after"), no_steps.alias("steps"), (F.col("f") > 0).alias("open"))
    state = common.stored(state, "mix-state")
    while not state.where("open").isEmpty():
        state = common.stored(_filled(ranked, state, levels), "mix-state")
    # the last place, where nothing fitted any more
    left = _with(ranked, state.where(F.col("gap") > F.col("target") * NEAR), "s").where(F.col("s").isNotNull())
    limit = F.col("s.gap") + F.col("s.target") * OVER
    left = left.where((F.col("size") <= limit) & ~_taken(F.col("rank"), F.col("size"), F.col("s.steps"), F.lit(None).cast("double")))
    left = left.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first(limit).alias("limit")).where("size <= limit")
    last = left.groupBy("source").agg(F.min("rank").alias("last"))
    state = _with(state, last, "l").select(F.col("source").alias("of"), "steps", F.col("l.last").alias("last"))
    state = of_source.join(state, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state = common.stored(state, "mix-order")
    own = common.free_name(documents, "own")
    mix = common.free_name(documents, "mix")
    final = _with(documents.withColumn(own, F.struct(words("text").alias("size"), u.alias("u"))), state, mix)
    size, held = F.col(own)["size"], F.col(mix)
    rank = common.free_name(documents, "rank")
    final = final.withColumn(rank, F.when((held["f"] > 0) & (size > 0), _rank(size, F.col(own)["u"], held["f"], held["mean_lean"])))
    extra = F.coalesce(_taken(F.col(rank), size, held["steps"], held["last"]), F.lit(False))
    copies = (held["whole"] + extra.cast("long")).cast("long")
    return final.select(*documents.columns, size.alias("size"), held["source_size"].alias("source_size"), held["target"].alias("target"), copies.alias("copies"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    copy = common.free_name(docs, "copy")
    kept = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    drawn = mixture(kept).where("copies > 0").withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return drawn.select("row.*")


#: The same mix without bins: each source's documents in one order, and a recursive step for each of them.
OP10_SQL = r"""
with recursive d as (select doc_id, source, md5(coalesce(text, '')) as of_text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
h as (select *, (size * 1000000 // (size + 256))::bigint as lean from d),
s as (select source, sum(size)::bigint as source_size, sum(lean::hugeint * size)::double as leans from h group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
  (sum(source_size) over ())::double as total, source_size * 3 as cap from s),
l as (select *, row_number() over (order by cap::double / weight, source nulls last) as nth,
  (total - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
  / (sum(weight) over () - coalesce(sum(weight) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double)) as level from w),
f as (select arg_min(level, nth) as water from l where cap >= level * weight),
t as (select source, source_size, leans, case when water is null then cap::double else least(cap::double, water * weight) end as target from l, f),
e as (select *, case when source_size > 0 then target / source_size else 0.0::double end as e, case when source_size > 0 then leans / source_size else 0.0::double end as mean_lean from t),
p as (select doc_id, size, h.source, source_size, target, floor(e)::bigint as whole, e - floor(e) as f,
  (e - floor(e)) * (1 + 0.5::double * (1 - (e - floor(e))) * (mean_lean - lean) / 1000000) as p,
  (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || of_text || ':mix'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from h join e on h.source is not distinct from e.source),
r as (select *, case when f > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from p),
o as (select source, odds, sum(size)::double as words, max(size) as size, row_number() over (partition by source order by odds / (1 + odds)) as nth from r where f > 0 and size > 0 group by source, odds),
g as (
  select source, 0::bigint as nth, any_value(target - source_size * whole) as gap, any_value(target - source_size * whole) as most, any_value(target) as target,
    false as taken, null::double as odds, any_value(f) > 0 as open from p group by source
  union all
  select g.source, o.nth, case when o.words <= g.gap then g.gap - o.words else g.gap end,
    case when o.words > g.gap and o.size <= g.most then g.gap else g.most end, g.target, o.words <= g.gap, o.odds,
    not (o.words > g.gap and o.size <= g.most and g.gap <= g.target * 0.001)
  from g join o on g.source is not distinct from o.source and o.nth = g.nth + 1 where g.open),
z as (select source, min(gap) as gap, any_value(target) as target from g group by source having min(gap) > any_value(target) * 0.001),
k as (select o.source, min(o.odds) as odds from o join z on o.source is not distinct from z.source left join g on g.source is not distinct from o.source and g.odds = o.odds and g.taken
  where g.odds is null and o.words <= z.gap + z.target * 0.01 group by o.source)
select doc_id, r.size, source_size, r.target, (r.whole + case when r.size > 0 and (g.taken or k.odds is not null) then 1 else 0 end)::bigint * r.size as taken
from r left join g on r.source is not distinct from g.source and r.odds = g.odds left join k on r.source is not distinct from k.source and r.odds = k.odds
"""
