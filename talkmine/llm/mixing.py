"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source's target says how many copies its documents get: the whole part surely, the
fraction as an inclusion probability ``p``. A document's Pareto rank is its random odds
``u / (1 - u)`` divided by its inclusion odds ``p / (1 - p)``; ``u`` comes from a hash of its id,
so reruns agree. In rank order documents get one more copy until the words that the target
still lacks are met as nearly as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmine.llm.text import WORD_PATTERN
from talkmine.session import cut_lineage, fresh_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: ranks are summed up in this many cells, then those of the deciding cell in as many again
CELLS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) out of 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_key(source: Column) -> Column:
    """The source, or a key of its own for null."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST_COPIES) -> DataFrame:
    """key, source_size and target of each source.

    Sources in code point order (null last) weigh ``weights`` in turn and divide ``share`` of all
    words. A target ends at ``most`` times its source's size; the excess is divided again.
    Filled in order of ``most * size / weight``: those below the water level are full. Only the
    sources, one row each, pass through one task here.
    """
    by_source = sizes.groupBy("key").agg(
        F.min("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
             - (F.sum("cap").over(fill) - F.col("cap"))) / (
        F.sum("weight").over(Window.partitionBy()) - (F.sum("weight").over(fill) - F.col("weight")))
    ranked = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", cap).withColumn(
        "full_at", F.col("cap") / F.col("weight")).withColumn("level", level)
    water = F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    return ranked.select("key", "source_size", F.when(
        F.col("level") >= F.col("full_at"), F.col("cap").cast("double")).otherwise(F.col("weight") * water).alias("target"))


def _rank(u: Column, p: Column) -> Column:
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def plan(sizes: DataFrame, **choice) -> DataFrame:
    """One row per source: source_size, target, whole copies of every document, the words still
    lacking (``rest``), ``p``, and ``last``, the highest rank that gets one more copy (or null).

    ``sizes`` holds key, source, size and u of each document. Ranks are first summed up in cells
    of u, so a source with a third of all rows is never sorted in one task: only its cells are,
    and in the second round the cells of its deciding cell, and then the few ranks left.
    """
    goal = targets(sizes, **choice)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = cut_lineage(goal)
    # words of each source below the cell in which the rest is met
    state = goal.filter("p > 0").select("key", "p", "rest", F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("cell"))
    state = cut_lineage(state)
    for cells in (CELLS, CELLS * CELLS):
        inside = F.floor(F.col("u") * (cells // CELLS)) == F.col("cell") if cells > CELLS else F.lit(True)
        sums = sizes.join(state, "key").filter(inside).groupBy(
            "key", F.floor(F.col("u") * cells).cast("double").alias("at")).agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("p").alias("p"),
            F.first("below").alias("below"))
        before = F.col("below") + F.sum("words").over(Window.partitionBy("key").orderBy("at")) - F.col("words")
        state = cut_lineage(sums.withColumn("before", before).filter("before < rest").groupBy("key").agg(
            F.max_by(F.struct("p", "rest", F.col("before").alias("below"), F.col("at").alias("cell")), "at").alias("s"))
            .select("key", "s.*"))
    left = sizes.join(state, "key").filter(F.floor(F.col("u") * (CELLS * CELLS)) == F.col("cell")).groupBy("key", "u").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("p").alias("p"), F.first("below").alias("below"))
    before = F.col("below") + F.sum("words").over(Window.partitionBy("key").orderBy(_rank(F.col("u"), F.col("p")), "u")) \
        - F.col("words")
    taken = left.withColumn("before", before).withColumn(
        "enters", F.col("before") + F.col("words") / 2 <= F.col("rest"))
    # without an entering rank in the deciding cell, all ranks below that cell enter
    last = taken.groupBy("key").agg(F.coalesce(
        F.max(F.when(F.col("enters"), F.col("u"))), F.min(F.floor(F.col("u") * (CELLS * CELLS)) / (CELLS * CELLS))).alias("last"))
    return goal.join(last, "key", "left")


def doc_sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("key"),
                       n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u"))


def _copies() -> Column:
    return (F.col("whole") + F.coalesce((F.col("u") <= F.col("last")).cast("long"), F.lit(0))).cast("long")


def _stored(spark, sources: DataFrame) -> DataFrame:
    """Written and read again, so that Spark knows its size and decides how to join."""
    path = fresh_dir(spark, "mix")
    sources.write.parquet(path)
    return spark.read.parquet(path)


def mix(docs: DataFrame, seed: int = 0, **choice) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row of ``docs``
    (doc_id, source, text).

    A null text counts 0 words, a null source is a source of its own and comes last. Rows that
    repeat a doc_id share its rank, so of one source they are taken together. A source without
    words has target 0. An empty table gives no rows.
    """
    sizes = cut_lineage(doc_sizes(docs, seed))
    sources = _stored(docs.sparkSession, plan(sizes, **choice))
    return sizes.join(sources, "key").withColumn("copies", _copies()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = 0, **choice) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; texts stay where they are."""
    sources = _stored(docs.sparkSession, plan(cut_lineage(doc_sizes(docs, seed)), **choice)).select(
        F.col("key").alias("__mix_key"), F.col("whole").alias("__mix_whole"), F.col("last").alias("__mix_last"))
    drawn = docs.withColumn("__mix_u", uniform(docs["doc_id"], seed)).join(
        sources, source_key(docs["source"]) == F.col("__mix_key"))
    more = F.coalesce((F.col("__mix_u") <= F.col("__mix_last")).cast("long"), F.lit(0))
    return drawn.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), (F.col("__mix_whole") + more).cast("int")))).select(
        *[drawn[c] for c in docs.columns])


ORACLE = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496 u
  from documents),
sources as (
  select source, sum(size)::bigint source_size, row_number() over (order by source asc nulls last) place
  from sizes group by source),
weighed as (
  select *, [3, 1, 2][((place - 1) % 3 + 1)::int] weight, 2 * source_size cap from sources),
filled as (
  select *, cap / weight::double full_at from weighed),
levels as (
  select *, (sum(source_size) over () * 1.5::double - (sum(cap) over f - cap)::double)
    / (sum(weight) over () - (sum(weight) over f - weight))::double lvl
  from filled window f as (order by full_at, source asc nulls last)),
goals as (
  select source, source_size,
    case when lvl >= full_at then cap::double else weight * max(case when lvl < full_at then lvl end) over () end target
  from levels),
rates as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end whole from goals),
ranks as (
  select s.source, s.u, sum(s.size) words, any_value(target - whole * source_size) rest
  from sizes s join rates r on s.source is not distinct from r.source
  where source_size > 0 and target / source_size > whole group by s.source, s.u),
ordered as (
  select *, sum(words) over (partition by source order by u) - words before from ranks),
lasts as (
  select source, max(u) last_u from ordered where before + words / 2.0::double <= rest group by source)
select s.doc_id, s.size, r.source_size::bigint source_size, r.target,
  (s.size * (r.whole + case when s.u <= l.last_u then 1 else 0 end))::bigint taken
from sizes s join rates r on s.source is not distinct from r.source
left join lasts l on l.source is not distinct from s.source
"""
