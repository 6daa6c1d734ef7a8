"""Collision counters for canonical-store names (first free, in order).

Each candidate wants ``dir/base``; when it is taken (by an existing store
entry or by an earlier candidate) it tries ``stem_1.ext``, ``stem_2.ext``
... in turn.

* Candidates of one base are solved exactly in bulk: the i-th candidate
  (0-based, in order) takes the i-th counter not in the base's taken set T.
  With T sorted (t_0 < t_1 < ...) and g_j = t_j - j, that is
  ``i + #{j : g_j <= i}``, i.e. the candidate's position in the merged order of
  candidates and taken entries.  Ranks come from a skew-safe rank-within-key,
  so a hot name is never one task.
* Two bases share a name only where one is a generated name of the other
  (``x_3.mp4`` beside ``x.mp4``): counter 3 of the parent is the plain name of
  the child.  Whoever comes first takes it, and the other finds it taken.  The
  parent's candidate that would take counter k is its candidate number
  ``k - blocked``, blocked being the counters below k it found taken, so it
  comes first exactly when that number is less than the count of parent
  candidates before the child's first one.  Names are decided level by level:
  the counters in a name's chain (``x``, ``x_3``, ``x_3_1``) give its level, and
  a parent's plain name was decided one level up.  Within a level a parent's
  shared names, in rising order of their counters, are dealt to blocks of
  ``BLOCK``, each a row of its own.  All blocks are decided at once from a guess
  of the counters blocked before them; the counts that come out give the next
  guess, and when a round confirms its guess it is the answer, since the first
  block's is known, hence the second's, and so on.  What is decided are further
  taken entries, and the bulk path does the rest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger.functions import paths as P
from copyledger.operators.ranking import rank_within
from copyledger.sources.snapshots import stage
from copyledger.session import pickle_by_value

pickle_by_value(__name__)

#: Shared names of one parent that are decided together: bounds a row's list.
BLOCK = 1 << 13
_COUNTER_RE = r"^(.*)_([1-9][0-9]*)$"
_CHAIN_RE = r"(?:_[1-9][0-9]*)*$"


def _with_parent(df: DataFrame) -> DataFrame:
    """``_parent`` and ``_k`` where ``base`` is counter k of a shorter base."""
    stem, ext = P.split_ext("base")
    head = F.regexp_extract("_stem", _COUNTER_RE, 1)
    k = F.when(head != "", F.regexp_extract("_stem", _COUNTER_RE, 2)).try_cast("long")
    return (df.withColumn("_stem", stem).withColumn("_ext", ext).withColumn("_k", k)
            .withColumn("_parent", F.when(F.col("_k").isNotNull(), F.concat(head, F.col("_ext")))))


def taken_counters(taken: DataFrame) -> DataFrame:
    """Existing names (``dir, name``) as (dir, base, counter) for both
    readings of a name: as a plain base (counter 0) and, when it ends in
    ``_<k>``, as counter k of the shorter base."""
    stem, ext = P.split_ext("name")
    t = (taken.select("dir", "name").withColumn("_ext", ext).withColumn("_stem", stem)
         .withColumn("_m", F.regexp_extract("_stem", _COUNTER_RE, 1))
         .withColumn("_k", F.regexp_extract("_stem", _COUNTER_RE, 2)))
    plain = t.select("dir", F.col("name").alias("base"), F.lit(0).cast("long").alias("t"))
    # A number too long for a counter can never be generated: no reading.
    gen = (t.filter(F.col("_m") != "")
           .select("dir", F.concat("_m", "_ext").alias("base"), F.expr("try_cast(_k AS BIGINT)").alias("t"))
           .filter(F.col("t").isNotNull()))
    return plain.unionByName(gen).distinct()


def _markers_passed(rows: DataFrame, markers: DataFrame, order: list[str], out: str) -> DataFrame:
    """``markers(dir, base, child, ...)`` plus ``out``: how many ``rows`` of the
    same (dir, base) come before each in ``order``."""
    cols = ["dir", "base", *order]
    merged = (markers.select(*cols, "child")
              .unionByName(rows.select(*cols, F.lit(None).cast("string").alias("child"))))
    place = rank_within(merged, ["dir", "base"], order, "_place").filter(F.col("child").isNotNull())
    place = rank_within(place, ["dir", "base"], order, "_own")
    return place.select("dir", "child", (F.col("_place") - F.col("_own")).alias(out))


def _passed(blocked: int, edges: list[dict]):
    """Each shared name of a block in turn: (edge, parent comes first), then the
    counters blocked after it.  A name that the store holds is taken for both."""
    decided = []
    for e in edges:
        first = not e["static"] and e["k"] - e["below"] - blocked < e["before"]
        if not first:
            blocked += 1
        if not e["static"]:
            decided.append((e, first))
    return decided, blocked


def _count_blocked(batches):
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["dir"], batch["parent"], batch["block"],
             pa.array([_passed(r["start"], r["edges"])[1] - r["start"] for r in rows], pa.int64())],
            ["dir", "parent", "block", "blocked"])


def _decide(batches):
    for batch in batches:
        out = [(r["dir"], e["child"], 0) if first else (r["dir"], r["parent"], e["k"])
               for r in batch.to_pylist() for e, first in _passed(r["start"], r["edges"])[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()),
             pa.array([o[2] for o in out], pa.int64())], ["dir", "base", "t"])


def _start_of(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``: blocked before them, by the counts of the blocks before."""
    ahead = (Window.partitionBy("dir", "parent").orderBy("block")
             .rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("start", F.col("own") + F.coalesce(F.sum("blocked").over(ahead), F.lit(0)))


def _decide_level(rows: DataFrame, lost: DataFrame | None, block: int) -> DataFrame:
    """Taken entries (dir, base, t) of one level's shared names ``rows``;
    ``lost``: (dir, base) whose plain name a parent took."""
    edge = F.struct("k", "below", "before", "static", "child")
    blocks = (rows.withColumn("block", F.floor(F.col("place") / block))
              .groupBy("dir", "parent", "block").agg(F.sort_array(F.collect_list(edge)).alias("edges")))
    if lost is None:
        blocks = blocks.withColumn("own", F.lit(0).cast("long"))
    else:
        took = lost.select("dir", F.col("base").alias("parent"), F.lit(1).cast("long").alias("own"))
        blocks = blocks.join(took, ["dir", "parent"], "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    # first guess: every child keeps its name, so all names before are blocked
    blocks = stage(blocks.withColumn("blocked", F.size("edges").cast("long")), "name-blocks")
    if blocks.filter(F.col("block") > 0).isEmpty():
        return blocks.withColumn("start", F.col("own")).mapInArrow(_decide, "dir string, base string, t long")
    guess = _start_of(blocks.select("dir", "parent", "block", "own", "blocked"))
    while True:
        guess = stage(guess.select("dir", "parent", "block", "own", "start"), "name-guess")
        at = blocks.select("dir", "parent", "block", "edges").join(guess, ["dir", "parent", "block"])
        counted = at.select("dir", "parent", "block", "start", "edges").mapInArrow(
            _count_blocked, "dir string, parent string, block long, blocked long")
        told = _start_of(guess.withColumnRenamed("start", "guessed").join(counted, ["dir", "parent", "block"]))
        told = stage(told, "name-told")
        if told.filter("start <> guessed").isEmpty():
            return at.select("dir", "parent", "start", "edges").mapInArrow(_decide, "dir string, base string, t long")
        guess = told


def _shared_names(c: DataFrame, t: DataFrame, block: int) -> DataFrame | None:
    """Taken entries (dir, base, t) that follow from names which two bases
    share; None when no two do."""
    parents = c.select("dir", F.col("base").alias("_parent")).distinct()
    edges = (c.filter(F.col("_parent").isNotNull())
             .groupBy("dir", "base", "_parent", "_k")
             .agg(F.min(F.struct("ord0", "ord1", "id")).alias("first"))
             .join(parents, ["dir", "_parent"], "left_semi"))
    edges = stage(edges.select("dir", F.col("base").alias("child"), F.col("_parent").alias("base"),
                               F.col("_k").alias("t"), "first.*"), "shared-names")
    if edges.isEmpty():
        return None
    bases = edges.select("dir", "base").distinct()
    plain = t.filter(F.col("t") == 0).select("dir", F.col("base").alias("child"), F.lit(True).alias("static"))
    # Counters of a parent that are nobody's plain name.
    other = (t.join(bases, ["dir", "base"], "left_semi")
             .join(edges.select("dir", "base", "t"), ["dir", "base", "t"], "left_anti"))
    before = _markers_passed(c.join(bases, ["dir", "base"], "left_semi"), edges, ["ord0", "ord1", "id"], "before")
    below = _markers_passed(other, edges, ["t"], "below")
    stem, _ = P.split_ext("parent")
    rows = (edges.select("dir", "child", F.col("base").alias("parent"), F.col("t").alias("k"))
            .join(before, ["dir", "child"]).join(below, ["dir", "child"])
            .join(plain, ["dir", "child"], "left").withColumn("static", F.coalesce("static", F.lit(False)))
            .withColumn("level", F.regexp_count(F.regexp_extract(stem, _CHAIN_RE, 0), F.lit("_"))))
    rows = stage(rank_within(rows, ["dir", "parent"], ["k"], "place"), "shared-ranked")
    # a level is a counter more in the name: bounded by the length of a name
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())
    done, lost = None, None
    for level in levels:
        new = stage(_decide_level(rows.filter(F.col("level") == level), lost, block), "level-taken")
        done = new if done is None else done.unionByName(new)
        lost = done.filter("t = 0").select("dir", "base")
    return done


def resolve_counters(cands: DataFrame, taken: DataFrame, order_cols: tuple[str, str] = ("ord0", "ord1"),
                     block: int = BLOCK) -> DataFrame:
    """(id, dir, base, counter, name) for every candidate.

    ``cands``: id, dir, base, and the two order columns; ``taken``: dir, name
    of existing entries.
    """
    o0, o1 = order_cols
    c = _with_parent(cands.select("id", "dir", "base", F.col(o0).alias("ord0"), F.col(o1).alias("ord1")))
    # Stage the narrow candidate table: its key columns are regex-derived and
    # feed several joins (re-deriving them per join bloats generated code).
    c = stage(c.select("id", "dir", "base", "ord0", "ord1", "_parent", "_k"), "store-names")
    t = stage(taken_counters(taken).join(c.select("dir", "base").distinct(), ["dir", "base"], "left_semi"), "taken")
    shared = _shared_names(c, t, block)
    if shared is not None:
        t = t.select("dir", "base", "t").unionByName(shared)

    ranked = rank_within(c.select("id", "dir", "base", "ord0", "ord1"),
                         ["dir", "base"], ["ord0", "ord1", "id"], "i")
    t = rank_within(t, ["dir", "base"], ["t"], "j").withColumn("g", F.col("t") - F.col("j"))
    # i + #{g_j <= i} is the position of candidate i in the merged order of
    # candidates (key i) and taken entries (key g, first on ties): one more
    # rank, no candidate x taken pairs.
    merged = (ranked.select("dir", "base", "id", F.col("i").alias("key"), F.lit(1).alias("kind"))
              .unionByName(t.select("dir", "base", F.lit(None).cast("long").alias("id"),
                                    F.col("g").alias("key"), F.lit(0).alias("kind"))))
    pos = rank_within(merged, ["dir", "base"], ["key", "kind", "id"], "counter")
    out = pos.filter(F.col("kind") == 1).select("id", "dir", "base", "counter")
    return P.with_counter_name(out, "base", "counter", "name")
