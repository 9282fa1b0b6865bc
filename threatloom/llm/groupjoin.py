"""Set similarity join over a token-group matrix: similar documents in groups, overlap bounds, only qualifying groups opened.

1. One scan adds up how loaded each of ``SLOTS`` hash slots of shingles is: a fixed-size global order, rare shingles first.
2. A second scan gives each document its set's size, fingerprint, and its first shingles in that order (its *lead*).  If two
   sets of similarity t share at least ``a`` shingles, leads of size - a + MATCHES shingles share MATCHES of them (or all).
   Documents with equal sets form a class; only its smallest id goes on.
3. Every class meets the most central class of each of its lead shingles once, which joins a group of n near copies by about n
   comparisons.
4. Classes are then partitioned into bounded groups of similar documents of one component.  The matrix holds, for each
   lead shingle, the groups in whose union it lies.  The number of matrix entries a class hits in a group bounds its overlap
   with every member; groups that reach the bound are opened, and compared on full sets, unless they are of the class's
   own component.  No link between components is lost: every bound is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.llm.common import components, mixed, shingle_sets, small_batches, stage

SLOTS = 1 << 18
MATCHES = 4
MEMBERS, TOKENS = 64, 1 << 16  # of a group: so many classes, or so many shingles
ASKING = 256  # classes that ask one group in one task
BROADCAST_IDS = 1 << 20  # 8 MB of ids
_SIGNED = pa.struct([("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("kin", pa.int64()), ("lead", pa.list_(pa.int64()))])
_SQL_SIGNED = "struct<n: bigint, set_a: bigint, set_b: bigint, kin: bigint, lead: array<bigint>>"


def slots_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(46)).astype(np.int64)


def slot_loads(base: DataFrame, words: int) -> np.ndarray:
    """How many (document, shingle) entries fall into each slot, over all documents; ``SLOTS`` numbers, whatever the input."""
    def add(batches):
        loads = np.zeros(SLOTS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for found in shingle_sets(batch.column("text"), words):
                held.append(slots_of(found))
                if len(held) >= 4096 or len(found) > 1 << 16:
                    loads += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held.clear()
        if held:
            loads += np.bincount(np.concatenate(held), minlength=SLOTS)
        used = np.flatnonzero(loads)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used.astype(np.int32)), "load": pa.array(loads[used])})

    total = np.zeros(SLOTS, np.int64)
    found = base.select("text").mapInArrow(add, "slot int, load bigint").groupBy("slot").agg(F.sum("load").alias("load")).toArrow()
    total[found.column("slot").to_numpy()] = found.column("load").to_numpy()
    return total


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` shingles with any set it is linked with."""
    return -(-percent * n // 100)


def _required(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def lead_of(found: np.ndarray, loads: np.ndarray, percent: int) -> np.ndarray:
    """First shingles of a sorted set in the global order: by load of the slot, then by value."""
    size = min(len(found), len(found) - required(len(found), percent) + MATCHES)
    return found[np.argsort(loads[slots_of(found)], kind="stable")[:size]]


def kin_of(found: np.ndarray) -> int:
    """Equal for most pairs of similar sets: the two smallest values of one hash function."""
    values = mixed(found ^ np.uint64(0xA24BAED4963EE407))
    low = np.partition(values, 1)[:2] if len(values) > 2 else values
    return int(mixed(low.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def signatures(texts: pa.Array, words: int, percent: int, loads: np.ndarray) -> pa.Array:
    columns: list[list] = [[], [], [], [], []]
    for found in shingle_sets(texts, words):
        sums = np.array([found.sum(dtype=np.uint64), mixed(found * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
        row = (len(found), int(sums[0]), int(sums[1]), kin_of(found) if len(found) else 0, lead_of(found, loads, percent).view(np.int64))
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(arrays, fields=list(_SIGNED))


def set_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles;
    ``component_id`` is the smallest id reachable.  A text of fewer words has its whole sequence as its one shingle; a null or
    word-free text has an empty set, no link, and is a component of its own.  Rows of one id are one node, whatever their
    texts; each row comes out once with the size of its own set.  A row without id belongs to the component of its text's
    class, or to none (null) if no row with an id has that set.  Other columns are ignored.  Texts are read whole.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        loads = slot_loads(base, words)
    sign = F.arrow_udf(lambda texts: signatures(texts, words, percent, loads), _SQL_SIGNED)
    with small_batches(docs.sparkSession):
        signed = stage(base.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*"))
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    reps = stage(
        named.groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("kin").alias("kin"), F.any_value("lead").alias("lead")))
    known = _same_id(named, reps)
    labels = _labels(base, reps, known, words, percent)
    classes = reps.join(labels, reps.rep == labels.node, "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("label"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label"))
    return (
        signed.select("doc_id", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")))


def _same_id(named: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of ids whose rows have different sets."""
    sets = F.struct("set_a", "set_b")
    torn = named.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select("doc_id")
    rows = named.join(torn, "doc_id").select("doc_id", "set_a", "set_b").join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    return stage(rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())


def _sets_of(base: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Full shingle sets of the documents named; a text moves only if it is among them, or if they are too many to broadcast."""
    ids = stage(ids.distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    @F.arrow_udf("array<bigint>")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array([found.view(np.int64) for found in shingle_sets(texts, words)], pa.list_(pa.int64()))

    chosen = base.join(ids, base.doc_id == ids.rep, "left_semi")
    with small_batches(base.sparkSession):
        return stage(chosen.select(F.col("doc_id").alias("rep"), tokens("text").alias("tokens")).where("size(tokens) > 0"))


def _matching(percent: int):
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(_rows(left), _rows(right), strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def _rows(lists: pa.Array) -> list[np.ndarray]:
    flat = lists.flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(lists) else []


def _labels(base: DataFrame, reps: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """Component label of every class that is linked with another, as ``(node, label)``."""
    spots = reps.select("rep", "n", F.posexplode("lead").alias("place", "token"))
    shared = spots.groupBy("token").agg(F.count("*").alias("meets")).where("meets > 1")
    spots = stage(spots.join(shared, "token"))
    hubs = stage(_hub_pairs(spots, percent))
    sets = _sets_of(base, hubs.select(F.explode(F.array("a", "b")).alias("rep")), words)
    both = hubs.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("right")), "b")
    both = both.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("left")), "a")
    links = stage(both.where(_matching(percent)("left", "right")).select("a", "b").distinct().union(known))
    labels = components(links)
    found = _group_links(base, reps, spots, labels, words, percent)
    return labels if found is None else components(links.union(found))


def _hub_pairs(spots: DataFrame, percent: int) -> DataFrame:
    """Every class with the most central classes of its lead shingles, where they share enough of them.

    The text from which others were made shares more shingles than they share with each other: it is the best hub.
    This only saves work; what it leaves out is found by the groups.
    """
    central = spots.groupBy("rep").agg(F.sum("meets").alias("central"))
    ranked = spots.join(central, "rep")
    hub = ranked.groupBy("token").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), F.struct("central", -F.col("rep"))).alias("h"))
    sizes = 100 * F.least("n", "h.hub_n") >= percent * F.greatest("n", "h.hub_n")
    pairs = spots.join(hub, "token").where((F.col("rep") != F.col("h.hub")) & sizes)
    enough = F.least(F.lit(MATCHES), F.col("least"))
    met = pairs.groupBy("rep", F.col("h.hub").alias("hub")).agg(F.count("*").alias("hits"), F.min(_required(F.col("n"), percent)).alias("least"))
    return met.where(F.col("hits") >= enough).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _group_links(base: DataFrame, reps: DataFrame, spots: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between classes of different components, one at least for each class and group that hold one."""
    named = reps.select("rep", "n", "kin").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = stage(named.join(spots.select("rep").distinct(), "rep", "left_semi"))
    crowd = named.groupBy("label", "kin").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("members") / MEMBERS, F.col("tokens") / TOKENS))
    block = F.pmod(F.xxhash64("rep", F.lit("block")), blocks)
    homes = named.join(crowd, ["label", "kin"]).withColumn("grp", F.xxhash64("label", "kin", block))
    homes = stage(homes.join(homes.groupBy("grp").agg(F.count("*").alias("held")), "grp").select("rep", "n", "label", "grp", "held"))
    # Shingles all of whose classes are of one component have nothing left to say.
    open_spots = spots.select("token", "rep", "place").join(homes, "rep")
    torn = open_spots.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    # A lead shingle before this one that is not open itself is in no set of another component that has this one in its
    # lead, so it lessens what they can have in common.
    before = F.col("place") + 1 - F.row_number().over(Window.partitionBy("rep").orderBy("place", "token"))
    open_spots = stage(open_spots.join(torn, "token", "left_semi").withColumn("reach", F.col("n") - before).drop("place"))
    matrix = stage(
        open_spots.groupBy("token", "grp", "label", "held").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach")))
    asked = matrix.select("token", *[F.col(c).alias(f"g_{c}") for c in ("grp", "label", "held", "least", "most", "reach")])
    other = F.greatest(F.col("g_least"), _required(F.col("n"), percent))
    sizes = (100 * F.col("g_most") >= percent * F.col("n")) & (
        (100 + percent) * F.least("reach", "g_reach") >= percent * (F.col("n") + other))
    # Each pair of groups once: members of the smaller one ask the larger one.
    once = F.struct("held", "grp") < F.struct(F.col("g_held").alias("held"), F.col("g_grp").alias("grp"))
    hits = open_spots.join(asked, "token").where((F.col("label") != F.col("g_label")) & sizes & once)
    bound = hits.groupBy("rep", "n", F.col("g_grp").alias("grp")).agg(F.count("*").alias("hits"))
    calls = stage(bound.where(F.col("hits") >= F.least(F.lit(MATCHES), _required(F.col("n"), percent))).select("rep", "n", "grp"))
    if calls.isEmpty():
        return None
    busy = calls.groupBy("grp").agg(F.count("*").alias("calls"), F.sum("n").alias("tokens"))
    busy = stage(busy.select("grp", F.ceil(F.greatest(F.col("calls") / ASKING, F.col("tokens") / (16 * TOKENS))).alias("parts")))
    members = homes.select("rep", "grp", "label").join(busy, "grp")
    sets = _sets_of(base, calls.select("rep").union(members.select("rep")), words)
    asking = calls.join(busy, "grp").withColumn("part", F.pmod(F.xxhash64("rep", F.lit("part")), "parts")).join(sets, "rep")
    opened = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).join(sets, "rep")

    def compare(group: pa.Table, queries: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if len(group) and len(queries):
            held, ids, of = _rows(group.column("tokens").combine_chunks()), group.column("rep").to_pylist(), group.column("label").to_pylist()
            union = np.unique(np.concatenate(held))
            for query, mine in zip(queries.column("q_rep").to_pylist(), _rows(queries.column("q_tokens").combine_chunks()), strict=True):
                reach = len(np.intersect1d(mine, union, assume_unique=True))
                if 100 * reach < percent * len(mine):
                    continue
                done = set()  # one link with a component says it all
                for other, label, tokens in zip(ids, of, held, strict=True):
                    if label in done or 100 * min(len(tokens), reach) < percent * max(len(tokens), len(mine)):
                        continue
                    both = len(np.intersect1d(mine, tokens, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(tokens) - both):
                        out_a.append(query)
                        out_b.append(other)
                        done.add(label)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    left = opened.select("grp", "part", "rep", "label", "tokens").groupBy("grp", "part")
    right = asking.select(*[F.col(c).alias(f"q_{c}") for c in ("grp", "part", "rep", "tokens")]).groupBy("q_grp", "q_part")
    found = stage(left.cogroup(right).applyInArrow(compare, "a bigint, b bigint").distinct())
    return None if found.isEmpty() else found
