"""N-gram Jaccard join: components of documents whose word-shingle sets are similar, found exactly with signature trees."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm.common import batch_rows, drop_tables, final_table, materialise, pieces, recorded
from locusframe.llm.components import components
from locusframe.llm.signature_tree import LEAF, bitmap, bytes_of, candidate_pairs, earlier, may_reach

#: Shingles that more sets than this have among their selected ones come last in the order.
HEAVY = 48
#: Bits of the filter that holds those shingles: its size is fixed, and what it wrongly holds only comes later in the order than it need.
FILTER_BITS = 1 << 25
#: Sets of one tree; larger groups are dealt as pairs of blocks.
BLOCK = 4096
#: Rows of two or three long columns are broadcast up to so many.
BROADCAST_IDS = 500_000
#: Rounds in which classes try to merge before trees are built, and the partners that a class tries in a round.
ROUNDS, PARTNERS = 2, 3
#: Groups of a set that a tree row names, so that a pair is handed out in the first group that it shares.
NAMED = 64

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words, A-Z lower-cased; of the whole sequence if it has fewer; empty without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            x = (x ^ (h[k : len(h) - n + 1 + k] * _ODD[k % 5])) * _ODD[(k + 1) % 5]
            x ^= x >> np.uint64(32)
    return np.unique(x)


def selected(values: np.ndarray, percent: int, late: np.ndarray | None = None) -> np.ndarray:
    """The first values of a set in the common order, those marked late at its end: sets that reach the similarity share one of them."""
    n = len(values)
    count = n - -(-percent * n // 100) + 1
    if late is None:
        return values[:count]
    return np.concatenate([values[~late], values[late]])[:count]


def held(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the filter holds: bits at two places of each."""
    at = [(values * _ODD[k] >> np.uint64(20)) & np.uint64(len(words) * 64 - 1) for k in (0, 1)]
    return np.all([words[a >> np.uint64(6)] >> (a & np.uint64(63)) & np.uint64(1) for a in at], axis=0)


def _places(bits: int) -> Callable:
    """Values to the filter's words and the bits set in them; a word may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([(values * _ODD[k] >> np.uint64(20)) & np.uint64(bits - 1) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(_signed(np.uint64(1) << (at & np.uint64(63))))], ["word", "bits"])

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(words: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in pieces(batches):
            rows = []
            for text in b.column(1):
                s = shingles(text.as_py(), words)
                if len(s):
                    rows.append((_node(s), len(s), _signed(selected(s, percent)), bitmap(s)))
                else:
                    rows.append((None, 0, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            number = pa.array(range(at, at + len(rows)), pa.int64())
            at += len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), number, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "h", "row", "id", "n", "picked", "bits"])

    return run


def _touched(heavy) -> Callable:
    """The ids of nodes that selected a value which the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(heavy.value, np.uint64)
        for b in pieces(batches):
            lists = b.column(1)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            late = held(words, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.unique(row[late])))], ["id"])

    return run


def _reselect(words: int, percent: int, heavy) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(heavy.value, np.uint64), set()
        for b in pieces(batches):
            ids, picked = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i in seen:
                    continue
                s = shingles(text.as_py(), words)
                if i == _node(s):
                    seen.add(i)
                    ids.append(i)
                    picked.append(_signed(selected(s, percent, held(bits, s).astype(bool))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(picked, pa.list_(pa.int64()))], ["id", "picked"])

    return run


def _plausible(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_rows
            n = np.concatenate([b.column(2).to_numpy(), b.column(3).to_numpy()])
            keep = may_reach(bytes_of(pa.concat_arrays([b.column(4), b.column(5)])), n, np.arange(k), np.arange(k, 2 * k), percent)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])

    return run


def _verified(words: int, percent: int) -> Callable:
    """Pairs with both texts, those of one v together, to pairs that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, text: pa.StringScalar) -> np.ndarray:
            if key not in cache:
                cache[key] = shingles(text.as_py(), words)
                if len(cache) > 64:
                    cache.popitem(last=False)
            return cache[key]

        for b in batches:
            keep = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                p, q = of(u, x), of(v, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            at = pa.array(np.flatnonzero(np.array(keep, bool)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])

    return run


def _tree_pairs(percent: int) -> Callable:
    """Rows sorted by group: (value, b1, b2, id, n, label, side, bits, named) to pairs that may reach the similarity, each in the first group that both name.

    A group of LEAF sets or fewer is a tree of one leaf; the leaves of many such groups are compared at once.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], schema=schema)

    def tree(t: pa.Table) -> pa.RecordBatch:
        value = t.column("value")[0].as_py()
        named = earlier([[v for v in x if v < value] for x in t.column("named").to_pylist()])
        i, j = candidate_pairs(t.column("bits").to_pylist(), *(t.column(c).to_numpy() for c in ("n", "label", "side")), percent, named)
        return out(t.column("id").to_numpy(), i, j)

    def leaves(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        ids, n, label, value = (t.column(c).to_numpy() for c in ("id", "n", "label", "value"))
        pairs = [np.flatnonzero((group[:-d] == group[d:]) & (label[:-d] != label[d:])) for d in range(1, min(LEAF, len(group)))]
        i = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        j = i + np.repeat(np.arange(1, len(pairs) + 1), [len(p) for p in pairs])
        keep = may_reach(bytes_of(t.column("bits").combine_chunks()), n, i, j, percent)
        i, j = i[keep], j[keep]
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        named = [{v for v in x if v < value[r]} for r, x in zip(rows, t.column("named").take(pa.array(rows)).to_pylist(), strict=True)]
        first = np.array([named[a].isdisjoint(named[b]) for a, b in zip(at[: len(i)], at[len(i) :], strict=True)], bool)
        return out(ids, i[first], j[first])

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [t.column(c).to_numpy() for c in ("value", "b1", "b2")]
        start = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        size = np.diff(np.append(start, len(t)))
        for k in np.flatnonzero(size > LEAF):
            yield tree(t.slice(start[k], size[k]))
        small = np.repeat(size <= LEAF, size)
        if small.any():
            yield leaves(t.filter(pa.array(small)), np.repeat(np.arange(len(size)), size)[small])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None  # the last rows, whose group may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if waiting is None else pa.concat_tables([waiting, t])
            if not len(t):
                continue
            last = np.all([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("value", "b1", "b2")], axis=0)
            done = int(np.argmax(last))
            waiting = t.slice(done)
            if done:
                yield from groups(t.slice(0, done))
        if waiting is not None:
            yield from groups(waiting)

    return run


def jaccard_components(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach) for each row of df.

    Two texts link when 100 * intersection >= percent * union of their shingle sets (percent of 50 or more). Texts with
    fewer words than a shingle have the whole sequence as one; texts without words, or null, have none and link with
    nothing: their component is their own id. Null ids keep their row; a component of null ids only is null. Rows that
    repeat id or text are rows like any other. Other columns of df are not carried. An empty df gives an empty result.

    Equal sets are one node (a 64-bit hash). Each set selects its first values in a common order (by hash, values that
    are frequent among the selected ones last), of which linked sets share one, so groups by selected value hold every
    link. Each group first links its members to its most central one; then the classes so found try a few members of
    other classes that share a group, and merge (ROUNDS, PARTNERS). Groups that still hold several classes go through
    signature trees: a dual traversal prunes node pairs by the most overlap that OR-ed bitmaps and size ranges allow,
    by equal class, and, so that no pair comes from more than one group, by earlier groups that all sets of both nodes
    share. Surviving pairs are verified on the whole sets, as are all links before.
    """
    with batch_rows(df.sparkSession, 500):
        return final_table(lambda: materialise(_components(df, words, percent, id_col, text_col), "similar"))


def _components(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sets, wide = recorded(lambda: materialise(docs.mapInArrow(_sets(words, percent), "doc_id long, h long, row long, id long, n long, picked array<long>, bits binary"), "sets"))
    firsts = sets.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    nodes = sets.join(_small(materialise(firsts.select("x.row"), "firsts")), "row").select("id", "n", "picked", "bits", F.col("doc_id").alias("least"), "h")
    texts = _Texts(docs, nodes)
    first_nodes = nodes
    nodes = final_table(lambda: _heavy_last(first_nodes, texts, words, percent))
    texts = _Texts(docs, nodes)
    sets = materialise(sets.select("doc_id", "n", "id"), "ids")
    drop_tables(df.sparkSession, wide)

    rows = nodes.select("id", F.explode("picked").alias("value"))
    counts = rows.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    groups = materialise(rows.join(counts, "value"), "groups")
    bits = nodes.select("id", "n", "bits")

    # Stars: each member of a group and the group's most central member.
    central = groups.groupBy("id").agg(F.sum("members").alias("weight"))
    best = groups.join(central, "id").groupBy("value").agg(F.max(F.struct("weight", F.expr("-id").alias("id"))).alias("best"))
    stars = groups.join(best, "value").select(F.col("id").alias("u"), (-F.col("best.id")).alias("v")).where("u != v").distinct()
    links = final_table(lambda: _verify(stars, bits, texts, words, percent, "links"))

    # A class is named by the least centre that one of its members links to.
    label = links.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    heads = links.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    label = label.unionAll(heads).groupBy("id").agg(F.max(F.struct((F.col("id") == F.col("label")).alias("own"), "label")).alias("x")).select("id", F.col("x.label").alias("label"))
    opened = _still_mixed(groups.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    found = [links.select("u", "v")]
    for k in range(ROUNDS):
        if opened.isEmpty():
            break
        more = final_table(lambda o=opened, k=k: _verify(_partners(o, bits, k), bits, texts, words, percent, "merges"))
        if more.isEmpty():
            break
        found.append(more.select("u", "v"))
        opened = _still_mixed(opened.join(_small(_merged_classes(opened, more)), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
    if not opened.isEmpty():
        found.append(final_table(lambda: _verify(_from_trees(opened, bits, percent), bits, texts, words, percent, "more", known=True)))

    roots = components(reduce(DataFrame.unionAll, found))
    member = sets.select("doc_id", "n", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = member.where("id is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of")
    return member.join(least, F.col("root") == F.col("of"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _small(d: DataFrame) -> DataFrame:
    """d, a table of a few long columns, broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(d) if d.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else d


def _still_mixed(labelled: DataFrame) -> DataFrame:
    """The rows (value, id, members, label, alike) of groups whose members are of different classes; one of groups with the same members (equal count and two xor-ed hashes of the ids), with their number."""
    labelled = labelled if "alike" in labelled.columns else labelled.withColumn("alike", F.lit(1).cast("long"))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.first("alike").alias("alike")).where("a != b")
    mixed = mixed.groupBy("k", "x", "y").agg(F.min("value").alias("value"), F.sum("alike").alias("alike")).select("value", "alike")
    return materialise(labelled.drop("alike").join(mixed, "value").select("value", "id", "members", "label", "alike"), "mixed")


def _partners(opened: DataFrame, bits: DataFrame, k: int) -> DataFrame:
    """(u, v) for classes to try: in each group one member of its largest class is the centre, and one member of each other class its partner, by hashes that differ by group and round.

    A class keeps the PARTNERS pairs that stand for most groups, and of them those that stand for a quarter or more of
    what a member selects: others hardly ever link, and are left to the trees.
    """
    one = opened.groupBy("value", "label", "alike").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "value", F.lit(k)).alias("h"), "id")).alias("one"))
    centre = one.groupBy("value").agg(F.max(F.struct("n", F.col("one.h").alias("h"), F.col("one.id").alias("id"), "label")).alias("c"))
    pairs = one.join(centre, "value").where(F.col("label") != F.col("c.label")).groupBy("label", F.col("c.label").alias("to")).agg(F.sum("alike").alias("alike"), F.min(F.struct("value", F.col("one.id").alias("a"), F.col("c.id").alias("b"))).alias("p"))
    pairs = pairs.join(bits.select(F.col("id").alias("a_id"), F.col("n").alias("size")), F.col("p.a") == F.col("a_id")).where(F.col("alike") * 20 >= F.col("size"))
    pairs = pairs.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(F.desc("alike"), "p"))).where(F.col("nth") <= PARTNERS)
    return pairs.select(F.greatest("p.a", "p.b").alias("u"), F.least("p.a", "p.b").alias("v")).distinct()


def _merged_classes(opened: DataFrame, links: DataFrame) -> DataFrame:
    """(label, to) of classes that links join with one of a lesser label: the least label linked to, and that one's in turn. Classes of one name are in one component; not every component is one class yet."""
    of = opened.select("id", "label").distinct()
    a, b = of.select(F.col("id").alias("u"), F.col("label").alias("lu")), of.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    edges = links.join(a, "u").join(b, "v").select("lu", "lv")
    step = edges.unionAll(edges.select(F.col("lv").alias("lu"), F.col("lu").alias("lv"))).groupBy("lu").agg(F.min("lv").alias("lv")).where("lv < lu")
    then = step.select(F.col("lu").alias("t"), F.col("lv").alias("tt"))
    return materialise(step.join(then, F.col("lv") == F.col("t"), "left").select(F.col("lu").alias("label"), F.coalesce("tt", "lv").alias("to")), "classes")


def _from_trees(opened: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different classes that may reach the similarity, from a signature tree for each group."""
    named = opened.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("value")), 1, NAMED).alias("named"))
    rows = opened.join(named.join(bits, "id"), "id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.hash("id"), blocks)
    dealt = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
    # Across two blocks a row stands on the side of its block; the pair of a block with itself has one side.
    side = F.when(F.col("b1") == F.col("b2"), 0).otherwise((F.col("own") == F.col("b2")).cast("int"))
    dealt = dealt.select("value", "b1", "b2", "id", "n", "label", side.alias("side"), "bits", "named")
    return dealt.repartition("value", "b1", "b2").sortWithinPartitions("value", "b1", "b2").mapInArrow(_tree_pairs(percent), "u long, v long").distinct()


class _Texts:
    """Texts of nodes, fetched from the documents by the node's least id and the text's hash; only texts that are asked for move."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes.select("id", "least", F.col("h").alias("of_h"))

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of a table of distinct node ids. Rows that repeat id and text come as often as they are there."""
        wanted = _small(materialise(self.nodes.join(ids, "id"), "wanted"))
        return self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("h") == F.col("of_h"))).select("id", "text")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each id in a task."""
    seen: set[int] = set()
    for b in batches:
        ids = b.column(0).to_pylist()
        keep = [not (i in seen or seen.add(i)) for i in ids]
        yield b.filter(pa.array(keep, pa.bool_()))


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def _own_text(words: int) -> Callable:
    """One row of each id in a task, and only if the text is that of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _once(batches):
            keep = [i == _node(shingles(t.as_py(), words)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def _heavy_last(nodes: DataFrame, texts: _Texts, words: int, percent: int) -> DataFrame:
    """nodes, with frequent values moved to the end of the order of sets that had selected one. They are known by a filter of fixed size, which is broadcast."""
    spark = nodes.sparkSession
    frequent = nodes.select(F.explode("picked").alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    frequent = materialise(frequent.select("value", F.floor(F.log2("n")).alias("power")), "frequent")
    least, room = 0, FILTER_BITS // 16  # of more frequent values than the filter has room for, the most frequent ones
    for r in frequent.groupBy("power").count().orderBy(F.desc("power")).collect():
        room -= r["count"]
        if room < 0:
            least = r.power + 1
            break
    filled = frequent.where(F.col("power") >= least).select("value").mapInArrow(_places(FILTER_BITS), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not filled.num_rows:
        return materialise(nodes, "nodes")
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    heavy = spark.sparkContext.broadcast(bits.tobytes())
    touched = nodes.select("id", "picked").mapInArrow(_touched(heavy), "id long")
    again = texts.of(touched).mapInArrow(_reselect(words, percent, heavy), "id long, picked array<long>").dropDuplicates(["id"]).select(F.col("id").alias("t_id"), F.col("picked").alias("again"))
    return materialise(nodes.join(again, F.col("id") == F.col("t_id"), "left").select("id", "n", F.coalesce("again", "picked").alias("picked"), "bits", "least", "h"), "nodes")


def _verify(pairs: DataFrame, bits: DataFrame, texts: _Texts, words: int, percent: int, name: str, known: bool = False) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity. known: their bitmaps have been compared."""
    if not known:
        left = bits.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
        right = bits.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
        fit = (F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent)
        pairs = pairs.join(left, "u").join(right, "v").where(fit).select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_plausible(percent), "u long, v long")
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    found = materialise(texts.of(ids).mapInArrow(_own_text(words), "id long, text string").dropDuplicates(["id"]), "texts")
    both = pairs.join(found.select(F.col("id").alias("u"), F.col("text").alias("x")), "u").join(found.select(F.col("id").alias("v"), F.col("text").alias("y")), "v")
    return materialise(both.select("u", "v", "x", "y").mapInArrow(_verified(words, percent), "u long, v long"), name)
