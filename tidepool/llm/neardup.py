"""N-gram Jaccard join by PartEnum signatures, and the groups that its links make."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Written, any_names, drawn_by_hash, map_columns
from .components import components
from .partenum import least_difference, shingles, signatures, sketch

#: Buckets of so many sets or fewer are compared pair by pair; rows of a block of a larger group.
SMALL, BLOCK = 8, 384
#: Documents whose shared passages are looked for, how many of them make a shingle common, and shingles kept, at most.
PASSAGE_SAMPLE, PASSAGE_COUNT, MOST_COMMON = 4000, 3, 60_000
#: Different sets of that sample that make a signature hot, and parts that a hot signature's sets are dealt to.
HOT_COUNT, SALTS = 12, 32
#: Bits of the filter that says which sets are candidates: fixed, so it is broadcast at 8 MB whatever the input.
FILTER_BITS = 26
#: Sets that a task remembers having signed, so that a large group of equal ones isn't signed over and over.
REMEMBERED = 200_000
#: Bytes of a shingle.
KEPT = 8
#: Rounds for all differences allowed: signatures grow with them, and are shuffled in rounds so that the disk they take doesn't.
ROUNDS = 20
#: Bytes of sets that a round of comparisons may shuffle besides as much as all sets have.
ROUND_BYTES = 64 << 20


def code(digest: bytes) -> int:
    """A set's node: the first 64 bits of its hash."""
    return int.from_bytes(digest[:8], "little", signed=True)


def node_of(items: np.ndarray, text: str | None) -> int:
    """A document's node: that of its set, and without words that of its text, since empty sets aren't copies."""
    return code(xxhash.xxh3_128_digest(items.tobytes() if len(items) else (text or "").encode()))


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, sid, node): the size and the 128-bit hash of each document's shingle set, and its ``node_of``."""

    def make():
        def work(doc_id: list, text: list) -> dict:
            items = [shingles(t, width) for t in text]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in items]
            return {"doc_id": doc_id, "n_shingles": [len(x) for x in items], "sid": digests, "node": [code(d) if len(x) else node_of(x, t) for d, x, t in zip(digests, items, text, strict=True)]}

        return work

    return map_columns(docs, "doc_id bigint, n_shingles bigint, sid binary, node bigint", make)


def sampled(docs: DataFrame) -> DataFrame:
    """About PASSAGE_SAMPLE of the documents, by a hash of their id. What comes of them only steers how work is dealt out."""
    return docs.where(drawn_by_hash("doc_id", docs.count(), PASSAGE_SAMPLE) & F.col("text").isNotNull())


def common_shingles(drawn: DataFrame, width: int) -> np.ndarray:
    """Shingles that several sampled documents hold. They only steer which signatures are weak."""

    def make():
        def work(doc_id: list, text: list) -> dict:
            return {"s": np.concatenate([np.unique(shingles(t, width)) for t in text]).view(np.int64)}

        return work

    counted = map_columns(drawn, "s bigint", make).groupBy("s").count().where(F.col("count") >= PASSAGE_COUNT)
    kept = counted.orderBy(F.desc("count"), "s").limit(MOST_COMMON).select("s").toArrow().column("s").to_numpy()
    return np.sort(kept.view(np.uint64))


def hot_signatures(drawn: DataFrame, width: int, num: int, den: int, common: np.ndarray) -> np.ndarray:
    """Signatures that many different sampled sets share, sorted; at most a HOT_COUNT-th of the sample's."""
    rows = signed(drawn, width, num, den, common, np.empty(0, dtype=np.uint64)).select("sig", "node").distinct()
    hot = rows.groupBy("sig").count().where(F.col("count") >= HOT_COUNT).select("sig").toArrow().column("sig").to_numpy()
    return np.sort(hot.view(np.uint64))


def rounds_of(num: int, den: int) -> int:
    return max(1, round(ROUNDS * (den - num) / (den + num)))


def signed(docs: DataFrame, width: int, num: int, den: int, common: np.ndarray, hot: np.ndarray, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(sig, salt, node, n): every set's signatures; the salt is 0, or which part of a hot signature's sets this is in.

    Of several rounds each gives the signatures with its remainder, so sets that share one meet in one round.
    """

    def make():
        seen: set[bytes] = set()

        def work(doc_id: list, text: list) -> dict:
            sigs, salts, nodes, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int8)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for t in text:
                items = shingles(t, width)
                digest = xxhash.xxh3_128_digest(items.tobytes())
                if digest in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                own, node = np.unique(signatures(items, num, den, common)), code(digest)
                own = own if rounds == 1 else own[own % np.uint64(rounds) == turn]
                at = np.minimum(np.searchsorted(hot, own), max(len(hot) - 1, 0))
                sigs.append(own)
                salts.append(np.where(hot[at] == own, node % SALTS + 1, 0).astype(np.int8) if len(hot) else np.zeros(len(own), np.int8))
                nodes.append(np.full(len(own), node, dtype=np.int64))
                sizes.append(np.full(len(own), len(items), dtype=np.int32))
            return {"sig": np.concatenate(sigs).view(np.int64), "salt": np.concatenate(salts), "node": np.concatenate(nodes), "n": np.concatenate(sizes)}

        return work

    return map_columns(docs, "sig bigint, salt tinyint, node bigint, n int", make)


def buckets(rows: DataFrame) -> DataFrame:
    """(sig, salt, node, n, members): the sets of every signature that at least two sets share, each once.

    ``members`` are those with the same signature and salt; a hot signature's parts all count as large.
    """
    order = Window.partitionBy("sig", "salt").orderBy("node")
    first = F.coalesce(F.lag("node").over(order) != F.col("node"), F.lit(True))
    marked = rows.withColumn("first", first).withColumn("members", F.sum(F.col("first").cast("int")).over(Window.partitionBy("sig", "salt")).cast("int"))
    members = F.when(F.col("salt") > 0, F.greatest("members", F.lit(SMALL + 1))).otherwise(F.col("members"))
    return marked.where("first").withColumn("members", members).where("members > 1").select("sig", "salt", "node", "n", "members")


def pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): candidate pairs. Small buckets give all theirs, large ones those of every member with one centre, the first.

    In a hot signature every part has a centre, and the parts' centres are paired with the first of them.
    """
    order = Window.partitionBy("sig", "salt").orderBy("node")
    member = F.struct("node", "n")
    before = F.collect_list(member).over(order.rowsBetween(-SMALL, -1))
    centre = F.array(F.first(member).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = shared.select("*", before.alias("before"), centre.alias("centre"))
    near = near.select("node", "n", F.explode(F.when(F.col("members") <= SMALL, F.col("before")).otherwise(F.col("centre"))).alias("p"))
    centres = shared.where("salt > 0").groupBy("sig", "salt").agg(F.min(member).alias("m")).select("sig", "m.*")
    top = F.first(member).over(Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))  # at most SALTS rows
    near = near.unionByName(centres.select("node", "n", top.alias("p")))
    fits = (F.least("n", "p.n") * den >= F.greatest("n", "p.n") * num) & (F.col("node") != F.col("p.node"))
    return near.where(fits).select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b")).distinct()


def candidate_filter(nodes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits of the nodes' low bits, built where the nodes are."""
    place = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # bitmap functions count from 1
    made = nodes.select(place.alias("x")).selectExpr("bitmap_bucket_number(x) as k", "bitmap_bit_position(x) as p").groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
    whole = bytearray((1 << FILTER_BITS) // 8)
    for r in made.collect():
        whole[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return bytes(whole)


def _listed(values: np.ndarray, bits: bytes) -> np.ndarray:
    at = values & ((1 << FILTER_BITS) - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


def candidate_sets(docs: DataFrame, width: int, wanted: bytes) -> DataFrame:
    """(node, items, sketch): the sets of candidate nodes, and of the few others that share their bit."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # 2**FILTER_BITS bits

    def make():
        seen: set[int] = set()
        bits = held.value

        def work(doc_id: list, text: list) -> dict:
            nodes, items, sketches = [], [], []
            for t in text:
                own = shingles(t, width)
                node = code(xxhash.xxh3_128_digest(own.tobytes()))
                at = node & ((1 << FILTER_BITS) - 1)
                if not len(own) or node in seen or not bits[at >> 3] >> (at & 7) & 1:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                nodes.append(node)
                items.append(own.tobytes())
                sketches.append(sketch(own))
            return {"node": nodes, "items": items, "sketch": sketches}

        return work

    return map_columns(docs, "node bigint, items binary, sketch binary", make)


def unpack(items: bytes) -> np.ndarray:
    return np.frombuffer(items, dtype=np.uint64)


def turns_for(moved: int, sets: DataFrame) -> int:
    """Rounds, so that none shuffles many more than the bytes of all sets where ``moved`` bytes are to be compared."""
    held = sets.agg(F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()[0]
    return -(-moved // max(held, ROUND_BYTES)) or 1


def likely(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, bytes): the candidate pairs whose sketches don't show that they differ by too much; the bytes of a's set.

    Sketches have a sixteenth of their sets' bytes at most, beyond the smallest. They rule out no pair that reaches the threshold.
    """
    left = sets.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    both = candidates.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")

    def make():
        def work(b: list, a: list, x: list, y: list) -> dict:
            out = {"a": [], "b": [], "bytes": []}
            for p, q, left, right in zip(a, b, x, y, strict=True):
                n, m, differ = least_difference(left, right)
                if differ * (den + num) <= (n + m) * (den - num):
                    out["a"].append(p)
                    out["b"].append(q)
                    out["bytes"].append(n * KEPT)
            return out

        return work

    return map_columns(both, "a bigint, b bigint, bytes bigint", make)


def linked(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> list[Written]:
    """(u, v) of each round: the candidate pairs whose sets reach the threshold.

    What meets its sets is the pairs that their sketches leave, in rounds, so that pairs in any number take the disk of a few
    times all sets.
    """
    pairs_ = Written(likely(candidates, sets, num, den), "likely-pairs")
    rounds = turns_for(pairs_.df.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], sets)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def make():
        def work(b: list, a: list, x: list, y: list) -> dict:
            u, v = [], []
            for p, q, left, right in zip(a, b, x, y, strict=True):
                n, m = len(left) // KEPT, len(right) // KEPT
                same = len(np.intersect1d(unpack(left), unpack(right), assume_unique=True))
                if same * den >= num * (n + m - same):
                    u.append(p)
                    v.append(q)
            return {"u": u, "v": v}

        return work

    made = []
    for turn in range(rounds):
        now = pairs_.df.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == turn).select("a", "b")
        both = now.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")
        made.append(Written(map_columns(both, "u bigint, v bigint", make), "links"))
    pairs_.drop()
    return made


def open_groups(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): members of large buckets that hold several components so far; the root names their group.

    Large buckets that share a member are one group, since near copies in great number meet in many buckets.
    """
    named = shared.where(F.col("members") > SMALL).select("sig", "salt", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = Written(named, "large-buckets")
    parts = named.df.groupBy("sig", "salt").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("centre"))
    parts = Written(parts, "large-bucket-parts")
    several = parts.df.groupBy("sig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("centre").alias("top")).where("lo <> hi").select("sig", "top")
    open_ = parts.df.join(several, "sig").select("sig", "salt", "centre", "top")
    ties = named.df.join(open_, ["sig", "salt"]).select(F.col("node").alias("u"), F.col("centre").alias("v"))
    ties = Written(ties.unionByName(open_.select(F.col("centre").alias("u"), F.col("top").alias("v"))).distinct(), "open-buckets")
    made = components(ties.df)
    for table in (named, parts, ties):
        table.drop()
    return made


def linked_in_groups(groups: DataFrame, sets: DataFrame, num: int, den: int) -> list[Written]:
    """(u, v) of each round: links that tie each group as all links within it do.

    A group is split by size, into classes so wide that only sets of one class or of neighbours can be similar, and classes
    into blocks. Every two blocks that may hold similar sets meet in one task, so no task holds more than two blocks. Of a
    meeting's links a spanning forest comes back. A set goes to as many meetings as its group has blocks; they are held in
    rounds, so that the disk for this grows with the sets and not with a group's square.
    """
    width = math.log(den / num)
    sized = groups.join(sets.hint("shuffle_merge"), "node").withColumn("class", F.floor(F.log(F.octet_length("items") / KEPT) / width + 1e-9))
    held = Written(sized.select("root", "class", "node", "items"), "group-sets")
    sized = held.df
    counts = sized.groupBy("root", "class").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("blocks"))
    order = Window.partitionBy("root").orderBy("class")
    beside = lambda step: F.when(F.lag("class", -step).over(order) == F.col("class") + step, F.lag("blocks", -step).over(order)).otherwise(0)
    counts = counts.select("root", "class", "blocks", beside(-1).alias("below"), beside(1).alias("above"))
    counts = Written(counts, "group-blocks")
    moved = F.octet_length("items") * (F.col("blocks") + F.col("below") + F.col("above"))
    rows = sized.join(counts.df, ["root", "class"])
    rounds = turns_for(rows.agg(F.coalesce(F.sum(moved), F.lit(0))).first()[0], sets)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    place = lambda low, high, i, j: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))
    each = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda x: x < n), f)
    c, own = F.col("class"), F.col("own")
    meetings = F.concat(
        each(F.col("blocks"), lambda x: place(c, c, F.least(own, x), F.greatest(own, x))),
        each(F.col("above"), lambda x: place(c, c + 1, own, x)),
        each(F.col("below"), lambda x: place(c - 1, c, x, own)),
    )
    rows = rows.select("root", "node", "items", F.explode(meetings).alias("at")).select("root", "at.*", "node", "items")
    keys = ["root", "low", "high", "i", "j"]

    def meet(block: pa.Table) -> pa.Table:
        nodes = block.column("node").to_pylist()
        sets_ = [unpack(x) for x in block.column("items").to_pylist()]
        sizes = np.array([len(s) for s in sets_])
        _, column, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets_)), sizes)
        shared = times > 1  # what one set alone holds is in no intersection
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        width = int(shared.sum())
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        same = np.zeros((len(sets_), len(sets_)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, width, 8192):  # dense slices of the membership matrix, multiplied with themselves
            a, b = np.searchsorted(column, [low, low + 8192])
            dense = np.zeros((len(sets_), min(8192, width - low)), dtype=np.float32)
            dense[row[a:b], column[a:b] - low] = 1
            same += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - same
        u, v = [], []
        for i, j in zip(*np.nonzero(np.triu(same * den >= num * union, 1)), strict=True):
            a, b = find(int(i)), find(int(j))
            if a != b:
                parent[a] = b
                u.append(nodes[i])
                v.append(nodes[j])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    made = []
    for turn in range(rounds):
        now = rows.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == turn)
        made.append(Written(now.groupBy(*keys).applyInArrow(meet, "u bigint, v bigint"), "group-links"))
    held.drop()
    counts.drop()
    return made


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A document's set holds its distinct ``width``-word shingles; two documents link when intersection * den >= num * union.
    component_id is the smallest id reachable by links, the document's own included. All links between different sets count:
    small buckets are compared pair by pair, large ones with a centre first and, where that leaves several components, in
    blocks. Equal sets are one node (by a 64-bit hash) and are never paired.

    Null or blank text, or no words: an empty set, no links, component_id = doc_id. Null ids: their text takes part;
    component_id is then null unless a document with an id is reachable. Repeated rows: each comes back. Empty table: no
    rows. Extra columns: ignored.
    """
    return members(docs, width, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``groups`` with their set's node and its component's root, null for an empty set."""
    if not 0 < num <= den:
        raise ValueError("the threshold num / den must be above 0 and at most 1")
    docs = _text(docs, id_col, text_col)
    own = Written(sets_of(docs, width), "sets").df
    if num == den:  # only equal sets link, and they are one node
        roots = own.where("n_shingles > 0").select("node", F.col("node").alias("root")).distinct()
    else:
        roots = linked_roots(docs, width, num, den)

    # The smallest id of each set, then of each component, comes back to the documents.
    classes = own.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.select("node", "root").join(least, "root").select("node", "root", "component_id")
    some = own.where("n_shingles > 0").join(final, "node").select("doc_id", "n_shingles", "node", "root", "component_id")
    return some.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", "node", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id")))


def linked_roots(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) of every set that links with another one."""
    drawn = sampled(docs)
    common = common_shingles(drawn, width)
    hot = hot_signatures(drawn, width, num, den, common)
    rounds = rounds_of(num, den)
    turns = [Written(buckets(signed(docs, width, num, den, common, hot, turn, rounds)), "buckets") for turn in range(rounds)]
    shared = reduce(DataFrame.unionByName, [t.df for t in turns])
    candidates = Written(pairs(shared, num, den), "pairs")
    wanted = candidates.df.select(F.col("a").alias("node")).union(candidates.df.select("b")).union(shared.where(F.col("members") > SMALL).select("node"))
    sets = Written(candidate_sets(docs, width, candidate_filter(wanted)).dropDuplicates(["node"]), "candidate-sets")
    links = linked(candidates.df, sets.df, num, den)
    candidates.drop()
    roots = components(reduce(DataFrame.unionByName, [x.df for x in links]))
    more = linked_in_groups(open_groups(shared, roots), sets.df, num, den)
    if not all(x.df.isEmpty() for x in more):
        roots = components(reduce(DataFrame.unionByName, [x.df for x in [*links, *more]]))
    for table in (*turns, sets, *links, *more):
        table.drop()
    return roots


@any_names
def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all their columns unchanged, of one document of each group: the one whose id names it.

    A document is an id and a set: rows that share an id but are of different groups each stay, those of one group are one.
    A row without an id stays where no row of its group has one, one for each group. Rows without words stay, one for each
    id and text. Only rows whose id may be among those dropped or repeated, or is null, are joined; a bitmap of fixed size
    tells the others.
    """
    rows = Written(members(docs, width, num, den, id_col, text_col), "groups").df
    again = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    names = F.col("doc_id").eqNullSafe(F.col("component_id"))
    copies = rows.where(~names).select("doc_id", "node")
    # Different sets of one group under the id that names it, or all without one: the least set stays.
    several = rows.where(names & F.col("root").isNotNull()).groupBy("doc_id", "root").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    several = several.select(F.col("doc_id").alias("d"), "root", "lo")
    others = rows.where(names).join(several, "root").where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") != F.col("lo"))).select("doc_id", "node")
    dropped = copies.unionByName(others).distinct()
    listed = candidate_filter(copies.select("doc_id").where(F.col("doc_id").isNotNull()).union(again).select(F.col("doc_id").alias("node")))
    held = docs.sparkSession.sparkContext.broadcast(listed)  # 2**FILTER_BITS bits

    def mark(batches):
        for batch in batches:
            ids = batch.column(id_col).cast(pa.int64())
            may = _listed(ids.fill_null(0).to_numpy(), held.value) | ~ids.is_valid().to_numpy(zero_copy_only=False)
            at, nodes = np.flatnonzero(may), [None] * batch.num_rows
            for i, t in zip(at.tolist(), batch.column(text_col).take(pa.array(at)), strict=True):
                t = t.as_py()
                nodes[i] = node_of(shingles(t, width), t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, node])

    node = "_may_be_dropped"
    while node in docs.columns:
        node += "_"
    marked = docs.mapInArrow(mark, StructType([*docs.schema, StructField(node, LongType())]))
    asked, dropped = marked.where(F.col(node).isNotNull()), dropped.select(F.col("doc_id").alias("_" + node), F.col("node").alias("__" + node))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_" + node)) & (F.col(node) == F.col("__" + node))
    kept = asked.join(dropped, same, "left_anti").dropDuplicates([id_col, node])
    return marked.where(F.col(node).isNull()).unionByName(kept).drop(node)
