"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with equal shingle sets are one node. Nodes whose signatures agree in a band are
candidates. A candidate pair's signatures are compared in batches; after each, the
posterior of its similarity decides whether the threshold is still within reach at the
chosen miss probability. Survivors are verified on their full sets.

Groups of copies can be of any size, so pairs are not written out for them:

* first every node of a bucket meets one node of it (another one in each band), and the
  links found are contracted to components;
* buckets that still hold several components go on in rounds: the node that is in the most
  crowded buckets, most often the text that the others were made from, meets the nodes of
  other components, leaves the bucket, and components are contracted again, as long as
  rounds pay;
* the nodes of what is left are dealt to blocks of bounded size, by that node of the largest
  bucket that they are in, so a crowd's nodes fill few blocks; two blocks that share a
  bucket meet in one task, which compares all pairs of different components there and
  returns no more links than it has nodes.

So every candidate pair is compared, or lies within one component already. Components
(not pairs) are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm import minhash
from rankweave.llm.common import map_groups, map_texts
from rankweave.llm.components import components
from rankweave.session import broadcast_if_small, stored

# 36 bands of 5: a pair at similarity 0.8 is no candidate with probability 6e-7.
BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
# Signature values compared before each decision, and the chosen miss probability.
STEP, MISS = 36, 1e-5
# A round is followed by another if it took off this share of what was left.
PAYS = 0.1
# Nodes of a block; two blocks meet in a task.
BLOCK = 512
# Parts that a component's nodes are dealt to when they meet its key.
SALTS = 32
# Columns of the indicator matrix that a task holds at once.
COLUMNS = 4096


def features(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, text_hash, node, hi, n, sig) of each row; ``node`` is a digest of the set."""

    def start():
        shingler = minhash.Shingler(width)

        def work(texts):
            node, hi, size, sig = [], [], [], []
            for said in texts:
                shingles = shingler.set_of(said)
                first, second = minhash.fingerprint(shingles)
                node.append(np.array([first, second]).tobytes())
                hi.append(first)
                size.append(len(shingles))
                sig.append(minhash.signature(shingles, HASHES).tobytes() if len(shingles) else b"")
            return None, [node, hi, size, sig]

        return work

    read = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(read, ["id", "text_hash"], "text", {"node": "binary", "hi": "long", "n": "long", "sig": "binary"}, start)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(key, text_hash, n_shingles, component_id, first) of each row of ``docs``.

    Rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word
    shingles; ``component_id`` is the smallest key that links reach, and ``first`` marks
    the rows of the one (key, text) that stands for the component. A text of fewer words
    is one shingle; without words it is linked with nothing. Null keys are passed over
    for a component's key unless it has no other. Repeated rows are all returned; other
    columns are not carried.
    """
    found = stored(features(docs, key, text, width), "features")
    order = F.struct(F.col("id").isNull().alias("void"), "id", "text_hash")
    nodes = stored(
        found.where(F.col("n") > 0)
        .groupBy("node", "hi")
        .agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(order).alias("rep")),
        "nodes",
    )
    members = stored(_members(nodes), "members")
    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    links = stored(_star_links(members, nodes, source, width, percent), "links")
    roots = stored(components(links, "a", "b"), "roots")
    # The hub of a bucket has met all its other nodes.
    rest = stored(_mixed(members.where(F.col("hi") != F.col("hub")), nodes, roots), "rest")
    left = rest.count()
    while left:
        central = stored(_central(rest), "central")
        roots = _linked(roots, stored(_star_links(central.where(F.col("label") != F.col("hub_label")), nodes, source, width, percent), "links"))
        rest = stored(_mixed(central.where(F.col("hi") != F.col("hub")), nodes, roots), "rest")
        before, left = left, rest.count()
        if left > (1 - PAYS) * before:
            break
    if left:
        roots = _linked(roots, stored(_block_links(rest, nodes, source, width, percent), "links"))
    # A component may hold a third of all nodes: its top has several copies to join with.
    linked = roots.join(nodes.select("node", "rep"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    tops = linked.groupBy("root").agg(F.min("rep").alias("top")).withColumn("salt", copies)
    topped = linked.join(tops, ["root", "salt"]).select("node", "top")
    placed = nodes.select("node", "rep").join(topped, "node", "left").select("node", F.coalesce("top", "rep").alias("top"))
    return found.select("id", "text_hash", "n", "node").join(placed, "node", "left").select(
        F.col("id").alias(key),
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("top.id")).alias("component_id"),
        (
            (F.col("n") == 0)
            | (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("text_hash") == F.col("top.text_hash")))
        ).alias("first"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component.

    Texts without words are in no component and stay. Of rows that repeat key and text,
    any one stays.
    """
    found = stored(near_duplicates(docs, key, text, width, percent).where("first"), "first")
    names = found.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"), "n_shingles")
    repeats = names.where("n_shingles > 0").groupBy("__key", "__hash").count().where("count > 1").isEmpty()
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash"))
    kept = docs.join(names.select("__key", "__hash").distinct(), same, "left_semi")
    if repeats:
        return kept
    # Repeated rows of a text with words: the first of equal ones, found in two parts.
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = kept.where(~wordless).dropDuplicates([key, text])
    return kept.where(wordless).unionByName(once)


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, hi, hub): the nodes of each bucket that has several, and one of them.

    The hub is the least node number after an exclusive or with the bucket's number, so
    every bucket has a hub of its own choice, found by partial aggregates.
    """
    size = ROWS * 2
    buckets = F.array(
        *[F.xxhash64(F.lit(b), F.substring("sig", b * size + 1, size)) for b in range(BANDS)]
    )
    rows = nodes.select("hi", F.explode(buckets).alias("bucket"))
    turned = F.col("hi").bitwiseXOR(F.col("bucket"))
    hubs = (
        rows.groupBy("bucket")
        .agg(F.min(turned).alias("low"), F.max(turned).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("hub"))
    )
    return rows.join(hubs, "bucket")


def _linked(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components of known ones and more links."""
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stored(components(known.unionByName(more), "a", "b"), "roots")


def _mixed(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, hi, hub, label, m): the buckets of several components, the nodes' labels, the bucket's size."""
    short = nodes.select("hi", "node").join(roots, "node").select("hi", F.xxhash64("root").alias("label"))
    named = members.select("bucket", "hi", "hub").join(short, "hi", "left").withColumn("label", F.coalesce("label", "hi"))
    mixed = (
        named.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("bucket", "m")
    )
    return named.join(mixed, "bucket")


def _central(rest: DataFrame) -> DataFrame:
    """(bucket, hi, label, hub, hub_label): each bucket's node that shares buckets with most nodes."""
    weights = rest.groupBy("hi").agg(F.sum("m").alias("weight"))
    weighed = rest.join(weights, "hi")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "hi", "label")).alias("h"))
    return rest.drop("hub").join(hubs, "bucket").select("bucket", "hi", "label", F.col("h.hi").alias("hub"), F.col("h.label").alias("hub_label"))


def _star_links(members: DataFrame, nodes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the verified pairs of a bucket's hub and its other nodes."""
    pairs = (
        members.where(F.col("hi") != F.col("hub"))
        .select(F.least("hi", "hub").alias("x"), F.greatest("hi", "hub").alias("y"))
        .distinct()
    )

    def side(name: str, on: str) -> DataFrame:
        return nodes.select(
            F.col("hi").alias(on), F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")
        )

    threshold = percent / 100

    def compare(batches):
        for batch in batches:
            a, b = (_signatures(batch.column(batch.schema.get_field_index(f"sig_{s}"))) for s in "ab")
            alive = pa.array(minhash.may_reach(a, b, threshold, MISS, STEP))
            yield batch.select(["a", "b"]).take(alive)

    near = (
        pairs.join(side("a", "x"), "x")
        .join(side("b", "y"), "y")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(compare, "a binary, b binary")
    )
    near = stored(near, "pairs")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(wanted, nodes, source, width), "sets")

    def verify(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(f"set_{s}")) for s in "ab")
            good = [
                minhash.share_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(a.to_pylist(), b.to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def held(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))

    return near.join(held("a"), "a").join(held("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(verify, "a binary, b binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _sets(wanted: DataFrame, nodes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the one text that stands for each.

    While few nodes are wanted their keys are broadcast, and no text is moved.
    """
    keys = nodes.join(wanted, "node", "left_semi").select(
        "node", F.col("rep.id").alias("r_id"), F.col("rep.text_hash").alias("r_hash")
    )
    picked = source.join(
        broadcast_if_small(keys), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
    )

    def start():
        shingler = minhash.Shingler(width)
        return lambda texts: (None, [[shingler.set_of(t).tobytes() for t in texts]])

    # Repeated rows of the text that stands for a node give its set again.
    return map_texts(picked, ["node"], "text", {"shingles": "binary"}, start).groupBy("node").agg(
        F.first("shingles").alias("shingles")
    )


def _block_links(rest: DataFrame, nodes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between nodes of different components that share a bucket of ``rest``."""
    # A node's home is the hub of the largest bucket that it is in; homes are cut to blocks.
    home = rest.groupBy("hi", "label").agg(F.max(F.struct("m", "bucket", "hub")).alias("home"))
    home = home.select("hi", "label", F.col("home.hub").alias("home"), F.pmod(F.xxhash64("hi"), F.lit(SALTS)).alias("salt"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    crowds = home.groupBy("home").agg(F.count("*").alias("crowd")).withColumn("salt", copies)
    part = F.pmod(F.xxhash64("hi", "label"), F.ceil(F.col("crowd") / BLOCK))
    block = stored(home.join(crowds, ["home", "salt"]).select("hi", "label", F.xxhash64("home", part).alias("block")), "blocks")
    present = rest.select("bucket", "hi", "label").join(block, ["hi", "label"]).select("bucket", "block").distinct()
    meet = (
        present.withColumnRenamed("block", "x")
        .join(present.withColumnRenamed("block", "y"), "bucket")
        .where(F.col("x") <= F.col("y"))
        .select("x", "y")
        .distinct()
    )
    asked = meet.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    rows = asked.join(
        block.join(nodes.select("hi", "node", "n", "sig"), "hi"), "block"
    ).select("x", "y", "block", "label", "node", "n", "sig")
    threshold = percent / 100

    def pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of pairs of different components that sizes allow, each pair once."""
        label, size = table["label"].to_numpy(), table["n"].to_numpy()
        a, b = np.triu_indices(len(label), 1)
        fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        if table["x"][0] != table["y"][0]:
            own = table["block"].to_numpy()
            fits &= own[a] != own[b]
        fits &= label[a] != label[b]
        return a[fits], b[fits]

    def start_signatures():
        def work(table: pa.Table):
            a, b = pairs_of(table)
            sig = _signatures(table["sig"])
            near = []
            for i in range(0, len(a), 20_000):
                x, y = a[i : i + 20_000], b[i : i + 20_000]
                alive = minhash.may_reach(sig[x], sig[y], threshold, MISS, STEP)
                near += [x[alive], y[alive]]
            if not near or not (rows := np.unique(np.concatenate(near))).size:
                return None
            kept = table.select(["x", "y", "block", "label", "node", "n"]).take(pa.array(rows))
            return kept.combine_chunks().to_batches()[0]

        return work

    survivors = stored(
        map_groups(rows, ["x", "y"], "x long, y long, block long, label long, node binary, n long", start_signatures), "near"
    )
    sets = _sets(survivors.select("node").distinct(), nodes, source, width)
    filled = survivors.join(sets, "node").select("x", "y", "block", "label", "node", "n", "shingles")

    def start_sets():
        def work(table: pa.Table):
            a, b = pairs_of(table)
            both = _intersections([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()])[a, b]
            size, label = table["n"].to_numpy(), table["label"].to_numpy()
            good = 100 * both >= percent * (size[a] + size[b] - both)
            node = table["node"].to_pylist()
            parent = {x: x for x in label.tolist()}
            links = []
            for i, j in zip(a[good].tolist(), b[good].tolist()):
                x, y = (_root(parent, int(label[k])) for k in (i, j))
                if x != y:
                    parent[x] = y
                    links.append((node[i], node[j]))
            if not links:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], ["a", "b"])

        return work

    return map_groups(filled, ["x", "y"], "a binary, b binary", start_sets)


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of indicator matrices."""
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared, at, often = np.unique(values, return_inverse=True, return_counts=True)
    # A shingle of one set alone is in no intersection.
    number = np.cumsum(often > 1) - 1
    owners, at = owners[often[at] > 1], number[at[often[at] > 1]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    owners, at = owners[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        first, last = np.searchsorted(at, [low, low + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[owners[first:last], at[first:last] - low] = 1
        total += matrix @ matrix.T
    return np.rint(total).astype(np.int64)
