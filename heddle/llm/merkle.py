"""Operator 13: a Merkle manifest of a dataset by time-forward processing.

A node's label is its level and place, so children come before their parents. Digests travel as messages to the
label of the parent that waits for them. The external priority queue that orders messages by label is the
exchange between chunks of consecutive nodes; within a chunk, which has CHUNK nodes at most, a heap is. A chunk sends one
digest on, so the next round has a CHUNK-th of the nodes. A reversed sweep then goes from the root down: what
a node's parent knows of its way to the root (the proof suffix) is delivered to the node, and in the end to the leaves.

Rows are ordered by tree and key in range partitions that are counted afterwards: no tree is gathered anywhere, be it a
third of all rows. Order: null keys first, then by key, of equal keys by leaf; of equal leaves it doesn't matter.
An empty table gives an empty result. Null fields count as ``-``, empty texts as ``0:``. A row whose doc_id is null
isn't tampered with. Repeated rows are leaves each. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Children of a node, and levels and nodes of a chunk.
ARITY, LEVELS = 8, 3
CHUNK = ARITY**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as a dash."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Order.
def placed(rows: DataFrame, tree: str | None, *keys: Column) -> DataFrame:
    """``rows`` with tree_at (the place of its tree's first row among all rows), pos (place in the tree, from 0) and size (the tree's
    rows), in order of ``tree`` (None: all rows are one) and keys; nulls first. Counts are kept for each
    partition and tree, a row each; rows are joined with those of their own partition."""
    names = shared.names_free(rows, "_salt", "_at", "_part", "_first", "_n")
    salt, at, part, first, n = names.values()
    order = ([F.col(tree).asc_nulls_first()] if tree else []) + [k.asc_nulls_first() for k in keys]
    salted = rows.withColumn(salt, F.monotonically_increasing_id())  # equal rows can be parted
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salted.repartitionByRange(parts, *order, salt).sortWithinPartitions(*order, salt)
    kept = shared.stored(ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33).cast("int")).drop(salt), "placed")
    key = F.col(tree) if tree else F.lit(0)
    counts = kept.groupBy(part, key.alias("_tree")).agg(F.count("*").alias(n), F.min(at).alias(first))
    # As many rows as partitions and trees; the running sums over partitions, and over a tree's.
    whole = counts.groupBy(part).agg(F.sum(n).alias("_rows"))
    whole = whole.select(part, (F.sum("_rows").over(Window.orderBy(part)) - F.col("_rows")).alias("_before"))
    counts = counts.join(whole, part).withColumn("_start", F.col("_before") + F.col(first) - F.shiftleft(F.col(part).cast("long"), 33))
    mine = Window.partitionBy("_tree")
    counts = counts.select(F.col(part).alias("_p"), "_tree", F.col(first).alias("_f"), F.min("_start").over(mine).alias("tree_at"), (F.sum(n).over(mine.orderBy(part)) - F.col(n)).alias("_done"), F.sum(n).over(mine).alias("size"))
    met = (kept[part] == counts["_p"]) & key.eqNullSafe(counts["_tree"])
    return kept.join(counts, met).withColumn("pos", F.col("_done") + F.col(at) - F.col("_f")).drop(at, part, "_p", "_tree", "_f", "_done")


# Within a chunk.
def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    up = 0
    while size > 1:
        size, up = -(-size // ARITY), up + 1
    return up


def climbed(digests: list[str], levels: int) -> tuple[str, list[tuple[tuple[int, int], list[str]]]]:
    """The digest that a chunk sends on, and its inner nodes in order of label with their children's digests. Messages
    (label of the receiver, place among its children, digest) wait in a heap."""
    if levels == 0:
        return digests[0], []
    queue = [((1, i // ARITY), i % ARITY, d) for i, d in enumerate(digests)]  # sorted, hence a heap
    seen: list[tuple[tuple[int, int], list[str]]] = []
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        seen.append((label, children))
        if label[0] < levels:
            level, i = label
            heapq.heappush(queue, ((level + 1, i // ARITY), i % ARITY, digest("".join(children))))
    return digest("".join(seen[-1][1])), seen


Suffix = list[list[str]]  # for each level upwards: the siblings to the left, and those to the right


def delivered(seen: list[tuple[tuple[int, int], list[str]]], levels: int, count: int, above: Suffix) -> Iterator[Suffix]:
    """The reversed sweep: labels fall, and each node hands its children their siblings and its own suffix. Yields those of
    the chunk's nodes in order."""
    queue: list[tuple[tuple[int, int], Suffix]] = [((-levels, 0), above)]
    at, out = len(seen) - 1, [above] * count
    while at >= 0:
        (level, i), suffix = heapq.heappop(queue)
        level, i = -level, -i
        children = seen[at][1]
        at -= 1
        for k in range(len(children)):
            mine = [["".join(children[:k]), "".join(children[k + 1 :])], *suffix]
            child = i * ARITY + k
            if level == 1:
                out[child] = mine
            else:
                heapq.heappush(queue, ((-(level - 1), -child), mine))
    return iter(out)


def folded(start: str, suffix: Suffix) -> str:
    """The root that a leaf's digest and its proof give."""
    for left, right in suffix:
        start = digest(left + start + right)
    return start


# Between chunks.
def forward(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, pos, digest, size) chunk by chunk until each tree has one: the rounds' tables, and (tree, digest)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t = group.sort_by("pos")
        size = t.column("size")[0].as_py()
        sent = climbed(t.column("digest").to_pylist(), min(LEVELS, height(size)))[0]
        columns = [pa.array([k.as_py()], pa.int64()) for k in key]
        return pa.table([*columns, pa.array([sent]), pa.array([-(-size // CHUNK)], pa.int64())], names=["tree", "pos", "digest", "size"])

    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        one, more = rounds[-1].filter("size = 1"), rounds[-1].filter("size > 1")
        sent = more.groupBy("tree", F.floor(F.col("pos") / CHUNK).alias("chunk")).applyInArrow(run, "tree long, pos long, digest string, size long")
        rounds.append(shared.stored(one.select("tree", "pos", "digest", "size").unionByName(sent), "nodes"))
    return rounds, rounds[-1].select("tree", "digest")


SUFFIX = "array<array<string>>"


def backward(rounds: list[DataFrame], tops: DataFrame, leaves) -> DataFrame:
    """The reversed sweep over forward()'s rounds. ``tops``: tree, suffix and columns to pass on with it. The first
    round's rows are given to ``leaves(rows, suffixes, what came with the suffix)``, which makes a table of them; see proofs()."""
    passed = tops.withColumn("pos", F.lit(0).cast("long"))
    carried = [c for c in tops.columns if c not in ("tree", "suffix")]
    make, kind = leaves

    def sweep(last: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            t = left.sort_by("pos")
            levels = min(LEVELS, height(t.column("size")[0].as_py()))
            found = delivered(climbed(t.column("digest").to_pylist(), levels)[1], levels, t.num_rows, right.column("suffix")[0].as_py())
            with_it = {c: right.column(c)[0].as_py() for c in carried}
            if last:
                return make(t, found, with_it)
            columns = [t.column("tree"), t.column("pos"), pa.array(list(found), pa.list_(pa.list_(pa.string())))]
            return pa.table(columns + [pa.array([with_it[c]] * t.num_rows, right.column(c).type) for c in carried], names=["tree", "pos", "suffix", *carried])

        return run

    between = ", ".join(["tree long", "pos long", f"suffix {SUFFIX}", *[f"{c} {tops.schema[c].dataType.simpleString()}" for c in carried]])
    for level, nodes in reversed(list(enumerate(rounds))):
        chunks = nodes.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
        above = passed.select("tree", F.col("pos").alias("chunk"), "suffix", *carried)
        done = chunks.groupBy("tree", "chunk").cogroup(above.groupBy("tree", "chunk")).applyInArrow(sweep(level == 0), kind if level == 0 else between)
        passed = done if level == 0 else shared.stored(done, "suffixes")
    return passed


def proofs(leaves: DataFrame, root: str) -> tuple:
    """What backward() does with leaves: their proof's digest, the root that it gives with the presented leaf, and whether it's the root."""

    def make(t: pa.Table, suffixes: Iterator[Suffix], with_it: dict) -> pa.Table:
        proof, got = [], []
        for shown, suffix in zip(t.column("presented").to_pylist(), suffixes, strict=True):
            proof.append(digest("".join(x for pair in suffix for x in pair)))
            got.append(folded(shown, suffix))
        n = t.num_rows
        columns = [t.column("doc_id"), t.column("digest"), pa.array([with_it["subroot"]] * n, pa.string()), pa.array([root] * n), pa.array(proof), pa.array(got), pa.array([g == root for g in got])]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = leaves.schema["doc_id"].dataType.simpleString()
    return make, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves``: doc_id, tree, leaf (digest) and presented (the digest to be verified). For each its subroot (of its tree), the root
    over all trees, the digest of its proof, the root that proof and presented leaf give, and whether that's the root."""
    found = placed(leaves.select("doc_id", "tree", "leaf", "presented"), "tree", F.col("doc_id"), F.col("leaf"))
    nodes = shared.stored(found.select("doc_id", F.col("leaf").alias("digest"), "presented", F.col("tree_at").alias("tree"), "pos", "size"), "leaves")
    rounds, subroots = forward(nodes)
    top = shared.stored(placed(subroots, None, F.col("tree")).select(F.lit(0).cast("long").alias("tree"), "pos", "digest", "size", F.col("tree").alias("below")), "subroots")
    above, roots = forward(top)
    root = roots.first()
    root = root["digest"] if root else ""

    def hand_down(t: pa.Table, suffixes: Iterator[Suffix], _: dict) -> pa.Table:
        return pa.table([t.column("below"), pa.array(list(suffixes), pa.list_(pa.list_(pa.string()))), t.column("digest")], names=["tree", "suffix", "subroot"])

    start = top.filter("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.array().cast(SUFFIX).alias("suffix"))
    tops = shared.stored(backward(above, start, (hand_down, f"tree long, suffix {SUFFIX}, subroot string")), "tops")
    return backward(rounds, tops, proofs(nodes, root))


def document_leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """Leaves of documents, a tree for each lang. Where ``tampered`` holds, a leaf with ``text`` instead is presented. Digests are made
    once, in the scan; the texts aren't moved."""
    values = [F.col(c) for c in FIELDS]
    changed = leaf(*values[:-1], text) if text is not None else leaf(*values)
    rows = docs.select("doc_id", F.col("lang").alias("tree"), leaf(*values).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), changed).alias("presented") if tampered is not None else F.lit(None).cast("string").alias("presented"))
    return shared.stored(rows, "digests").withColumn("presented", F.coalesce("presented", "leaf"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(document_leaves(docs, hit, shared.ascii_lower(F.col("text"))))


def levels_sql(nodes: str, name: str, up: int) -> str:
    """Tables {name}0 to {name}{up}: nodes (tree, pos, d, m) of each level; {name}s: siblings to both sides and the parent's place."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(up):
        out.append(f"{name}r{k} AS (SELECT tree, pos // 8 AS up, any_value(m) AS m, list(d ORDER BY pos) AS ds FROM {name}{k} WHERE m > 1 GROUP BY tree, pos // 8)")
        out.append(f"{name}{k + 1} AS (SELECT tree, up AS pos, sha256(array_to_string(ds, '')) AS d, (m + 7) // 8 AS m FROM {name}r{k} UNION ALL SELECT tree, pos, d, m FROM {name}{k} WHERE m = 1)")
    return ",\n".join(out)


#: Levels that the SQL goes up: enough for 8**LEVELS_SQL rows of a lang.
LEVELS_SQL = 7
STEP = "CASE WHEN b >= 0 THEN xor(c, b) ELSE c END"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN ({STEP}) % 2 = 1 THEN xor(({STEP}) // 2, 3988292384::BIGINT) ELSE ({STEP}) // 2 END), 4294967295::BIGINT)"


def leaf_sql(text: str) -> str:
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(f, [*[f'd.{c}' for c in FIELDS[:-1]], text]))})"


def way_sql(rows: str, name: str, tree: str, start: str) -> str:
    """Rows with left{k}, right{k} of each level of {name}."""
    sides = ", ".join(f"array_to_string({name}r{k}.ds[1 : ({start} // {8**k}) % 8], '') AS {name}l{k}, array_to_string({name}r{k}.ds[({start} // {8**k}) % 8 + 2 :], '') AS {name}g{k}" for k in range(LEVELS_SQL))
    joins = " ".join(f"LEFT JOIN {name}r{k} ON {name}r{k}.tree = r.{tree} AND {name}r{k}.up = {start} // {8 ** (k + 1)}" for k in range(LEVELS_SQL))
    return f"SELECT r.*, {sides} FROM ({rows}) r {joins}"


def fold_sql() -> str:
    """Steps of folding, one table for each level, those of the lang and then those above."""
    out, prior = [], "shown"
    for name in ("a", "b"):
        for k in range(LEVELS_SQL):
            out.append(f"f{name}{k} AS (SELECT *, CASE WHEN {name}l{k} IS NULL THEN f{len(out)} ELSE sha256({name}l{k} || f{len(out)} || {name}g{k}) END AS f{len(out) + 1} FROM {prior})")
            prior = f"f{name}{k}"
    return ",\n".join(out)


SQL = f"""WITH langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (SELECT d.doc_id, tree, {leaf_sql('d.text')} AS leaf, CASE WHEN {CRC} % 3 = 0 THEN {leaf_sql("translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf_sql('d.text')} END AS presented FROM documents d JOIN langs ON langs.lang IS NOT DISTINCT FROM d.lang),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM leaves),
{levels_sql('SELECT tree, pos, leaf AS d, m FROM ordered', 'a', LEVELS_SQL)},
{levels_sql(f'SELECT 0 AS tree, tree AS pos, d, count(*) OVER () AS m FROM a{LEVELS_SQL}', 'b', LEVELS_SQL)},
ways AS ({way_sql(f"SELECT o.*, s.d AS subroot, 0 AS one, t.d AS root, o.presented AS f0 FROM ordered o JOIN a{LEVELS_SQL} s ON s.tree = o.tree CROSS JOIN b{LEVELS_SQL} t", 'a', 'tree', 'r.pos')}),
shown AS ({way_sql('SELECT * FROM ways', 'b', 'one', 'r.tree')}),
{fold_sql()}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f"coalesce({n}l{k} || {n}g{k}, '')" for n in 'ab' for k in range(LEVELS_SQL))}) AS proof_sha256, f{2 * LEVELS_SQL} AS folded_root, f{2 * LEVELS_SQL} = root AS verified FROM fb{LEVELS_SQL - 1}"""
