"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups' roots.

Every node carries the interval of leaf ranks [lo, hi) that it covers. Leaves are cut by rank into runs of `arity **
levels`; a run holds the nodes of its own levels as arrays, and its top node is a leaf of the next tier, so that a tree
of any size takes a few tiers and no task sees more than a run. Downwards, each run meets the node that covers it by a
join on tree and interval bucket with containment as condition, and takes that node's way to the root. Siblings are the
nodes within the parent's interval that lie outside the node's own: those that end before it and those that begin after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .ranks import ranked

ARITY = 2
LEVELS = 10  # of a run
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: list[Column]) -> Column:
    """Lower-case hex sha256 of the values, one after the other: `-` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _hashed(nodes: Column, arity: int) -> Column:
    """The nodes above: every `arity` of them in a row become one, the last ones however few they are."""

    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * arity + 1, F.lit(arity))
        text = F.array_join(F.transform(run, lambda x: x["digest"]), "")
        return F.struct(F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(text, 256).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int")), parent)


def _runs(nodes: DataFrame, span: int, arity: int, levels: int) -> DataFrame:
    """tree, bucket, n, own, levels: the runs of `span` nodes with the levels above them, from the nodes themselves upwards, up
    to their top node. nodes: tree, index, lo, hi, digest, n (nodes of the tree on this tier), own (a struct that stays).
    """
    node = F.struct("index", "lo", "hi", "digest", "own")
    cut = nodes.groupBy("tree", F.floor(F.col("index") / span).alias("bucket"), "n").agg(F.array_sort(F.collect_list(node)).alias("run"))
    first = F.transform("run", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
    many = F.col("n") > span

    def climbed(done: Column, _: Column) -> Column:
        top = F.element_at(done, -1)
        return F.when(many | (F.size(top) > 1), F.concat(done, F.array(_hashed(top, arity)))).otherwise(done)

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(F.col("first")), climbed)
    cut = cut.select("tree", "bucket", "n", F.transform("run", lambda x: x["own"]).alias("own"), first.alias("first"))
    return cut.select("tree", "bucket", "n", "own", steps.alias("levels"))


def _entry(nodes: Column, arity: int, at: Column, lo: Column) -> Column:
    """The siblings of the node that covers leaf `lo`, among the run of `arity` nodes that its parent covers: at, counted in runs."""
    inside = F.slice(nodes, at * arity + 1, F.lit(arity))
    return F.struct(
        F.transform(F.filter(inside, lambda x: x["hi"] <= lo), lambda x: x["digest"]).alias("left"), F.transform(F.filter(inside, lambda x: x["lo"] > lo), lambda x: x["digest"]).alias("right")
    )


def _ways(runs: DataFrame, arity: int) -> DataFrame:
    """tree, lo, hi, digest, own, path, subroot, root of every node of the runs, which carry the rest of the path as above."""

    def way(i: Column) -> Column:
        lo = F.get(F.get("levels", F.lit(0)), i)["lo"]
        steps = F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda nodes, j: _entry(nodes, arity, F.floor(i / F.pow(F.lit(float(arity)), j + 1)).cast("int"), lo))
        return F.concat(steps, F.col("above"))

    each = F.transform("own", lambda own, i: F.struct(F.get(F.get("levels", F.lit(0)), i).alias("node"), own.alias("own"), way(i).alias("path")))
    out = runs.select("tree", "subroot", "root", F.explode(each).alias("_x"))
    return out.select("tree", "_x.node.lo", "_x.node.hi", "_x.node.digest", "_x.own", "_x.path", "subroot", "root")


def _tiers(nodes: DataFrame, largest: int, arity: int, levels: int) -> list[tuple[DataFrame, int]]:
    """The runs of each tier as tables, and the leaves that a run of it covers at most. largest: the leaves of the largest tree."""
    span, tiers = arity**levels, []
    covered = span
    while True:
        runs = written(_runs(nodes, span, arity, levels), "runs")
        tiers.append((runs, covered))
        if largest <= span:
            return tiers
        largest, covered = -(-largest // span), covered * span
        nodes = runs.where(F.col("n") > span).select("tree", F.col("bucket").alias("index"), "n", _top("levels").alias("top"))
        nodes = nodes.select("tree", "index", "top.lo", "top.hi", "top.digest", F.ceil(F.col("n") / span).alias("n"), F.struct("index").alias("own"))


def _top(levels: str) -> Column:
    return F.element_at(F.element_at(levels, -1), 1)


def forest(leaves: DataFrame, tree: str, order: list[str], leaf: str, own: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """tree, lo (the leaf's rank), hi, digest, own, path, subroot, root for every row of leaves.

    Each tree's leaves ascend by order; every arity nodes in a row are hashed to one while several remain, which gives the
    tree's subroot; subroots in the order of tree (null first) are hashed likewise to the root. path: for each level from
    the leaf to the root the digests of the siblings before the node (left) and behind it (right); a level whose node has
    none is there with two empty lists. own: a struct column of leaves that stays.
    """
    nodes = ranked(leaves.select(F.col(tree).alias("tree"), F.col(leaf).alias("digest"), F.col(own).alias("own"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), ["tree"], [f"_o{i}" for i in range(len(order))], "_rank", "_n")
    nodes = nodes.select("tree", F.col("_rank").alias("index"), F.col("_rank").alias("lo"), (F.col("_rank") + 1).alias("hi"), "digest", F.col("_n").alias("n"), "own")
    span = arity**levels
    tiers = _tiers(nodes, nodes.agg(F.max("n")).first()[0] or 0, arity, levels)
    tops = [runs.where(F.col("n") <= span).select("tree", _top("levels").alias("top"), F.lit(i).alias("tier")) for i, (runs, _) in enumerate(tiers)]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    roots = _over(written(subroots, "subroots"), arity, levels)
    ways = None
    for i in reversed(range(len(tiers))):
        runs, covered = tiers[i]
        upper = roots.where(F.col("tier") == i).drop("tier")
        upper = upper if ways is None else upper.unionByName(ways.select("tree", "lo", "hi", "path", "subroot", "root"))
        ways = _ways(_covered(runs, upper, covered), arity)
    return ways


def _covered(runs: DataFrame, upper: DataFrame, covered: int) -> DataFrame:
    """runs with the path of the node above that covers them, its subroot and its root."""
    up = upper.select(F.col("tree").alias("_t"), F.floor(F.col("lo") / covered).alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("above"), "subroot", "root")
    top = _top("levels")
    inside = (F.col("_lo") <= top["lo"]) & (top["hi"] <= F.col("_hi"))
    return runs.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_b")) & inside).drop("_t", "_b", "_lo", "_hi")


def _over(subroots: DataFrame, arity: int, levels: int) -> DataFrame:
    """tree, tier, lo, hi, path, subroot, root of each tree's top node (tree, top, tier): its way through the tree of trees."""
    rows = subroots.select(F.lit(0).alias("all"), "tree", F.struct("tree", "tier", F.col("top.lo").alias("lo"), F.col("top.hi").alias("hi")).alias("own"), F.col("top.digest").alias("digest"))
    nodes = ranked(rows, ["all"], ["tree"], "_rank", "_n").select(F.col("all").alias("tree"), F.col("_rank").alias("index"), F.col("_rank").alias("lo"), (F.col("_rank") + 1).alias("hi"), "digest", F.col("_n").alias("n"), "own")
    tiers = _tiers(nodes, nodes.agg(F.max("n")).first()[0] or 0, arity, levels)
    none, ways = F.array().cast("array<struct<left:array<string>,right:array<string>>>"), None
    for runs, covered in reversed(tiers):
        if ways is None:
            ways = _ways(runs.select("*", none.alias("above"), F.lit(None).cast("string").alias("subroot"), _top("levels")["digest"].alias("root")), arity)
        else:
            ways = _ways(_covered(runs, ways, covered), arity)
    return ways.select("own.tree", "own.tier", "own.lo", "own.hi", "path", F.col("digest").alias("subroot"), "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give: at each level the siblings before, the node, the siblings behind are hashed."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(F.array_join(step["left"], ""), node, F.array_join(step["right"], "")), 256))


def proof(path: Column) -> Column:
    """Lower-case hex sha256 of all siblings of the path, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: F.concat(step["left"], step["right"]))), ""), 256)


def manifest(df: DataFrame, fields: list[str], tree: str, order: str, keep: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """tree, lo, hi, digest (the leaf), own, path, subroot, root for every row of df: a leaf is the digest of its fields, a tree
    has the rows of one value of `tree`, in the order of `order` (null first) and of their digests where that is equal;
    rows equal in both are interchangeable. keep: a struct that stays as own. Other columns of df take no part. Without rows
    there is no tree.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    rows = df.select(F.col(f"`{tree}`").alias("_tree"), F.col(f"`{order}`").alias("_order"), digest([*cols.values()]).alias("_leaf"), (F.struct(F.lit(0).alias("none")) if keep is None else keep).alias("_own"))
    return forest(written(rows, "leaves"), "_tree", ["_order", "_leaf"], "_leaf", "_own", arity, levels)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and what a copy with tampered n_chars folds to.

    Rows that share a doc_id are leaves of their own, in the order of their digests; rows without one come first and are not
    tampered. A null n_chars stays null when tampered, so its leaf stays. Without siblings the proof is the hash of nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tampered = digest([F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in FIELDS])
    done = manifest(docs, list(FIELDS), "lang", "doc_id", F.struct("doc_id", F.when(hit, tampered).alias("tampered")))
    out = done.select(F.col("own.doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("own.tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sql() -> str:
    """Tree by tree and level by level: pairs of neighbours in a recursive query, crc32 bit by bit."""

    def field(c: str, plus: str = "") -> str:
        return f"coalesce(octet_length(encode(({c}{plus})::VARCHAR)) || ':' || ({c}{plus})::VARCHAR, '-')"

    leaf = "sha256(" + " || ".join(field(c) for c in FIELDS) + ")"
    tampered = "sha256(" + " || ".join(field(c, "::HUGEINT + 1" if c == "n_chars" else "") for c in FIELDS) + ")"
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = "list_reduce(range(8), lambda a, b: " + bit + ", xor(c, x))"
    crc = f"xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::UBIGINT), lambda c, x: {byte}, 4294967295::UBIGINT), 4294967295)"

    def climbed(start: str) -> str:
        return f"""
  SELECT tree, 0 AS level, i, h, n FROM {start}
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY i) AS after FROM {{}}) WHERE n > 1 AND i % 2 = 0"""

    return f"""
WITH RECURSIVE
d AS (SELECT *, {leaf} AS leaf, doc_id::VARCHAR AS s FROM documents),
c AS (SELECT *, coalesce({crc} % 7 = 0, false) AND n_chars IS NOT NULL AS hit FROM d),
l AS (
  SELECT doc_id, lang, leaf AS h, CASE WHEN hit THEN {tampered} ELSE leaf END AS own, coalesce(lang, '') || (lang IS NULL) AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM c),
nodes AS ({climbed("l").format("nodes")}),
subs AS (
  SELECT 'all' AS tree, t.tree AS lang_tree, t.h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT tree, lang FROM l) k JOIN nodes t USING (tree) WHERE t.n = 1),
tops AS ({climbed("subs").format("tops")}),
steps AS (
  SELECT l.doc_id, l.tree, l.i AS leaf_no, p.level, (p.i % 2) = 1 AS behind, s.h
  FROM l JOIN nodes p ON p.tree = l.tree AND p.i = l.i >> p.level AND p.n > 1
  LEFT JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1)
  UNION ALL
  SELECT l.doc_id, l.tree, l.i, 1000 + p.level, (p.i % 2) = 1, s.h
  FROM l JOIN subs b ON b.lang_tree = l.tree JOIN tops p ON p.i = b.i >> p.level AND p.n > 1
  LEFT JOIN tops s ON s.level = p.level AND s.i = xor(p.i, 1)),
paths AS (
  SELECT tree, leaf_no, string_agg(h, '' ORDER BY level) AS siblings,
         list({{'behind': behind, 'h': coalesce(h, '')}} ORDER BY level) AS path
  FROM steps GROUP BY tree, leaf_no),
done AS (
  SELECT l.doc_id, l.h AS leaf, b.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_transform(coalesce(path, []), lambda x: {{'behind': x.behind, 'h': x.h}}), lambda a, x: {{'behind': false, 'h': sha256(CASE WHEN x.behind THEN x.h || a.h ELSE a.h || x.h END)}}, {{'behind': false, 'h': own}}).h AS folded_root
  FROM l JOIN subs b ON b.lang_tree = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.leaf_no = l.i)
SELECT *, folded_root = root AS verified FROM done"""
