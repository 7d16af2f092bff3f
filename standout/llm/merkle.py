"""A Merkle manifest of a dataset: a tree of digests for each value of a column, one over their roots, and a proof for each row."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import numbered, stored, table

#: Nodes that become one parent.
ARITY = 8
#: Nodes of one window partition, whole runs: no window sees more rows, whatever the size of a tree.
BLOCK = 64 * ARITY
#: Columns of a document that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value: no two rows give the same text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased; texts of single bytes take the shorter way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes ``(tree, size, place, digest, ...)`` with ``slot`` and the joined digests ``left`` and ``right`` of it in its run.

    Columns of fixed offsets back and ahead hold the neighbours; the slot masks those before the run, the length of the run
    (the last one of a tree may be shorter) those after it. Windows are blocks of whole runs.
    """
    near = Window.partitionBy("tree", F.floor(F.col("place") / BLOCK)).orderBy("place")
    slot = F.col("place") % ARITY
    run = F.least(F.lit(ARITY), F.col("size") - (F.col("place") - slot))
    offsets = range(1, ARITY)
    back = {f"_b{k}": F.lag("digest", k).over(near) for k in offsets}
    ahead = {f"_a{k}": F.lead("digest", k).over(near) for k in offsets}
    rows = nodes.withColumns(back | ahead).withColumns({"slot": slot, "_run": run})
    left = F.concat_ws("", *[F.when(F.col("slot") >= k, F.col(f"_b{k}")) for k in reversed(offsets)])
    right = F.concat_ws("", *[F.when(F.col("slot") + k < F.col("_run"), F.col(f"_a{k}")) for k in offsets])
    return rows.select(*nodes.columns, "slot", left.alias("left"), right.alias("right"))


def parent_place() -> Column:
    return ((F.col("place") - F.col("place") % ARITY) / ARITY).cast("long")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes ``(tree, size, place, digest)`` of each level, from the leaves up; a tree ends at its level of size 1.

    The first row of a run hashes its digest and those ahead of it to the parent. The driver learns the size of the largest
    tree only; each level is stored and an eighth of the one below.
    """
    out = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        first = with_siblings(out[-1].where("size > 1").select("tree", "size", "place", "digest")).where("slot = 0")
        out.append(
            stored(
                first.select(
                    "tree",
                    F.ceil(F.col("size") / ARITY).alias("size"),
                    parent_place().alias("place"),
                    F.sha2(F.concat("digest", "right"), 256).alias("digest"),
                ),
                "merkle-level",
            )
        )
        most = -(-most // ARITY)
    return out


def roots(nodes: Sequence[DataFrame]) -> DataFrame:
    """``(tree, digest)``: what remains of each tree."""
    tops = [level.where("size = 1").select("tree", "digest") for level in nodes]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def proofs(nodes: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path`` and the columns that ``above (tree, path, ...)`` has for the roots of the trees.

    A path is an array of (left, right) from the leaf up; that of a node is its own step and the path of its parent, so
    paths are built from the top and a parent's is joined to eight children at most.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    found: DataFrame | None = None
    for depth, level in reversed(list(enumerate(nodes))):
        top = level.where("size = 1").join(above, "tree").select(*level.columns, *more, "path")
        if found is not None:
            parents = found.select("tree", F.col("place").alias("_parent"), F.col("path").alias("_rest"), *more)
            inner = with_siblings(level.where("size > 1")).withColumn("_parent", parent_place()).join(parents, ["tree", "_parent"])
            step = F.array(F.struct("left", "right"))
            top = top.unionByName(inner.select(*level.columns, *more, F.concat(step, "_rest").alias("path")))
        found = stored(top, "merkle-paths") if depth else top
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, tree: str = "lang", order: str = "doc_id", **more: Column) -> DataFrame:
    """A row for each row of ``docs``: ``columns`` but text, ``leaf, subroot, root, path`` and the columns ``more``.

    The rows of each value of ``tree`` are the leaves of a tree in the order of ``order`` (NULL first, equal ones by digest);
    the roots of the trees, NULL first and then in the order of UTF-8 bytes, are the leaves of the last one. Runs of eight nodes
    become one; a run of one is hashed too. Any column may be NULL; repeated rows are leaves of their own; a tree of one leaf has
    it as subroot and a dataset of one tree its subroot as root. An empty table gives no rows. Only ``columns`` and those
    that ``more`` names are read. Texts are hashed where they are scanned and never shuffled.
    """
    keep = [c for c in columns if c != "text"]
    name = F.when(F.col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col(order).alias("at"), name.alias("tree"), leaf([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.lit(0).alias("_"), *[v.alias(k) for k, v in more.items()]).alias("more"),
    )
    leaves = numbered(stored(rows, "merkle-leaves"), ["tree"], ["at", "digest"], "place", "size")
    within = levels(leaves)
    names = stored(roots(within).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-roots")
    over = levels(numbered(names, ["tree"], ["name"], "place", "size"))
    end = roots(over).select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = proofs(over, end).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    rows = proofs(within, stored(above, "merkle-above"))
    return rows.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "path", *[f"more.{k}" for k in more])


def verified(listed: DataFrame, leaf_now: Column) -> DataFrame:
    """A manifest with ``folded_root``, from the present leaf and the listed path, and whether it is the root."""
    rows = listed.withColumn("folded_root", folded(leaf_now, F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


MANIFEST_SQL = """
WITH RECURSIVE enc AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, text,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM documents
), crc AS (
  SELECT d, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL)
), leaves AS MATERIALIZED (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(c, 4294967295::BIGINT) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now
  FROM enc LEFT JOIN crc ON d = CAST(doc_id AS VARCHAR)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves
), up AS (
  SELECT 0 AS lev, tree, place, size, leaf AS h FROM placed
  UNION ALL
  SELECT lev + 1, tree, place // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY lev, tree, place // 8
), subs AS MATERIALIZED (
  SELECT tree, h AS subroot, lev AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1
), over_ AS (
  SELECT 0 AS lev, place, size, subroot AS h FROM subs
  UNION ALL
  SELECT lev + 1, place // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM over_ WHERE size > 1 GROUP BY lev, place // 8
), nodes AS MATERIALIZED (
  SELECT lev, tree, place, size, h FROM up UNION ALL SELECT lev, '', place, size, h FROM over_
), steps AS MATERIALIZED (
  SELECT n.lev, n.tree, n.place,
         coalesce(string_agg(m.h, '' ORDER BY m.place) FILTER (WHERE m.place < n.place), '') AS lft,
         coalesce(string_agg(m.h, '' ORDER BY m.place) FILTER (WHERE m.place > n.place), '') AS rgt
  FROM nodes n JOIN nodes m ON m.lev = n.lev AND m.tree = n.tree AND m.place // 8 = n.place // 8 WHERE n.size > 1 GROUP BY ALL
), walk AS (
  SELECT 0 AS n, p.doc_id, p.tree AS own, p.leaf, p.place AS first, p.tree AS tree, 0 AS lev, p.place, p.now AS at, '' AS sibs,
         CASE WHEN p.size = 1 THEN 1 ELSE 0 END AS done FROM placed p
  UNION ALL
  SELECT w.n + 1, w.doc_id, w.own, w.leaf, w.first,
         CASE WHEN w.done = 1 THEN '' ELSE w.tree END, CASE WHEN w.done = 1 THEN 0 ELSE w.lev + 1 END,
         CASE WHEN w.done = 1 THEN b.place ELSE w.place // 8 END,
         CASE WHEN w.done = 1 THEN w.at ELSE sha256(s.lft || w.at || s.rgt) END, CASE WHEN w.done = 1 THEN w.sibs ELSE w.sibs || s.lft || s.rgt END,
         CASE WHEN w.done = 1 THEN CASE WHEN b.size = 1 THEN 2 ELSE 0 END
              WHEN w.tree = '' THEN CASE WHEN w.lev + 1 = (SELECT max(lev) FROM over_) THEN 2 ELSE 0 END
              ELSE CASE WHEN w.lev + 1 = b.height THEN 1 ELSE 0 END END
  FROM walk w JOIN subs b ON b.tree = w.own LEFT JOIN steps s ON s.tree = w.tree AND s.lev = w.lev AND s.place = w.place WHERE w.done < 2
)
SELECT w.doc_id, w.leaf, b.subroot, r.h AS root, sha256(w.sibs) AS proof_sha256, w.at AS folded_root, w.at = r.h AS verified
FROM walk w JOIN subs b ON b.tree = w.own CROSS JOIN (SELECT h FROM over_ WHERE size = 1) r WHERE w.done = 2
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against a copy in which every third document's text is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    changed = leaf([F.col(c) if c != "text" else lower_ascii(F.col(c)) for c in COLUMNS])
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    listed = verified(manifest(docs, changed=F.when(third, changed)), F.coalesce("changed", "leaf"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return listed.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
