"""Merkle manifest of a table, with a proof per row.

A level of the tree is text: the digests of its nodes, 64 hex digits each, one after
the other. Nodes are numbered within their group and cut into aligned blocks of
``WIDTH ** DEPTH``; a block keeps its lowest level as one string, and as parents are
hashes of fixed-width substrings, the levels above are strings of the same row. The
siblings of a node are what flanks it in its run, again two substrings. The tops of
the blocks are the nodes of a smaller table that is treated the same way, until every
group has one node, its subroot; the subroots are one more such table. Proofs then
come down: a block's siblings above it are joined to the block, never to its rows.
"""

from pyspark.sql import functions as F

from flowloom.llm.text import lower_ascii
from flowloom.operators import ordering
from flowloom.sources import scratch

WIDTH, DEPTH, HEX = 8, 3, 64
STEP = "struct<left: string, right: string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text):
    return F.sha2(text.cast("binary"), 256)


def leaf(columns):
    """The hash of a row's fields, each ``-`` when null, else its bytes' number, ``:``, itself."""

    def field(column):
        value = column.cast("string")
        return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest_of(F.concat(*[field(c) for c in columns]))


def _parents(level):
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / F.lit(WIDTH * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: digest_of(F.substr(level, r * WIDTH * HEX + 1, F.lit(WIDTH * HEX)))), "")


def _blocks(nodes):
    """One written row per block of numbered nodes: its members in order and its levels.

    ``nodes`` has _group, _at, _node and may have more; ``_rise`` is how many levels the
    block goes up: all, but for a group's only block, which stops at one node. Whether a
    block is the only one its number and size say; where a full first block is, it rises
    all levels too.
    """
    span = WIDTH**DEPTH
    rest = [c for c in nodes.columns if c not in ("_group", "_at")]
    members = F.array_sort(F.collect_list(F.struct("_at", *rest)))
    placed = nodes.withColumn("_block", F.floor(F.col("_at") / span).cast("long"))
    blocks = placed.groupBy("_group", "_block").agg(members.alias("_members"))
    rise = sum((F.size("_members") > WIDTH**k).cast("int") for k in range(DEPTH))
    blocks = blocks.withColumn("_rise", F.when(F.col("_block") > 0, F.lit(DEPTH)).otherwise(rise))
    blocks = blocks.withColumn("_l0", F.array_join(F.transform("_members", lambda m: m["_node"]), ""))
    for i in range(1, DEPTH + 1):
        blocks = blocks.withColumn(f"_l{i}", F.when(F.col("_rise") >= i, _parents(F.col(f"_l{i - 1}"))).otherwise(F.col(f"_l{i - 1}")))
    return scratch.materialise(blocks, "blocks")


def _siblings(i):
    """What flanks member ``i`` of a block on its way up, as (left, right) per level."""
    steps = []
    for k in range(DEPTH):
        level, at = F.col(f"_l{k}"), F.floor(i / WIDTH**k).cast("int")
        place = F.pmod(at, F.lit(WIDTH))
        left = F.substr(level, (at - place) * HEX + 1, place * HEX)
        right = F.substr(level, (at + 1) * HEX + 1, (WIDTH - 1 - place) * HEX)
        steps.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("_rise"))


def _climb(nodes):
    """(blocks from the bottom up, subroots): until every group has one node.

    A frame of blocks has ``_members``, numbered from the block's first; subroots are
    _group and _node.
    """
    stack = []
    while True:
        blocks = _blocks(nodes)
        stack.append(blocks)
        nodes = blocks.select("_group", F.col("_block").alias("_at"), F.col(f"_l{DEPTH}").alias("_node"))
        if nodes.filter("_at > 0").isEmpty():
            return stack, nodes.select("_group", "_node")


def _descend(stack, above):
    """Members of the lowest blocks with their whole path.

    ``above`` has _group, _path (the siblings over each group's top node) and _top.
    """
    paths = above.withColumn("_block", F.lit(0).cast("long"))
    for depth, blocks in reversed(list(enumerate(stack))):
        joined = blocks.join(paths.withColumnRenamed("_path", "_over"), ["_group", "_block"])
        place = lambda m: (m["_at"] - F.col("_block") * WIDTH**DEPTH).cast("int")
        met = F.transform("_members", lambda m: m.withField("_path", F.concat(_siblings(place(m)), F.col("_over"))))
        members = joined.select("_group", "_top", F.explode(met).alias("_m"))
        if depth:
            paths = members.select("_group", "_top", F.col("_m._at").alias("_block"), F.col("_m._path").alias("_path"))
    return members


def prove(docs, group="lang", order="doc_id", fields=FIELDS, carry=None):
    """Every row's place in the Merkle tree of the table.

    Returns ``order``, the columns of ``carry`` (name to column expression over
    ``docs``), group_key, position (in its group), leaf, subroot, root and path: the
    siblings (left and right of the node) of each level up to the root. A group's leaves ascend by ``order``,
    null first, then by leaf, and rows that are equal in both take any place: their leaves
    are the same. Groups ascend bytewise, null first; a null group and an empty one are two.
    A lone leaf is its group's subroot and a lone subroot the root; an empty table gives
    no row. No task holds a group: numbering is by range partitions, and all else is by
    blocks of ``WIDTH ** DEPTH`` nodes.
    """
    carry = carry or {}
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.hex(F.encode(F.col(group).cast("string"), "utf-8"))))
    rows = docs.select(
        key.alias("_group"), F.col(order).alias("_order"), leaf([F.col(c) for c in fields]).alias("_node"),
        F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("_carry"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    leaves = ordering.sorted_ordinal(rows, ["_order", "_node", "_tie"], ["_group"], name="_at").drop("_tie")
    stack, subroots = _climb(leaves)
    tops = ordering.sorted_ordinal(subroots.withColumnRenamed("_group", "_key"), ["_key"], name="_at")
    upper, roots = _climb(tops.withColumn("_group", F.lit("")))
    root = roots.head()
    start = roots.select("_group", F.array().cast(f"array<{STEP}>").alias("_path"), F.lit("").alias("_top"))
    over = _descend(upper, start).select(F.col("_m._key").alias("_group"), F.col("_m._path").alias("_path"), F.col("_m._node").alias("_top"))
    found = _descend(stack, over)
    return found.select(
        F.col("_m._order").alias(order), *[F.col(f"_m._carry.{n}").alias(n) for n in carry],
        F.col("_group").alias("group_key"), F.col("_m._at").alias("position"), F.col("_m._node").alias("leaf"),
        F.col("_top").alias("subroot"), F.lit(root and root["_node"]).alias("root"), F.col("_m._path").alias("path"),
    )


def fold(node, path):
    """The root that ``node`` gives with the siblings of ``path``."""
    return F.aggregate(path, node, lambda h, s: digest_of(F.concat(s["left"], h, s["right"])))


def digest(docs):
    """Each document's leaf, subroot, root and proof, checked after tampering.

    Where 3 divides the CRC-32 of the decimal doc_id, text is lower-cased (A-Z) before
    its leaf is computed again; a null id is never tampered with, nor a null text.
    """
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    changed = leaf([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    proved = prove(docs.select(*FIELDS), carry={"again": F.when(chosen, changed)})
    path = F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"])))
    folded = proved.select(
        "doc_id", "leaf", "subroot", "root", digest_of(F.array_join(path, "")).alias("proof_sha256"),
        fold(F.coalesce("again", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
    list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(c, x)), CAST(4294967295 AS BIGINT)) AS state
  FROM documents),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(state, 4294967295) % 3 = 0
         THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS again
  FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
low AS (
  SELECT 0 AS lvl, lang, pos, leaf AS node, n FROM p
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 8, n),
subroot AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, node, n FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8, n),
place AS (
  SELECT p.doc_id, p.lang, p.pos, p.leaf, p.again, s.pos AS spos, s.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root
  FROM p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang),
side AS (
  SELECT q.lang, q.pos, l.lvl, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (WHERE l.pos < q.pos // CAST(pow(8, l.lvl) AS BIGINT)), '') AS lft,
    coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (WHERE l.pos > q.pos // CAST(pow(8, l.lvl) AS BIGINT)), '') AS rgt
  FROM place q JOIN low l ON q.lang IS NOT DISTINCT FROM l.lang AND l.n > 1 AND l.pos // 8 = q.pos // CAST(pow(8, l.lvl + 1) AS BIGINT)
  GROUP BY q.lang, q.pos, l.lvl
  UNION ALL
  SELECT q.lang, q.pos, 100 + l.lvl, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (WHERE l.pos < q.spos // CAST(pow(8, l.lvl) AS BIGINT)), ''),
    coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (WHERE l.pos > q.spos // CAST(pow(8, l.lvl) AS BIGINT)), '')
  FROM place q JOIN high l ON l.n > 1 AND l.pos // 8 = q.spos // CAST(pow(8, l.lvl + 1) AS BIGINT)
  GROUP BY q.lang, q.pos, l.lvl),
step AS (SELECT lang, pos, lft, rgt, row_number() OVER (PARTITION BY lang, pos ORDER BY lvl) - 1 AS i FROM side),
proof AS (SELECT lang, pos, string_agg(lft || rgt, '' ORDER BY i) AS proof, count(*) AS steps FROM step GROUP BY lang, pos),
folded AS (
  SELECT lang, pos, 0 AS i, coalesce(again, leaf) AS node FROM place
  UNION ALL
  SELECT f.lang, f.pos, f.i + 1, sha256(s.lft || f.node || s.rgt) FROM folded f JOIN step s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND f.i = s.i)
SELECT q.doc_id, q.leaf, q.subroot, q.root, sha256(coalesce(r.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = q.root AS verified
FROM place q LEFT JOIN proof r ON q.lang IS NOT DISTINCT FROM r.lang AND q.pos = r.pos
JOIN folded f ON q.lang IS NOT DISTINCT FROM f.lang AND q.pos = f.pos AND f.i = coalesce(r.steps, 0)
"""
