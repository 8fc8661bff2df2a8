"""The trie of the turns that conversations begin with.

Turns are told apart by SHA-256 of role and text, so texts stay where they are. Conversations that are equal as a whole are one
sequence with its number of members. Sequences are dealt by the digest of their first turn; a first turn with too many
different sequences is a node of its own, and its sequences are dealt by the next turn, as often as needed. What is dealt
together is built as tries of dictionaries in one pandas group and summed up in postorder. Turns beyond those that different
conversations share form chains, which need no trie.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import input_parts, lean, meet, shared_table, ship

#: Different sequences that a node may have below it to be built in one group, sequences that a group has about, turns that are hashed together.
LIMIT, GROUP, CHUNK = 256, 2000, 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), digest and chars of each turn, in the order of the turn column, null first, equal ones by digest.

    Rows are numbered in ranges of (conversation, turn) and moved by what the ranges before hold, so no conversation
    lands in one task. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), "digest", "row"]
    rows = shared_table(rows.repartitionByRange(input_parts(df), "conv", *order).withColumn("part", F.spark_partition_id()), "prefix-turns")
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).where("before > 0").drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    # A range begins within one conversation at most, so there are fewer rows with something before them than ranges.
    pos = (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long")
    return ranked.join(F.broadcast(before), ["conv", "part"], "left").select("conv", pos.alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``span``: (conv) of all, and their turns.

    The first h turns of conversation c - c % span, h being the CRC-32 of the number c modulo ``most``, then the own turns after the first h.
    """
    turns = shared_table(turns, "prefix-numbered")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    convs = turns.select("conv").distinct()
    heads = turns.where((F.col("conv") % span == 0) & (F.col("pos") < most)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    given = convs.withColumn("base", F.col("conv") - F.col("conv") % span).join(heads, "base", "left")
    given = shared_table(given.select("conv", F.coalesce(F.slice("head", F.lit(1), h.cast("int")), F.slice(F.array(F.struct(F.lit(1).cast("long").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"))), 1, 0)).alias("head")), "prefix-heads")
    first = given.select("conv", F.explode("head").alias("x")).select("conv", "x.*")
    own = turns.where(F.col("pos") > h).join(given.select("conv", F.size("head").alias("k")), "conv").select("conv", (F.col("pos") - h + F.col("k")).alias("pos"), "digest", "chars")
    return convs, first.unionByName(own)


def _chain(batches):
    """For each conversation the digest of its first chunk, first two chunks, and so on."""
    for batch in batches:
        conv, k, p, last = [], [], [], []
        for own, chunks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sha = hashlib.sha256()
            digests = chunks.values.field("digest").to_pylist()
            for i, d in enumerate(digests):
                sha.update(d)
                conv.append(own)
                k.append(i)
                p.append(sha.digest())
                last.append(i + 1 == len(digests))
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary()), pa.array(last, pa.bool_())], names=["conv", "k", "p", "last"])


def _hash_members(batches):
    """SHA-256 of the members of each class, whose blocks follow each other in order."""
    at, sha = None, None
    for batch in batches:
        p, ends = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != at:
                if at is not None:
                    p.append(at)
                    ends.append(sha.hexdigest())
                at, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(ends, pa.string())], names=["p", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["p", "ends"])


def _classes(members: DataFrame) -> DataFrame:
    """p, conv (the least), n and ends of all members (p, conv) with the same p.

    Members are joined in blocks of 65,536 numbers, so the task that hashes a large class reads one row for each block.
    """
    sizes = shared_table(members.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")), "prefix-sizes")
    several = sizes.where("n > 1").select("p", F.col("n").alias("w"))
    blocks = meet(members, shared_table(several, "prefix-several"), ["p"], "w", members.count()).groupBy("p", F.shiftright("conv", 16).alias("block"))
    blocks = blocks.agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    hashed = blocks.repartition("p").sortWithinPartitions("p", "block").mapInArrow(lean(_hash_members), "p binary, ends string")
    own = F.coalesce("ends", F.sha2(F.col("conv").cast("string").cast("binary"), 256))
    return shared_table(sizes.join(hashed, "p", "left").withColumn("ends", own), "prefix-classes")


_NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, path array<binary>"


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all sequences with the same key: dictionaries of children by digest, summed up in postorder without recursion.

    A row's key stands for the first ``off`` + 1 of its turns. The top nodes of the result carry key and path.
    """
    tops: dict[bytes, list] = {}
    # children, least member, members, ends, characters, children and saved characters of a chain that goes on here
    for r in rows.itertuples(index=False):
        node = tops.get(r.key)
        if node is None:
            node = tops[r.key] = [{}, r.conv, 0, _EMPTY, r.chars[r.off], 0, 0, r.off, r.path, r.parent]
        for i in range(r.off, len(r.digests)):
            if i > r.off:
                child = node[0].get(r.digests[i])
                if child is None:
                    child = node[0][r.digests[i]] = [{}, r.conv, 0, _EMPTY, r.chars[i], 0, 0]
                node = child
            node[1] = min(node[1], r.conv)
            node[2] += r.n
        if r.chained:
            node[5], node[6] = 1, r.chain_saved
        else:
            node[3] = r.ends
    out = []
    for key, top in tops.items():
        order, stack = [], [(top, top[7] + 1, top[9])]
        while stack:
            node, depth, parent = stack.pop()
            order.append((node, depth, parent))
            stack.extend((c, depth + 1, node[1]) for c in node[0].values())
        sums: dict[int, tuple[int, int]] = {}
        for node, depth, parent in reversed(order):
            below = [sums.pop(id(c)) for c in node[0].values()]
            leaves = sum(x[0] for x in below) + node[5] or 1
            saved = sum(x[1] for x in below) + node[6] + (node[2] - 1) * node[4]
            sums[id(node)] = leaves, saved
            is_top = node is top
            out.append((node[1], depth, parent, node[2], len(node[0]) + node[5], leaves, saved, node[3], key if is_top else None, list(top[8]) if is_top else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE_SQL.split(", ")])


def prefix_trie(convs: DataFrame, turns: DataFrame, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of all conversations ``convs`` (conv) with the ``turns`` (conv, pos from 1 on, digest, chars).

    A node stands for each different sequence of first turns, the root for none; members of a node are the conversations that begin with it. Columns:
    conv_id (the least member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes of
    its subtree), saved_tokens (over the subtree: (n_convs - 1) times the characters of the last turn), ends_sha256 (SHA-256 of the
    numbers of members that end here, ascending, joined by commas).

    Defined cases: a conversation without turns is a member of the root alone; no conversations give no rows. A pandas group holds the sequences of GROUP nodes
    about, and of one node ``limit`` different ones at most, each as far as different conversations share it and 2 * ``chunk`` turns more.
    """
    ship(turns.sparkSession)
    convs = shared_table(convs, "prefix-convs")
    first = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    if not first[0]:
        return turns.sparkSession.createDataFrame([], _NODE_SQL).drop("key", "path")
    chunks = turns.groupBy("conv", ((F.col("pos") - 1) / chunk).cast("int").alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("seq"))
    chunks = shared_table(chunks.withColumn("chars", F.aggregate("seq", F.lit(0).cast("long"), lambda a, x: a + x.chars)), "prefix-chunks")
    joined = F.aggregate("seq", F.lit(b""), lambda a, x: F.concat(a, x.digest))
    lists = chunks.select("conv", "k", F.unhex(F.sha2(joined, 256)).alias("digest")).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "digest"))).alias("chunks"))
    chain = shared_table(lists.mapInArrow(lean(_chain), "conv long, k int, p binary, last boolean"), "prefix-chain")
    members = convs.join(chain.where("last").select("conv", "p"), "conv", "left").select("conv", F.coalesce("p", F.lit(b"")).alias("p"))
    classes = _classes(shared_table(members, "prefix-members"))

    # How many chunks each class shares with others; the next one is its own, what follows is a chain.
    known = classes.where("p <> X''").select("conv", "n", "ends")
    own = chain.join(known.select("conv"), "conv")
    common = own.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = own.join(common.select("p"), "p").groupBy("conv").agg(F.count(F.lit(1)).alias("m"))
    of_class = shared_table(known.join(shared, "conv", "left").withColumn("m", F.coalesce("m", F.lit(0))), "prefix-shared")
    mine = chunks.join(of_class, "conv")
    after = F.coalesce(F.sum("chars").over(Window.partitionBy("conv").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = mine.where("k > m").withColumn("after", after)
    inner = F.sum("chars").over(Window.partitionBy("conv", "k").orderBy(F.desc("pos"))) + F.col("after")
    tails = tails.select("conv", "k", "n", "ends", "after", F.explode("seq").alias("x")).select("conv", "k", "n", "ends", "after", "x.*").withColumn("rest", inner)
    last = mine.groupBy("conv").agg(F.max(F.struct("k", F.size("seq").alias("s"))).alias("z")).select("conv", (F.col("z.k").cast("long") * chunk + F.col("z.s")).alias("end"))
    is_end = F.col("pos") == F.col("end")
    chains = tails.join(last, "conv").select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(is_end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(is_end, F.col("ends")).otherwise(_EMPTY).alias("ends_sha256"),
    )
    head = F.when(F.col("k") <= F.col("m"), F.struct("k", "seq"))
    seqs = mine.groupBy("conv", "n", "ends").agg(
        F.sort_array(F.collect_list(head)).alias("parts"), F.max(F.col("k") > F.col("m")).alias("chained"), ((F.col("n") - 1) * F.coalesce(F.sum(F.when(F.col("k") > F.col("m"), F.col("chars"))), F.lit(0))).alias("chain_saved"))
    seq = F.flatten(F.transform("parts", lambda x: x.seq))
    rows = seqs.select("conv", "n", "ends", "chained", "chain_saved", F.transform(seq, lambda x: x.digest).alias("digests"), F.transform(seq, lambda x: x.chars).alias("chars"))
    rows = rows.withColumns({"key": F.col("digests")[0], "off": F.lit(0), "path": F.array().cast("array<binary>"), "parent": F.lit(first[1])})

    ready, uppers, rows = None, None, shared_table(rows, "prefix-rows")
    while True:
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("conv").alias("least")).where(F.col("c") > limit)
        large = shared_table(large, "prefix-large")
        small = rows.join(large.select("key"), "key", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            break
        split = shared_table(meet(rows, large, ["key"], "c", rows.count()), "prefix-split")
        whole = F.size("digests") == F.col("off") + 1
        nodes = split.groupBy("key").agg(
            F.first("least").alias("conv_id"), (F.first("off") + 1).cast("long").alias("depth"), F.first("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"),
            F.first(F.col("chars")[F.col("off")]).alias("own"), F.coalesce(F.max(F.when(whole, F.col("ends"))), F.lit(_EMPTY)).alias("ends_sha256"), F.first("path").alias("path"))
        nodes = shared_table(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("own")), "prefix-upper")
        uppers = nodes if uppers is None else uppers.unionByName(nodes)
        further = split.where(~whole).withColumns({
            "path": F.concat("path", F.array("key")), "key": F.unhex(F.sha2(F.concat("key", F.col("digests")[F.col("off") + 1]), 256)), "off": F.col("off") + 1, "parent": F.col("least")})
        rows = shared_table(further.drop("least"), "prefix-rows")

    groups = ready.count() // GROUP + 1
    dealt = ready.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).repartition(min(groups, 1 << 16), "group")
    built = shared_table(dealt.groupBy("group").applyInPandas(build_tries, _NODE_SQL), "prefix-nodes")
    columns = [c.split()[0] for c in _NODE_SQL.split(", ")[:-2]]
    out = built.select(*columns).unionByName(chains)
    tops = built.where("key is not null").select("path", "n_leaves", "saved_tokens")
    if uppers is not None:
        last_of = lambda p: F.element_at(p, -1)
        given = tops.select(F.explode("path").alias("key"), last_of(F.col("path")).alias("above"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        from_upper = uppers.select(F.explode(F.concat("path", F.array("key"))).alias("key"), F.try_element_at("path", F.lit(-1)).alias("above"), F.lit(0).cast("long").alias("leaves"), "saved")
        sums = given.unionByName(from_upper).groupBy("key").agg(F.sum(F.when(F.col("key") == F.col("above"), 1).otherwise(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        out = out.unionByName(uppers.drop("saved").join(sums, "key").select(*columns))
        above = uppers.select("path", F.lit(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        tops = tops.unionByName(above)
    ends = classes.where("p = X''").select("ends")
    root = tops.withColumn("ends", F.lit(None).cast("string")).unionByName(ends, allowMissingColumns=True).agg(
        F.coalesce(F.sum(F.when(F.size("path") == 0, 1)), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(_EMPTY)).alias("ends_sha256"))
    root = root.withColumns({"conv_id": F.lit(first[1]), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(first[0]).cast("long")}).select(*columns)
    return out.unionByName(root)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*rebuilt(turns))


#: A conversation's turns as a list of (role, text); the CRC-32 is worked out over the digits of its number.
OP13_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS seq FROM turns GROUP BY 1),
h AS (
  SELECT conv_id, seq, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.seq, 1, h.h), []), coalesce(list_slice(h.seq, h.h + 1, len(h.seq)), [])) AS seq
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
member AS (SELECT conv_id, d AS depth, list_slice(seq, 1, d) AS prefix, len(seq) AS size FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM member GROUP BY 1, 2),
above AS (
  SELECT m.conv_id AS own, m.depth AS own_depth, n.conv_id, n.depth
  FROM node m JOIN member x ON x.conv_id = m.conv_id AND x.depth <= m.depth JOIN node n ON n.depth = x.depth AND n.prefix = x.prefix),
child AS (SELECT conv_id, depth, count(*) AS n_children FROM above WHERE own_depth = depth + 1 GROUP BY 1, 2),
own_value AS (
  SELECT n.conv_id, n.depth, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[n.depth].text) END AS saved
  FROM node n LEFT JOIN child c USING (conv_id, depth)),
total AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM above a JOIN own_value v ON v.conv_id = a.own AND v.depth = a.own_depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN own_value v USING (conv_id, depth) JOIN total t USING (conv_id, depth)
  LEFT JOIN above p ON p.own = n.conv_id AND p.own_depth = n.depth AND p.depth = n.depth - 1
"""
