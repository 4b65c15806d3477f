"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of a base conversation and a suffix of its
own turns. Its texts are never put together: the fingerprint of a sequence of
turns is its hash product (B^length, sum of t_i B^i modulo a prime), which is a
monoid with inverses, so the product of a base head with an own suffix follows
from two running products of the original turns. Groups of equal products at a
depth are the trie's nodes; each stores the turn it ends with by reference (the
conversation and position it comes from). Their equality is verified: all
members of a node must have the same parent node and the same last turn, and
turns of one hash the same role and text; if that fails, all is drawn anew with
another seed.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import broadcast_if_small, stage

PRIME = 2**31 - 1
#: Independent products; two are packed into one long, so that a key has 124 bits.
LANES = 4
#: Turns of a base that a rebuilt conversation can begin with.
MOST_HEAD = 3
#: Fixed value: characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
SPAN_BITS, SPANS = 6, 6


def table_of(numbers) -> Column:
    return F.expr("array(" + ", ".join(f"{x}L" for x in numbers) + ")")


def power(exponent: Column, base: int, prime: int) -> Column:
    """base ^ exponent modulo prime, exponent under 2 ** 36, by its digits."""
    out = None
    for digit in range(SPANS):
        step = pow(base, 1 << (SPAN_BITS * digit), prime)
        at = F.shiftright(exponent.cast("long"), SPAN_BITS * digit).bitwiseAND(2**SPAN_BITS - 1).cast("int")
        one = F.get(table_of(pow(step, i, prime) for i in range(2**SPAN_BITS)), at)
        out = one if out is None else out * one % prime
    return out


def packed(lanes: list[Column], prefix: str) -> list[Column]:
    """Two longs of the four lanes."""
    return [F.shiftleft(lanes[2 * i].cast("long"), 31).bitwiseOR(lanes[2 * i + 1].cast("long")).alias(f"{prefix}{i + 1}") for i in range(LANES // 2)]


class Collision(Exception):
    """Two different sequences or turns have one fingerprint."""


def hashed(turns: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text without nulls (turn may be), and two hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumns({f"h{i}": F.xxhash64(F.lit(2 * seed + i), "role", "text") for i in (1, 2)})


def verify_turns(rows: DataFrame, slim: DataFrame) -> None:
    """Turns with equal hashes must be equal. Only texts of hashes that repeat
    are shuffled, reduced to the least and greatest in each task first."""
    again = stage(slim.groupBy("h1", "h2").count().filter("count > 1").drop("count"), "trie-again")
    repeated = rows.join(broadcast_if_small(again, 1_000_000), ["h1", "h2"], "left_semi")
    content = F.struct("role", "text")
    if not repeated.groupBy("h1", "h2").agg(F.min(content).alias("a"), F.max(content).alias("b")).filter("a <> b").isEmpty():
        raise Collision


def place(slim: DataFrame, bases: list[int], prime: int) -> DataFrame:
    """Position of each turn in its conversation (from 1), the running product
    s0.. up to it and its own term t0.. of that.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any
    length is spread over tasks; products of what lies before in other tasks
    are added for the conversations that span several, two a task at most."""
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2", "row"]
    dealt = stage(slim.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-dealt")
    w = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("i", F.row_number().over(w))
    for k, b in enumerate(bases):
        content = F.shiftright(F.col(f"h{k // 2 + 1}"), 31 * (k % 2)).bitwiseAND(2**31 - 1) % prime
        rows = rows.withColumn(f"t{k}", content * power(F.col("i"), b, prime) % prime)
    for k in range(LANES):
        rows = rows.withColumn(f"s{k}", F.sum(f"t{k}").over(w) % prime)
    totals = dealt.groupBy("part", "conv_id").count()
    spanning = totals.join(broadcast_if_small(stage(totals.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id"), "trie-spanning"), 1_000_000), "conv_id", "left_semi")
    ends = rows.join(F.broadcast(spanning), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.max("i").alias("n"), *[F.max_by(f"s{k}", "i").alias(f"s{k}") for k in range(LANES)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, b in enumerate(bases):
        ends = ends.withColumn(f"c{k}", F.coalesce(F.sum(F.col(f"s{k}") * power(F.col("n0"), b, prime) % prime).over(before), F.lit(0)) % prime)
    carry = stage(ends.select("part", "conv_id", "n0", *[f"c{k}" for k in range(LANES)]), "trie-carry")
    found = rows.join(F.broadcast(carry), ["part", "conv_id"], "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
    lanes = []
    for k, b in enumerate(bases):
        shift = F.when(F.col("n0") == 0, F.lit(1)).otherwise(power(F.col("n0"), b, prime))
        lanes += [((F.coalesce(f"c{k}", F.lit(0)) + shift * F.col(f"s{k}")) % prime).cast("int").alias(f"s{k}"), (shift * F.col(f"t{k}") % prime).cast("int").alias(f"t{k}")]
    return found.select("part", "conv_id", (F.col("n0") + F.col("i")).alias("pos"), "words", "h1", "h2", *lanes)


def rebuild(placed: DataFrame, base: Column, head: Column, bases: list[int], prime: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv_id, depth, key k1 k2, parent's key p1 p2, last turn by hash
    and reference) of all rebuilt conversations, and the end of each."""
    numbers = range(1, MOST_HEAD + 1)
    fields = [*[f"s{k}" for k in range(LANES)], "words", "h1", "h2"]
    each = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), *[F.max_by(f"s{k}", "pos").alias(f"e{k}") for k in range(LANES)], *[F.max(F.when(F.col("pos") == j, F.col(f))).alias(f"{f}_{j}") for j in numbers for f in fields])
    each = stage(each, "trie-each")
    heads = each.select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST_HEAD)).alias("there"), *[F.col(f"{f}_{j}").alias(f"b_{f}_{j}") for j in numbers for f in fields])
    h = F.when((head >= 0) & (head <= MOST_HEAD), head).otherwise(F.raise_error(F.lit(f"a head has 0 to {MOST_HEAD} turns")).cast("int"))
    conv = each.withColumn("base", base).withColumn("h", h).join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))).cast("int"))

    def at(name: str, place: Column, prefix: str = "") -> Column:
        out = F.lit(0)
        for j in numbers:
            out = F.when(place == j, F.col(f"{prefix}{name}_{j}")).otherwise(out)
        return out

    own = F.least("h", "n")
    for k, b in enumerate(bases):
        inverse = pow(b, -1, prime)
        factor = F.get(table_of(pow(inverse, i, prime) for i in range(MOST_HEAD + 1)), F.col("h") - F.col("k"))
        conv = conv.withColumn(f"f{k}", factor)
        conv = conv.withColumn(f"a{k}", F.pmod(at(f"s{k}", F.col("k"), "b_") - F.col(f"f{k}") * at(f"s{k}", own) % prime, F.lit(prime)))
    conv = stage(conv.select("conv_id", "base", "n", "h", "k", *[x for i in range(LANES) for x in (f"f{i}", f"a{i}", f"e{i}")], *[f"b_{f}_{j}" for j in numbers for f in fields]), "trie-conv")

    suffix = placed.join(conv.select("conv_id", "h", "k", *[x for i in range(LANES) for x in (f"f{i}", f"a{i}")]), "conv_id").filter("pos > h")
    here = [(F.col(f"a{i}") + F.col(f"f{i}") * F.col(f"s{i}")) % prime for i in range(LANES)]
    above = [F.pmod(x - F.col(f"f{i}") * F.col(f"t{i}") % prime, F.lit(prime)) for i, x in enumerate(here)]
    rows = suffix.select("conv_id", "part", (F.col("k") + F.col("pos") - F.col("h")).cast("long").alias("depth"), *packed(here, "k"), *packed(above, "p"), "h1", "h2", "words", F.col("conv_id").alias("turn_conv_id"), F.col("pos").cast("long").alias("turn_pos"))
    one = F.explode(F.expr("sequence(0, k)")).alias("depth")
    head_rows = conv.select("*", one)
    d = F.col("depth")
    here = [at(f"s{i}", d, "b_") for i in range(LANES)]
    above = [at(f"s{i}", d - 1, "b_") for i in range(LANES)]
    rows = rows.unionByName(head_rows.select("conv_id", F.lit(-1).alias("part"), d.cast("long").alias("depth"), *packed(here, "k"), *packed(above, "p"), *[at(x, d, "b_").cast("long").alias(x) for x in ("h1", "h2", "words")], F.when(d > 0, F.col("base")).alias("turn_conv_id"), F.when(d > 0, d.cast("long")).alias("turn_pos")))
    last = [F.when(F.col("n") > F.col("h"), (F.col(f"a{i}") + F.col(f"f{i}") * F.col(f"e{i}")) % prime).otherwise(at(f"s{i}", F.col("k"), "b_")) for i in range(LANES)]
    ends = conv.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("depth"), *packed(last, "k"))
    return stage(rows, "trie-prefixes"), ends


KEY = ["depth", "k1", "k2"]


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """One row a node, its members counted and verified to be one sequence."""
    same = [F.min(c).alias(f"min_{c}") for c in ("p1", "p2", "h1", "h2")] + [F.max(c).alias(f"max_{c}") for c in ("p1", "p2", "h1", "h2")]
    first = [F.min_by(c, "conv_id").alias(c) for c in ("part", "turn_conv_id", "turn_pos")]
    out = stage(prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *first, *same), "trie-nodes")
    if not out.filter(" or ".join(f"min_{c} <> max_{c}" for c in ("p1", "p2", "h1", "h2"))).isEmpty():
        raise Collision
    return out.select(*KEY, "conv_id", "n_convs", "words", "part", "turn_conv_id", "turn_pos", F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"))


def subtree_sums(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves and saved tokens below each node. Each node's own share is laid on
    its smallest member, at its depth; a member adds to a node what lies at or
    after that depth. So no level of the trie waits for the one below."""
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    own = nodes.select("conv_id", "part", *KEY, ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.lit(False).alias("member"))
    both = own.unionByName(prefixes.select("conv_id", "part", *KEY, F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("member")))
    parts = own.groupBy("conv_id", "part").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    parts = both.filter("member").select("conv_id", "part").distinct().join(parts, ["conv_id", "part"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("saved_later"), F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaf_later"))
    down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))  # rows of one depth together
    sums = both.withColumn("saved", F.sum("saved").over(down)).withColumn("leaf", F.sum("leaf").over(down)).filter("member").join(parts, ["conv_id", "part"])
    sums = sums.groupBy(*KEY).agg(F.sum(F.col("saved") + F.col("saved_later")).alias("saved_tokens"), F.sum(F.col("leaf") + F.col("leaf_later")).alias("n_leaves"))
    return nodes.join(sums, KEY)


def stream_sha256(batches):
    """Digest of the pieces of each key, which come in order."""
    import pyarrow as pa

    key, digest, out = None, None, []

    def done() -> None:
        out.append((*key, digest.hexdigest()))

    def rows():
        names = [*KEY, "ends_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], names)

    for b in batches:
        for d, k1, k2, piece in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            if (d, k1, k2) != key:
                if key is not None:
                    done()
                key, digest = (d, k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        if len(out) >= 10_000:
            yield rows()
            out.clear()
    if key is not None:
        done()
    if out:
        yield rows()


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node. Ids are sorted and joined within
    ranges first; a digest reads its pieces in order and keeps none of them."""
    dealt = stage(ends.repartitionByRange(*KEY, "conv_id").withColumn("part", F.spark_partition_id()), "trie-ends")
    pieces = dealt.groupBy("part", *KEY).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "piece")
    return ordered.mapInArrow(stream_sha256, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column, head: Column, seed: int = 0, tries: int = 4, prime: int = PRIME) -> DataFrame:
    """Nodes of the trie of rebuilt conversations; turns: conv_id, turn, role,
    text (further columns are ignored). base and head are expressions of
    conv_id: the conversation whose first head turns (0 to 3) replace one's own.

    Turns go by number, null first; equal numbers by role, then by content hash,
    so that reruns agree; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation. A missing
    base gives no head. No conversation, no node."""
    for attempt in range(tries):
        rng = random.Random(seed + attempt)
        bases = [rng.randrange(2, prime - 1) for _ in range(LANES)]
        rows = hashed(turns, seed + attempt)
        slim = stage(rows.select("conv_id", "turn", "role", "h1", "h2", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")), "trie-turns")
        try:
            verify_turns(rows, slim)
            prefixes, ends = rebuild(stage(place(slim, bases, prime), "trie-placed"), base, head, bases, prime)
            nodes = nodes_of(prefixes)
        except Collision:
            continue
        found = subtree_sums(prefixes, nodes).join(ends_digest(ends), KEY, "left")
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        empty = hashlib.sha256().hexdigest()
        return found.join(parents, ["depth", "p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "turn_conv_id", "turn_pos")
    raise RuntimeError(f"fingerprints collide under {tries} seeds")


def base_rule() -> Column:
    """The base of the registered query."""
    return F.col("conv_id") - F.col("conv_id") % 20


def head_rule() -> Column:
    """The head's turns in the registered query."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")


ORACLE = """
with crc(conv_id, v) as (
  select conv_id, list_reduce(list_concat([4294967295], flatten([[1000 + ord(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(cast(conv_id as varchar), '')])),
    lambda a, x: case when x >= 0 then xor(a, x - 1000) else xor(a >> 1, 3988292384 * (a & 1)) end)
  from (select distinct conv_id from conversations where conv_id is not null)),
h as (select conv_id, xor(v, 4294967295) % 4 as h from crc),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
        {'r': coalesce(role, ''), 't': coalesce(text, '')} as x from conversations where conv_id is not null),
c as (select conv_id, list(x order by pos) as xs from t group by conv_id),
rebuilt as (select c.conv_id, list_concat(coalesce(b.xs, [])[1:h.h], c.xs[h.h + 1:]) as xs
  from c join h using (conv_id) left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
member as (select conv_id, unnest(range(0, len(xs) + 1)) as depth, xs from rebuilt),
prefix as (select conv_id, depth, xs[1:depth] as key, len(xs) as n from member),
node as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from prefix group by key, depth),
child as (select key[1:depth - 1] as key, depth - 1 as depth, count(*) as n_children from node where depth > 0 group by 1, 2),
full_node as (select node.*, coalesce(n_children, 0) as n_children,
  case when node.depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(node.key[node.depth].t, '[^\\x20\\x09-\\x0D]+')) end as saved
  from node left join child on node.key = child.key and node.depth = child.depth),
up as (select key[1:d] as key, d as depth, sum(saved) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves
  from (select *, unnest(range(0, depth + 1)) as d from full_node) group by 1, 2)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(up.n_leaves as bigint) as n_leaves,
  cast(up.saved_tokens as bigint) as saved_tokens, f.ends_sha256
from full_node f join up on f.key = up.key and f.depth = up.depth
left join node p on p.key = f.key[1:f.depth - 1] and p.depth = f.depth - 1
"""
