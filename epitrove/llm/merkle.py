"""A Merkle manifest of a dataset: a root over all rows, and for each row the proof that it is in there.

Rows of one source are the leaves of its tree, ordered by id; every 16 nodes in a row, a run, are hashed to the
node above until one is left, the source's subroot. Subroots are the leaves of the top tree, ordered by source.
A run is one row of a table, with the digests of its members, and points to the run that its node above is a member of.

Proofs come from pointer jumping. A run holds a segment of the way up: the runs from itself to the one
before its pointer, and the place of each node in them. The table is joined with itself on the pointer: the segment
is continued by the one of the run pointed to, whose pointer takes over, so the distance doubles with each
join, until every leaf's run has reached the root. The 16 leaves of a run share its way, which so is moved
once; their own siblings differ only within it and are cut out at the end.

At distance d at most 16**d runs point to one, and hardly a run has so many below it: joins are ordinary ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.llm.ordering import running
from epitrove.plans.storage import pin

ARITY = 16
_TOP = -1
"""The tree of subroots; other trees have the number of their source."""


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its text; a null as ``-``."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _hex(digests: str) -> str:
    return f"lower(hex({digests}))"


def fold(digest: str, proof: str) -> Column:
    """The root that a leaf's digest leads to with the siblings of a proof."""
    low = _hex("substring(x.siblings, 1, 32 * x.place)")
    high = _hex("substring(x.siblings, 32 * x.place + 1)")
    return F.expr(f"aggregate({proof}, {digest}, (node, x) -> sha2(concat({low}, node, {high}), 256))")


def siblings(proof: str) -> Column:
    """The digests of a proof from the leaf to the root, left to right, as one text."""
    return F.expr(f"array_join(transform({proof}, x -> {_hex('x.siblings')}), '')")


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level over ``nodes`` (tree, pos, size, digest), and the nodes that are the last of their tree.

    ``size`` is the number of nodes of the tree at that level; ``most`` is the largest.
    """
    runs, last, level = [], [nodes.where("size = 1").select("tree", "digest")], 0
    while most > 1:
        members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda m: m["digest"]), "")
        grown = nodes.where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("run")).agg(F.max("size").alias("size"), members.alias("members"))
        grown = pin(grown.select("tree", F.lit(level).alias("level"), "run", "size", F.unhex("members").alias("members")))
        runs.append(grown)
        nodes = grown.select("tree", F.col("run").alias("pos"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"),
                             F.expr(f"sha2({_hex('members')}, 256)").alias("digest"))
        last.append(nodes.where("size = 1").select("tree", "digest"))
        most, level = -(-most // ARITY), level + 1
    return runs, last


def _all(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


def _up(runs: DataFrame, trees: int) -> DataFrame:
    """``runs`` with the run that holds the node above as ``up``, null for the last one, and the node's place in it."""
    inside = F.struct(F.col("tree"), (F.col("level") + 1).alias("level"), F.expr(f"run div {ARITY}").alias("run"))
    above = F.struct(F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.expr(f"tree div {ARITY}").alias("run"))
    up = F.when(F.col("size") > ARITY, inside)
    place = F.when(F.col("size") > ARITY, F.col("run") % ARITY)
    if trees > 1:
        outside = (F.col("size") <= ARITY) & (F.col("tree") != _TOP)
        up, place = up.when(outside, above), place.when(outside, F.col("tree") % ARITY)
    way = F.array(F.col("members"))
    places = F.when(place.isNull(), F.array().cast("array<int>")).otherwise(F.array(place.cast("int")))
    return runs.select(F.struct("tree", "level", "run").alias("at"), up.alias("up"), way.alias("way"), places.alias("places"))


def _jump(runs: DataFrame, height: int) -> DataFrame:
    """``at``, ``way``, ``places``: the runs on the way from each run to the root, and each node's place in the next."""
    distance = 1
    while distance < height:
        onward = runs.select(F.col("at").alias("up"), F.col("up").alias("next_up"), F.col("way").alias("next_way"), F.col("places").alias("next_places"))
        jumped = runs.where("up IS NOT NULL").join(onward, "up").select(
            "at", F.col("next_up").alias("up"), F.concat("way", "next_way").alias("way"), F.concat("places", "next_places").alias("places"))
        runs = pin(runs.where("up IS NULL").unionByName(jumped))
        distance *= 2
    return runs.select("at", "way", "places")


def _height(size: int) -> int:
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


_PROVED = {"proof": "array<struct<place: int, siblings: binary>>", "subroot": "string", "root": "string"}


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, leaf, …) with ``proof``, ``subroot`` and ``root``.

    ``leaf`` is a lower-case hexadecimal digest. ``proof`` lists, from the leaf upwards, the digests of the run's other members
    (32 bytes each, in order) and the node's place among them; ``fold`` leads from a leaf and its proof to the root.
    Leaves are ordered by doc_id within their source, nulls first; rows that share an id are
    ordered by digest, and equal rows are leaves of their own. A null source is a source, and the first. The only
    leaf of a source is its subroot, the only subroot the root. An empty table has no rows and no root. Other
    columns come along, except ``tree``, ``pos``, ``size``, ``proof``, ``subroot`` and ``root``, which are replaced.
    """
    leaves = leaves.drop("tree", "pos", "size", "proof", "subroot", "root")
    columns = leaves.columns
    numbered = running(leaves, ["source", "doc_id", "leaf"], {"__number": F.lit(1).cast("long")})
    sources = pin(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("size")))
    most, trees = sources.agg(F.max("size"), F.count(F.lit(1))).first()
    if not trees:
        return leaves.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in _PROVED.items()])
    sources = pin(running(sources, ["source"], {"tree": F.lit(1).cast("long"), "__first": F.col("size")}).withColumnRenamed("source", "__source"))
    numbered = numbered.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    numbered = pin(numbered.select(*columns, "tree", "size", (F.col("__number") - F.col("__first")).alias("pos")))

    runs, subroots = _grow(numbered.select("tree", "pos", "size", F.col("leaf").alias("digest")), most)
    top = _all(subroots).select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("size"), "digest")
    top_runs, roots = _grow(pin(top), trees)
    root = _all(roots).first()["digest"]
    proved = numbered.withColumn("__at", F.when(F.col("size") > 1, F.struct("tree", F.lit(0).alias("level"), F.expr(f"pos div {ARITY}").alias("run"))).otherwise(
        F.struct(F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.expr(f"tree div {ARITY}").alias("run"))))
    if runs or top_runs:
        ways = _jump(pin(_up(_all(runs + top_runs), trees)), _height(most) + _height(trees))
        proved = proved.join(ways.withColumnRenamed("at", "__at"), "__at", "left")
    else:
        proved = proved.withColumns({"way": F.array().cast("array<binary>"), "places": F.array().cast("array<int>")})
    own = F.when(F.col("size") > 1, F.col("pos") % ARITY).otherwise(F.col("tree") % ARITY).cast("int")
    proved = proved.withColumn("places", F.concat(F.array(own), "places"))
    # A digit of size - 1 in base 16 for each level of the source's tree.
    inside = "if(size > 1, length(hex(size - 1)), 0)"
    return proved.select(
        *columns,
        F.expr("""transform(coalesce(way, array()), (run, i) -> struct(places[i] AS place,
            concat(substring(run, 1, 32 * places[i]), substring(run, 32 * places[i] + 33)) AS siblings))""").alias("proof"),
        F.expr(f"coalesce({_hex(f'substring(get(way, {inside}), 32 * get(places, {inside}) + 1, 32)')}, '{root}')").alias("subroot"),
        F.lit(root).alias("root"))


def manifest_of(docs: DataFrame, fields: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """``manifest`` of the rows of ``docs`` (doc_id, source, …), each a leaf of ``fields`` in that order.

    ``more`` names further columns, made from those of ``docs``, to come along.
    """
    more = more or {}
    return manifest(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                                leaf([F.col(f"`{f}`") for f in fields]).alias("leaf"), *[c.alias(n) for n, c in more.items()]))
