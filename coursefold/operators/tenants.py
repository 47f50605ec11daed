"""Tenants: the life of a row, scoped reads, registration and erasure, as folds and joins over appended events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import materialize
from .graph import components

#: Fixed value: active children that a family may hold.
MOST_CHILDREN = 6


def lifecycle(events: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Rows that exist, with ``status`` active or deleting and the other columns of the event that added them.

    ``events``: key, seq, event (added, deleting, removed) and what an added row holds. A row is absent until it is
    added; adding it again changes nothing; deleting hides it, and removing ends it, after which it can be added anew.
    Deleting or removing what is not there is fine.
    """
    rest = [c for c in events.columns if c not in (*key, seq, "event")]
    is_ = lambda e: F.when(F.col("event") == e, F.col(seq))
    ended = F.max(is_("removed")).over(Window.partitionBy(*key))
    since = events.withColumn("_ended", ended).where(F.col("_ended").isNull() | (F.col(seq) > F.col("_ended")))
    added = F.min(F.when(F.col("event") == "added", F.struct(F.col(seq).alias("_seq"), *rest))).alias("_added")
    rows = since.groupBy(*key).agg(added, F.max(is_("deleting")).alias("_deleting")).where("_added is not null")
    status = F.when(F.col("_deleting") > F.col("_added._seq"), "deleting").otherwise("active")
    return rows.select(*key, *(F.col(f"_added.{c}").alias(c) for c in rest), status.alias("status"))


def visible(rows: DataFrame) -> DataFrame:
    """What readers see: a deleting row is hidden at once, though it is still there."""
    return rows.where("status = 'active'")


def in_place(rows: DataFrame, key: str, position: str, id_: str) -> DataFrame:
    """Each key's visible rows as one list in order of position, ids breaking ties: a family's few children."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(position, id_))), lambda x: x[id_])
    return visible(rows).groupBy(key).agg(listed.alias("children"))


def others(rows: DataFrame, picked: DataFrame, key: str, id_: str) -> DataFrame:
    """Each key's rows but the picked one; all of them where none is picked."""
    return rows.join(picked.select(key, id_).distinct(), [key, id_], "left_anti")


def admit(adds: DataFrame, current: DataFrame, families: DataFrame, key: str, seq: str = "seq", most: int = MOST_CHILDREN) -> DataFrame:
    """``adds`` with ``reason`` (null if added) and ``position``, one past all positions, deleting rows included.

    Only active rows count against ``most``. A family that is not there comes before a full one.
    """
    held = current.groupBy(key).agg(F.count_if(F.col("status") == "active").alias("_active"), F.max("position").alias("_top"))
    known = families.select(key).distinct().withColumn("_known", F.lit(True))
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    rows = adds.withColumn("_n", n).join(held, key, "left").join(known, key, "left")
    reason = F.when(F.col("_known").isNull(), "family-not-found").when(F.coalesce("_active", F.lit(0)) + F.col("_n") > most, "child-limit-reached")
    rows = rows.withColumn("reason", reason)
    position = F.when(F.col("reason").isNull(), (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("long"))
    return rows.withColumn("position", position).drop("_n", "_active", "_top", "_known")


def edit(current: DataFrame, edits: DataFrame, key: list[str], editable: list[str]) -> DataFrame:
    """``current`` with each edit's values in the ``editable`` columns; a null sent is a value cleared.

    All other columns stay. A deleting row is not edited.
    """
    sent = edits.select(*key, *(F.col(c).alias(f"_{c}") for c in editable), F.lit(True).alias("_sent"))
    joined = current.join(sent, key, "left").withColumn("_sent", F.coalesce("_sent", F.lit(False)) & (F.col("status") == "active"))
    return joined.select(*(F.when(F.col("_sent"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in editable else F.col(c) for c in current.columns))


def refused_edits(current: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Keys of edits that changed nothing, and why."""
    joined = edits.select(*key).join(current.select(*key, F.col("status").alias("_s")), key, "left")
    reason = F.when(F.col("_s").isNull(), "child-not-found").when(F.col("_s") == "deleting", "child-deleting")
    return joined.select(*key, reason.alias("reason")).where("reason is not null")


def chain(rows: DataFrame, *owners: tuple[DataFrame, str, str]) -> DataFrame:
    """``rows`` with the columns of what owns them, of what owns that, and so on: each step is (owners, the column that names one, their key)."""
    for owner, names, key in owners:
        rows = rows.join(owner, F.col(names) == F.col(key))
    return rows


def within(rows: DataFrame, owners: DataFrame, names: str, key: str) -> DataFrame:
    """The rows whose owner is one of ``owners``."""
    return rows.join(owners.select(F.col(key).alias(names)), names, "left_semi")


def scoped(table: DataFrame, callers: DataFrame, caller: str, tenant: str) -> DataFrame:
    """Every row of ``table`` that a caller may read, with the caller: ``callers`` (caller, tenant) says whose tenant is whose."""
    return table.join(callers.select(caller, tenant), tenant)


def scoped_lookup(requests: DataFrame, table: DataFrame, callers: DataFrame, caller: str, tenant: str, id_: str) -> DataFrame:
    """``requests`` (caller, id and more) with ``found`` and ``reason``: a foreign id is as unknown as one that does not exist."""
    known = requests.join(callers.select(caller, tenant), caller, "left")
    there = table.select(tenant, id_).distinct().withColumn("_there", F.lit(True))
    found = F.col("_there").isNotNull()
    reason = F.when(F.col(tenant).isNull(), "not-registered").when(~found, "not-found")
    return known.join(there, [tenant, id_], "left").select(*requests.columns, found.alias("found"), reason.alias("reason"))


def own_profiles(members: DataFrame, profiles: DataFrame, user: str, tenant: str) -> DataFrame:
    """Profiles of the members' users that still point at the same tenant: who has registered again since is left out."""
    return profiles.join(members.select(user, tenant).distinct(), [user, tenant], "left_semi")


def erase(gone: DataFrame, tenant: str, user: str, members: DataFrame, profiles: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of profiles, members and all ``tables`` once the tenants in ``gone`` are erased."""
    gone = gone.select(tenant).distinct()
    ended = own_profiles(members.join(gone, tenant, "left_semi"), profiles, user, tenant)
    left = {name: t.join(gone, tenant, "left_anti") for name, t in {**tables, "members": members}.items()}
    return left | {"profiles": profiles.join(ended.select(user), user, "left_anti")}


def register(requests: DataFrame, uid: str = "uid", family: str = "family_id", seq: str = "seq", rounds: int = 2) -> DataFrame:
    """``requests`` with ``result``: registered, already-registered or family-id-taken, as if they came one by one.

    A user and a family id each register once; a refused request takes neither, so its user can try again under
    another id. First come ``rounds`` in which the requests that are first both for their user and their family among those undecided win
    and rule out the others of both. What refusals that hang on each other leave undecided is split into the connected components of its users
    and families, which have nothing to do with each other, and each component's requests pass one by one, in order, through one task that
    keeps the users and families that have won in it. So the number of jobs does not follow the length of a chain but its logarithm.
    """
    left = materialize(requests.select(uid, family, seq))
    won = left.limit(0)
    for _ in range(rounds):
        first = left.groupBy(uid).agg(F.min(seq).alias(seq)).join(left.groupBy(family).agg(F.min(seq).alias(seq)), seq).select(uid, family, seq)
        first = materialize(first)
        won = won.unionByName(first)
        left = materialize(left.join(first.select(uid), uid, "left_anti").join(first.select(family), family, "left_anti"))
    if not left.isEmpty():
        won = won.unionByName(materialize(_one_by_one(left, uid, family, seq)))
    won = materialize(won)
    rows = requests.join(won.select(uid, F.col(seq).alias("_u")), uid, "left").join(won.select(family, F.col(seq).alias("_f")), family, "left")
    result = F.when(F.col("_u") == F.col(seq), "registered").when(F.col("_u") < F.col(seq), "already-registered").otherwise("family-id-taken")
    return rows.select(*requests.columns, result.alias("result"))


def _one_by_one(left: DataFrame, uid: str, family: str, seq: str) -> DataFrame:
    """The requests of ``left`` that win, decided in order within each component of users and families."""
    # users and families are nodes of two kinds
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    ends = left.select(node(0, uid).alias("a"), node(1, family).alias("b"))
    of = components(ends).select(F.col("node.id").alias("_user"), F.col("component").alias("_component")).where("node.kind = 0")
    parted = left.withColumn("_user", F.col(uid).cast("string")).join(of, "_user").withColumn("_c", F.xxhash64("_component"))
    parted = parted.select(uid, family, seq, "_c").repartition("_c").sortWithinPartitions("_c", seq)

    def run(batches):
        import pyarrow as pa

        now, users, families = None, set(), set()
        for b in batches:
            keep = []
            for u, f, _, c in zip(*(x.to_pylist() for x in b.columns)):
                if c != now:
                    now, users, families = c, set(), set()
                if ok := u not in users and f not in families:
                    users.add(u)
                    families.add(f)
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return parted.mapInArrow(run, parted.schema).drop("_c")


def registered_rows(registered: DataFrame, children: str, family: str = "family_id") -> DataFrame:
    """One active child row for each entry of the ``children`` list of a won request, numbered by its place from 0."""
    won = registered.where("result = 'registered'")
    return won.select(family, F.posexplode(children).alias("position", "child")).select(family, "position", "child.*", F.lit("active").alias("status"))


def still_active(work: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Work whose row is active now: asked before a slow step, and again after it, when the rest is undone."""
    return work.join(visible(rows).select(*key), key, "left_semi")


def caller(claims: Column) -> Column:
    """Uid, name, email and email_verified from a map of token claims; a blank subject is nobody: null."""
    text = lambda name: F.coalesce(claims[name], F.lit(""))
    verified = F.coalesce(F.lower(F.trim(claims["email_verified"])) == "true", F.lit(False))
    who = F.struct(claims["sub"].alias("uid"), text("name").alias("name"), text("email").alias("email"), verified.alias("email_verified"))
    return F.when(F.trim(claims["sub"]) != "", who)
