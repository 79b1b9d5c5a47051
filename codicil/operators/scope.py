"""Who may see, reach and change what: predicates over joined rows of resources and principals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.sources.tables import spread

ADMIN, MANAGER, USER = "admin", "manager", "user"


def in_scope() -> Column:
    """Branch reach of principal `p_*` to a row, assignments aside: a row without a branch is for all of its organisation."""
    own = F.col("branch_id").isNull() | (F.col("branch_id") == F.col("p_branch_id"))
    return (F.col("organization_id") == F.col("p_organization_id")) & ((F.col("p_role") == ADMIN) | own)


def can_write() -> Column:
    """Who may place content at a scope: admins anywhere in their organisation, managers in their own branch."""
    own = (F.col("p_role") == MANAGER) & (F.col("branch_id") == F.col("p_branch_id"))
    return (F.col("organization_id") == F.col("p_organization_id")) & ((F.col("p_role") == ADMIN) | F.coalesce(own, F.lit(False)))


def principals_for(principals: DataFrame) -> DataFrame:
    return principals.select("user_id", *[F.col(c).alias(f"p_{c}") for c in ("organization_id", "branch_id", "role")])


def visible(resources: DataFrame, principals: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pairs of principals and resources they may see: admins see their organisation; managers what is organisation-wide
    or of their branch; users what is assigned to them and reaches them. No organisation, nothing.

    Users are driven by their assignments, not by all rows of their organisation.
    """
    p = principals_for(principals).filter("p_organization_id is not null")
    wide = p.filter(F.col("p_role").isin(ADMIN, MANAGER)).join(resources, F.col("p_organization_id") == resources["organization_id"]).filter(in_scope())
    mine = p.filter(F.col("p_role") == USER).join(assignments, "user_id").join(resources, "policy_id").filter(in_scope())
    names = ["user_id", *resources.columns]
    return wide.select(*names).unionByName(mine.select(*names))


def by_scope(resources: DataFrame) -> DataFrame:
    """Resources counted by (organisation, branch), with the smallest and largest policy: few rows, whatever there is of either side."""
    return resources.groupBy("organization_id", "branch_id").agg(F.count("*").alias("n"), F.min("policy_id").alias("low"), F.max("policy_id").alias("high"))


def visible_counts(resources: DataFrame, principals: DataFrame, assignments: DataFrame) -> DataFrame:
    """How many resources each principal may see, and the smallest and largest of them: the counts of `visible` without its pairs.

    Admins and managers meet the scopes of their organisation, not its resources; users their assignments.
    """
    p = principals_for(principals).filter("p_organization_id is not null")
    wide = p.filter(F.col("p_role").isin(ADMIN, MANAGER)).join(by_scope(resources), F.col("p_organization_id") == F.col("organization_id")).filter(in_scope())
    mine = p.filter(F.col("p_role") == USER).join(assignments, "user_id").join(resources, "policy_id").filter(in_scope())
    every = wide.select("user_id", "n", "low", "high").unionByName(mine.select("user_id", F.lit(1).cast("long").alias("n"), F.col("policy_id").alias("low"), F.col("policy_id").alias("high")))
    return every.groupBy("user_id").agg(F.sum("n").alias("n_visible"), F.min("low").alias("first_policy"), F.max("high").alias("last_policy"))


def write_counts(resources: DataFrame, principals: DataFrame) -> DataFrame:
    """How many resources each principal's scope reaches, and at how many of these scopes they may place content."""
    met = principals_for(principals).join(by_scope(resources), F.col("p_organization_id") == F.col("organization_id")).filter(in_scope())
    return met.groupBy("user_id").agg(F.sum("n").alias("reached"), F.sum(F.when(can_write(), F.col("n")).otherwise(0)).alias("writable"))


def assignable(policies: DataFrame, users: DataFrame, assignments: DataFrame, search: str = "", limit: int = 200) -> DataFrame:
    """Users that each policy's scope reaches, by name, with a flag for those who have it; at most `limit` for each policy.

    The first `limit` users are found once for each scope, not for each policy.
    """
    found = users.filter(F.contains(F.lower("name"), F.lit(search.lower()))).filter(F.col("role") == USER).select("user_id", "name", "organization_id", F.col("branch_id").alias("home"))
    first = lambda *by: found.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("name", "user_id"))).filter(F.col("k") <= limit)
    rows = policies.select("policy_id", "organization_id", "branch_id")
    near = rows.filter("branch_id is not null").join(first("organization_id", "home").withColumnRenamed("home", "branch_id"), ["organization_id", "branch_id"])
    wide = rows.filter("branch_id is null").join(first("organization_id"), "organization_id")
    best = near.select("policy_id", "user_id", "name").unionByName(wide.select("policy_id", "user_id", "name"))
    flag = assignments.select("policy_id", "user_id").distinct().withColumn("assigned", F.lit(True))
    return best.join(flag, ["policy_id", "user_id"], "left").select("policy_id", "user_id", "name", F.coalesce("assigned", F.lit(False)).alias("assigned"))


def audience(policies: DataFrame, users: DataFrame, assignments: DataFrame, slices: int = 16) -> DataFrame:
    """Whom news of a policy reaches: users it is assigned to, and managers of its scope. Managers meet the policies of their branch,
    and apart from these the few that are for a whole organisation.

    Pairs of policies and users with one row each cannot come twice, so they are not shuffled to be made distinct; the others are. A
    scope's policies are dealt into `slices`, so that no task has all pairs of a scope.
    """
    rows = policies.select("policy_id", "organization_id", "branch_id").distinct().withColumn("n", F.count("*").over(Window.partitionBy("policy_id")))
    people = users.filter(F.col("role").isin(USER, MANAGER)).select("user_id", "role", "organization_id", "branch_id").distinct().withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    given = assignments.select("policy_id", "user_id").distinct()
    dealt, every = F.pmod(F.xxhash64("policy_id"), F.lit(slices)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")

    def reached(p: DataFrame, u: DataFrame) -> DataFrame:
        mine = spread(given).join(u.filter(F.col("role") == USER).select("user_id"), "user_id").join(p.select("policy_id"), "policy_id").select("policy_id", "user_id")
        managers = u.filter(F.col("role") == MANAGER).select("user_id", "organization_id", "branch_id", every)
        near = p.filter("branch_id is not null").withColumn("slice", dealt).join(spread(managers), ["organization_id", "branch_id", "slice"])
        wide = p.filter("branch_id is null").withColumn("slice", dealt).join(spread(managers.drop("branch_id")), ["organization_id", "slice"])
        return mine.unionByName(near.select("policy_id", "user_id")).unionByName(wide.select("policy_id", "user_id"))

    often = reached(rows.filter("n > 1"), people).unionByName(reached(rows.filter("n = 1"), people.filter("n > 1")))
    return reached(rows.filter("n = 1"), people.filter("n = 1")).unionByName(often.distinct())
